"""Table reconciliation and workload analytics on PySpark.

Every operator is a function from DataFrames to a DataFrame. Results are lazy unless a
docstring says that a step is written to the shared folder first.
"""
