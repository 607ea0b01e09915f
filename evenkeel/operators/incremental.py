"""Comparing two loads of different age: both sides are cut at the lower of their last dates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions.columns import field_type, ref


def date_columns(df: DataFrame) -> list[str]:
    """Names of the date and timestamp columns, sorted."""
    kinds = (T.DateType, T.TimestampType, T.TimestampNTZType)
    return sorted(f.name for f in df.schema.fields if isinstance(f.dataType, kinds))


def incremental_cutoff(source: DataFrame, target: DataFrame, column: str) -> DataFrame:
    """One row: the last date per side and the cutoff, which is NULL when none is needed."""

    def last_of(df: DataFrame, name: str, other: str) -> DataFrame:
        """One row; a plain MAX, which a database or file statistics can answer."""
        return df.agg(F.max(ref(column)).alias(name)).withColumn(other, F.lit(None))

    sides = last_of(source, "source_max", "target_max").unionByName(last_of(target, "target_max", "source_max"))
    last = sides.agg(F.max("source_max").alias("source_max"), F.max("target_max").alias("target_max"))
    needed = F.col("source_max") != F.col("target_max")
    return last.withColumn("cutoff", F.when(needed, F.least("source_max", "target_max")))


def cut(df: DataFrame, column: str, cutoff) -> DataFrame:
    """Rows up to the cutoff and rows without a date; all rows without a cutoff. The literal has
    the column's type, so the predicate is pushed into the scan."""
    if cutoff is None:
        return df
    return df.where((ref(column) <= F.lit(str(cutoff)).cast(field_type(df, column))) | ref(column).isNull())


def incremental_pair(source: DataFrame, target: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Both sides cut for a fair comparison. Reads the one-row cutoff."""
    cutoff = incremental_cutoff(source, target, column).select(F.col("cutoff").cast("string")).first()[0]
    return cut(source, column, cutoff), cut(target, column, cutoff)
