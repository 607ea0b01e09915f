"""Report tables: the summary of a run and its differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.ranking import top_per_group
from evenkeel.functions.text import fixed, format_number


def comparison_report(results: DataFrame) -> DataFrame:
    """The summary table of a run with formatted numbers."""
    counts = {
        "source_rows": "source_row_count",
        "target_rows": "target_row_count",
        "matching_rows": "matching_rows",
        "different_rows": "different_rows",
        "source_only": "source_only_rows",
        "target_only": "target_only_rows",
    }
    return results.select(
        "source_table",
        "target_table",
        "status",
        "schema_match",
        *[format_number(F.col(c)).alias(n) for n, c in counts.items()],
        F.concat(fixed(F.col("match_percentage"), 2), F.lit("%")).alias("match_percentage"),
        *[fixed(F.col(c), 2).alias(c) for c in ("duration_seconds",) if c in results.columns],
        "summary",
    )


def difference_report(schema_differences: DataFrame, data_differences: DataFrame, shown: int | None = None) -> DataFrame:
    """All schema differences and all data differences, or the first `shown` of each table."""
    schema_rows = schema_differences.select(
        "table_name",
        F.lit("schema").alias("section"),
        F.lit("").alias("key_display"),
        F.coalesce("column_name", F.lit("")).alias("column_name"),
        F.coalesce("source_value", F.lit("")).alias("source_value"),
        F.coalesce("target_value", F.lit("")).alias("target_value"),
    )
    order = [F.col("key_display"), F.col("column_name")]
    first = data_differences.select("table_name", "key_display", "column_name", "source_value", "target_value")
    if shown is not None:
        first = top_per_group(first, ["table_name"], order, shown)
    data_rows = first.select(
        "table_name",
        F.lit("data").alias("section"),
        "key_display",
        F.coalesce("column_name", F.lit("")).alias("column_name"),
        F.coalesce("source_value", F.lit("")).alias("source_value"),
        F.coalesce("target_value", F.lit("")).alias("target_value"),
    )
    return schema_rows.unionByName(data_rows)
