"""Writing results, differences and advice for other tools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.text import fixed

# fixed values: columns of the exported tables
CSV_SUMMARY = (
    "source_table STRING, target_table STRING, status STRING, schema_match BOOLEAN, source_rows BIGINT, "
    "target_rows BIGINT, matching_rows BIGINT, different_rows BIGINT, source_only BIGINT, target_only BIGINT, "
    "match_percentage DOUBLE"
)


def csv_summary(results: DataFrame) -> DataFrame:
    return results.select(
        "source_table",
        "target_table",
        "status",
        "schema_match",
        F.col("source_row_count").alias("source_rows"),
        F.col("target_row_count").alias("target_rows"),
        "matching_rows",
        "different_rows",
        F.col("source_only_rows").alias("source_only"),
        F.col("target_only_rows").alias("target_only"),
        "match_percentage",
        *[c for c in ("duration_seconds",) if c in results.columns],
    )


def write_csv(results: DataFrame, schema_differences: DataFrame | None, folder: str) -> list[str]:
    """`summary` and, if given, `schema_differences` as CSV with a header. Returns the paths."""
    written = [f"{folder}/summary"]
    csv_summary(results).write.option("header", True).csv(written[0])
    if schema_differences is not None:
        written.append(f"{folder}/schema_differences")
        schema_differences.select(
            F.col("table_name").alias("table"),
            F.col("difference_type").alias("type"),
            *[F.coalesce(c, F.lit("")).alias(n) for c, n in (("column_name", "column"), ("source_value", "source"), ("target_value", "target"))],
            "description",
        ).write.option("header", True).csv(written[1])
    return written


def json_results(
    results: DataFrame, schema_differences: DataFrame | None = None, data_difference_counts: DataFrame | None = None
) -> DataFrame:
    """Results with their schema differences nested and the number of data differences.

    `schema_differences` and `data_difference_counts` name the table in `table_name`; a table
    has at most as many schema differences as columns, so the list stays small.
    """
    entry = F.struct(
        F.col("column_name").alias("column"),
        F.col("difference_type").alias("type"),
        F.col("source_value").alias("source"),
        F.col("target_value").alias("target"),
        "description",
    )
    document = results
    if schema_differences is not None:
        nested = schema_differences.groupBy(F.col("table_name").alias("source_table")).agg(
            F.array_sort(F.collect_list(entry)).alias("schema_differences")
        )
        document = document.join(nested, "source_table", "left")
    else:
        document = document.withColumn("schema_differences", F.lit(None))
    if data_difference_counts is not None:
        counts = data_difference_counts.select(
            F.col("table_name").alias("source_table"), F.col("data_differences_count").cast("long")
        )
        document = document.join(counts, "source_table", "left")
    else:
        document = document.withColumn("data_differences_count", F.lit(0).cast("long"))
    element = "array<struct<column:string,type:string,source:string,target:string,description:string>>"
    return document.withColumn(
        "schema_differences", F.coalesce(F.col("schema_differences").cast(element), F.array().cast(element))
    ).withColumn("data_differences_count", F.coalesce("data_differences_count", F.lit(0).cast("long")))


def write_json(document: DataFrame, folder: str, exported_at: str) -> None:
    """One JSON line per result in `results`, and date and count in `envelope`."""
    document.write.option("ignoreNullFields", False).json(f"{folder}/results")
    written = document.sparkSession.read.text(f"{folder}/results")  # counted from the files, so the run is computed once
    written.agg(F.count("*").alias("total_comparisons")).select(
        F.lit(exported_at).alias("export_date"), "total_comparisons"
    ).write.json(f"{folder}/envelope")


def recommendation_table(advice: DataFrame) -> DataFrame:
    """Advice on codecs with display names (fixed values) and rounded sizes."""
    return advice.select(
        F.col("table_name").alias("Table"),
        F.col("current_codec").alias("Current Compression"),
        F.col("recommended_codec").alias("Recommended"),
        fixed(F.col("current_size_mb"), 2).alias("Current Size (MB)"),
        fixed(F.col("estimated_size_mb"), 2).alias("Estimated Size (MB)"),
        fixed(F.col("estimated_savings_mb"), 2).alias("Savings (MB)"),
        F.concat(fixed(F.col("estimated_savings_percent"), 1), F.lit("%")).alias("Savings %"),
        F.col("priority").alias("Priority"),
        F.col("reason").alias("Reason"),
    )


def write_recommendations(advice: DataFrame, folder: str, format: str = "csv") -> None:
    """Advice as csv or json; other formats are an error."""
    if format not in ("csv", "json"):
        raise ValueError(f"unsupported export format: {format}")
    writer = recommendation_table(advice).write
    (writer.option("header", True) if format == "csv" else writer).format(format).save(folder)
