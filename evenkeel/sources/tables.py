"""Reading tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from evenkeel.functions.columns import ref


def table(spark: SparkSession, folder: str, name: str, schema: str | None = None) -> DataFrame:
    """One parquet table of a folder of `<name>.parquet` tables. A declared schema saves the
    job that would read it from a file footer."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{folder}/{name}.parquet")


def scan(
    df: DataFrame,
    columns: list[str] | None = None,
    where: Column | str | None = None,
    order_by: list[str | Column] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Projection, predicate, order and limit of one table; all of it reaches the scan.

    A limit without an order is taken in the order of the projected columns, so that the
    answer does not depend on file layout.
    """
    if where is not None:
        df = df.where(where)
    if columns:
        df = df.select(*[ref(c) for c in columns])
    if limit is not None and not order_by:
        order_by = df.columns
    if order_by:
        df = df.orderBy(*[ref(c) if isinstance(c, str) else c for c in order_by])
    return df.limit(limit) if limit is not None else df
