"""Ranks and per-group limits that do not gather a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.functions.columns import ref
from evenkeel.session import staged


def with_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Adds the 1-based position in a total order.

    An unpartitioned window would move every row to one task. Instead rows are
    range-partitioned and numbered inside their range; the sizes of the lower ranges, one
    row per range, are added. The range of each row is written out when this is called, so that both steps see
    the same ranges. `order` must be unique, or ties get an arbitrary order.
    """
    ranged = staged(
        df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges"
    )
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    below = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_below"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return (
        ranged.withColumn("_inside", inside)
        .join(F.broadcast(offsets), "_range")
        .withColumn(name, (F.col("_inside") + F.col("_below")).cast("long"))
        .drop("_range", "_inside", "_below")
    )


GROUP_LIMIT = 1000  # Spark's own limit up to which a rank filter is applied in every task before the shuffle


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first `n` rows of each group with their position.

    Up to GROUP_LIMIT rows, Spark keeps the first `n` of a group in every task, so even a group
    with a third of all rows moves little. Above it, groups are split into as many parts as
    there are shuffle partitions; each part keeps its first `n`, and only those meet.
    """
    keys = [ref(c) for c in group]
    if n <= GROUP_LIMIT:
        position = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return df.withColumn(name, position).where(F.col(name) <= n).withColumn(name, F.col(name).cast("long"))
    salts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[ref(c) for c in df.columns]), F.lit(salts)))
    part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    kept = salted.withColumn("_part", F.row_number().over(part)).where(F.col("_part") <= n).drop("_part", "_salt")
    whole = Window.partitionBy(*keys).orderBy(*order)
    return kept.withColumn(name, F.row_number().over(whole).cast("long")).where(F.col(name) <= n)
