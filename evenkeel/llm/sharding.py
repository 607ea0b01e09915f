"""Shards of near equal size by longest-processing-time scheduling.

Rows that must stay together form a group. Groups in descending order of size go to the least
loaded shard, which a heap gives. One heap over all groups would pass them all through the driver,
so it is used twice:

1. Groups of more than 1 / ITEMS of the whole are items of their own; there are fewer than ITEMS.
   All others are packed by the heap of the task that holds them into bins, together about
   ITEMS of them. A task gets its groups sorted and keeps only the heap.
2. The driver's heap deals these items, largest first, to the shards.

With up to ITEMS distinct items (and no smaller groups) this is the plain schedule. In general no shard exceeds
the least loaded one by more than the last item it got, 1 / ITEMS of the whole unless that item is a
group which alone is larger.

Rows are written to one folder per shard. They move once, by the key of their group; rows of large
groups, whose shard is broadcast, are spread over all tasks. A shard's rows are numbered without gaps
by an index that has one entry for each task and shard.

Defined results: rows with the same group columns are one group, null equals null; a null text has
size 16 in the query and is one group with the empty text; an empty table gives no rows; with fewer
groups than shards the later shards stay empty. Input columns may have any names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evenkeel.llm.common import column, lookup
from evenkeel.session import fresh_path, staged

ITEMS = 100_000  # bounds what the driver schedules; the shards' sizes differ by about 1 / ITEMS of the whole


def schedule(sizes: list[int], bins: int) -> list[int]:
    """The bin of each of `sizes`, which are taken in the order given."""
    heap = [(0, b) for b in range(bins)]
    placed = []
    for size in sizes:
        load, b = heap[0]
        heapq.heapreplace(heap, (load + size, b))
        placed.append(b)
    return placed


def _packed(bins: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() * bins
        heap = [(0, b) for b in range(first, first + bins)]
        for batch in batches:
            placed = np.empty(batch.num_rows, np.int64)
            for i, size in enumerate(column(batch, "size").to_pylist()):
                load, placed[i] = heap[0]
                heapq.heapreplace(heap, (load + size, int(placed[i])))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "key"), column(batch, "size"), pa.array(placed)], names=["key", "size", "bin"]
            )

    return pack


def group_shards(groups: DataFrame, shards: int, items: int = ITEMS) -> tuple[DataFrame, DataFrame]:
    """(large, small): key and shard of each row of (key, size), which must be files.

    `large` has fewer than `items` rows. The keys are 64-bit and distinct, the sizes not negative.
    """
    spark = groups.sparkSession
    total = int(groups.agg(F.sum("size")).first()[0] or 0)
    cut = total // items
    large = groups.where(F.col("size") > cut).collect()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = groups.where(F.col("size") <= cut).repartition(parts, "key").sortWithinPartitions(F.desc("size"), "key")
    small = staged(ordered.mapInArrow(_packed(-(-items // parts)), "key bigint, size bigint, bin bigint"), "shard-bins")
    bins = small.groupBy("bin").agg(F.sum("size").alias("size")).collect()  # at most items + parts

    todo = [(-r["size"], 0, r["key"]) for r in large] + [(-r["size"], 1, r["bin"]) for r in bins]
    todo.sort()
    placed = schedule([-size for size, _, _ in todo], shards)
    of_kind = [[(key, s) for (_, k, key), s in zip(todo, placed, strict=True) if k == kind] for kind in (0, 1)]
    found = spark.createDataFrame(of_kind[0], "key bigint, shard int")
    binned = spark.createDataFrame(of_kind[1], "bin bigint, shard int")
    return found, small.join(F.broadcast(binned), "bin").select("key", "shard")


def write(docs: DataFrame, shards: int, together: list[Column], size: Column, path: str | None = None, items: int = ITEMS) -> str:
    """Write all rows of `docs` to shards 0 to `shards` - 1; the folder they are in.

    Rows for which all of `together` are equal get the same shard. A chance agreement of the hash
    that stands for them only lets two groups stay together.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "shards")
    keyed = docs.select(F.struct("*").alias("doc"), F.xxhash64(*together).alias("key"), size.cast("bigint").alias("size"))
    groups = staged(keyed.groupBy("key").agg(F.sum("size").alias("size")), "shard-groups")
    large, small = group_shards(groups, shards, items)
    placed = lookup(keyed.select("doc", "key"), "key", large, small).withColumn("part", F.spark_partition_id())
    numbered = placed.sortWithinPartitions("shard", "key").withColumn("at", F.monotonically_increasing_id())
    numbered.select("doc", "part", "at", "shard").write.partitionBy("shard").parquet(f"{path}/rows")

    rows = spark.read.parquet(f"{path}/rows") if groups.limit(1).count() else None
    if rows is None:  # Spark writes no folder of a shard for an empty table
        numbered.select("doc", "part", "at", "shard").limit(0).write.mode("overwrite").parquet(f"{path}/rows")
        rows = spark.read.parquet(f"{path}/rows")
    spans = rows.groupBy("shard", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).write.parquet(f"{path}/index")
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc (the row as it was given), shard and slot of every row; slots count from 0 in each shard."""
    rows, index = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/index")
    spans = index.select("shard", "part", "first", "before")
    return rows.join(spans, ["shard", "part"]).select(
        "doc", F.col("shard").cast("int").alias("shard"), (F.col("at") - F.col("first") + F.col("before")).alias("slot")
    )


def text_shards(docs: DataFrame, shards: int, text: str = "text", items: int = ITEMS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document, from the files written.

    The law is `bytes`: sizes (UTF-8 bytes and 16 for each document) are near equal, equal texts stay together.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    path = write(docs, shards, [whole], F.octet_length(whole) + 16, items=items)
    stored = F.coalesce(F.col("doc")[text], F.lit(""))
    return read(docs.sparkSession, path).select(
        F.col("doc.doc_id").alias("doc_id"),
        (F.octet_length(stored) + 16).cast("bigint").alias("size"),
        F.crc32(stored.cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
