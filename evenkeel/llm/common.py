"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.session import staged

BATCH_BYTES = 8 << 20  # texts that a task handles at once, unless one row alone is longer


ROWS_PER_BATCH = "1000"  # Spark's default of 10,000 whole texts would not be bounded memory


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, and send them small batches.

    On a cluster that does not share that folder, install the package or send it with
    --py-files. A batch size that the session sets itself stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, ROWS_PER_BATCH)
    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if home not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (known, home) if x)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of about `limit` bytes of text, so that memory stays bounded."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        rows = max(1, batch.num_rows)
        step = max(1, int(rows * limit / max(limit, column.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def strings(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A text column as a list, null as the empty text."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def lookup(rows: DataFrame, key: str, heavy: DataFrame, rest: DataFrame) -> DataFrame:
    """`rows` with the other columns that `heavy`, or else `rest`, has for their `key`; null where neither has it.

    `heavy` holds the keys that many rows may have. It is broadcast, so the caller bounds its size. Rows found
    there are spread over all tasks of the join with `rest`; no hot key meets in one task.
    """
    values = [c for c in heavy.columns if c != key]
    known = heavy.select(F.col(key), F.struct(*values).alias("_heavy"))
    found = rows.join(F.broadcast(known), key, "left")
    spread = F.when(F.col("_heavy").isNull(), 0).otherwise(1 + F.monotonically_increasing_id() % 1_000_003)
    other = rest.select(F.col(key), F.struct(*values).alias("_rest"), F.lit(0).cast("bigint").alias("_spread"))
    joined = found.withColumn("_spread", spread).join(other, [key, "_spread"], "left")
    return joined.select(*rows.columns, *[F.coalesce(F.col("_heavy")[v], F.col("_rest")[v]).alias(v) for v in values])


FILTER_BITS = 26  # of a filter of hashes: at most 2 ** 20 rows of 64 bits are broadcast, whatever the input


def bit_filter(hashes: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """word and bits: a bit for the beginning of every 64-bit hash in the one column of `hashes`, written out."""
    place = F.shiftrightunsigned(F.col(hashes.columns[0]), 64 - bits)
    one = F.expr(f"shiftleft(1L, CAST(shiftrightunsigned({hashes.columns[0]}, {64 - bits}) & 63 AS INT))")
    words = hashes.select(F.shiftright(place, 6).alias("word"), one.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    return staged(words, "bit-filter", few_files=True)


def with_bit(rows: DataFrame, hashed: str, words: DataFrame, name: str, bits: int = FILTER_BITS) -> DataFrame:
    """`rows` with `name`: whether `words` has the bit of the hash in the column `hashed`.

    True for every hash that the filter was made of, and for others with a share that grows with their number: a
    hundredth of all rows at 10^6 hashes. So what is looked up exactly afterwards is few rows, and others do not move.
    """
    place = F.shiftrightunsigned(F.col(hashed), 64 - bits)
    found = rows.withColumn("_word", F.shiftright(place, 6)).join(
        F.broadcast(words.select(F.col("word").alias("_word"), F.col("bits").alias("_bits"))), "_word", "left"
    )
    bit = F.getbit("_bits", (F.shiftrightunsigned(F.col(hashed), 64 - bits).bitwiseAND(F.lit(63))).cast("int"))
    return found.withColumn(name, F.coalesce(bit, F.lit(0)) == 1).drop("_word", "_bits")
