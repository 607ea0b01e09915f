"""Digests of hash buckets of the key, as a tree, and comparisons that read only buckets which differ.

Level 0 is the whole table; a bucket of level l is told by the first l hexadecimal digits of a hash of the
key and has 16 buckets below it. A digest holds the row count and order-insensitive sums of row hashes, so a
bucket's digest is the sum of those below it and the tree comes from one aggregate of the last level.

Trees are small (at most 16 ** levels rows below the last level) and can be kept: with a `Snapshot`, whose rows
lie in one folder per bucket, or with a run of the history. Two trees are compared from the top; only below
buckets that differ are the digests of the next level read, and only rows of differing buckets are compared.

Like a fingerprint, equal digests mean equal rows except with a probability of about 2^-64 for each bucket; duplicate
keys are found in buckets that differ and not looked for in the others.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions.columns import aligned, common_columns, ref, union_all
from evenkeel.functions.rowhash import row_hash
from evenkeel.operators.fingerprint import _MEASURES
from evenkeel.operators.row_diff import MATCH, key_states
from evenkeel.session import staged

MAX_LEVELS = 5  # about a million buckets
DIGEST = ["row_count", *[m for m in _MEASURES if m != "row_count"]]
BUCKET = "_bucket"
TREE = "bucket BIGINT, " + ", ".join(f"{m} BIGINT" for m in DIGEST) + ", level INT"


def key_bucket(df: DataFrame, keys: list[str], levels: int, by: str = "xxhash64") -> Column:
    """The number of a row's bucket in the last of `levels`.

    `xxhash64` is the cheap way and depends on the types of the keys. `md5` takes it from the keys' text, joined by
    commas and with a null as the empty text, which other databases can compute as well.
    """
    if not 0 <= levels <= MAX_LEVELS:
        raise ValueError(f"levels must be 0 to {MAX_LEVELS}, not {levels}")
    if levels == 0:
        return F.lit(0).cast("bigint")
    if by == "md5":
        text = F.concat_ws(",", *[F.coalesce(ref(k).cast("string"), F.lit("")) for k in keys])
        return F.conv(F.substring(F.md5(text), 1, levels), 16, 10).cast("bigint")
    if by != "xxhash64":
        raise ValueError(f"buckets are made by xxhash64 or md5, not by {by!r}")
    return F.shiftrightunsigned(row_hash(df, keys, salt=16), 64 - 4 * levels)


def digest_tree(df: DataFrame, keys: list[str], levels: int = 3, columns: list[str] | None = None, by: str = "xxhash64") -> DataFrame:
    """level, bucket and the digest of every bucket that has rows, for the levels 0 to `levels`.

    One scan; rows are combined in every task, so the exchange holds one row per bucket and task.
    """
    hashed = df.select(
        key_bucket(df, keys, levels, by).alias("bucket"),
        row_hash(df, sorted(df.columns) if columns is None else columns).alias("_h"),
    )
    leaves = hashed.groupBy("bucket").agg(*[F.expr(f"{_MEASURES[m]} AS {m}") for m in DIGEST])
    return _rolled_up(leaves, levels)


def _rolled_up(leaves: DataFrame, levels: int) -> DataFrame:
    """The tree over digests of its last level."""
    level = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")
    above = leaves.select(level, *leaves.columns).withColumn(
        "bucket", F.expr(f"shiftright(bucket, 4 * ({levels} - level))")
    )
    # the xor and the sums of a bucket are those of the buckets below it
    return above.groupBy("level", "bucket").agg(
        *[(F.bit_xor(m) if m == "hash_xor" else F.sum(m)).alias(m) for m in DIGEST]
    )


def differing_buckets(source: DataFrame, target: DataFrame, levels: int) -> DataFrame:
    """bucket, source_row_count and target_row_count of the buckets of the last level that differ.

    The trees are read level by level. Of each level only buckets below a differing one are
    compared, and nothing is read below levels that agree. Runs one small job for each level.
    """
    changed = None
    for level in range(levels + 1):
        sides = [tree.where(F.col("level") == level).select("bucket", *DIGEST) for tree in (source, target)]
        if changed is not None:
            parents = changed.select(F.col("bucket").alias("_parent"))  # at most 16 ** levels rows
            sides = [s.join(F.broadcast(parents), F.shiftright("bucket", 4) == F.col("_parent"), "left_semi") for s in sides]
        s, t = sides[0].alias("s"), sides[1].alias("t")
        same = " AND ".join(f"s.{m} <=> t.{m}" for m in DIGEST)
        changed = staged(
            s.join(t, F.col("s.bucket") == F.col("t.bucket"), "full").where(f"NOT ({same})").selectExpr(
                "coalesce(s.bucket, t.bucket) AS bucket",
                "coalesce(s.row_count, 0L) AS source_row_count",
                "coalesce(t.row_count, 0L) AS target_row_count",
            ),
            "differing-buckets",
            few_files=True,
        )
        if changed.limit(1).count() == 0:
            break
    return changed


class Snapshot(NamedTuple):
    """A table whose rows lie in a folder for each bucket of the last level, and its tree."""

    path: str
    keys: tuple[str, ...]
    levels: int
    by: str
    schema: T.StructType

    def tree(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(TREE).parquet(f"{self.path}/tree")

    def rows(self, spark: SparkSession, buckets: list[int] | None = None) -> DataFrame:
        """The rows, or those of some buckets; no other folder is read."""
        stored = spark.read.schema(_placed(self.schema)).parquet(f"{self.path}/rows")
        if buckets is not None:
            stored = stored.where(F.col(BUCKET).isin(buckets))
        return stored.drop(BUCKET)


def _placed(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])


def save_snapshot(df: DataFrame, keys: list[str], path: str, levels: int = 2, by: str = "xxhash64") -> Snapshot:
    """Write `df` by bucket, and its tree. Each bucket should hold a few files' worth of rows.

    The rows of a bucket are gathered by one exchange; adaptive execution splits a bucket that is too large.
    """
    placed = df.withColumn(BUCKET, key_bucket(df, keys, levels, by).cast("int"))
    placed.hint("rebalance", F.col(BUCKET)).write.partitionBy(BUCKET).parquet(f"{path}/rows")
    stored = df.sparkSession.read.schema(_placed(df.schema)).parquet(f"{path}/rows")
    hashed = stored.select(
        F.col(BUCKET).cast("bigint").alias("bucket"), row_hash(df, sorted(df.columns)).alias("_h")
    )
    leaves = hashed.groupBy("bucket").agg(*[F.expr(f"{_MEASURES[m]} AS {m}") for m in DIGEST])
    _rolled_up(leaves, levels).repartition(1).sortWithinPartitions("level", "bucket").write.partitionBy("level").parquet(f"{path}/tree")
    return Snapshot(path, tuple(keys), levels, by, df.schema)


def _differing_rows(spark: SparkSession, source: Snapshot, target: Snapshot) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The differing buckets and the rows of both sides in them."""
    if (source.keys, source.levels, source.by) != (target.keys, target.levels, target.by):
        raise ValueError("snapshots are compared only by the same keys, levels and hash")
    kinds = [{f.name: f.dataType for f in s.schema.fields} for s in (source, target)]
    if kinds[0] != kinds[1]:
        raise ValueError("the snapshots' columns differ, so their digests do as well; compare their rows instead")
    changed = differing_buckets(source.tree(spark), target.tree(spark), source.levels)
    buckets = [r["bucket"] for r in changed.select("bucket").collect()]  # at most 16 ** levels
    return changed, source.rows(spark, buckets), target.rows(spark, buckets)


def snapshot_differences(spark: SparkSession, source: Snapshot, target: Snapshot) -> DataFrame:
    """The keys that are not a match with their `difference_type`, from the rows of differing buckets."""
    _, left, right = _differing_rows(spark, source, target)
    return key_states(left, right, list(source.keys)).where(F.col("difference_type") != MATCH)


def snapshot_counts(spark: SparkSession, source: Snapshot, target: Snapshot) -> DataFrame:
    """One row with the six counts of `row_diff_counts`; rows of equal buckets are counted by their digests."""
    changed, left, right = _differing_rows(spark, source, target)
    states = key_states(left, right, list(source.keys)).agg(
        *[
            F.count_if(F.col("difference_type") == kind).alias(name)
            for kind, name in (
                (MATCH, "matching"), ("data_different", "different_rows"),
                ("data_only_source", "source_only_rows"), ("data_only_target", "target_only_rows"),
            )
        ]
    )
    totals = [
        snapshot.tree(spark).where("level = 0").agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias(f"{side}_row_count"))
        for side, snapshot in (("source", source), ("target", target))
    ]
    inside = changed.agg(F.coalesce(F.sum("source_row_count"), F.lit(0)).alias("inside"))
    parts = [states, *totals, inside]  # one row each
    names = [name for part in parts for name in part.columns]
    rows = union_all([part.select(*[F.col(n) if n in part.columns else F.lit(None).cast("bigint").alias(n) for n in names]) for part in parts])
    return rows.agg(*[F.max(n).alias(n) for n in names]).select(
        "source_row_count",
        "target_row_count",
        (F.col("matching") + F.col("source_row_count") - F.col("inside")).alias("matching_rows"),
        "different_rows",
        "source_only_rows",
        "target_only_rows",
    )


def bucket_differences(source: DataFrame, target: DataFrame, keys: list[str], levels: int = 3) -> DataFrame:
    """The keys that are not a match, of tables without a layout by bucket.

    Both are read twice: once for their trees, once for the rows of differing buckets, which alone are exchanged. That
    is the better plan where few buckets differ; where most do, use `key_states`.
    """
    left, right = aligned(source, target, [*keys, *[c for c in common_columns(source, target) if c not in keys]])
    changed = differing_buckets(digest_tree(left, keys, levels), digest_tree(right, keys, levels), levels)
    wanted = F.broadcast(changed.select(F.col("bucket").alias("_wanted")))  # at most 16 ** levels rows

    def part(df: DataFrame) -> DataFrame:
        return df.join(wanted, key_bucket(df, keys, levels) == F.col("_wanted"), "left_semi")

    return key_states(part(left), part(right), keys).where(F.col("difference_type") != MATCH)

