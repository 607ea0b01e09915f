"""Digest trees, snapshots by bucket and comparisons of what differs."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.catalog import query
from evenkeel.catalog.diffs import COUNTS, JOINED, ORDER_KEY
from evenkeel.operators.digest_tree import (
    bucket_differences,
    differing_buckets,
    digest_tree,
    save_snapshot,
    snapshot_counts,
    snapshot_differences,
)
from evenkeel.session import fresh_path
from evenkeel.sources.fixtures import ctes, view

BUCKET = "('0x' || left(md5(CAST({key} AS VARCHAR)), {level}))::BIGINT"


@query(
    "digest_tree_counts",
    "\nUNION ALL ".join(
        f"SELECT {level} AS level, {BUCKET.format(key='l_orderkey', level=level) if level else '0::BIGINT'} AS bucket, "
        "count(*) AS row_count FROM lineitem GROUP BY ALL"
        for level in range(4)
    ),
)
def _(spark, folder):
    """The levels of a tree over a table whose key repeats."""
    return digest_tree(view(spark, folder, "lineitem"), ["l_orderkey"], 3, by="md5").select("level", "bucket", "row_count")


@query(
    "digest_differing_buckets",
    ctes(
        "orders_t",
        more=JOINED
        + f""", placed AS (
  SELECT {BUCKET.format(key='coalesce(sk, tk)', level=3)} AS bucket, sk, tk, sk IS NOT NULL AND tk IS NOT NULL AND same AS same FROM joined)""",
    )
    + """SELECT bucket, count(sk) AS source_row_count, count(tk) AS target_row_count FROM placed
GROUP BY bucket HAVING NOT bool_and(same)""",
)
def _(spark, folder):
    trees = [digest_tree(view(spark, folder, name), ORDER_KEY, 3, by="md5") for name in ("orders", "orders_t")]
    return differing_buckets(*trees, 3)


def _snapshots(spark, folder):
    return [
        save_snapshot(view(spark, folder, name), ORDER_KEY, fresh_path(spark, "snapshot"), levels=1) for name in ("orders", "orders_t")
    ]


@query("snapshot_counts", ctes("orders_t", more=JOINED) + COUNTS)
def _(spark, folder):
    return snapshot_counts(spark, *_snapshots(spark, folder))


DIFFERENT = """SELECT coalesce(sk, tk) AS o_orderkey,
  CASE WHEN tk IS NULL THEN 'data_only_source' WHEN sk IS NULL THEN 'data_only_target' ELSE 'data_different' END AS difference_type
FROM joined WHERE sk IS NULL OR tk IS NULL OR NOT same"""


@query("snapshot_differences", ctes("orders_t", more=JOINED) + DIFFERENT)
def _(spark, folder):
    return snapshot_differences(spark, *_snapshots(spark, folder))


@query("bucket_differences", ctes("orders_t", more=JOINED) + DIFFERENT)
def _(spark, folder):
    return bucket_differences(view(spark, folder, "orders"), view(spark, folder, "orders_t"), ORDER_KEY)


@query(
    "digest_late_rows",
    "SELECT o_orderkey FROM orders WHERE o_orderkey % 97 = 5",
)
def _(spark, folder):
    """What a later load added to a snapshot: few buckets differ, and only those are compared."""
    orders = view(spark, folder, "orders")
    before = save_snapshot(orders.where(F.col("o_orderkey") % 97 != 5), ORDER_KEY, fresh_path(spark, "snapshot"), levels=1)
    after = save_snapshot(orders, ORDER_KEY, fresh_path(spark, "snapshot"), levels=1)
    added = snapshot_differences(spark, after, before)
    return added.where("difference_type = 'data_only_source'").select("o_orderkey")
