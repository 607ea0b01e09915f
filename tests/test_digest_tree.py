import glob

import pytest
from pyspark.sql import functions as F

from evenkeel.operators.digest_tree import (
    bucket_differences,
    differing_buckets,
    digest_tree,
    key_bucket,
    save_snapshot,
    snapshot_counts,
    snapshot_differences,
)
from evenkeel.operators.row_diff import key_states, row_diff_counts
from evenkeel.sources.history import History
from evenkeel.sources.versioned_history import VersionedHistory
from tests.conftest import rows


def table(spark, n=2000):
    return spark.range(n).select(
        F.col("id").alias("k"), (F.col("id") % 7).cast("string").alias("a"), F.when(F.col("id") % 3 > 0, F.col("id") / 2).alias("b")
    )


def changed(df):
    """One row changed, one gone, one new."""
    moved = df.where("k <> 11").withColumn("a", F.when(F.col("k") == 5, "changed").otherwise(F.col("a")))
    return moved.union(df.sparkSession.createDataFrame([(9999, "new", None)], df.schema))


@pytest.mark.parametrize("by", ["xxhash64", "md5"])
def test_levels_add_up(spark, by):
    df = table(spark)
    tree = digest_tree(df, ["k"], 3, by=by)
    totals = {r.level: (r.n, r.x) for r in tree.groupBy("level").agg(F.sum("row_count").alias("n"), F.bit_xor("hash_xor").alias("x")).collect()}
    assert set(totals) == {0, 1, 2, 3} and len(set(totals.values())) == 1 and totals[0][0] == 2000
    buckets = {r.level: r.n for r in tree.groupBy("level").agg(F.count("*").alias("n")).collect()}
    assert buckets[0] == 1 and buckets[1] == 16 and buckets[2] <= 256 and buckets[3] <= 4096
    assert rows(digest_tree(df.repartition(7), ["k"], 3, by=by)) == rows(tree)


@pytest.mark.parametrize("levels", [0, 1, 3, 4])
def test_differing_buckets(spark, levels):
    source = table(spark)
    target = changed(source)
    trees = [digest_tree(df, ["k"], levels) for df in (source, target)]
    found = {r.bucket for r in differing_buckets(*trees, levels).collect()}
    touched = source.where("k IN (5, 11)").union(target.where("k = 9999"))
    assert found == {r[0] for r in touched.select(key_bucket(touched, ["k"], levels)).collect()}
    assert differing_buckets(trees[0], trees[0], levels).count() == 0


def test_snapshots_read_only_differing_buckets(spark, tmp_path):
    source = table(spark)
    target = changed(source)
    a = save_snapshot(source, ["k"], str(tmp_path / "a"), 2)
    b = save_snapshot(target, ["k"], str(tmp_path / "b"), 2)
    expected = rows(row_diff_counts(source, target, ["k"]))
    buckets = [r.bucket for r in differing_buckets(a.tree(spark), b.tree(spark), 2).collect()]
    assert 1 <= len(buckets) <= 3
    for path in (a.path, b.path):
        for file in glob.glob(f"{path}/rows/_bucket=*/*.parquet"):
            if int(file.split("_bucket=")[1].split("/")[0]) not in buckets:
                with open(file, "wb") as broken:  # reading it would fail
                    broken.write(b"no parquet")
    assert rows(snapshot_counts(spark, a, b)) == expected
    assert rows(snapshot_differences(spark, a, b)) == [(5, "data_different"), (11, "data_only_source"), (9999, "data_only_target")]


def test_levels_below_equal_ones_are_not_read(spark, tmp_path):
    one = save_snapshot(table(spark), ["k"], str(tmp_path / "a"), 3)
    for file in glob.glob(f"{one.path}/tree/level=*/*.parquet"):
        if "level=0" not in file:
            with open(file, "wb") as broken:
                broken.write(b"no parquet")
    assert differing_buckets(one.tree(spark), one.tree(spark), 3).count() == 0


def test_types_are_aligned_and_keys_composite(spark):
    source = spark.createDataFrame([(1, None, 1), (2, "x", 2), (None, "y", 3)], "a int, b string, v int")
    target = spark.createDataFrame([(1, None, 1), (2, "x", 5), (None, "y", 3)], "a bigint, b string, v bigint")
    assert rows(bucket_differences(source, target, ["a", "b"])) == [(2, "x", "data_different")]
    kept = key_states(source, target, ["a", "b"]).where("difference_type <> 'match'")
    assert rows(bucket_differences(source, target, ["a", "b"])) == rows(kept)


def test_snapshots_refuse_other_layouts(spark, tmp_path):
    df = table(spark, 50)
    a = save_snapshot(df, ["k"], str(tmp_path / "a"), 1)
    b = save_snapshot(df, ["k"], str(tmp_path / "b"), 2)
    c = save_snapshot(df.withColumn("a", F.col("k")), ["k"], str(tmp_path / "c"), 1)
    for other in (b, c):
        with pytest.raises(ValueError):
            snapshot_counts(spark, a, other)
    with pytest.raises(ValueError):
        key_bucket(df, ["k"], 9)


def test_empty_sides(spark, tmp_path):
    df = table(spark, 30)
    full = save_snapshot(df, ["k"], str(tmp_path / "a"), 1)
    none = save_snapshot(df.limit(0), ["k"], str(tmp_path / "b"), 1)
    assert rows(snapshot_counts(spark, full, none)) == [(30, 0, 0, 0, 30, 0)]
    assert rows(snapshot_counts(spark, none, none)) == [(0, 0, 0, 0, 0, 0)]


def test_duplicate_keys_are_found_where_buckets_differ(spark, tmp_path):
    df = table(spark, 30)
    twice = df.union(df.where("k = 3"))
    with pytest.raises(Exception, match="duplicate key: k=3"):
        bucket_differences(twice, df, ["k"]).collect()


@pytest.mark.parametrize("kind", [History, VersionedHistory])
def test_trees_are_stored_with_runs(spark, tmp_path, kind):
    """A later run learns what has changed since an earlier one from digests alone."""
    history, df = kind(spark, str(tmp_path / "h")), table(spark, 300)
    for run, rows_then in (("r1", df), ("r2", changed(df))):
        history.open_run(run, "2024-01-01")
        history.save_digests(run, "t", "source", digest_tree(rows_then, ["k"], 2))
    found = differing_buckets(history.digests("r1", "t", "source"), history.digests("r2", "t", "source"), 2)
    assert rows(found) == rows(differing_buckets(digest_tree(df, ["k"], 2), digest_tree(changed(df), ["k"], 2), 2))
    assert history.digests("r1", "t", "target").count() == 0
    copy = history.compact(str(tmp_path / "copy"))
    assert rows(copy.digests("r2", "t", "source")) == rows(history.digests("r2", "t", "source"))
