"""Key search and keyed differences of bucketed tables."""

from itertools import combinations

import pytest
from pyspark.sql import functions as F

from evenkeel.operators import copartitioned as co
from evenkeel.operators.keys import column_sets, distinct_sketches, minimal_keys
from evenkeel.operators.row_diff import cell_diff, key_states, row_diff_counts
from evenkeel.sources.fixtures import view
from tests.conftest import rows


def plain_keys(table, columns, width):
    found = []
    for n in range(1, width + 1):
        for s in combinations(columns, n):
            values = [tuple(r[c] for c in s) for r in table]
            if any(set(k) <= set(s) for k in found) or any(v is None for t in values for v in t):
                continue
            if len(set(values)) == len(values):
                found.append(s)
    return sorted((", ".join(s), len(s)) for s in found)


@pytest.mark.parametrize("sample", [10, 300, 20_000])
def test_minimal_keys(spark, sample):
    df = spark.range(600).select(
        (F.col("id") % 30).alias("a"), F.floor(F.col("id") / 30).alias("b"), (F.col("id") % 7).alias("c"), F.lit(1).alias("d"),
        F.when(F.col("id") != 9, F.col("id")).alias("e"), (F.col("id") % 599).alias("f"),
    )
    table = df.collect()
    expected = plain_keys(table, df.columns, 3)
    assert ("a, b", 2) in expected and not any("e" in k for k, _ in expected)
    assert rows(minimal_keys(df, 3, sample=sample)) == expected


def test_one_column_and_empty(spark):
    assert rows(minimal_keys(spark.range(50))) == [("id", 1)]
    assert rows(minimal_keys(spark.range(0))) == [("id", 1)]
    repeated = spark.range(50).select(F.lit(2).alias("x"))
    assert rows(minimal_keys(repeated)) == []


def test_chunks_of_sets(spark, monkeypatch):
    from evenkeel.operators import keys

    monkeypatch.setattr(keys, "SETS_PER_SCAN", 2)
    df = spark.range(60).select((F.col("id") % 6).alias("a"), F.floor(F.col("id") / 6).alias("b"), F.lit(0).alias("c"))
    assert rows(minimal_keys(df, 3)) == [("a, b", 2)]


def test_sketches(spark):
    df = spark.range(20_000).select((F.col("id") % 5000).alias("a"), "id")
    sets = column_sets(df.columns, 2)
    found = {r.set: r for r in distinct_sketches(df, sets, 8).collect()}
    estimates = [found[i].sampled_values * 8 for i in range(3)]
    assert abs(estimates[0] - 5000) < 700 and abs(estimates[1] - 20_000) < 1500 and abs(estimates[2] - 20_000) < 1500
    assert [found[i].repeated for i in range(3)] == [True, False, False]
    halves = [distinct_sketches(df.where(f"id % 2 = {i}"), sets, 8) for i in (0, 1)]
    assert sum(h.where("set = 1").first().sampled_rows for h in halves) == found[1].sampled_rows


def test_sets_are_refuted_on_chosen_rows(spark, monkeypatch):
    """No column set is hashed on every row; and sets whose values repeat only within one order do not come to the exact check."""
    from evenkeel.operators import keys

    df = spark.range(200_000).select(
        F.floor(F.col("id") / 4).alias("order"), (F.col("id") % 4).alias("line"), F.floor(F.col("id") / 2).alias("pair"),
        F.xxhash64("id").alias("price"), (F.col("id") % 3).alias("flag"),
    )
    looked, checked = [], []
    sketches, candidates = keys.distinct_sketches, keys.candidate_keys
    monkeypatch.setattr(keys, "distinct_sketches", lambda rows, sets, share: looked.append(rows.count()) or sketches(rows, sets, share))
    monkeypatch.setattr(keys, "candidate_keys", lambda rows, sets: checked.extend(sets) or candidates(rows, sets))
    found = rows(minimal_keys(df, 2, sample=500))
    assert found == [("line, pair", 2), ("order, line", 2), ("pair, flag", 2), ("price", 1)]
    assert looked and max(looked) <= 200_000 // 4
    assert ["order", "pair"] not in checked and ["order", "flag"] not in checked


def test_sketches_take_one_scan(spark, folder):
    df = spark.read.parquet(f"{folder}/lineitem.parquet")
    plan = distinct_sketches(df, column_sets(df.columns, 3), 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


@pytest.fixture()
def bucketed(spark, folder):
    names = ("orders", "orders_t")
    return [co.save_bucketed(view(spark, folder, n), ["o_orderkey"], 8) for n in names]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_counts_without_exchange(spark, folder, bucketed):
    source, target = bucketed
    assert rows(co.bucketed_counts(source, target, ["o_orderkey"])) == rows(row_diff_counts(source, target, ["o_orderkey"]))
    states = co.bucketed_states(source, target, ["o_orderkey"])
    assert rows(states) == rows(key_states(source, target, ["o_orderkey"]))
    whole = co._joined(source, target, ["o_orderkey"], lambda df: [])
    assert "Exchange" not in plan_of(whole)
    plan = plan_of(states)  # only rows without a key are exchanged
    assert plan.count("Exchange") <= 1 and "isnull(o_orderkey" in plan


def test_bucketed_cells_without_exchange(spark, folder, bucketed):
    source, target = bucketed
    found = co.bucketed_cells(source, target, ["o_orderkey"])
    assert "Exchange" not in plan_of(found)
    assert rows(found) == rows(cell_diff(source, target, ["o_orderkey"]))


def test_null_and_duplicate_keys(spark):
    schema = "a INT, b STRING, v INT"
    source = spark.createDataFrame([(None, "x", 1), (1, "y", 2), (2, "z", 3), (None, None, 4)], schema)
    target = spark.createDataFrame([(None, "x", 9), (1, "y", 2), (3, "z", 3), (None, None, 4)], schema)
    for s, t in ((source, target), [co.save_bucketed(df, ["a", "b"], 3) for df in (source, target)]):
        assert rows(co.bucketed_states(s, t, ["a", "b"])) == rows(key_states(s, t, ["a", "b"]))
    with pytest.raises(Exception, match="duplicate key: a=1, b=y"):
        co.bucketed_counts(source.union(source.where("a = 1")), target, ["a", "b"]).collect()
    with pytest.raises(ValueError):
        co.bucketed_counts(source, target.withColumn("a", F.col("a").cast("long")), ["a", "b"])
