import math

import pytest
from pyspark.sql import functions as F

from evenkeel.operators.fingerprint import fingerprint, quick_compare
from evenkeel.operators.row_diff import cell_diff, drill_down, key_states, row_diff_counts, row_diff_rows
from evenkeel.operators.set_diff import common_rows, except_rows, multiset_diff, two_way_except
from evenkeel.sources.fixtures import view
from tests.conftest import rows

COUNTS = ["source_row_count", "target_row_count", "matching_rows", "different_rows", "source_only_rows", "target_only_rows"]


def counts(df):
    row = df.first()
    return tuple(row[c] for c in COUNTS)


def test_invariants_and_swap(spark, folder):
    s, t = view(spark, folder, "orders"), view(spark, folder, "orders_t")
    ns, nt, match, differ, only_s, only_t = counts(row_diff_counts(s, t, ["o_orderkey"]))
    assert match + differ + only_s == ns == s.count()
    assert match + differ + only_t == nt == t.count()
    assert counts(row_diff_counts(t, s, ["o_orderkey"])) == (nt, ns, match, differ, only_t, only_s)


def test_same_table_has_no_difference(spark, folder):
    s = view(spark, folder, "customer")
    assert counts(row_diff_counts(s, s, ["c_custkey"])) == (s.count(), s.count(), s.count(), 0, 0, 0)
    assert cell_diff(s, s, ["c_custkey"]).count() == 0
    assert multiset_diff(s, s).count() == 0
    assert except_rows(s, s).count() == 0


@pytest.mark.parametrize("left, right, expected", [
    ([], [], (0, 0, 0, 0, 0, 0)),
    ([(1, "a")], [], (1, 0, 0, 0, 1, 0)),
    ([], [(1, "a")], (0, 1, 0, 0, 0, 1)),
    ([(None, "a")], [(None, "a")], (1, 1, 1, 0, 0, 0)),
    ([(None, "a"), (1, None)], [(None, "b"), (1, None)], (2, 2, 1, 1, 0, 0)),
])
def test_small_sides(spark, left, right, expected):
    schema = "k INT, v STRING"
    s, t = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    assert counts(row_diff_counts(s, t, ["k"])) == expected
    assert counts(row_diff_counts(s, t)) [:2] == expected[:2]


def test_duplicate_keys_raise_or_count_as_multiset(spark):
    s = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k INT, v STRING")
    t = spark.createDataFrame([(1, "a"), (2, "c")], "k INT, v STRING")
    with pytest.raises(Exception, match="duplicate key: k=1"):
        row_diff_counts(s, t, ["k"]).collect()
    assert counts(row_diff_counts(s, t, ["k"], on_duplicate="multiset")) == (3, 2, 1, 0, 2, 1)
    with pytest.raises(ValueError):
        row_diff_counts(s, t, ["k"], on_duplicate="ignore")


def test_null_positions_and_special_doubles(spark):
    s = spark.createDataFrame([(1, None, "a", float("nan"), 0.0)], "k INT, a STRING, b STRING, x DOUBLE, z DOUBLE")
    t = spark.createDataFrame([(1, "a", None, float("nan"), -0.0)], "k INT, a STRING, b STRING, x DOUBLE, z DOUBLE")
    assert rows(cell_diff(s, t, ["k"]), "column_name", "source_value", "target_value") == [("a", None, "a"), ("b", "a", None)]
    assert quick_compare(s, t).first().fingerprint_match is False
    same = t.select("k", F.lit(None).cast("string").alias("a"), F.lit("a").alias("b"), "x", "z")
    assert quick_compare(s, same).first().fingerprint_match is True
    assert counts(row_diff_counts(s, same, ["k"])) == (1, 1, 1, 0, 0, 0)
    assert multiset_diff(s, same).count() == 0
    assert math.isnan(s.first().x)


def test_rows_that_cancel_in_an_xor(spark):
    s = spark.createDataFrame([("a",), ("a",), ("c",)], "v STRING")
    t = spark.createDataFrame([("b",), ("b",), ("c",)], "v STRING")
    assert quick_compare(s, t).first().fingerprint_match is False


def test_fingerprint_ignores_order_and_partitioning(spark, folder):
    df = view(spark, folder, "lineitem")
    shuffled = df.repartition(7, "l_suppkey").sort("l_quantity")
    assert fingerprint(df).first() == fingerprint(shuffled).first()


def test_no_common_columns(spark):
    s, t = spark.createDataFrame([(1,)], "a INT"), spark.createDataFrame([(1,), (2,)], "b INT")
    row = quick_compare(s, t).first()
    assert (row.source_row_count, row.target_row_count, row.fingerprint_match) == (1, 2, None)
    with pytest.raises(ValueError):
        row_diff_counts(s, t, ["a"])


def test_types_are_aligned(spark):
    s = spark.createDataFrame([(1, 5, "7", 1.5)], "k INT, a INT, b STRING, c FLOAT")
    t = spark.createDataFrame([(1, 5, 7, 1.5)], "k BIGINT, a BIGINT, b INT, c DOUBLE")
    assert counts(row_diff_counts(s, t, ["k"])) == (1, 1, 1, 0, 0, 0)


def test_text_against_number_does_not_fail(spark):
    s = spark.createDataFrame([(1, "x")], "k INT, a STRING")
    t = spark.createDataFrame([(1, 5)], "k INT, a INT")
    assert rows(cell_diff(s, t, ["k"]), "source_value", "target_value") == [("x", "5")]


def test_nested_values(spark):
    schema = "k INT, a ARRAY<STRING>, m MAP<STRING, INT>, s STRUCT<x: INT, y: ARRAY<STRING>>"
    base = (1, ["a", None], {"p": 1, "q": 2}, (1, ["z"]))
    s = spark.createDataFrame([base], schema)
    t = spark.createDataFrame([(1, [None, "a"], {"q": 2, "p": 1}, (1, ["z"]))], schema)
    assert rows(cell_diff(s, t, ["k"]), "column_name") == [("a",)]
    reordered = spark.createDataFrame([(1, ["a", None], {"q": 2, "p": 1}, (1, ["z"]))], schema)
    assert quick_compare(s, reordered).first().fingerprint_match is True
    assert multiset_diff(s, reordered).count() == 0
    assert multiset_diff(s, reordered, by_hash=True).count() == 0
    assert multiset_diff(s, t, by_hash=True).count() == 2


def test_composite_key_and_limit(spark):
    s = spark.createDataFrame([(1, None, "a", 1), (1, 2, "b", 2), (2, 1, "c", 3)], "k1 INT, k2 INT, v STRING, w INT")
    t = spark.createDataFrame([(1, None, "x", 9), (1, 2, "y", 2), (2, 1, "c", 3)], "k1 INT, k2 INT, v STRING, w INT")
    found = cell_diff(s, t, ["k1", "k2"])
    assert rows(found, "key_display", "column_name") == [("k1=1, k2=2", "v"), ("k1=1, k2=None", "v"), ("k1=1, k2=None", "w")]
    assert rows(cell_diff(s, t, ["k1", "k2"], limit=1), "key_display", "column_name") == [("k1=1, k2=None", "v")]
    assert rows(row_diff_rows(s, t, ["k1", "k2"]), "difference_type") == [("data_different",)] * 2


def test_names_with_dots_and_spaces(spark):
    s = spark.createDataFrame([(1, "a")], "`the.key` INT, `a value` STRING")
    t = spark.createDataFrame([(1, "b")], "`the.key` INT, `a value` STRING")
    assert rows(cell_diff(s, t, ["the.key"]), "column_name", "source_value") == [("a value", "a")]
    assert rows(key_states(s, t, ["the.key"]), "difference_type") == [("data_different",)]


def test_drill_down_key_and_columns(spark):
    s = spark.createDataFrame([(1, "a", "x")], "id INT, v STRING, created_by STRING")
    t = spark.createDataFrame([(1, "b", "y")], "id INT, v STRING, created_by STRING")
    assert rows(drill_down(s, t), "id", "column_name") == [(1, "v")]
    with pytest.raises(ValueError):
        drill_down(s.select("id"), t)


def test_set_operations_on_copies_and_nulls(spark):
    s = spark.createDataFrame([(1, None), (1, None), (2, "a"), (3, "c")], "k INT, v STRING")
    t = spark.createDataFrame([(1, None), (2, "b"), (3, "c"), (3, "c")], "k INT, v STRING")
    assert rows(except_rows(s, t)) == rows(s.subtract(t)) == [(2, "a")]
    assert rows(common_rows(s, t)) == rows(s.intersect(t))
    assert rows(two_way_except(s, t), "k", "difference_type") == [(2, "data_only_source"), (2, "data_only_target")]
    diff = multiset_diff(s, t)
    expand = [r for r in diff.collect() for _ in range(r.copies)]
    gone = sorted((r.k, r.v or "") for r in expand if r.difference_type == "data_only_source")
    added = sorted((r.k, r.v or "") for r in expand if r.difference_type == "data_only_target")
    assert gone == sorted((r.k, r.v or "") for r in s.exceptAll(t).collect())
    assert added == sorted((r.k, r.v or "") for r in t.exceptAll(s).collect())


def test_columns_whose_names_differ_in_case(spark):
    s = spark.createDataFrame([(1, "a")], "k INT, Name STRING")
    t = spark.createDataFrame([(1, "b")], "k INT, name STRING")
    assert counts(row_diff_counts(s, t, ["k"])) == (1, 1, 1, 0, 0, 0)


def test_expected_counts_of_the_fixtures(spark):
    sf = "/root/testdata/sf0.01"
    s, t = view(spark, sf, "orders"), view(spark, sf, "orders_t")
    assert counts(row_diff_counts(s, t, ["o_orderkey"])) == (15000, 14907, 12035, 2082, 883, 790)
    assert (except_rows(s, t).count(), except_rows(t, s).count()) == (2965, 2872)
    li, lt = view(spark, sf, "lineitem"), view(spark, sf, "lineitem_t")
    assert counts(row_diff_counts(li, lt))[4:] == (3464, 1447)


def test_rows_that_are_not_looked_for_do_not_move(spark):
    """Also where the differing keys are too many to be broadcast, only rows that the filter lets pass are shuffled whole."""
    from pyspark.sql import functions as F

    from evenkeel.operators.set_diff import except_rows, multiset_diff

    wide = spark.range(40_000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("text"))
    other = wide.withColumn("text", F.when(F.col("id") % 20 == 3, F.lit("x")).otherwise(F.col("text")))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = {
            "cells": cell_diff(wide, other, ["id"]),
            "rows": multiset_diff(wide, other, by_hash=True),
            "except": except_rows(wide, other, by_hash=True),
        }
        counts = {n: len(df.collect()) for n, df in found.items()}
        plans = {n: df._jdf.queryExecution().executedPlan().toString() for n, df in found.items()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert counts == {"cells": 2000, "rows": 4000, "except": 2000}
    for name, plan in plans.items():
        assert "BroadcastHashJoin" in plan and "_word0" in plan, name
    assert rows(found["rows"]) == rows(multiset_diff(wide, other))
    assert rows(found["except"]) == rows(except_rows(wide, other))


def test_hash_filter_holds_what_it_was_made_of(spark):
    from pyspark.sql import functions as F

    from evenkeel.operators.hash_filter import hash_filter, passing

    df = spark.range(200_000).select("id", F.xxhash64(F.lit(1), "id").alias("a"), F.xxhash64(F.lit(2), "id").alias("b"))
    words = hash_filter(df.where("id % 20 = 0"), "a", "b")
    got = {r.id for r in passing(df, "a", "b", words).collect()}
    assert set(range(0, 200_000, 20)) <= got and len(got) < 10_100
    assert passing(df, "a", "b", hash_filter(df.where("false"), "a", "b")).count() == 0


def test_signed_zeros_and_nan_in_keys_are_still_found(spark):
    schema = "k DOUBLE, v INT"
    a = spark.createDataFrame([(0.0, 1), (float("nan"), 2), (None, 3), (5.0, 5)], schema)
    b = spark.createDataFrame([(-0.0, 9), (float("nan"), 8), (None, 7), (5.0, 5)], schema)
    assert sorted(r.source_value for r in cell_diff(a, b, ["k"]).collect()) == ["1", "2", "3"]
