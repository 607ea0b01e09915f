"""Random small tables against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evenkeel.operators.change_set import apply_change_set, change_set
from evenkeel.operators.fingerprint import quick_compare
from evenkeel.operators.row_diff import cell_diff, row_diff_counts
from evenkeel.operators.set_diff import common_rows, except_rows, multiset_counts, multiset_diff
from evenkeel.plans.workload import Thresholds, connection_issues
from evenkeel.operators import activity as A
from evenkeel.sources.fixtures import AS_OF, view
from tests.conftest import rows
from tests.test_row_diff import counts

SCHEMA = "k1 INT, k2 STRING, a INT, b STRING"


def table(rng, size):
    keys = [(rng.choice([None, 1, 2, 3]), rng.choice([None, "", "x", "y", "z"])) for _ in range(size)]
    return {k: (rng.choice([None, 0, 1]), rng.choice([None, "", "v"])) for k in keys}


@pytest.mark.parametrize("seed", range(5))
def test_keyed(spark, seed):
    rng = random.Random(seed)
    left, right = table(rng, 12), table(rng, 12)
    right.update({k: v for k, v in left.items() if rng.random() < 0.4})
    s = spark.createDataFrame([(*k, *v) for k, v in left.items()], SCHEMA)
    t = spark.createDataFrame([(*k, *v) for k, v in right.items()], SCHEMA)
    both = left.keys() & right.keys()
    same = sum(left[k] == right[k] for k in both)
    expected = (len(left), len(right), same, len(both) - same, len(left) - len(both), len(right) - len(both))
    assert counts(row_diff_counts(s, t, ["k1", "k2"])) == expected
    cells = {(*k, c) for k in both for i, c in enumerate("ab") if left[k][i] != right[k][i]}
    assert set(rows(cell_diff(s, t, ["k1", "k2"]), "k1", "k2", "column_name")) == cells
    after = apply_change_set(t, change_set(s, t, ["k1", "k2"]), ["k1", "k2"])
    assert Counter(map(tuple, after.collect())) == Counter(map(tuple, s.collect()))
    assert quick_compare(s, t).first().fingerprint_match == (left == right)


@pytest.mark.parametrize("seed", range(5))
def test_multisets(spark, seed):
    rng = random.Random(100 + seed)
    left, right = ([(rng.choice([None, 1, 2]), rng.choice([None, "", "x"])) for _ in range(rng.randint(0, 20))] for _ in range(2))
    s, t = spark.createDataFrame(left, "a INT, b STRING"), spark.createDataFrame(right, "a INT, b STRING")
    ls, rs = Counter(left), Counter(right)
    gone, added = ls - rs, rs - ls
    assert set(map(tuple, except_rows(s, t).collect())) == ls.keys() - rs.keys()
    assert sorted(map(str, except_rows(s, t, by_hash=True).collect())) == sorted(map(str, except_rows(s, t).collect()))
    assert set(map(tuple, common_rows(s, t).collect())) == ls.keys() & rs.keys()
    found = {"data_only_source": Counter(), "data_only_target": Counter()}
    for r in multiset_diff(s, t).collect():
        found[r.difference_type][r.a, r.b] = r.copies
    assert found == {"data_only_source": gone, "data_only_target": added}
    expected = (len(left), len(right), len(left) - gone.total(), 0, gone.total(), added.total())
    assert counts(multiset_counts(s, t)) == expected
    assert counts(multiset_counts(s, t, by_hash=True)) == expected
    assert rows(multiset_diff(s, t, by_hash=True)) == rows(multiset_diff(s, t))
    assert quick_compare(s, t).first().fingerprint_match == (ls == rs)


def test_a_hot_row_and_a_hot_null_key(spark):
    """A third of all rows are the same row, whose key is NULL."""
    key = F.when(F.col("id") % 3 != 0, F.col("id"))
    s = spark.range(0, 30000, 1, 8).select(key.alias("k"), F.lit("x").alias("v"))
    t = s.where("k IS NULL OR k <> 10").union(s.where("k IS NULL").limit(5))
    for by_hash in (False, True):
        found = row_diff_counts(s, t, ["k"], on_duplicate="multiset", by_hash=by_hash)
        assert counts(found) == (30000, 30004, 29999, 0, 1, 5)
    with pytest.raises(Exception, match="duplicate key: k=None"):
        row_diff_counts(s, t, ["k"]).collect()


def test_numbers_of_the_workload_fixtures(spark):
    sf = "/root/testdata/sf0.01"
    sessions, requests = view(spark, sf, "wl_sessions"), view(spark, sf, "wl_requests")
    sources = A.connection_sources(sessions, requests, AS_OF)
    totals = sources.agg(F.count("*"), F.sum("idle_connections"), F.sum("active_requests"), F.sum("blocked_count")).first()
    assert tuple(totals) == (18, 60, 84, 30)
    pairs = A.blocking_pairs(sessions, requests)
    assert (pairs.count(), pairs.where("wait_time_ms > 30000").count()) == (30, 12)
    assert A.wait_stats(view(spark, sf, "wl_waits"), sessions).count() == 90
    assert A.lock_counts(view(spark, sf, "wl_locks"), sessions).count() == 4909
    idle_only = connection_issues(sources, Thresholds(sessions=5, idle_sessions=2, transaction_seconds=10**9, blocked_sessions=10**9))
    assert idle_only.count() > 0
