"""Hard negatives against all scores."""

import math

import numpy as np
import pytest

from evenkeel.llm import hard_negatives
from evenkeel.llm.common import table
from evenkeel.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<float>, label int, row string, id string, cell string, need string, rank string"


def embeddings(spark, rows, partitions=3):
    df = spark.createDataFrame([(*r, None, None, None, None, None) for r in rows], SCHEMA)
    return df.repartition(partitions) if rows else df


def plain(rows):
    """All pairs; rows of (vec_id, vector, label), ids distinct or rows equal."""
    usable = []
    for i, v, label in rows:
        if label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * float(np.float32(x))) for x in v]
        usable.append((i, q, (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    out = []
    for a, (i, q, label) in enumerate(usable):
        if i is None or i % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(q, p, strict=True)), j is None, j or 0, o) for b, (j, p, o) in enumerate(usable) if b != a]
        scored.sort()
        for s, none, j, _ in [x for x in scored if x[3] == label][:5]:
            fitting = [(-t, None if n else k) for t, n, k, o in scored if o != label and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out += [(i, None if none else j, rank, k, -s, t) for rank, (t, k) in enumerate(fitting, 1)]
    return out


def check(df, rows):
    got = [tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]
    order = lambda t: [(x is None, x or 0) for x in t]
    assert sorted(got, key=order) == sorted(plain(rows), key=order)


def clustered(n, dim, spread, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    return [(i, (centres[i % 12] + spread * rng.normal(size=dim)).astype(float).tolist(), int(rng.integers(10))) for i in range(n)]


@pytest.mark.parametrize("spread", [0.02, 0.5])
def test_against_all_pairs(spark, monkeypatch, spread):
    monkeypatch.setattr(hard_negatives, "CELL", 4)
    monkeypatch.setattr(hard_negatives, "FIRST", 2)
    monkeypatch.setattr(hard_negatives, "BLOCK", 30)
    monkeypatch.setattr(hard_negatives, "ASKS", 3)
    rows = clustered(900, 6, spread)
    check(hard_negatives.mined(embeddings(spark, rows)), rows)


def test_stops_early_on_clusters(spark, monkeypatch):
    rows = hard_negatives.vectors(embeddings(spark, clustered(1200, 8, 0.01)))
    monkeypatch.setattr(hard_negatives, "CELL", 4)
    codes = hard_negatives.build(rows).codes
    some = rows.limit(5).collect()
    for r in some:
        bounds = list(codes.visits(np.array(r.vector, float)))
        assert [b[0] for b in bounds] == sorted((b[0] for b in bounds), reverse=True)
        assert sum(b[0] >= sum(x * x for x in r.vector) * 0.98 for b in bounds) < len(bounds) / 2


def test_bounds_hold(spark):
    rows = hard_negatives.vectors(embeddings(spark, clustered(700, 5, 0.3)))
    index = hard_negatives.build(rows)
    stored = [(r.cell, np.frombuffer(r.vector, "<i4").astype(float)) for r in index.rows.collect()]
    for r in rows.limit(8).collect():
        q = np.array(r.vector, float)
        bounds = {cell: (low, high) for high, low, cell in index.codes.visits(q)}
        assert all(bounds[c][0] <= q @ v <= bounds[c][1] for c, v in stored)


def test_edges(spark):
    rng = np.random.default_rng(3)
    some = [(i, rng.normal(size=3).tolist(), int(rng.integers(3))) for i in range(0, 400, 5)]
    odd = [
        (None, [0.1, 0.2, 0.3], 1), (None, [0.1, 0.2, 0.3], 2), (1, None, 1), (2, [], 1), (3, [0.1, None, 0.2], 1),
        (4, [float("nan"), 0.0, 0.0], 1), (6, [float("inf"), 0.0, 0.0], 1), (8, [0.0, 0.0, 0.0], None), (500, [0.0, 0.0, 0.0], 4),
        (600, [1.0, 1.0, 1.0], 8), (700, [1.0, 1.0, 1.0], 8), (11, [1.0, 1.0, 1.0], 9), (12, [0.5, 0.5, 0.5], 2), (13, [30000.0, 2.0, 2.0], 9),
        *[(i, [0.5, 0.5, 0.5], i % 4) for i in range(1001, 1100)],
    ]
    check(hard_negatives.mined(embeddings(spark, some + odd)), some + odd)
    other = embeddings(spark, some + odd + [(800, [1.0, 1.0], 1), (900, [1.0] * 4, 8)])
    check(hard_negatives.mined(other), some + odd)


def test_one_vector_everywhere(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 50)
    rows = [(i, [0.25, -0.5, 1.0, 0.125], i % 10) for i in range(600)] + clustered(300, 4, 0.3)[1:]
    rows = [(i, v, label) for i, (_, v, label) in enumerate(rows)]
    check(hard_negatives.mined(embeddings(spark, rows)), rows)


def test_large_numbers(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4) * 500_000], int(rng.integers(10))) for i in range(0, 1500, 5)]
    check(hard_negatives.mined(embeddings(spark, rows)), rows)


def test_repeated_ids_and_empty(spark):
    assert hard_negatives.mined(embeddings(spark, [])).collect() == []
    rows = [(100, [1.0, 0.5], 1)] * 3 + [(5, [1.0, 0.25], 2)] * 2
    check(hard_negatives.mined(embeddings(spark, rows)), rows)


def test_query(spark, folder):
    rows = [tuple(r) for r in table(spark, folder, "embeddings").select("vec_id", "embedding", "label").collect()]
    check(QUERIES["op13_hard_negatives"](spark, folder), rows)
