"""Exact duplicates against grouping in Python."""

import hashlib
import random
import re

import numpy as np
import pytest

from evenkeel.llm import exact_dedup, golomb
from tests.llm.helpers import documents, edge_texts, prose


def normal(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_golomb_round_trip(n):
    rng = np.random.default_rng(n)
    values = np.unique(rng.integers(5 << 40, 6 << 40, n, dtype=np.uint64))
    data = golomb.encode(values, 5 << 40, 6 << 40)
    assert (golomb.decode(data, 5 << 40) == values).all()
    if n == 1000:
        assert len(data) * 8 < n * (40 - np.log2(n) + 3)


def test_groups(spark):
    rng = random.Random(2)
    texts = [*edge_texts(), *[prose(rng.randint(0, 9), 12).replace(" ", rng.choice([" ", "  ", "\n"])) for _ in range(200)]]
    docs = documents(spark, texts, 5)
    rows = exact_dedup.duplicate_groups(docs).collect()
    members = {}
    for r in docs.collect():
        members.setdefault(normal(r.text), []).append(r.doc_id)
    assert len(rows) == len(texts)
    for text, ids in members.items():
        sha = hashlib.sha256(text.encode()).hexdigest()
        mine = [r for r in rows if r.text_sha256 == sha]
        known = [i for i in ids if i is not None]
        assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in mine)
        assert {r.keep_id for r in mine} == {min(known) if known else None}
        assert {r.group_size for r in mine} == {len(ids)}
        assert sum(r.kept for r in mine) == 1


def test_drop_keeps_columns_and_rereads(spark, tmp_path):
    docs = documents(spark, edge_texts(), 4)
    docs.write.parquet(str(tmp_path / "d"))
    stored = spark.read.parquet(str(tmp_path / "d"))
    kept = exact_dedup.drop_duplicates(stored, reread=True)
    assert kept.schema == stored.schema
    found = [normal(r.text) for r in kept.collect()]
    assert sorted(found) == sorted({normal(r.text) for r in stored.collect()})


def test_one_text_everywhere(spark):
    rows = exact_dedup.duplicate_groups(documents(spark, ["same text"] * 3000, 7)).collect()
    assert {(r.keep_id, r.group_size) for r in rows} == {(0, 3000)} and sum(r.kept for r in rows) == 1


def test_empty_table(spark):
    assert exact_dedup.duplicate_groups(documents(spark, [])).collect() == []
    assert exact_dedup.drop_duplicates(documents(spark, [])).collect() == []


@pytest.mark.parametrize("splits", [(2, 8), (8, 2)])
def test_other_splits_between_scans(spark, tmp_path, splits):
    """The rows are read by other tasks than they were hashed by, as after the loss of executors."""
    texts = [prose(i % 900, 30) for i in range(1200)] + ["same"] * 300 + [(5, "same", "x", None, None)] * 3
    documents(spark, texts, 8).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    key, before = "spark.sql.files.minPartitionNum", spark.conf.get("spark.sql.files.minPartitionNum", None)
    try:
        spark.conf.set(key, splits[0])
        kept, groups = exact_dedup.drop_duplicates(docs, reread=True), exact_dedup.duplicate_groups(docs, reread=True)
        spark.conf.set(key, splits[1])
        found, marked = kept.collect(), groups.collect()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    first = {}
    for r in docs.collect():
        first[normal(r.text)] = min(r.doc_id, first.get(normal(r.text), r.doc_id))
    assert sorted((normal(r.text), r.doc_id) for r in found) == sorted(first.items())
    assert sorted(r.doc_id for r in marked if r.kept) == sorted(first.values()) and len(marked) == len(texts)


@pytest.mark.parametrize("bits", [7, 12])
def test_crowded_filter(spark, monkeypatch, bits):
    """Rows that only share the beginning of a suspect's hash."""
    monkeypatch.setattr(exact_dedup, "FILTER_BITS", bits)
    texts = [prose(i % 500, 12) for i in range(800)]
    docs = documents(spark, texts, 5)
    assert sorted(r.doc_id for r in exact_dedup.drop_duplicates(docs).collect()) == list(range(500))
    assert sorted(r.doc_id for r in exact_dedup.duplicate_groups(docs).collect() if r.kept) == list(range(500))


def test_hot_text_without_ids(spark):
    rows = [(None, "same", str(i % 3), None, None) for i in range(400)] + [prose(i, 9) for i in range(50)]
    docs = documents(spark, rows, 6)
    assert exact_dedup.drop_duplicates(docs).where("text = 'same'").count() == 1
    marked = exact_dedup.duplicate_groups(docs).where("keep_id IS NULL").collect()
    assert len(marked) == 400 and sum(r.kept for r in marked) == 1 and {r.group_size for r in marked} == {400}
