"""Shards against a plain longest-processing-time schedule."""

import heapq
import random
import zlib
from collections import Counter, defaultdict

import pytest

from evenkeel.llm import sharding
from evenkeel.llm.common import table
from evenkeel.llm.queries import QUERIES
from tests.llm.helpers import documents, edge_texts, prose


def loads_of_plain_schedule(texts, shards):
    sizes = Counter()
    for t in texts:
        sizes[t or ""] += len((t or "").encode()) + 16
    heap = [0] * shards
    for size in sorted(sizes.values(), reverse=True):
        heapq.heapreplace(heap, heap[0] + size)
    return sorted(heap)


def check(rows, given, shards):
    """Every row once with its own size and hash, groups together, slots gapless; the shards' loads."""
    expected = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in given)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == expected
    slots, loads, homes = defaultdict(list), Counter(), defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
        homes[r.text_crc32, r.size].add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values())
    return sorted(loads[s] for s in range(shards))


def test_edges_and_clashing_columns(spark):
    docs = documents(spark, edge_texts()).selectExpr("*", "1 AS shard", "2 AS part", "3 AS at", "'x' AS doc", "4 AS size", "5 AS slot")
    given = [(r.doc_id, r.text) for r in docs.collect()]
    for shards in (1, 3, 40):
        loads = check(sharding.text_shards(docs, shards).collect(), given, shards)
        assert loads == loads_of_plain_schedule([t for _, t in given], shards)


@pytest.mark.parametrize("items", [sharding.ITEMS, 60])
def test_balance_with_a_hot_group(spark, items):
    rng = random.Random(4)
    texts = [prose(i % 400, rng.randint(1, 60)) for i in range(900)] + [prose(7, 40)] * 450
    docs = documents(spark, texts, 5)
    loads = check(sharding.text_shards(docs, 8, items=items).collect(), list(enumerate(texts)), 8)
    plain = loads_of_plain_schedule(texts, 8)
    if items == sharding.ITEMS:
        assert loads == plain
    else:  # groups go through bins, so single shards differ by about a bin
        assert max(loads) <= max(max(plain), sum(loads) / 8 * 1.2)


def test_structure_is_kept(spark):
    docs = documents(spark, ["a", "b", None])
    path = sharding.write(docs, 2, [docs.lang], sharding.F.lit(1))
    rows = sharding.read(spark, path)
    assert {r.doc for r in rows.collect()} == set(docs.collect()) and rows.select("shard").distinct().count() == 1


def test_empty_table(spark):
    assert sharding.text_shards(documents(spark, []), 40).collect() == []


def test_query(spark, folder):
    given = [(r.doc_id, r.text) for r in table(spark, folder, "documents").collect()]
    loads = check(QUERIES["op12_sharding"](spark, folder).collect(), given, 40)
    assert loads == loads_of_plain_schedule([t for _, t in given], 40)
