"""Greedy string tiling and decontamination."""

import random

import numpy as np

from evenkeel.llm import decontaminate as D
from tests.llm.helpers import documents, edge_texts, prose


def slow_tiles(item, text, least):
    """Greedy tiling by trying every pair of positions for the longest match, again and again."""
    a, b, covered = [False] * len(item), [False] * len(text), 0
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and not a[i + n] and not b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < least:
            return covered
        n, i, j = best
        a[i : i + n] = b[j : j + n] = [True] * n
        covered += n


def test_tiles_cover_what_greedy_search_covers():
    rng = random.Random(8)
    for _ in range(150):
        item = np.array([rng.randint(0, 3) for _ in range(rng.randint(3, 25))])
        text = np.array([rng.randint(0, 3) for _ in range(rng.randint(3, 40))])
        tiles = D.tile(item, text, 3)
        for i, j, n in tiles:
            assert n >= 3 and (item[i : i + n] == text[j : j + n]).all()
        used = sorted(p for i, _, n in tiles for p in range(i, i + n))
        assert len(used) == len(set(used))
        # ties between equally long matches may be taken in another order
        assert abs(len(used) - slow_tiles(item.tolist(), text.tolist(), 3)) <= 6


def test_leaks(spark):
    items = [prose(1000 + i, 40) for i in range(20)] + [None, "", "two words", prose(99, 5)]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item_id bigint, text string, doc_id string")
    words = items[3].split()
    edited = [w if i % 10 else "changed" for i, w in enumerate(items[4].split())]
    texts = [
        f"{prose(50, 300)} {items[0]} {prose(51, 300)}",
        f"{prose(52, 80)} {' '.join(words[20:])} {prose(53, 20)} {' '.join(words[:20])}",  # reordered
        " ".join(edited).upper().replace(" ", ", "),
        f"{prose(54, 80)} {' '.join(items[5].split()[:12])}",  # too little of it
        prose(60, 2000), "two words", "two words more", f"{items[7]} {items[8]}", items[23], *edge_texts(),
    ]
    docs = documents(spark, texts)
    found = {(r.doc_id, r.item_id) for r in D.contaminated(docs, benchmark).collect()}
    assert found == {(0, 0), (1, 3), (2, 4), (5, 22), (7, 7), (7, 8), (8, 23)}
    blocks = {(r.doc_id, r.item_id) for r in D.contaminated(docs, benchmark, block_bytes=4000).collect()}
    assert blocks == found
    kept = D.clean(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == len(texts) - len({d for d, _ in found})


def test_rows_without_and_with_the_same_id(spark):
    item, other = prose(1000, 40), prose(1, 60)
    benchmark = spark.createDataFrame([(0, item)], "item_id bigint, text string")
    rows = [(None, f"{other} {item}", "x", None, None), (None, other, "x", None, None), (5, item, "x", None, None), (5, other, "x", None, None)]
    docs = documents(spark, [*rows, None])
    assert sorted(str(r.doc_id) for r in D.contaminated(docs, benchmark).collect()) == ["5", "None"]
    kept = D.clean(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.select("doc_id", "text").collect() if r.text) == [("5", other), ("None", other)]
    assert kept.count() == 3


def test_plan_does_not_grow_with_the_benchmark(spark):
    docs = documents(spark, [prose(i, 30) for i in range(20)])
    sizes = []
    for n in (40, 160):
        benchmark = spark.createDataFrame([(i, prose(2000 + i, 40)) for i in range(n)], "item_id bigint, text string")
        assert len(list(D._blocks(benchmark, "text", 8000))) > 2
        found = D.contaminated(docs, benchmark, block_bytes=8000)
        sizes.append(len(found._jdf.queryExecution().optimizedPlan().toString().splitlines()))
    assert sizes[0] == sizes[1]


def test_empty_tables(spark):
    docs = documents(spark, ["a b c d e f"])
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert D.contaminated(docs, none).collect() == []
    assert D.contaminated(documents(spark, []), none).collect() == []
