"""The similarity join against all pairs."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from evenkeel.llm import ngram_join
from evenkeel.llm.components import components
from tests.llm.helpers import documents, edge_texts, prose


def grams(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]
    return {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def expected(rows):
    sets = [(d, grams(t)) for d, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for g in s:
            holders[g].append(i)
    done = set()
    for mine in holders.values():
        for i in mine:
            for j in mine:
                if i < j and (i, j) not in done:
                    done.add((i, j))
                    a, b = sets[i][1], sets[j][1]
                    if 100 * len(a & b) >= 85 * len(a | b):
                        x, y = find(i), find(j)
                        parent[max(x, y)] = min(x, y)
    smallest = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            smallest[find(i)] = min(smallest.get(find(i), d), d)
    return sorted(str((d, len(s), smallest.get(find(i), d))) for i, (d, s) in enumerate(sets))


def near(seed, base, n, rate):
    rng = random.Random(seed)
    words = base.split()
    return [" ".join(w if rng.random() > rate else w[::-1] for w in words) for _ in range(n)]


def check(spark, texts):
    docs = documents(spark, texts, 4)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in ngram_join.similar_groups(docs).collect())
    assert got == expected(rows)


def test_edge_cases(spark):
    check(spark, [*edge_texts(), "A b C d", "a B c D", "a b c", "a b c d e"])


def test_random_families(spark):
    texts = [prose(i, 40) for i in range(30)]
    for i, n, rate in ((100, 30, 0.01), (101, 30, 0.03), (102, 20, 0.002)):
        texts += near(i, prose(i, 90), n, rate)
    passage = prose(7, 60)
    texts += [f"{prose(500 + i, 60)} {passage} {prose(900 + i, 60)}" for i in range(90)]
    check(spark, texts)


def test_long_columns_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", 16)
    check(spark, [*near(5, prose(55, 80), 150, 0.012), *near(6, prose(56, 80), 100, 0.002), *[prose(i, 30) for i in range(20)]])


def test_one_of_each(spark):
    docs = documents(spark, [prose(1, 50), prose(2, 50), prose(1, 50) + " end", None])
    kept = ngram_join.one_of_each(docs)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 3] and kept.columns == docs.columns


def test_rows_without_and_with_the_same_id(spark):
    a, b, c = prose(1, 50), prose(2, 50), prose(3, 50)
    rows = [(None, a, "x", None, None), (5, a, "x", None, None), (5, b, "x", None, None), (9, b + " end", "x", None, None),
            (3, a + " end", "x", None, None), (None, c, "x", None, None), (None, c + " end", "x", None, None)]
    docs = documents(spark, rows)
    found = sorted(str((r.doc_id, r.component_id)) for r in ngram_join.similar_groups(docs).collect())
    assert found == sorted(map(str, [(None, 3), (5, 3), (5, 5), (9, 5), (3, 3), (None, None), (None, None)]))
    kept = ngram_join.one_of_each(docs).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept if r.doc_id is not None) == sorted([(3, a + " end"), (5, b)])
    assert len(kept) == 3  # and one of the two without an id


def test_sets_with_one_key(spark, monkeypatch):
    """Keys of few bits agree by chance; they are made anew until they do not."""
    monkeypatch.setattr(ngram_join, "KEY_BITS", 11)
    check(spark, [prose(i % 50, 30) for i in range(60)])


@pytest.mark.parametrize("n", [1, 4, 5])
def test_ngrams_of_texts(n):
    texts = ["", None, "a", "A a\tB", "a b c d e f g", "\x0b\x0c x y", "é É ß", *[prose(i, 40) for i in range(5)], "a b c d a b c d a b c d"]
    found = ngram_join.ngrams_of(pa.array(texts, pa.string()), n)
    for text, grams_found in zip(texts, found, strict=True):
        words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]
        expected_grams = {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()
        assert len(grams_found) == len(expected_grams) and (np.diff(grams_found.astype(np.int64)) > 0).all()
        alone = ngram_join.ngrams_of(pa.array([text], pa.string()), n)[0]
        assert (alone == grams_found).all()


def test_empty_table(spark):
    assert ngram_join.similar_groups(documents(spark, [])).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(90)] + [(i, i + 1) for i in range(500, 560)]
    edges += [(None, 1), (7, 7)]
    root = {}
    for a, b in edges:
        if a is not None and a != b:
            ra, rb = root.setdefault(a, {a}), root.setdefault(b, {b})
            if ra is not rb:
                ra |= rb
                for x in rb:
                    root[x] = ra
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {x: min(s) for x, s in root.items()}
