"""The prefix trie against one built in Python from whole sequences."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from evenkeel.llm import prefix_trie
from evenkeel.llm.common import table
from evenkeel.llm.queries import QUERIES

SCHEMA = "conv_id bigint, turn bigint, role string, text string, node string, seq string, pos string, length string, begun string"


def conversations(spark, rows, partitions=3):
    df = spark.createDataFrame([(*r, None, None, None, None, None) for r in rows], SCHEMA)
    return df.repartition(partitions) if rows else df


def tie(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def plain(rows):
    """conv_id, depth -> all other columns, from every prefix of every rebuilt conversation."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, tie(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * words + sum(saved[q] for q in children[p])
    found = {}
    for p, m in members.items():
        ends = ",".join(str(c) for c in m if whole[c] == p)
        parent = members[p[:-1]][0] if p else None
        sha = hashlib.sha256(ends.encode()).hexdigest()
        found[m[0], len(p)] = (parent, len(m), len(children[p]), leaves[p], saved[p], sha)
    return found


def check(df, rows):
    got = df.collect()
    assert {(r.conv_id, r.depth): tuple(r)[2:] for r in got} == plain(rows)
    assert len(got) == len({(r.conv_id, r.depth) for r in got})


def branching(seed, n, longest, ids=None):
    """Conversations that share beginnings of all lengths."""
    rng = random.Random(seed)
    rows, known = [], [[]]
    for c in ids or range(n):
        start = rng.choice(known)
        turns = start[: rng.randint(0, len(start))] + [f"t{rng.randint(0, 3)} x" for _ in range(rng.randint(0, longest // 2))]
        turns = turns[:longest] or ["t0"]
        known.append(turns)
        rows += [(c, i, "user" if i % 2 else "assistant", t) for i, t in enumerate(turns)]
    return rows


@pytest.mark.parametrize("block, longest", [(64, 12), (2, 12), (2, 40), (4, 70), (1, 9)])
def test_against_plain(spark, monkeypatch, block, longest):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    rows = branching(block + longest, 70, longest)
    check(prefix_trie.conversation_nodes(conversations(spark, rows)), rows)


def test_long_conversations(spark):
    turns = ["same words here"] * 900
    rows = [(c, i, "u", t if i < 100 + 150 * c else f"{c} {i}") for c in range(5) for i, t in enumerate(turns)]
    check(prefix_trie.conversation_nodes(conversations(spark, rows)), rows)


def test_edges(spark):
    rows = [
        (None, 1, "user", "a"), (None, None, None, None), (1, None, None, None), (1, 0, "user", "a b"), (1, 0, "user", "a b"),
        (1, 0, "user", "c"), (-5, 3, "x", "a"), (-5, 2, "x", " "), (-25, 2, "x", " "), (0, -1, "user", None), (0, 7, "", "a b"),
        (2, 0, "user", ""), (3, 0, "user", "w " * 30_000), (3, 1, "u1:", "x"), (3, 1, "u", "1:x"), (20, 0, None, "z"),
        (2**62, 0, "user", "\x0b\x1f"), (40, 0, "a", "b"), (40, 0, "a", "b"), (41, 0, "a", "b"),
    ]
    check(prefix_trie.conversation_nodes(conversations(spark, rows)), rows)


def test_hot_conversation_first_turn_and_copies(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 8)
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    monkeypatch.setattr(prefix_trie, "HEAVY", 20)
    rows = [(7, i, "user", f"{i // 3}") for i in range(700)]
    rows += [(c, i, "u", "hello" if i == 0 else "again" if c % 3 else f"{c}") for c in range(10, 310) for i in range(6)]
    check(prefix_trie.conversation_nodes(conversations(spark, rows)), rows)


def test_empty_and_turnless(spark):
    assert prefix_trie.conversation_nodes(conversations(spark, [])).collect() == []
    lone = [(c, 0, "u", "x") for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 > 0]  # base 20 is absent
    check(prefix_trie.conversation_nodes(conversations(spark, lone)), lone)


def test_query(spark, folder):
    rows = [tuple(r) for r in table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").collect()]
    check(QUERIES["op11_prefix_trie"](spark, folder), rows)
