"""Byte-level BPE against the tokenizer library."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from evenkeel.llm import bpe
from tests.llm.helpers import documents, edge_texts

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def test_round_trip_of_edge_texts(spark, ranks, library):
    docs = documents(spark, edge_texts())
    rows = bpe.round_trip(docs, ranks, public_tokenizers.PATTERN, ["key", "text"], with_ids=True).collect()
    assert len(rows) == len(edge_texts())
    for r in rows:
        ids = library.encode_ordinary(r.text or "")
        assert (r.ids, r.n_tokens) == (ids, len(ids))
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_encode_and_decode_are_inverse(spark, ranks):
    docs = documents(spark, edge_texts())
    tokens = bpe.encode(docs, ranks, public_tokenizers.PATTERN, ["text"])
    for r in bpe.decode(tokens, ranks, ["text"]).collect():
        assert bytes(r.bytes).decode() == (r.text or "")


def test_long_and_repetitive_words(ranks, library):
    coder, rng = bpe.Coder(ranks, public_tokenizers.PATTERN), random.Random(3)
    words = ["a" * 700, "ab" * 300, "é" * 200, "=" * 500, "abababaabba" * 20]
    words += ["".join(rng.choice(a) for _ in range(n)) for a in ("ab", "abc", "eth", "01", "éaß") for n in (3, 64, 65, 150)]
    got = coder.encode_words([w.encode() for w in words])
    assert got == [library.encode_ordinary(w) for w in words]
    assert coder.decode_words(got) == [w.encode() for w in words]


def test_memory_of_words_is_bounded(ranks, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 10)
    coder = bpe.Coder(ranks, public_tokenizers.PATTERN)
    for start in range(0, 100, 20):
        words = {f"w{i}" for i in range(start, start + 20)}
        coder.learn(words)
        coder.forget(words)
        assert set(coder.known) <= words


def test_unknown_id_fails(ranks):
    with pytest.raises(ValueError):
        bpe.Coder(ranks, r"\X").decode_words([[10**6]])


def test_empty_table(spark, ranks):
    assert bpe.round_trip(documents(spark, []), ranks, public_tokenizers.PATTERN, ["doc_id"]).collect() == []
