"""Directly addressable codes and the files of token ids."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from evenkeel.llm import dac
from tests.llm.helpers import documents, edge_texts, prose


@pytest.fixture(scope="module")
def vocabulary():
    with open(public_tokenizers.path("word_bpe_49k.json")) as file:
        return file.read()


@pytest.fixture(scope="module")
def library(vocabulary):
    return Tokenizer.from_str(vocabulary)


@pytest.mark.parametrize("top", [1, 200, 300, 50_000, 2**31])
def test_codes(top):
    rng = np.random.default_rng(top)
    ids = rng.integers(0, top, 3000).astype(np.uint32)
    levels = dac.pack(ids)
    assert (dac.read(levels, 0, len(ids)) == ids).all()
    for at in (0, 1, 511, 512, 513, 1024, 2999):
        assert dac.access(levels, at) == ids[at]
    for low, high in ((0, 0), (7, 8), (500, 1700), (1023, 1025), (2990, 3000)):
        assert (dac.read(levels, low, high) == ids[low:high]).all()


def test_files(spark, vocabulary, library, monkeypatch):
    texts = [*edge_texts()[:14], *[prose(i, 20) for i in range(50)], "see <|endoftext|> now", "<|startoftext|>" * 3, "a<|EndOfText|>"]
    docs = documents(spark, texts)
    rows = {r.doc_id: r for r in dac.documents(spark, dac.write(docs, vocabulary, 2)).collect()}
    at = 0
    for i, text in enumerate(texts):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_repeated_and_missing_ids(spark, vocabulary):
    docs = documents(spark, [(None, "b c", None, None, None), (None, "a", None, None, None), *[(5, "t" * i, None, None, None) for i in range(9)]])
    rows = sorted(dac.documents(spark, dac.write(docs, vocabulary, 2)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None] * 2 + [5] * 9
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows]])[:-1].tolist()


PARTS = [
    "a", "É", "é", "'s", "'S", "don't", ".", "...", "?!", '"', "1", "22", "ΑΣ.", " ", "\n", "\xa0", "日本", "<|endoftext|>", "<|startoftext|>",
    "<|ENDOFTEXT|>", "<|", "İ", "ß", "\u0301", "×", "÷", "ª.", "\x0b", "\x1f", "\x85", "\u3000", "word", "Words,", "ﬁ", "e\u0301:", "K", "x" * 70, "ÿ;",
]


def same(coder, library, texts):
    ids, lengths = coder.encode(pa.array(texts, pa.string()), 2)
    expected = [[*e.ids, 2] for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == expected


def test_pieces_give_the_ids_of_whole_texts(vocabulary, library, monkeypatch):
    rng = random.Random(1)
    monkeypatch.setattr(dac, "WORDS", 40)
    coder = dac.Words(vocabulary)
    for n in (1, 7, 300, 3000):
        texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25))) for _ in range(n)]
        same(coder, library, [*texts, None, "", " "])
    same(coder, library, [""])


def test_every_character_beside_a_word(vocabulary, library):
    coder = dac.Words(vocabulary)
    some = [chr(c) for c in [*range(1, 0x3000), *range(0xF900, 0xFFFE), *range(0x1F600, 0x1F650)] if not 0xD800 <= c < 0xE000]
    same(coder, library, [f"word{c}word {c}. {c}" for c in some])
    same(coder, library, [f"Caf{c}. {c}{c},{c}A" for c in some])


def test_empty_table(spark, vocabulary):
    assert dac.documents(spark, dac.write(documents(spark, []), vocabulary, 2)).collect() == []
