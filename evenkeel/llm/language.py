"""Language identification with a bit-sliced Bloom filter of n-grams.

One filter row holds one bit per language, in slices of SLICE languages, so a lookup of an n-gram
ANDs K rows and yields the set of all languages that contain it. A text's n-grams are counted per language by popcount of
each bit, the counts are corrected for the filter's false positives, and the largest share wins.

The filter is learned from at most SAMPLE_PER_LANGUAGE documents of a language (whole texts,
chosen by a hash of the id) and holds a language's TOP_GRAMS most frequent n-grams. Its size is
fixed for each slice (4 MB of 64 languages), whatever the number of rows, so it can be sent to every
task; the number of languages is not bounded. All texts are scored, in whole.

Defined results: null texts and texts without a letter are `und` with score 0; a text whose
n-grams are all unknown gets the language with most training documents, score 0; ties go to the
language that is first in the alphabet; an empty training set makes every language `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions.ranking import top_per_group
from evenkeel.llm.common import column, slices, strings
from evenkeel.session import staged

SAMPLE_PER_LANGUAGE = 1000  # up to 1000, Spark keeps the first rows of a group in every task before the shuffle
SLICE = 64  # languages in one column of the filter
SENT_LANGUAGES = 1000  # up to these the ids of the sample are sent to the scan, above they meet it in a shuffle
TOP_GRAMS = 20_000
OWN_SHARE = 0.2  # of the share that an n-gram has in the language where it is most frequent
ROWS = 1 << 19
K = 3
GRAM = 4  # bytes of lower-cased UTF-8, non-letters as spaces

_FOLD = np.full(256, 32, np.uint8)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[128:] = np.arange(128, 256)
_SEEDS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)[:K]


@dataclass
class Filter:
    languages: list[str]
    rows: np.ndarray  # (slices, ROWS), one bit per language; language i is bit i % SLICE of slice i // SLICE
    false_positive: np.ndarray  # per language
    fallback: str


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of the texts as uint32, and how many each text has.

    A space is put before and after each text; windows with more than one space are left out.
    """
    parts = [b" " + t.lower().encode() + b" " for t in texts]
    data = _FOLD[np.frombuffer(b"".join(parts), np.uint8)]
    sizes = np.array([len(p) for p in parts], np.int64)
    if len(data) < GRAM:
        return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
    n = len(data) - GRAM + 1
    code = np.zeros(n, np.uint32)
    spaces = np.zeros(n, np.uint8)
    for i in range(GRAM):
        window = data[i : i + n]
        code |= window.astype(np.uint32) << np.uint32(8 * i)
        spaces += window == 32
    keep = spaces < 2
    ends = np.cumsum(sizes)
    for end in ends[:-1]:  # windows that would cross into the next text
        keep[max(0, end - GRAM + 1) : end] = False
    total = np.concatenate([[0], np.cumsum(keep)])
    bounds = np.minimum(np.concatenate([[0], ends]), n)
    return code[keep], np.diff(total[bounds])


def _rows_of(codes: np.ndarray, seed: np.uint32) -> np.ndarray:
    h = codes * seed
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(8)) & np.uint32(ROWS - 1)


def lookup(rows: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """For each n-gram the bits of all languages that contain it."""
    found = rows[_rows_of(codes, _SEEDS[0])]
    for seed in _SEEDS[1:]:
        found &= rows[_rows_of(codes, seed)]
    return found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts, langs = strings(batch), column(batch, "lang").to_pylist()
        for lang in sorted(set(langs)):
            codes, _ = grams([t for t, x in zip(texts, langs, strict=True) if x == lang])
            found, count = np.unique(codes, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(count)],
                names=["lang", "gram", "n"],
            )


def fit(training: DataFrame, text: str = "text") -> Filter:
    """A filter from rows of doc_id, lang and text; rows without language or text teach nothing."""
    rows = training.select("doc_id", "lang", F.col(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    chosen = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = (  # reads no text; at most SAMPLE_PER_LANGUAGE rows of a language
        rows.select("doc_id", "lang")
        .withColumn("rank", F.row_number().over(chosen)).where(F.col("rank") <= SAMPLE_PER_LANGUAGE)
        .select("doc_id").distinct()
    )
    counts = (
        rows.join(F.broadcast(ids) if len(languages) <= SENT_LANGUAGES else ids, "doc_id").select("lang", "text")
        .mapInArrow(_counted, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    )
    # an n-gram that is far rarer here than elsewhere comes from a foreign passage
    counts = staged(counts, "gram-counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    totals = F.broadcast(totals) if len(languages) <= SENT_LANGUAGES else totals  # one row for each language
    counts = counts.join(totals, "lang").withColumn("share", F.col("n") / F.col("total")).drop("total")
    counts = counts.where(F.col("n") > 1).withColumn("most", F.max("share").over(Window.partitionBy("gram")))
    counts = counts.where(F.col("share") >= OWN_SHARE * F.col("most"))
    top = top_per_group(counts, ["lang"], [F.desc("n"), F.col("gram")], TOP_GRAMS)
    learned = top.groupBy("lang").agg(F.collect_list("gram").alias("grams")).toArrow()  # 160 KB a language
    bits = np.zeros((max(1, -(-len(languages) // SLICE)), ROWS), np.uint64)
    filled = []
    of_language = dict(zip(learned["lang"].to_pylist(), learned["grams"], strict=True))
    for i, lang in enumerate(languages):
        codes = of_language[lang].values.to_numpy().astype(np.uint32) if lang in of_language else np.empty(0, np.uint32)
        mine = np.zeros(ROWS, bool)
        for seed in _SEEDS:
            mine[_rows_of(codes, seed)] = True
        bits[i // SLICE] |= mine.astype(np.uint64) << np.uint64(i % SLICE)
        filled.append(mine.mean())
    width = next(w for w in (8, 16, 32, 64) if min(len(languages), SLICE) <= w)
    fallback = max(languages, key=lambda x: (sizes[x], [-ord(c) for c in x])) if languages else "und"
    return Filter(languages, bits.astype(f"uint{width}"), np.array(filled) ** K, fallback)


def classify(model: Filter, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The language of each text and its share of n-grams, corrected for false positives."""
    codes, sizes = grams(texts)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    shares = np.zeros((len(model.languages), len(texts)))
    some = np.maximum(sizes, 1)
    for i, p in enumerate(model.false_positive):
        if i % SLICE == 0:
            found = lookup(model.rows[i // SLICE], codes)
        bit = found.dtype.type(i % SLICE)
        hits = np.concatenate([[0], np.cumsum((found >> bit) & found.dtype.type(1), dtype=np.int64)])
        shares[i] = np.clip((np.diff(hits[starts]) - sizes * p) / ((1 - p) * some), 0, 1)
    best = shares.argmax(axis=0) if model.languages else np.zeros(len(texts), int)
    names, scores = [], np.zeros(len(texts))
    for j, text in enumerate(texts):
        if not model.languages or not any(c.isalpha() for c in text):
            names.append("und")
        elif shares[best[j], j] <= 0:
            names.append(model.fallback)
        else:
            names.append(model.languages[best[j]])
            scores[j] = shares[best[j], j]
    return names, scores


def identify(docs: DataFrame, model: Filter, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` of `docs` with `lang_pred` and `score`."""
    rows = docs.select(*keep, F.col(text).alias("__text"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            names, scores = classify(model, strings(batch, "__text"))
            kept = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(names, pa.string()), pa.array(scores)], names=[*keep, "lang_pred", "score"]
            )

    fields = [*rows.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return rows.mapInArrow(predict, T.StructType(fields))
