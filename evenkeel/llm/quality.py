"""Quality score by attention-based multiple-instance learning.

A document is a bag of passages: its lines, long ones cut every PASSAGE bytes. Each passage is
encoded from byte-class statistics and repetition, a gated attention network weighs the
passages, and the weighted mean is scored. Only documents have labels; the weights of the
passages are learned from them.

The model is fitted on the driver from at most SAMPLE labelled documents with at most PASSAGES passages, chosen by a hash of
the id; every passage of every document is scored.

Defined results: null counts as the empty text, a bag of one empty passage; without labelled
rows of both classes the score is the mean label (0.5 without any). Only the text enters a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import column, slices, strings

SAMPLE = 6000
PASSAGES = 150_000  # of the sample; their features are what the driver holds, about 1 KB each
PASSAGE = 480
HIDDEN, GATE = 32, 16
EPOCHS, BATCH, RATE, DECAY = 14, 64, 4e-3, 1e-4
PART = 1 << 20  # characters scored at once, unless one text is longer

# Classes of bytes: what kind of character, not which one.
_CLASS = np.zeros(256, np.uint8)
for _kind, _members in enumerate(
    (b" ", b"aeiou", b"bcdfghjklm", b"npqrstvwxyz", b"AEIOU", b"BCDFGHJKLMNPQRSTVWXYZ", b"0123456789", b".",
     b",;:", b"!?", b"%*#$&@^~=+", b"|<>[]{}()/\\", b"-_'\"`", b"\t\r\x0b\x0c\n"), start=1,
):
    _CLASS[list(_members)] = _kind
_CLASS[128:] = 15
CLASSES = 16
FEATURES = CLASSES + CLASSES * CLASSES + 5
_POWERS = (np.uint64(0x100000001B3) ** np.arange(PASSAGE + 1, dtype=np.uint64)).astype(np.uint64)


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and how many passages each text has."""
    parts = [t.encode() + b"\n" for t in texts]
    data = np.frombuffer(b"".join(parts), np.uint8)
    n, ends = len(data), np.cumsum([len(p) for p in parts])
    line = np.concatenate([[0], np.flatnonzero(data == 10) + 1])
    line = line[line < n]
    pieces = -(-np.diff(np.append(line, n)) // PASSAGE)
    first = np.repeat(line, pieces)
    start = first + PASSAGE * (np.arange(len(first)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    size = np.diff(np.append(start, n))
    counts = np.diff(np.searchsorted(start, np.concatenate([[0], ends])))
    owner = np.repeat(np.arange(len(start), dtype=np.int32), size)
    kind = _CLASS[data]
    single = np.bincount(owner * CLASSES + kind, minlength=len(start) * CLASSES).reshape(-1, CLASSES)
    pair_of = owner[:-1].astype(np.int64) * (CLASSES * CLASSES) + kind[:-1].astype(np.int64) * CLASSES + kind[1:]
    pair = np.bincount(pair_of[owner[:-1] == owner[1:]], minlength=len(start) * CLASSES * CLASSES).reshape(-1, CLASSES * CLASSES)

    # words as hashes: how often a word repeats one of the words just before it
    blank = (kind == 1) | (kind == 14)
    begins = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    in_word = np.arange(n, dtype=np.int64) - np.maximum.accumulate(np.where(blank, np.arange(n), -1)) & 255
    value = np.where(blank, np.uint64(0), (data.astype(np.uint64) + np.uint64(1)) * _POWERS[in_word])
    word = np.add.reduceat(value, begins) if len(begins) else np.empty(0, np.uint64)
    again = np.zeros(len(word), bool)
    holder = owner[begins]
    text_of = np.repeat(np.arange(len(texts)), counts)[holder]
    for back in (1, 2, 3, 4):
        again[back:] |= (word[back:] == word[:-back]) & (text_of[back:] == text_of[:-back])
    words = np.bincount(holder, minlength=len(start))
    repeats = np.bincount(holder, weights=again, minlength=len(start)) / np.maximum(words, 1)
    # a passage that occurs again in the same text
    whole = np.add.reduceat(value * np.uint64(31), start)
    bag = np.repeat(np.arange(len(texts), dtype=np.uint64), counts)
    _, index, copies = np.unique(whole * np.uint64(0x9E3779B97F4A7C15) + bag, return_inverse=True, return_counts=True)

    bytes_ = np.maximum(size, 1)[:, None]
    features = np.empty((len(start), FEATURES), np.float32)
    features[:, :CLASSES] = np.sqrt(single / bytes_)
    features[:, CLASSES:-5] = np.sqrt(pair / bytes_)
    features[:, -5] = repeats
    features[:, -4] = copies[index] > 1
    features[:, -3] = np.log1p(size) / 6
    features[:, -2] = np.log1p(words) / 5
    features[:, -1] = words / np.maximum(size, 1)
    return features, counts


@dataclass
class Model:
    weights: dict[str, np.ndarray] | None
    mean: np.ndarray | None
    scale: np.ndarray | None
    constant: float = 0.5


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts, axis=0)


def _forward(w: dict[str, np.ndarray], x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    starts = np.cumsum(counts) - counts
    h = np.tanh(x @ w["W"] + w["b"])
    v, u = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
    logit = (v * u) @ w["a"]
    raised = np.exp(logit - np.repeat(np.maximum.reduceat(logit, starts), counts))
    attention = raised / np.repeat(_sums(raised, starts), counts)
    z = _sums(h * attention[:, None], starts)
    return {"h": h, "v": v, "u": u, "attention": attention, "z": z, "p": 1 / (1 + np.exp(-(z @ w["o"] + w["c"])))}


def _gradients(w: dict[str, np.ndarray], x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    f, starts = _forward(w, x, counts), np.cumsum(counts) - counts
    error = (f["p"] - y) / len(y)
    per_bag = np.repeat(error, counts)[:, None] * w["o"]
    towards = (per_bag * f["h"]).sum(axis=1)  # of each passage's weight
    d_logit = f["attention"] * (towards - np.repeat(_sums(f["attention"] * towards, starts), counts))
    d_v = d_logit[:, None] * w["a"] * f["u"] * (1 - f["v"] ** 2)
    d_u = d_logit[:, None] * w["a"] * f["v"] * f["u"] * (1 - f["u"])
    d_h = (per_bag * f["attention"][:, None] + d_v @ w["V"].T + d_u @ w["U"].T) * (1 - f["h"] ** 2)
    return {
        "W": x.T @ d_h, "b": d_h.sum(axis=0), "V": f["h"].T @ d_v, "U": f["h"].T @ d_u,
        "a": (f["v"] * f["u"]).T @ d_logit, "o": f["z"].T @ error, "c": error.sum(keepdims=True),
    }


def train(bags: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Model:
    """Adam over minibatches of bags; standardised features, which replace those in the list `bags` one by one."""
    if len(set(labels.tolist())) < 2:
        return Model(None, None, None, float(labels.mean()) if len(labels) else 0.5)
    n = sum(len(b) for b in bags)
    mean = (sum(b.sum(axis=0, dtype=np.float64) for b in bags) / n).astype(np.float32)
    scale = (np.sqrt(sum(((b - mean) ** 2).sum(axis=0, dtype=np.float64) for b in bags) / n) + 0.02).astype(np.float32)
    for i, b in enumerate(bags):
        bags[i] = ((b - mean) / scale).astype(np.float32)
    rng = np.random.default_rng(seed)
    shapes = {"W": (FEATURES, HIDDEN), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "a": (GATE,), "o": (HIDDEN,)}
    w = {k: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32) for k, s in shapes.items()}
    w |= {"b": np.zeros(HIDDEN, np.float32), "c": np.zeros(1, np.float32)}
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            counts = np.array([len(bags[i]) for i in some])
            g = _gradients(w, np.concatenate([bags[i] for i in some]), counts, labels[some].astype(np.float32))
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for k in w:
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
                move = (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                w[k] -= (rate * (move + DECAY * w[k])).astype(np.float32)
    return Model(w, mean, scale)


def score(model: Model, texts: list[str]) -> np.ndarray:
    if model.weights is None:
        return np.full(len(texts), model.constant)
    x, counts = passages(texts)
    return _forward(model.weights, ((x - model.mean) / model.scale).astype(np.float32), counts)["p"].astype(np.float64)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        x, counts = passages(strings(batch))
        cuts = np.cumsum(counts)[:-1]
        bags = [b.astype(np.float16).tobytes() for b in np.split(x, cuts)]
        yield pa.RecordBatch.from_arrays(
            [column(batch, "key"), column(batch, "quality"), pa.array(bags, pa.binary())], names=["key", "quality", "bag"]
        )


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, passages_most: int = PASSAGES) -> Model:
    """A model from the texts of `docs` and `labels` of (doc_id, quality 0 or 1); other rows teach nothing.

    Only labels whose crc32(doc_id as text) mod 3 is not 1 are used, at most `sample` of them and at most `sample`
    documents, in the order of a hash, as far as they have `passages_most` passages together.
    """
    usable = labels.where("quality IN (0, 1) AND crc32(string(doc_id)) % 3 <> 1")
    chosen = (  # `sample` rows without text
        usable.select("doc_id", F.col("quality").cast("int").alias("quality"), F.xxhash64("doc_id").alias("key"))
        .orderBy("key", "doc_id", "quality").limit(sample)
    )
    # no text has more passages than `most`; rows are told apart by the hash of their text
    most = F.floor(F.octet_length("text") / PASSAGE) + F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    given = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select(
        "key", "quality", "text", F.xxhash64("text").alias("hash"), most.alias("most")
    )
    order = ["key", "quality", "hash"]
    sizes = given.select(*order, "most").orderBy(*order).limit(sample).toPandas().drop_duplicates(order)
    taken, total = [], 0
    for row in sizes.itertuples(index=False):
        if total + row.most <= passages_most:
            total += row.most
            taken.append((row.key, row.quality, row.hash))
    kept = docs.sparkSession.createDataFrame([tuple(map(int, t)) for t in taken], "key bigint, quality int, hash bigint")
    bags = (
        given.join(F.broadcast(kept), order).dropDuplicates(order).select("key", "quality", "text")
        .mapInArrow(_features, "key bigint, quality int, bag binary").toPandas()
        .sort_values(["key", "quality", "bag"])
    )
    classes, stored = bags["quality"].to_numpy(), bags["bag"].tolist()
    del bags
    decoded: list[np.ndarray] = []
    while stored:  # from the end, so that each is freed when it has been decoded
        decoded.append(np.frombuffer(stored.pop(), np.float16).reshape(-1, FEATURES).astype(np.float32))
    decoded.reverse()
    return train(decoded, classes)


def with_score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """`docs` with the score of the whole text. Only the text goes to Python, and only the score comes back."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out, part, size = [], [], 0
            for t in texts:
                part.append(t or "")
                size += len(part[-1])
                if size > PART:
                    out.append(score(model, part))
                    part, size = [], 0
            if part:
                out.append(score(model, part))
            yield pd.Series(np.concatenate(out) if out else np.empty(0))

    return docs.withColumn(into, scored(F.col(text)))
