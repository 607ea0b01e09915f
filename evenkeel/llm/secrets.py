"""Secret scan: rules, and a character convolutional network over every candidate and its context.

The rules of the base kinds find the spans that are always reported. The network looks at every
candidate, which is any unbroken run of at least 6 token characters, with the text around it, and at long candidates
piece by piece to their end. It is trained on labelled findings: values that a rule has found against candidates
that none has. Rules only find values of few forms beside a keyword, so each finding is also shown in other
places of its document, without the keyword, and with its value written anew in other alphabets and
lengths; words of the documents, joined as identifiers, dates and numbers are, stand against those.

Every document teaches. The different windows of all findings, and of all that stands against them, are dealt by a hash
into blocks of about BLOCK examples. In each of ROUNDS rounds every block goes on from the common network for PASSES
passes over its examples, and the mean of all blocks, in exact decimals, is the next common network. A block depends
on the examples alone, not on tasks or partitions, so a fit gives the same network again. The driver holds
the common network and counts of logits, of which there are few, as they are multiples of 1 / LOGIT_STEPS within LOGIT_MOST.

There are two kinds of context, behind a sign of assignment and elsewhere. The logits are calibrated on all findings
kept back, of which none shows its keyword, and for each context the threshold is the highest one
that still recalls RECALL of those, whatever the precision; both are kept with the network. Candidates from the threshold
on that no rule covers are reported as kind `cnn`.

Bounds of the candidates: values of less than 6 characters are not looked at, a dot ends a run, and away from a sign of
assignment neither are digits alone, as in numbers of cards and telephones, nor letters in one case only (or with one
capital in front, as words have).

Defined results: a null or empty text has no spans; positions are code points, the end is
exclusive; with fewer than LEAST different findings of either class there is no network and only the
rules report. Every text is learned from and scanned whole.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.llm.common import slices, strings
from evenkeel.session import staged

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
# A run that is too short fails at every place in it, so the least length may stand in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "cnn")
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")  # of ASSIGN, which is slow; without any it finds nothing
PART = 1 << 20  # characters that are told apart at once
LENGTH = 6  # the least of an assigned value, and of a candidate

FORMS = 12  # values written anew for each finding
LEAST = 8
RECALL = 0.98

BEFORE, INSIDE, AFTER = 20, 48, 8
WIDTH = BEFORE + INSIDE + AFTER
EMBED, FILTERS, KERNEL, BATCH, RATE = 8, 24, 5, 64, 5e-3
BLOCK = 16_384  # examples that are trained on at once; a task holds one block
ROUNDS, PASSES = 5, 2
LOGIT_STEPS, LOGIT_MOST = 256, 32
# Alphabet of the network: 0 is nothing, 1 any other character.
_CODE = np.ones(128, np.int64)
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-.:\"' \n@"):
    _CODE[ord(_c)] = _i + 2
SYMBOLS = int(_CODE.max()) + 1
SHAPES = {"E": (SYMBOLS, EMBED), "F": (KERNEL * EMBED, FILTERS), "f": (FILTERS,), "o": (2 * FILTERS,), "c": (1,)}
_ENDS = np.cumsum([int(np.prod(s)) for s in SHAPES.values()])

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) by start, then kind as listed."""
    lower = text.lower()
    may = ASSIGN.finditer(text) if any(k in lower for k in KEYWORDS) else ()
    found = [(m.start(), m.end(), "assign") for m in may if m.end(2) - m.start(2) >= LENGTH]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


_SIGN = re.compile(r"""[:=]\x20*["']?\Z""")


def assigned(text: str, start: int) -> bool:
    """Whether a sign of assignment stands before a place."""
    return _SIGN.search(text[max(0, start - 4) : start]) is not None


# Kinds of characters as bits. The runs of candidates are of the first four.
_UPPER, _LOWER, _DIGIT, _OTHER, _EQUALS = 1, 2, 4, 8, 16
_KIND = np.zeros(129, np.uint8)  # 128 stands for all that follow
for _members, _bits in (("ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER), ("abcdefghijklmnopqrstuvwxyz", _LOWER), ("0123456789", _DIGIT),
                        ("+/_-", _OTHER), ("=", _OTHER | _EQUALS), (":", _EQUALS)):
    _KIND[[ord(_c) for _c in _members]] = _bits


def candidates(text: str) -> list[tuple[int, int]]:
    """Unbroken runs with a letter and a digit or with mixed case inside, and any that are assigned."""
    parts = (text[at : at + PART].encode("utf-32-le", "surrogatepass") for at in range(0, len(text) or 1, PART))
    kind = np.concatenate([_KIND[np.minimum(np.frombuffer(p, np.uint32), 128)] for p in parts])
    inside = np.zeros(len(kind) + 2, bool)
    inside[1:-1] = kind & ~np.uint8(_EQUALS)
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    edges = edges.reshape(-1, 2)[edges[1::2] - edges[::2] >= LENGTH]
    if not len(edges):
        return []
    start, end = edges[:, 0], edges[:, 1]
    # of each run without its first character, and of all of it
    beyond = np.bitwise_or.reduceat(kind, np.stack([start + 1, end - 1], axis=1).ravel())[::2] | kind[end - 1]
    whole = beyond | kind[start]
    valued = (whole & (_UPPER | _LOWER) != 0) & (whole & _DIGIT != 0) | (beyond & _UPPER != 0) & (whole & _LOWER != 0)
    for back in range(1, 5):
        near = (kind[start - back] & _EQUALS != 0) & (start >= back) & ~valued
        for i in np.flatnonzero(near).tolist():
            valued[i] = assigned(text, int(start[i]))
    return [(a, b) for a, b in edges[valued].tolist()]


def window(text: str, start: int, end: int) -> np.ndarray:
    """Symbols before, in and after a run of at most INSIDE characters."""
    out = np.zeros(WIDTH, np.int64)
    before = text[max(0, start - BEFORE) : start]
    for at, part in ((BEFORE - len(before), before), (BEFORE, text[start:end]), (BEFORE + INSIDE, text[end : end + AFTER])):
        codes = np.frombuffer(part.encode("utf-32-le"), np.uint32)
        out[at : at + len(codes)] = np.where(codes < 128, _CODE[np.minimum(codes, 127)], 1)
    return out


def windows(text: str, start: int, end: int) -> list[np.ndarray]:
    """The pieces of a candidate, all of it, each with what is beside it."""
    return [window(text, at, min(at + INSIDE, end)) for at in range(start, end, INSIDE)]


@dataclass
class Network:
    weights: dict[str, np.ndarray]
    slope: float = 1.0
    shift: float = 0.0
    # for places that are not assigned, and for those that are
    threshold: tuple[float, float] = (0.5, 0.5)
    recall: tuple[float, float] = (0.0, 0.0)  # reached on the findings kept back
    precision: tuple[float, float] = (0.0, 0.0)  # there, with both classes as often as they were found or made

    def probability(self, windows: np.ndarray) -> np.ndarray:
        return self.curve(_logits(self.weights, windows))

    def curve(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (logits / LOGIT_STEPS) + self.shift, -60, 60)))


def _logits(w: dict[str, np.ndarray], windows: np.ndarray) -> np.ndarray:
    """Whole numbers of 1 / LOGIT_STEPS."""
    found = np.concatenate([_forward(w, windows[i : i + 1024])["logit"] for i in range(0, len(windows), 1024)])
    return np.rint(np.clip(found, -LOGIT_MOST, LOGIT_MOST) * LOGIT_STEPS).astype(np.int64)


def _forward(w: dict[str, np.ndarray], windows: np.ndarray) -> dict[str, np.ndarray]:
    embedded = w["E"][windows]
    steps = WIDTH - KERNEL + 1
    patches = np.concatenate([embedded[:, k : k + steps] for k in range(KERNEL)], axis=2)
    activated = np.maximum(patches @ w["F"] + w["f"], 0)
    best, mean = activated.argmax(axis=1), activated.mean(axis=1)
    top = np.take_along_axis(activated, best[:, None], axis=1)[:, 0]
    pooled = np.concatenate([top, mean], axis=1)
    return {"patches": patches, "activated": activated, "best": best, "pooled": pooled, "logit": pooled @ w["o"] + w["c"][0]}


def _gradients(w: dict[str, np.ndarray], windows: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    f, n = _forward(w, windows), len(y)
    error = (1 / (1 + np.exp(-f["logit"])) - y) / n
    d_pooled = error[:, None] * w["o"]
    steps = f["activated"].shape[1]
    above = f["activated"] > 0
    d = above * (d_pooled[:, None, FILTERS:] / steps)
    row, col = np.arange(n)[:, None], np.arange(FILTERS)[None, :]
    d[row, f["best"], col] += d_pooled[:, :FILTERS] * above[row, f["best"], col]
    d_patches = d @ w["F"].T
    d_windows = np.zeros((n, WIDTH, EMBED), d_patches.dtype)
    for k in range(KERNEL):
        d_windows[:, k : k + steps] += d_patches[:, :, k * EMBED : (k + 1) * EMBED]
    at = windows.ravel()
    d_embed = np.stack([np.bincount(at, d_windows[:, :, e].ravel(), SYMBOLS) for e in range(EMBED)], axis=1)
    return {
        "E": d_embed, "F": np.tensordot(f["patches"], d, axes=((0, 1), (0, 1))), "f": d.sum(axis=(0, 1)),
        "o": f["pooled"].T @ error, "c": error.sum(keepdims=True),
    }


def _named(flat: np.ndarray) -> dict[str, np.ndarray]:
    return {k: part.reshape(s) for (k, s), part in zip(SHAPES.items(), np.split(flat, _ENDS[:-1]), strict=True)}


def _begin(seed: int) -> np.ndarray:
    """Weights to begin with, and two moments of their gradients, which are zero."""
    rng = np.random.default_rng(seed)
    scale = {"E": 0.5, "F": 1 / np.sqrt(KERNEL * EMBED), "f": 0, "o": 1 / np.sqrt(FILTERS), "c": 0}
    weights = np.concatenate([rng.normal(size=s).ravel() * scale[k] for k, s in SHAPES.items()])
    return np.stack([weights, np.zeros_like(weights), np.zeros_like(weights)]).astype(np.float32)


def _passes(state: np.ndarray, done: int, windows: np.ndarray, y: np.ndarray, seed: int, number: int) -> np.ndarray:
    """The state after `number` passes of Adam over the examples, in batches; `done` steps were made before."""
    state, rng, y = state.copy(), np.random.default_rng(seed), y.astype(np.float32)
    weights, first, second = state
    named = _named(weights)
    for _ in range(number):
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            done += 1
            gradients = _gradients(named, windows[some], y[some])
            g = np.concatenate([gradients[k].ravel() for k in SHAPES]).astype(np.float32)
            first += 0.1 * (g - first)
            second += 0.001 * (g**2 - second)
            weights -= RATE * (first / (1 - 0.9**done)) / (np.sqrt(second / (1 - 0.999**done)) + 1e-8)
    return state


def _enough(fit: Iterable[int], kept: Iterable[int]) -> bool:
    """Whether there are examples of both classes to fit, and a quarter of those to keep back."""
    return min(*fit, *(4 * k for k in kept)) >= LEAST


def _cut(weights: np.ndarray, logits: np.ndarray, labels: np.ndarray, context: np.ndarray, rows: np.ndarray) -> Network:
    """A network calibrated and cut, for each of two contexts, on examples kept back: `rows` of each logit, label and context."""
    net = Network(_named(weights))
    net.slope, net.shift = _calibrated(logits / LOGIT_STEPS, labels, rows)
    cuts = []
    for c in (0, 1):
        mine = context == c
        if rows[mine & (labels == 1)].sum() * 4 < LEAST:
            mine = np.ones(len(rows), bool)
        finding = mine & (labels == 1)
        order = np.argsort(logits[finding], kind="stable")
        upto = np.cumsum(rows[finding][order])
        least = logits[finding][order][np.searchsorted(upto, int((1 - RECALL) * upto[-1]), side="right")]
        over = logits >= least
        recalled = int(rows[finding & over].sum())
        cuts.append((float(net.curve(least)), recalled / int(upto[-1]), recalled / int(rows[mine & over].sum())))
    net.threshold, net.recall, net.precision = zip(*cuts, strict=True)
    return net


def train(
    windows: np.ndarray, labels: np.ndarray, held: np.ndarray, context: np.ndarray | None = None, seed: int = 11
) -> Network | None:
    """A network fitted on the rows not in `held`, as one block, and calibrated and cut on those in `held`."""
    context = np.zeros(len(labels), np.int64) if context is None else context
    if not _enough(*([int((labels[part] == c).sum()) for c in (0, 1)] for part in (~held, held))):
        return None
    state = _passes(_begin(seed), 0, windows[~held], labels[~held], seed, ROUNDS * PASSES)
    return _cut(state[0], _logits(_named(state[0]), windows[held]), labels[held], context[held], np.ones(int(held.sum()), np.int64))


def _calibrated(logits: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton steps on targets drawn in from 0 and 1; `rows` of each logit and label."""
    scale = max(1.0, float(np.abs(logits).max()))
    x = np.stack([logits / scale, np.ones_like(logits)], axis=1)
    positive, negative = rows[labels == 1].sum(), rows[labels == 0].sum()
    target = np.where(labels == 1, (positive + 1) / (positive + 2), 1 / (negative + 2))
    theta = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hessian = (x * (rows * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        theta -= np.clip(np.linalg.solve(hessian, x.T @ (rows * (p - target)) + 1e-3 * theta), -2, 2)
    return float(theta[0] / scale), float(theta[1])


# Alphabets that secrets are written in.
ALPHABETS = [
    "0123456789abcdef",
    "0123456789ABCDEF",
    "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "abcdefghijklmnopqrstuvwxyz0123456789",
]


def rewritten(key: int, form: int) -> str:
    """A value of random characters in one of the alphabets, of 14 to 64, told by a finding's hash; some are grouped."""
    rng = random.Random(key * 1_000_003 + form)
    alphabet = rng.choice(ALPHABETS)
    if form % 8 == 7:
        return "-".join("".join(rng.choices(ALPHABETS[0], k=n)) for n in (8, 4, 4, 4, 12))
    value = "".join(rng.choices(alphabet, k=rng.choice((14, 16, 20, 24, 32, 32, 40, 64))))
    return value + rng.choice(("", "=", "==")) if "+" in alphabet else value


def harmless(words: list[str], key: int) -> str:
    """What stands in texts and looks like a value: joined words, dates, numbers and versions."""
    rng = random.Random(key)
    some = [re.sub(r"[^A-Za-z]", "", w) or "x" for w in rng.choices(words, k=3)]
    number = str(rng.randrange(10 ** rng.randint(1, 4)))
    made = [
        some[0].lower() + some[1].capitalize() + some[2].capitalize(),
        "_".join(some).lower() + number,
        some[0].capitalize() + some[1].capitalize(),
        some[0].capitalize() + "-" + number,
        f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}",
        "".join(rng.choices("0123456789", k=rng.randint(6, 20))),
        "v" + "-".join(str(rng.randint(0, 20)) for _ in range(3)),
        "/" + "/".join(some).lower() + "/" + number,
        "-".join(some).lower() + "-" + number,
        (some[0] + some[1]).upper() + number,
    ]
    return rng.choice([m for m in made if len(m) >= 6] or ["aaaaaa"])


class _Place(NamedTuple):
    """Where a value is shown: the texts before and after it."""

    before: str
    after: str


def _places(text: str, spans: list[Span], key: int) -> tuple[_Place, _Place]:
    """A place between the words of a text, away from its findings, and the same behind a name and a sign."""
    rng = random.Random(key)
    for _ in range(20):
        at = text.find(" ", rng.randrange(len(text))) + 1
        if not any(s - BEFORE <= at <= e + BEFORE for s, e, _ in spans):
            break
    before, after = text[max(0, at - BEFORE) : at], text[at - 1 : at + AFTER]
    sign, name = rng.choice((" = ", "=", ": ", ":", '="', ': "', "='")), before.split()[-1:] or ["x"]
    return _Place(before, after), _Place(before + name[0] + sign, sign[-1] + after if sign[-1] in "\"'" else after)


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=7).digest(), "big")


def examples(text: str) -> list[tuple[int, int, int, int, np.ndarray]]:
    """(key, label, context, how, window) of the findings in a text and of what stands against them.

    `how` is 0 for values as they stand, 1 for values of the text in other places, from 2 on for those made up.
    """
    spans = base_spans(text)
    out: list[tuple[int, int, int, int, np.ndarray]] = []

    def show(key: int, label: int, how: int, value: str, places: Iterable[_Place]) -> None:
        for place in places:
            whole = place.before + value + place.after
            context = int(assigned(whole, len(place.before)))
            out.extend((key, label, context, how, w) for w in windows(whole, len(place.before), len(place.before) + len(value)))

    for start, end, kind in spans:
        if kind == "assign":
            start = ASSIGN.match(text, start).start(2)
        key = _hash(text[start:end])
        out += [(key, 1, int(assigned(text, start)), 0, w) for w in windows(text, start, end)]
        places = _places(text, spans, key)
        show(key, 1, 1, text[start:end], places)
        for form in range(FORMS):
            show(key, 1, 2 + form, rewritten(key, form), [places[form % 2]])
    for start, end in candidates(text):
        if not any(s < end and start < e for s, e, _ in spans):
            key = _hash(text[start:end])
            out += [(key, 0, int(assigned(text, start)), 0, w) for w in windows(text, start, end)]
    words = text.split()
    if words:
        key = _hash(text)
        for n, place in enumerate(_places(text, spans, key)):
            show(key + n, 0, 2, harmless(words, key + n), [place])
    return out


def _findings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = [e for text in strings(batch) for e in examples(text)]
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32())
        shown = pa.array([w.astype(np.uint8).tobytes() for w in columns[4]], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=False)], shown],
            names=["key", "label", "context", "how", "shown"],
        )


def _shown(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    """The windows of some rows."""
    whole = b"".join(table.column("shown").to_pylist())
    return np.frombuffer(whole, np.uint8).reshape(-1, WIDTH).astype(np.int64)


def _round(examples: DataFrame, state: np.ndarray, done: int, seed: int, passes: int) -> np.ndarray:
    """The mean of the states that the blocks of `examples` come to from `state`."""

    def trained(group: pa.Table) -> pa.Table:
        group = group.sort_by([("hash", "ascending"), ("label", "ascending"), ("shown", "ascending")])
        after = _passes(state, done, _shown(group), group.column("label").to_numpy(), seed, passes)
        return pa.table({"state": pa.array([after.ravel().tolist()], pa.list_(pa.float32()))})

    means = (  # sums of decimals are the same in any order
        examples.groupBy("block").applyInArrow(trained, "state array<float>")
        .select(F.posexplode("state").alias("at", "value"))
        .groupBy("at").agg((F.sum(F.col("value").cast("decimal(28,18)")).cast("double") / F.count("*")).alias("mean"))
        .toPandas().sort_values("at")
    )
    return means["mean"].to_numpy().astype(np.float32).reshape(state.shape)


def _counted(weights: np.ndarray):
    """A function that gives the logits of rows of examples and how often each occurs in a batch."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = {"label": batch.column("label"), "context": batch.column("context")}
                yield pa.RecordBatch.from_pydict({**columns, "logit": pa.array(_logits(_named(weights), _shown(batch)), pa.int32())})

    return count


def fit(docs: DataFrame, text: str = "text", seed: int = 11) -> Network | None:
    """A network from the findings in all of `docs`. Runs jobs, and stages the different examples: about two small rows a document."""
    found = docs.select(F.col(text).alias("text")).mapInArrow(_findings, "key bigint, label int, context int, how int, shown binary")
    held = F.expr("shiftright(key, 1) % 4 = 0")
    used = found.distinct().withColumn("held", held).where("NOT held OR how > 0 OR label = 0")  # kept back: no finding beside its keyword
    examples = staged(used, "secret-examples")
    numbers = examples.groupBy("label").agg(
        F.count_if(~F.col("held")).alias("fit"), F.count_if("held").alias("kept"),
        F.count_distinct(F.when(F.col("how") == 0, F.col("key"))).alias("real"),
    ).toPandas().set_index("label").reindex([0, 1], fill_value=0)
    if numbers["real"].min() < LEAST or not _enough(numbers["fit"], numbers["kept"]):
        return None
    total = int(numbers["fit"].sum())
    blocks = -(-total // BLOCK)
    dealt = examples.where("NOT held").select(
        F.xxhash64("key", "label", "context", "how", "shown").alias("hash"), "label", "shown"
    ).withColumn("block", F.pmod("hash", F.lit(blocks)))
    state, steps = _begin(seed), -(-total // (blocks * BATCH)) * PASSES
    for number in range(ROUNDS):
        state = _round(dealt, state, number * steps, seed + number, PASSES)
    kept = examples.where("held").mapInArrow(_counted(state[0]), "label int, context int, logit int")
    counts = kept.groupBy("label", "context", "logit").count().toPandas().sort_values(["logit", "label", "context"])
    return _cut(state[0], *(counts[c].to_numpy().astype(np.int64) for c in ("logit", "label", "context", "count")))


def scan(texts: list[str], net: Network | None) -> list[list[tuple[int, int, str, float]]]:
    """(start, end, kind, probability) of each text's spans, by start, then kind as listed.

    The probability of a candidate of several pieces is their mean.
    """
    out, at, shown = [], [], []
    for i, text in enumerate(texts):
        spans = base_spans(text)
        out.append([(*s, 1.0) for s in spans])
        if net:
            for a, b in candidates(text):
                if not any(s < b and a < e for s, e, _ in spans):
                    pieces = windows(text, a, b)
                    at.append((i, a, b, int(assigned(text, a)), len(pieces)))
                    shown += pieces
    if shown:
        sizes = np.array([n for *_, n in at])
        means = np.add.reduceat(net.probability(np.stack(shown)), np.cumsum(sizes) - sizes) / sizes
        for (i, a, b, context, _), p in zip(at, means.tolist(), strict=True):
            if p >= net.threshold[context]:
                out[i].append((a, b, "cnn", p))
    for spans in out:
        spans.sort(key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return out


def find_secrets(docs: DataFrame, net: Network | None, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` of `docs` with `secrets`: an array of (start, end, kind, probability)."""
    rows = docs.select(*keep, F.col(text).alias("__text"))
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("probability", pa.float64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            spans = [[dict(zip(span.names, s, strict=True)) for s in each] for each in scan(strings(batch, "__text"), net)]
            kept = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(spans, pa.list_(span))], names=[*keep, "secrets"])

    kind = T._parse_datatype_string("array<struct<start:bigint,end:bigint,kind:string,probability:double>>")
    return rows.mapInArrow(find, T.StructType([*rows.schema.fields[:-1], T.StructField("secrets", kind)]))


def secrets_digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, hash of the base spans, all spans."""
    found = find_secrets(docs, fit(docs), ["doc_id"])

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count_of(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint")

    return found.select(
        "doc_id",
        *[count_of(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(listed(F.filter("secrets", lambda s: s["kind"] != "cnn")), 256).alias("base_sha256"),
        listed(F.col("secrets")).alias("spans"),
    )
