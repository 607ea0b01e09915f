"""Benchmark decontamination by greedy string tiling.

Texts become sequences of lower-cased words without punctuation. Runs of MIN_TILE words that a
document shares with a test item are the seeds; only items with a seed in the document are
tiled, and only the document's words under seeds. Tiling repeatedly marks the longest common
run of unmarked words, found by running Karp-Rabin with a falling search length, so passages
count in any order and no word counts twice. A document is contaminated by an item when its tiles
cover at least COVERAGE of the item's words.

The benchmark goes to the tasks in blocks of at most BLOCK_BYTES of text (or one item, where that is longer). A larger
benchmark takes more passes over the documents; the results of each pass are written before the next block is
read, so the driver holds one block and the plan does not grow. Documents are never shuffled.

Defined results: null and empty texts and items match nothing; an item shorter than MIN_TILE
words matches documents that consist of exactly its words; repeated rows are reported once per
row, rows without doc_id with a null; an empty benchmark gives no rows. `clean` decides by the text of each row, also
where rows share a doc_id or have none.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from evenkeel.llm.common import bit_filter, column, slices, strings, with_bit
from evenkeel.session import fresh_path, staged

MIN_TILE = 5
COVERAGE = 0.6
BLOCK_BYTES = 16 << 20
FILTER_BITS = 20

_BLANK = bytes.maketrans(bytes(c for c in range(128) if not chr(c).isalnum()), b" " * sum(not chr(c).isalnum() for c in range(128)))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[bytes]:
    return text.lower().encode().translate(_BLANK).split()


def window_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of `width` ids."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    values = ids.astype(np.uint64) + np.uint64(1)
    for i in range(width):
        out = out * _BASE + values[i : i + n]
    return out ^ (out >> np.uint64(29))


@dataclass
class Tests:
    """A block of the benchmark, indexed by its seeds."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    items: list[tuple[int, np.ndarray]] = field(default_factory=list)
    seeds: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    holders: list[list[int]] = field(default_factory=list)
    whole: dict[tuple[int, ...], list[int]] = field(default_factory=dict)
    filter: np.ndarray = field(default_factory=lambda: np.zeros(1 << FILTER_BITS, bool))


def index(rows: list[tuple[int, str | None]], min_tile: int = MIN_TILE) -> Tests:
    tests, found = Tests(), defaultdict(set)
    for item, text in rows:
        ids = [tests.vocabulary.setdefault(w, len(tests.vocabulary)) for w in words(text or "")]
        if not ids:
            continue
        at = len(tests.items)
        tests.items.append((item, np.array(ids, np.int64)))
        if len(ids) < min_tile:
            tests.whole.setdefault(tuple(ids), []).append(at)
        for h in window_hashes(tests.items[at][1], min_tile).tolist():
            found[h].add(at)
    tests.seeds = np.array(sorted(found), np.uint64)
    tests.holders = [sorted(found[h]) for h in tests.seeds.tolist()]
    tests.filter[(tests.seeds >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    return tests


def seeds_in(tests: Tests, ids: np.ndarray, min_tile: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, seed number) of every window of `ids` that a test item has; ids below 0 are no words."""
    hashes = window_hashes(np.where(ids < 0, -2, ids), min_tile)
    if not len(hashes) or not len(tests.seeds):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.flatnonzero(tests.filter[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
    place = np.minimum(np.searchsorted(tests.seeds, hashes[at]), len(tests.seeds) - 1)
    same = tests.seeds[place] == hashes[at]
    at, place = at[same], place[same]
    inside = np.array([(ids[p : p + min_tile] >= 0).all() for p in at.tolist()], bool) if len(at) else np.empty(0, bool)
    return at[inside], place[inside]


def tile(item: np.ndarray, text: np.ndarray, min_tile: int) -> list[tuple[int, int, int]]:
    """(position in the item, position in the text, length) of the tiles, longest first."""
    marked_item, marked_text = np.zeros(len(item), bool), text < 0
    tiles: list[tuple[int, int, int]] = []
    search = max(min_tile, len(item) // 2)
    while True:
        matches = _matches(item, text, marked_item, marked_text, search)
        longest = max((m[2] for m in matches), default=0)
        if longest > 2 * search:
            search = longest
            continue
        for i, j, length in sorted(matches, key=lambda m: (-m[2], m[1], m[0])):
            if not (marked_item[i : i + length].any() or marked_text[j : j + length].any()):
                marked_item[i : i + length] = True
                marked_text[j : j + length] = True
                tiles.append((i, j, length))
        if matches:
            continue  # parts of occluded matches may still be as long as the search length
        if search == min_tile:
            return tiles
        search = max(min_tile, search // 2)


def _matches(item, text, marked_item, marked_text, search: int) -> list[tuple[int, int, int]]:
    """Maximal common runs of unmarked words of at least `search` words."""
    in_text = _open_windows(marked_text, search)
    in_item = _open_windows(marked_item, search)
    if not len(in_text) or not len(in_item):
        return []
    places: dict[int, list[int]] = defaultdict(list)
    for i, h in zip(in_item.tolist(), window_hashes(item, search)[in_item].tolist(), strict=True):
        places[h].append(i)
    out, reached = [], {}
    for j, h in zip(in_text.tolist(), window_hashes(text, search)[in_text].tolist(), strict=True):
        for i in places.get(h, ()):
            if reached.get(j - i, -1) >= j + search:
                continue  # inside a run that has been found
            length = 0
            while (
                i + length < len(item) and j + length < len(text) and item[i + length] == text[j + length]
                and not marked_item[i + length] and not marked_text[j + length]
            ):
                length += 1
            if length >= search:
                out.append((i, j, length))
                reached[j - i] = j + length
    return out


def _open_windows(marked: np.ndarray, width: int) -> np.ndarray:
    """Starts of the windows without a marked word."""
    if len(marked) < width:
        return np.empty(0, np.int64)
    total = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(total[width:] == total[:-width])


def leaks(tests: Tests, texts: list[str], min_tile: int = MIN_TILE, coverage: float = COVERAGE) -> Iterator[tuple]:
    """(index of the text, item_id, coverage, number of tiles, longest tile) of contaminated texts."""
    worded = [words(t) for t in texts]
    get = tests.vocabulary.get
    gap = [-1]
    flat: list[int] = []
    starts = []
    for w in worded:
        starts.append(len(flat))
        flat += [get(x, -1) for x in w]
        flat += gap
    ids = np.array(flat, np.int64)
    starts = np.array(starts)
    at, seed = seeds_in(tests, ids, min_tile)
    owner = np.searchsorted(starts, at, side="right") - 1
    hits: dict[tuple[int, int], list[int]] = defaultdict(list)
    for text, position, number in zip(owner.tolist(), at.tolist(), seed.tolist(), strict=True):
        for item in tests.holders[number]:
            hits[text, item].append(position)
    for (text, at_item), positions in hits.items():
        covered = np.unique(np.concatenate([np.arange(p, p + min_tile) for p in positions]))
        breaks = np.flatnonzero(np.diff(covered) > 1) + 1
        passage = np.insert(ids[covered], breaks, -1)
        item_id, item = tests.items[at_item]
        tiles = tile(item, passage, min_tile)
        share = sum(t[2] for t in tiles) / len(item)
        if share >= coverage:
            yield text, item_id, share, len(tiles), max(t[2] for t in tiles)
    if tests.whole:
        for text, w in enumerate(worded):
            for at_item in tests.whole.get(tuple(get(x, -1) for x in w) if len(w) < min_tile else (), ()):
                yield text, tests.items[at_item][0], 1.0, 1, len(w)


def _blocks(benchmark: DataFrame, text: str, block_bytes: int) -> Iterator[list[tuple]]:
    rows = benchmark.select("item_id", F.col(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(2 * total / block_bytes))  # hashed blocks vary in size
    for b in range(blocks):
        mine = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else rows
        yield [tuple(r) for r in mine.orderBy("item_id", "text").collect()]


def contaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", min_tile: int = MIN_TILE,
    coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles and longest_tile of every document and item that it leaks.

    Runs when called if the benchmark has more than one block.
    """
    return _leaking(docs, benchmark, text, min_tile, coverage, block_bytes).drop("text_hash")


def _leaking(
    docs: DataFrame, benchmark: DataFrame, text: str, min_tile: int = MIN_TILE, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """With `text_hash`, which tells the rows that share a doc_id."""
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    schema = T.StructType(
        [
            rows.schema["doc_id"],
            T.StructField("text_hash", T.LongType()),
            T.StructField("item_id", benchmark.schema["item_id"].dataType),
            *T._parse_datatype_string("coverage double, n_tiles bigint, longest_tile bigint").fields,
        ]
    )
    arrow = to_arrow_schema(schema)

    def searched(block: list[tuple]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tests = index(block, min_tile)
            for batch in slices(batches, limit=4 << 20):
                ids, hashes = column(batch, "doc_id").to_pylist(), column(batch, "text_hash").to_pylist()
                found = [(ids[i], hashes[i], *rest) for i, *rest in leaks(tests, strings(batch), min_tile, coverage)]
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*found), arrow, strict=True)], schema=arrow
                    )

        return rows.mapInArrow(run, schema)

    blocks = _blocks(benchmark, text, block_bytes)
    first = next(blocks)
    second = next(blocks, None)
    if second is None:
        return searched(first)
    path = fresh_path(docs.sparkSession, "leaks")
    for block in chain((first, second), blocks):
        searched(block).write.mode("append").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` whose text is not contaminated."""
    found = _leaking(docs, benchmark, text).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    leaking = staged(found.distinct(), "leaking")
    rows = docs.select(F.struct("*").alias("doc"), F.xxhash64(text).alias("text_hash"))
    rows = with_bit(rows, "text_hash", bit_filter(leaking.select("_hash")), "some")
    same = F.col("doc.doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    checked = rows.where("some").join(leaking, same, "left_anti")
    return rows.where("NOT some").select("doc.*").union(checked.select("doc.*"))
