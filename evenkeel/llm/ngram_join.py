"""Jaccard similarity join of documents by a blocked sparse matrix product.

A document is a row of the incidence matrix of documents by n-grams. The product of the matrix
with its transpose counts the n-grams two documents share. It is computed in blocks of columns:
each task holds the rows' entries in its block, adds up the counts of the pairs it sees, and the
counts of all blocks are summed.

Bounds derived from the sizes keep the product small without losing a link. Two sets link when
100 * |A n B| >= percent * |A u B|. With all n-grams in one order, rarest first, linked sets share
one among the first |A| - ceil(percent |A| / 100) + 1 of each, so only those entries are multiplied.
The length of an n-gram and the percentage are arguments; WORDS and PERCENT are those of op8.
Pairs whose sizes differ too much, or whose count plus what can still follow the last common
entry stays below the need, are discarded. The rest is verified on the whole sets.

Documents with the same set are one row of the matrix, whatever their number. N-grams with a
long column do not emit all pairs: their documents are first linked to one of them; only columns
that still join different components are multiplied in square tiles, inside tasks, and of a
tile's links a spanning forest is kept.

Defined results: null texts and texts without words have no n-gram and link with nothing; every row is
a document of its own, also where rows share a doc_id or have none; a component in which no row has an id has the id
null; an empty table gives no rows. N-grams are 48-bit hashes, of which two different ones agree with a probability of
2^-48. Sets are known by 64 bits; a second hash tells when two sets share them, and then all keys are made anew.

Pairs are verified in two rounds, since a group of n near copies has n^2 / 2 of them: first as many
as documents, then those that could still join two groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from evenkeel.llm import golomb
from evenkeel.llm.common import bit_filter, column, lookup, slices, with_bit
from evenkeel.llm.components import components
from evenkeel.session import staged

WORDS = 4
PERCENT = 85
COLUMN = 64  # entries of a column up to which all its pairs are emitted
ORDER_SIZE = 1 << 18  # most frequent n-grams whose counts order the columns; only the order depends on it
COUNT_BITS = 32  # of an n-gram's hash in the exchange of counts
TILE = 256
KEY_BITS = 64
SALTS = 64
HEAVY = 1000  # a component with more than 1 / HEAVY of all rows is looked up by broadcast
ROWS_AT_ONCE = 1 << 18

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
ENTRY = np.dtype([("h", "<u2", 3), ("key", "<i8"), ("n", "<u4"), ("pos", "<u4")])


def ngrams_of(texts: pa.Array, n: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct 48-bit hashes of each text's n-grams; shorter texts are one n-gram.

    Arrow cuts the words and numbers the distinct ones, so a word is hashed once for all texts.
    """
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = pc.ascii_split_whitespace(trimmed)  # one empty word, where there is none
    numbered = words.flatten().dictionary_encode()
    distinct = numbered.dictionary.to_pylist()
    known = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct), np.uint64, len(distinct))
    ids = known[numbered.indices.to_numpy()]
    bounds = words.offsets.to_numpy().astype(np.int64) - words.offsets[0].as_py()
    ends = np.where(pc.equal(trimmed, "").to_numpy(zero_copy_only=False), bounds[:-1], bounds[1:])
    whole = _mixed(ids, n)
    return [
        _distinct(whole[a : b - n + 1] if b - a >= n else _mixed(ids[a:b], b - a))
        for a, b in zip(bounds[:-1].tolist(), ends.tolist(), strict=True)
    ]


def _mixed(ids: np.ndarray, width: int) -> np.ndarray:
    """48-bit hashes of all windows of `width` words."""
    size = len(ids) - width + 1
    if size <= 0 or width == 0:
        return np.empty(0, np.uint64)
    mixed = np.full(size, width, np.uint64)
    for i in range(width):
        window = ids[i : i + size]
        mixed += (window ^ (window >> np.uint64(29))) * _MIX[i % 4]
        mixed = mixed * _MIX[(i + 1) % 4] ^ (mixed >> np.uint64(31))
    return mixed >> np.uint64(16)


def _distinct(values: np.ndarray) -> np.ndarray:
    if len(values) < 2:
        return values
    ordered = np.sort(values)
    return ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])]


def to_bytes(hashes: np.ndarray) -> bytes:
    return np.ascontiguousarray(hashes.astype("<u8").view("<u2").reshape(-1, 4)[:, :3]).tobytes()


def from_bytes(data: bytes) -> np.ndarray:
    return _widened(np.frombuffer(data, "<u2").reshape(-1, 3))


def _widened(parts: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(parts), 4), "<u2")
    wide[:, :3] = parts
    return wide.view("<u8").ravel().astype(np.uint64)


def _keys(sets: list[bytes], seed: int, bits: int) -> tuple[list[int | None], list[int | None]]:
    """Two hashes of each set, null for empty ones: its key, and a check that tells sets with the same key."""
    digests = [hashlib.blake2b(s, digest_size=16, salt=seed.to_bytes(16, "little")).digest() if s else None for s in sets]
    parts = [[None if d is None else int.from_bytes(d[at : at + 8], "little", signed=True) for d in digests] for at in (0, 8)]
    return [None if k is None else k >> (64 - bits) for k in parts[0]], parts[1]


def _sets(n: int, seed: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=4 << 20):
            stored = [to_bytes(g) for g in ngrams_of(column(batch, "text"), n)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(_keys(stored, seed, bits)[0], pa.int64()), pa.array(stored, pa.binary())], names=["key", "grams"]
            )

    return run


def _counts_sent(n: int, owners: int):
    """Sorted hashes of the n-grams in a task's texts, Golomb-coded, to the owners of their ranges."""

    def send(hashes: list[np.ndarray]) -> pa.RecordBatch:
        values, count = np.unique(np.concatenate(hashes) >> np.uint64(48 - COUNT_BITS), return_counts=True)
        bounds = (np.arange(owners + 1, dtype=object) * (1 << COUNT_BITS) // owners).astype(np.uint64)
        cuts = np.searchsorted(values, bounds)
        rows: list[list] = [[], [], [], []]
        for o in np.flatnonzero(np.diff(cuts)).tolist():
            v, c = values[cuts[o] : cuts[o + 1]], count[cuts[o] : cuts[o + 1]]
            low, high = int(bounds[o]), int(bounds[o + 1])
            for part, value in zip(rows, (o, golomb.encode(v[c == 1], low, high), golomb.encode(v[c > 1], low, high), c[c > 1].astype("<u4").tobytes()), strict=True):
                part.append(value)
        return pa.RecordBatch.from_arrays(
            [pa.array(rows[0], pa.int32()), *(pa.array(r, pa.binary()) for r in rows[1:])], names=["owner", "once", "often", "count"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(batches, limit=4 << 20):
            for grams in ngrams_of(column(batch, "text"), n):
                held.append(grams)
                size += len(grams)
                if size > 4 * ROWS_AT_ONCE:
                    yield send(held)
                    held, size = [], 0
        if held:
            yield send(held)

    return run


def _counted(owners: int):
    def run(letters: pd.DataFrame) -> pd.DataFrame:
        low = int(letters["owner"].iloc[0]) * (1 << COUNT_BITS) // owners
        values = [golomb.decode(d, low) for d in letters["once"]] + [golomb.decode(d, low) for d in letters["often"]]
        once = sum(len(v) for v in values[: len(letters)])
        weights = np.concatenate([np.ones(once, np.int64), *(np.frombuffer(d, "<u4").astype(np.int64) for d in letters["count"])])
        found, index = np.unique(np.concatenate(values), return_inverse=True)
        total = np.bincount(index, weights=weights).astype(np.int64)
        return pd.DataFrame({"gram": found[total > COLUMN].astype(np.int64), "n": total[total > COLUMN]})

    return run


def _needed(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    return -(-percent * n // 100)


def _entries(n: int, percent: int, frequent: np.ndarray, counts: np.ndarray, blocks: int, seed: int, bits: int, schema: pa.Schema):
    """Each document's key and size, and the entries of its leading n-grams, rarest first, by block.

    Entries of the frequent n-grams go out one by one, for their columns may be long. They and
    the documents are spread over blocks below 0, in which nothing is multiplied.
    """

    def rows(block: list, **columns) -> pa.RecordBatch:
        full = {"block": block, **columns}
        return pa.RecordBatch.from_arrays(
            [pa.array(full[f.name], f.type) if f.name in full else pa.nulls(len(block), f.type) for f in schema], schema=schema
        )

    def send(parts: list[np.ndarray]) -> pa.RecordBatch:
        entries = np.concatenate(parts)
        # leading n-grams have small hashes, so the block comes from a mix of them
        mixed = (_widened(entries["h"]) * _MIX[0]) >> np.uint64(32)
        block = (mixed * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        cuts = np.searchsorted(block[order], np.arange(blocks + 1))
        some = np.flatnonzero(np.diff(cuts)).tolist()
        return rows(some, payload=[entries[order[cuts[b] : cuts[b + 1]]].tobytes() for b in some])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, parts, size = set(), [], 0
        for batch in slices(batches, limit=4 << 20):
            sets, long_rows = ngrams_of(column(batch, "text"), n), []
            keys, checks = _keys([to_bytes(g) for g in sets], seed, bits)
            sizes = [len(g) for g in sets]
            for grams, key, total in zip(sets, keys, sizes, strict=True):
                if key is None or key in seen:
                    continue  # copies are one row of the matrix
                seen.add(key)
                lead = total - _needed(total, percent) + 1
                short = grams >> np.uint64(48 - COUNT_BITS)
                at = np.minimum(np.searchsorted(frequent, short), max(0, len(frequent) - 1))
                known = frequent[at] == short if len(frequent) else np.zeros(total, bool)
                first = grams[~known][:lead]
                entry = np.zeros(len(first), ENTRY)
                entry["h"] = first.astype("<u8").view("<u2").reshape(-1, 4)[:, :3]
                entry["key"], entry["n"], entry["pos"] = key, total, np.arange(len(first))
                parts.append(entry)
                size += len(entry)
                if len(first) < lead:
                    rest = grams[known][np.lexsort((grams[known], counts[at[known]]))][: lead - len(first)]
                    long_rows += [(g, key, total) for g in rest.tolist()]
            if size > ROWS_AT_ONCE:
                yield send(parts)
                parts, size = [], 0
            if len(seen) > 1_000_000:
                seen.clear()
            spread = [-1 - (i % blocks) for i in range(len(keys))]
            own = {c: column(batch, c) for c in ("doc_id", "text_hash")}
            yield rows(spread, key=keys, check=checks, n=sizes, **own)
            if long_rows:
                gram, key, total = zip(*long_rows, strict=True)
                yield rows([-1 - (hash((g, k)) % blocks) for g, k, _ in long_rows], gram=gram, key=key, n=total)
        if size:
            yield send(parts)

    return run


PAIR = "a bigint, b bigint, n_a bigint, n_b bigint, shared bigint, last_a bigint, last_b bigint, gram bigint, check bigint, text_hash bigint"


def _multiplied(percent: int, schema: pa.Schema):
    """One block of the product: pairs with their counts, and the members of long columns.

    Blocks below 0 pass through: members of long columns, and documents (no n-gram, no pair).
    """

    def result(**columns) -> pa.Table:
        size = len(next(iter(columns.values())))
        return pa.table([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)

    def run(rows: pa.Table) -> pa.Table:
        if rows["block"][0].as_py() < 0:
            kept = {"a": "key", "n_a": "n", "gram": "gram", "doc_id": "doc_id", "check": "check", "text_hash": "text_hash"}
            return result(**{new: rows[old].combine_chunks() for new, old in kept.items()})
        entries = np.concatenate([np.frombuffer(p, ENTRY) for p in rows["payload"].to_pylist()])
        gram, key = _widened(entries["h"]), entries["key"]
        order = np.lexsort((key, gram))
        gram, key, entries = gram[order], key[order], entries[order]
        fresh = np.concatenate([[True], (gram[1:] != gram[:-1]) | (key[1:] != key[:-1])])  # copies of a set, from other tasks
        gram, key, entries = gram[fresh], key[fresh], entries[fresh]
        start = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        length = np.diff(np.append(start, len(gram)))
        n, pos = entries["n"].astype(np.int64), entries["pos"].astype(np.int64)
        member = np.repeat(length > COLUMN, length)
        out = [result(a=key[member], n_a=n[member], gram=gram[member].astype(np.int64))]
        for size in np.unique(length[(length > 1) & (length <= COLUMN)]).tolist():
            columns = start[length == size]
            first, second = np.triu_indices(size, 1)
            step = max(1, ROWS_AT_ONCE // len(first))
            for at in range(0, len(columns), step):
                some = columns[at : at + step, None]
                i, j = (some + first).ravel(), (some + second).ravel()
                near = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
                i, j = i[near], j[near]
                frame = pd.DataFrame({"a": key[i], "b": key[j], "n_a": n[i], "n_b": n[j], "last_a": pos[i], "last_b": pos[j]})
                summed = frame.groupby(["a", "b", "n_a", "n_b"], as_index=False, sort=False).agg(
                    shared=("last_a", "size"), last_a=("last_a", "max"), last_b=("last_b", "max")
                )
                out.append(result(**{c: summed[c].to_numpy() for c in summed}))
        return pa.concat_tables(out)

    return run


def _links(percent: int):
    """The pairs whose whole sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "grams_a", 4 << 20):
            linked = []
            for a, b in zip(column(batch, "grams_a").to_pylist(), column(batch, "grams_b").to_pylist(), strict=True):
                x, y = from_bytes(a), from_bytes(b)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([column(batch, "a"), column(batch, "b")], names=["a", "b"]).filter(pa.array(linked))

    return run


def _tile(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """The links of one tile as a spanning forest: all documents of one or two parts of a cluster."""
    rows = rows.drop_duplicates("key")
    keys, root = rows["key"].to_numpy(), rows["root"].to_numpy()
    nothing = pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
    if len(set(root.tolist())) < 2:
        return nothing
    sets = [from_bytes(g) for g in rows["grams"]]
    sizes = np.array([len(s) for s in sets])
    columns, index, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    place = np.cumsum(count > 1) - 1
    keep = count[index] > 1
    owner, index = owner[keep], place[index[keep]]
    order = np.argsort(index, kind="stable")
    owner, index = owner[order], index[order]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    for at in range(0, int(index[-1]) + 1 if len(index) else 0, width):
        low, high = np.searchsorted(index, [at, at + width])
        block = np.zeros((len(sets), width), np.float32)
        block[owner[low:high], index[low:high] - at] = 1
        shared += block @ block.T
    linked = 100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)
    label = np.unique(root, return_inverse=True)[1]
    smallest = np.arange(label.max() + 1)  # the label that a label was merged into
    while True:
        near = np.where(linked, label[None, :], len(sets)).min(axis=1)
        np.minimum.at(smallest, label, near)
        after = smallest[smallest[label]]
        if (after == label).all():
            break
        label = after
    head = {int(k): i for i, k in reversed(list(enumerate(label)))}
    ends = [(int(keys[i]), int(keys[head[int(k)]])) for i, k in enumerate(label) if head[int(k)] != i]
    return pd.DataFrame(ends, columns=["a", "b"]) if ends else nothing


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """`pairs`, which must be files, with the sets of both sides as grams_a and grams_b.

    A document in more than 1 / HEAVY of all pairs meets them in SALTS tasks, to each of which its set goes.
    """
    ends = pairs.select(F.col("a").alias("hot")).union(pairs.select("b"))
    many = ends.groupBy("hot").agg(F.count("*").alias("n")).where(F.col("n") * HEAVY > F.lit(pairs.count()))
    hot = F.broadcast(staged(many.select("hot"), "join-hot", few_files=True))  # fewer than 2 * HEAVY
    salts = F.when(F.col("hot").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    copies = sets.join(hot, F.col("key") == F.col("hot"), "left").select("key", "grams", F.explode(salts).alias("salt"))
    salt = F.when(F.col("hot").isNull(), 0).otherwise(F.pmod(F.xxhash64("a", "b"), F.lit(SALTS)).cast("int"))
    for side in ("a", "b"):
        dealt = pairs.join(hot, F.col(side) == F.col("hot"), "left").withColumn("salt", salt).drop("hot")
        mine = copies.select(F.col("key").alias(side), F.col("grams").alias(f"grams_{side}"), "salt")
        pairs = dealt.join(mine, [side, "salt"]).drop("salt")
    return pairs.select("a", "b", "grams_a", "grams_b")


class _Texts(NamedTuple):
    """The documents, what is known of each row, and how their sets are made."""

    docs: DataFrame
    rows: DataFrame
    n: int
    seed: int
    bits: int


def _sets_of(texts: _Texts, keys: DataFrame) -> DataFrame:
    """(key, grams), once for each of `keys`, from one row of each.

    The rows are found by a hash in a filter of bounded size, in the scan of the texts; of the others a few pass too,
    and give sets that nothing asks for.
    """
    mark = F.xxhash64("doc_id", "text_hash")
    one = texts.rows.join(keys.distinct(), "key", "left_semi").groupBy("key").agg(F.min(mark).alias("mark"))
    marked = texts.docs.select("text", mark.alias("mark"))
    some = with_bit(marked, "mark", bit_filter(one.select("mark")), "some").where("some").select("text")
    sets = some.mapInArrow(_sets(texts.n, texts.seed, texts.bits), "key bigint, grams binary").where("key IS NOT NULL")
    return sets.groupBy("key").agg(F.first("grams").alias("grams"))


def _linked(texts: _Texts, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs whose whole sets are similar enough, written out."""
    pairs = staged(pairs, "join-candidates")
    sets = _sets_of(texts, pairs.select(F.col("a").alias("key")).union(pairs.select("b")))
    return staged(_with_sets(pairs, sets).mapInArrow(_links(percent), "a bigint, b bigint"), "join-links")


def similar_groups(docs: DataFrame, text: str = "text", n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id that is reachable by links.

    Documents link when their sets of n-grams of `n` words have a Jaccard similarity of `percent` or more.
    The texts are read for the counts, for the entries and for the sets of candidates, rather
    than all sets stored, which would take more room than the texts. Runs when called.
    """
    found = _grouped(docs, text, n, percent)
    return found.select("doc_id", "n_shingles", F.coalesce("first.doc_id", "doc_id").alias("component_id"))


def _grouped(docs: DataFrame, text: str, n: int, percent: int, seed: int = 0) -> DataFrame:
    """doc_id, text_hash, n_shingles and first, (without, doc_id, text_hash) of the row that leads a row's component;
    null where a row is alone."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col(text).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    blocks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    doc_id = docs.schema["doc_id"]

    # the order of the columns: counts of frequent n-grams
    letters = docs.select("text").mapInArrow(_counts_sent(n, blocks), "owner int, once binary, often binary, count binary")
    counted = letters.groupBy("owner").applyInPandas(_counted(blocks), "gram bigint, n bigint")
    top = counted.orderBy(F.desc("n"), "gram").limit(ORDER_SIZE).toPandas().sort_values("gram")

    # the product, block by block
    sent = T.StructType([*T._parse_datatype_string("block int, payload binary, gram bigint, key bigint, n bigint, check bigint, text_hash bigint").fields, doc_id])
    made = T.StructType([*T._parse_datatype_string(PAIR).fields, doc_id])
    frequent, counts = top["gram"].to_numpy().astype(np.uint64), top["n"].to_numpy()
    entries = docs.mapInArrow(_entries(n, percent, frequent, counts, blocks, seed, KEY_BITS, to_arrow_schema(sent)), sent)
    product = staged(entries.groupBy("block").applyInArrow(_multiplied(percent, to_arrow_schema(made)), made), "join-product")
    rows = product.where("b IS NULL AND gram IS NULL").select(
        "doc_id", "text_hash", F.col("n_a").alias("n_shingles"), F.col("a").alias("key"), "check"
    )
    told = rows.groupBy("key").agg(F.min("check").alias("low"), F.max("check").alias("high"))
    if told.where("low <> high").limit(1).count():  # two sets with one key: all keys are made anew
        return _grouped(docs, "text", n, percent, seed + 1)
    texts = _Texts(docs, rows, n, seed, KEY_BITS)
    members = product.where("gram IS NOT NULL").select("gram", F.col("a").alias("key"), F.col("n_a").alias("n")).distinct()
    need = F.ceil(F.lit(percent) * (F.col("n_a") + F.col("n_b")) / (100 + percent))
    follows = F.least(F.col("n_a") - F.col("last_a"), F.col("n_b") - F.col("last_b")) - 1
    pairs = (
        product.where("b IS NOT NULL").groupBy("a", "b", "n_a", "n_b")
        .agg(F.sum("shared").alias("shared"), F.max("last_a").alias("last_a"), F.max("last_b").alias("last_b"))
        .where(F.col("shared") + follows >= need).select("a", "b", "shared")
    )
    pairs = staged(pairs, "join-pairs")

    # first each document with its likeliest partner, and long columns with one of their documents:
    # this joins most groups, with as many pairs as documents
    members = staged(members, "join-long")
    center = members.groupBy("gram").agg(F.min(F.struct("key", "n")).alias("c"))
    near = f"100 * least(n, c.n) >= {percent} * greatest(n, c.n)"
    spokes = (
        members.join(center, "gram").where(f"key <> c.key AND {near}")
        .select(F.col("c.key").alias("a"), F.col("key").alias("b"))
    )
    likely = pairs.groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a")).select("a", "b")
    links = _linked(texts, likely.union(spokes).distinct(), percent)
    roots = components(links)

    # then the pairs that could still join two groups
    of = {side: roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")) for side in ("a", "b")}
    apart = ~F.coalesce("root_a", "a").eqNullSafe(F.coalesce("root_b", "b"))
    left = pairs.join(of["a"], "a", "left").join(of["b"], "b", "left").where(apart).select("a", "b")
    found = _linked(texts, left.join(likely, ["a", "b"], "left_anti"), percent)
    if found.limit(1).count():
        links = links.union(found)
        roots = components(links)

    # long columns that still join different components: square tiles
    rooted = members.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    open_ = rooted.groupBy("gram").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("key").alias("center"))
    rest = staged(rooted.join(open_.where("low <> high").select("gram", "center"), "gram").select("key", "root", "center"), "join-open")
    if rest.limit(1).count():
        clusters = components(rest.select(F.col("center").alias("a"), F.col("key").alias("b")))
        inside = rest.select("key", "root").distinct().join(clusters.select(F.col("node").alias("key"), F.col("root").alias("cluster")), "key")
        parts = inside.groupBy("cluster").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts"))
        placed = inside.join(parts, "cluster").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
        tiles = (
            placed.join(_sets_of(texts, inside.select("key")), "key")
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .groupBy("cluster", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
            .applyInPandas(lambda g: _tile(g, percent), "a bigint, b bigint")
        )
        roots = components(links.union(tiles))

    whole = rows.join(roots.withColumnRenamed("node", "key"), "key", "left")
    whole = staged(whole.select("doc_id", "text_hash", "n_shingles", F.coalesce("root", "key").alias("root")), "join-roots")
    order = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "text_hash")
    leads = whole.where("root IS NOT NULL").groupBy("root").agg(F.min(order).alias("first"), F.count("*").alias("size"))
    leads = staged(leads.where("size > 1"), "join-leads")
    large = leads.where(F.col("size") > F.lit(whole.count() // HEAVY)).select("root", "first")  # fewer than HEAVY
    return lookup(whole, "root", large, leads.select("root", "first")).drop("root")


def one_of_each(docs: DataFrame, text: str = "text", n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs` without those that are linked, at whatever distance, to one that comes before them.

    Of a component stays the row with the smallest doc_id, one without id last; rows that are
    equal in doc_id and text stay or go together.
    """
    groups = _grouped(docs, text, n, percent)
    mine = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "text_hash")
    dropped = groups.where(F.col("first").isNotNull() & (F.col("first") != mine)).select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")
    )
    dropped = staged(dropped.distinct(), "join-dropped")
    words = bit_filter(dropped.select("_hash"))
    rows = with_bit(docs.select(F.struct("*").alias("doc"), F.xxhash64(F.col(text)).alias("text_hash")), "text_hash", words, "some")
    same = F.col("doc.doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    checked = rows.where("some").join(dropped, same, "left_anti")
    return rows.where("NOT some").select("doc.*").union(checked.select("doc.*"))
