"""Token ids in directly addressable codes.

An id is split into chunks of 8 bits. Level 0 holds the lowest chunk of every id, level 1 the next
chunk of those ids that are longer, and so on. Each level has a bitmap that says which of its
chunks go on, and a directory of the number of set bits before every BLOCK bits, so the place of
a chunk's successor is found by rank. Any token, or any range, is read without decoding others.

Files: Parquet, one row per segment of whole documents, in ascending order of (part, seq):

    part, seq       position of the segment; parts are ranges of doc_id
    at              ids before the segment in its part
    doc_ids         the documents in order; equal ids follow each other in the order of a text hash
    ends            for each document the ids up to its end, counted from the segment's start
    levels          array of (chunks, more, ranks): bytes, bitmap with the lowest bit first, uint32 counts

Spark's committer writes them, so a task that is lost leaves nothing behind.

Defined results: null and empty texts have only the end id; a null doc_id comes first; an
empty table gives no segment.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from evenkeel.llm.common import column, slices
from evenkeel.session import fresh_path

BLOCK = 512  # bits of a bitmap for each entry of its directory
SEGMENT = 1 << 19  # ids after which a segment ends, at the end of a document
WORDS, IDS = 1_000_000, 16_000_000  # remembered between tasks of a Python worker: about 200 MB
LONG = 64  # characters of the longest piece that is remembered
BATCH = 4 << 20  # bytes of text that a task encodes at once, unless one text is longer
Level = tuple[np.ndarray, np.ndarray, np.ndarray]

_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def pack(ids: np.ndarray) -> list[Level]:
    """The levels of a sequence of unsigned ids."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >> np.uint32(8)
        goes_on = more > 0
        bits = np.packbits(goes_on, bitorder="little")
        per_block = np.add.reduceat(_POPCOUNT[bits].astype(np.uint32), np.arange(0, max(1, len(bits)), BLOCK // 8)) if len(bits) else np.zeros(0, np.uint32)
        ranks = np.concatenate([[0], np.cumsum(per_block)]).astype(np.uint32)
        levels.append(((rest & np.uint32(255)).astype(np.uint8), bits, ranks))
        if not goes_on.any():
            return levels
        rest = more[goes_on]


def rank(level: Level, at: int) -> int:
    """The number of set bits before position `at`."""
    _, bits, ranks = level
    block = at // BLOCK
    first, last = block * BLOCK // 8, at // 8
    count = int(ranks[block]) + int(_POPCOUNT[bits[first:last]].sum())
    return count + (int(_POPCOUNT[bits[last] & ((1 << (at % 8)) - 1)]) if at % 8 else 0)


def access(levels: list[Level], at: int) -> int:
    """The id at position `at`."""
    value, shift = 0, 0
    for level in levels:
        value |= int(level[0][at]) << shift
        if not level[1][at // 8] >> (at % 8) & 1:
            return value
        at, shift = rank(level, at), shift + 8
    return value


def read(levels: list[Level], low: int, high: int) -> np.ndarray:
    """The ids of positions [low, high), from the chunks that they have."""
    out = np.zeros(high - low, np.uint32)
    where, shift = np.arange(high - low), 0
    for level in levels:
        if low >= high:
            break
        out[where] |= level[0][low:high].astype(np.uint32) << np.uint32(shift)
        bits = np.unpackbits(level[1][low // 8 : -(-high // 8)], bitorder="little")[low % 8 : low % 8 + high - low]
        low, where, shift = rank(level, low), where[bits == 1], shift + 8
        high = low + len(where)
    return out


def levels_of(stored: list[dict]) -> list[Level]:
    return [
        (np.frombuffer(s["chunks"], np.uint8), np.frombuffer(s["more"], np.uint8), np.frombuffer(s["ranks"], "<u4"))
        for s in stored
    ]


# Letters whose lower case is one letter too, and that the vocabulary's rules take for letters.
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"


class Words:
    """A tokenizer that remembers the ids of the pieces of texts.

    The vocabulary's rules never look past white space, ignore case, and always cut between a letter and
    punctuation after it. So the pieces between white space, and between a letter and punctuation, give the ids of
    their text. Arrow cuts a batch of texts and numbers its distinct pieces; only those are looked up, and
    ids are gathered for all pieces at once. The one thing that reaches over pieces is a special token whose name
    stands in a text: such texts go to the library as a whole.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_str(vocabulary)
        added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = "|".join(map(re.escape, added))
        names = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, bool)  # ids that end a word
        self.ends[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.at: dict[str, int] = {}
        self.ids, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _add(self, ids: np.ndarray, lengths: np.ndarray) -> int:
        """Rows for pieces of these lengths, one after the other; the first of them."""
        first = len(self.starts) - 1
        self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
        return first

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by the id `end`, and the number of them for each text."""
        if len(self.at) > WORDS or len(self.ids) > IDS:
            self._forget()
        texts = pc.fill_null(texts, "")
        lower = pc.ascii_lower(texts)
        whole = np.flatnonzero(pc.match_substring_regex(lower, self.special).to_numpy(zero_copy_only=False)) if self.special else []
        if len(whole):
            mask = np.zeros(len(lower), bool)
            mask[whole] = True
            lower = pc.if_else(pa.array(mask), "", lower)
        pieces = pc.ascii_split_whitespace(pc.replace_substring_regex(lower, f"([{LATIN}])([.,;:!?])", r"\1 \2"))
        numbered = pieces.flatten().dictionary_encode()
        rows = self._rows(numbered.dictionary.to_pylist())[numbered.indices.to_numpy()]
        bounds = pieces.offsets.to_numpy().astype(np.int64) - pieces.offsets[0].as_py()

        where, more = bounds[1:], np.full(len(texts), self._add(np.array([end]), np.array([1])))
        if len(whole):
            encoded = [np.array(self.tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, np.uint32) for i in whole]
            first = self._add(np.concatenate(encoded), np.array([len(e) for e in encoded]))
            at = np.searchsorted(where, bounds[whole + 1], "left")  # before the text's own end
            order = np.argsort(np.concatenate([np.arange(len(texts)) * 2 + 1, whole * 2]), kind="stable")
            where = np.concatenate([where, bounds[whole + 1]])[order]
            more = np.concatenate([more, first + np.arange(len(at))])[order]
        rows = np.insert(rows, where, more)
        per_text = np.diff(bounds) + 1 + np.isin(np.arange(len(texts)), whole)

        lengths = np.diff(self.starts)[rows]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.ids[np.repeat(self.starts[rows] - upto[:-1], lengths) + np.arange(upto[-1])]
        return ids, np.diff(upto[np.concatenate([[0], np.cumsum(per_text)])])

    def _rows(self, pieces: list[str]) -> np.ndarray:
        known = self.at
        rows = np.array([known.get(p, -1) for p in pieces], np.int64)
        missing = np.flatnonzero(rows < 0).tolist()
        if not missing:
            return rows
        latin = re.compile(f"[{LATIN}]+").fullmatch
        simple, other = {}, []  # words of letters, and all other pieces
        for i in missing:
            piece = pieces[i]
            if len(piece) <= LONG and latin(piece):
                simple.setdefault(piece.lower(), []).append(i)
            else:
                other.append(i)
        todo = [w for w in simple if w not in known]
        for at in range(0, len(todo), 4000):
            self._learn_words(todo[at : at + 4000])
        for word, places in simple.items():
            for i in places:
                rows[i] = known[pieces[i]] = known[word]
        for at in range(0, len(other), 2000):
            some = other[at : at + 2000]
            found = [f.ids for f in self.tokenizer.encode_batch_fast([pieces[i] for i in some], add_special_tokens=False)]
            first = self._add(np.array([x for f in found for x in f], np.uint32), np.array([len(f) for f in found]))
            for n, i in enumerate(some):
                rows[i] = first + n
                if len(pieces[i]) <= LONG:
                    known[pieces[i]] = first + n
        return rows

    def _learn_words(self, words: list[str]) -> None:
        """Words of letters alone end where an id ends a word, so they are encoded as one text."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):
            raise RuntimeError("the vocabulary does not mark where words end")
        first = self._add(ids, np.diff(ends, prepend=0))
        self.at.update(zip(words, range(first, first + len(words)), strict=True))


_words: dict[str, Words] = {}


def words(vocabulary: str) -> Words:
    """One per process, since Spark uses a Python worker for many tasks."""
    if vocabulary not in _words:
        _words[vocabulary] = Words(vocabulary)
    return _words[vocabulary]


def write(docs: DataFrame, vocabulary: str, end: int, text: str = "text", path: str | None = None) -> str:
    """Write the ids of all documents in ascending order of doc_id; the folder they are in."""
    spark = docs.sparkSession
    path = path or fresh_path(spark, "token-ids")
    tie = F.xxhash64("text")  # also splits a doc_id that many rows have
    rows = docs.select("doc_id", F.col(text).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "doc_id", tie).sortWithinPartitions("doc_id", tie)
    key = rows.schema["doc_id"].dataType
    schema = T._parse_datatype_string(
        "part int, seq int, at bigint, doc_ids array<bigint>, ends array<bigint>, "
        "levels array<struct<chunks:binary,more:binary,ranks:binary>>"
    )
    schema.fields[3] = T.StructField("doc_ids", T.ArrayType(key))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, seq, at = words(vocabulary), TaskContext.get().partitionId(), 0, 0
        stored = pa.struct([("chunks", pa.binary()), ("more", pa.binary()), ("ranks", pa.binary())])
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []  # documents, their ids and the number of these

        def segment() -> pa.RecordBatch:
            ids, lengths = (np.concatenate(x) for x in list(zip(*held, strict=True))[1:])
            levels = [{"chunks": c.tobytes(), "more": m.tobytes(), "ranks": r.astype("<u4").tobytes()} for c, m, r in pack(ids)]
            doc_ids = pa.concat_arrays([d for d, _, _ in held])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([seq], pa.int32()),
                    pa.array([at], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids),
                    pa.array([np.cumsum(lengths)], pa.list_(pa.int64())),
                    pa.array([levels], pa.list_(stored)),
                ],
                names=["part", "seq", "at", "doc_ids", "ends", "levels"],
            )

        size = 0
        for batch in slices(batches, limit=BATCH):
            docs_left, (ids, lengths) = column(batch, "doc_id"), coder.encode(column(batch, "text"), end)
            while len(lengths):
                upto = np.cumsum(lengths)
                n = min(len(lengths), int(np.searchsorted(upto, SEGMENT - size)) + 1)  # the document that fills the segment
                cut = int(upto[n - 1])
                held.append((docs_left[:n], ids[:cut], lengths[:n]))
                docs_left, ids, lengths, size = docs_left[n:], ids[cut:], lengths[n:], size + cut
                if size >= SEGMENT:
                    yield segment()
                    held, seq, at, size = [], seq + 1, at + size, 0
        if held:
            yield segment()

    ordered.mapInArrow(segments, schema).write.parquet(path)
    return path


def documents(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, read back from the files."""
    stored = spark.read.parquet(path)
    key = stored.schema["doc_ids"].dataType.elementType
    schema = T._parse_datatype_string("doc_id bigint, part int, at bigint, n_tokens bigint, ids_crc32 bigint")
    schema.fields[0] = T.StructField("doc_id", key)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                levels = levels_of(column(one, "levels").to_pylist()[0])
                ends = column(one, "ends").flatten().to_numpy()
                starts = np.concatenate([[0], ends[:-1]])
                sums = [zlib.crc32(read(levels, int(a), int(b)).astype("<u4").tobytes()) for a, b in zip(starts, ends, strict=True)]
                n = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [
                        column(one, "doc_ids").flatten(),
                        pa.array([column(one, "part")[0].as_py()] * n, pa.int32()),
                        pa.array(column(one, "at")[0].as_py() + starts, pa.int64()),
                        pa.array(ends - starts, pa.int64()),
                        pa.array(sums, pa.int64()),
                    ],
                    names=["doc_id", "part", "at", "n_tokens", "ids_crc32"],
                )

    # one row per part, of which there are as many as shuffle partitions
    last = stored.select("part", F.expr("at + element_at(ends, -1)").alias("upto")).groupBy("part").agg(F.max("upto").alias("ids"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = last.select("part", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("before"))
    return (
        stored.mapInArrow(digests, schema).join(F.broadcast(offsets), "part")
        .select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
    )
