"""Byte-level BPE by recursive DuckDB queries inside each task.

A text is cut into words by the tokenizer's pattern. The distinct words a task has not met yet
become rows of (word, position, token), one per byte. A recursive query joins neighbouring
tokens with the merge table, contracts each word's leftmost pair of minimum rank and repeats
until no word has a pair left. An ordered aggregation over the tokens' bytes decodes.

The merge table holds every way to split a token of the vocabulary into two others; the rank of
a pair is the id of the token it makes. A word that is a token itself is taken whole.

Words longer than LONG bytes contract all places of the minimum pair at once, where no
pair that this creates has a lower rank, which gives the same result in far fewer rounds.

Defined results: null and empty texts have no tokens. Nothing is shuffled; memory is bounded by
SLICE bytes of text, CHUNK words in DuckDB and CACHE remembered words, unless one text is longer.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.llm.common import column, slices, strings

SLICE = 2 << 20
CHUNK = 20_000
CACHE = 500_000  # words a task remembers, about 220 bytes each
LONG = 64

# A row is (word, value) with position << 32 | token, so that the order of values is that of
# positions. The least (rank, position, next position) of a word is its leftmost pair of minimum rank.
_CONTRACT = """
WITH RECURSIVE steps AS (
  SELECT 0 AS step, word, (pos::BIGINT << 32) | tok AS v FROM start
  UNION ALL
  (WITH paired AS (SELECT word, v, lead(v) OVER (PARTITION BY word ORDER BY v) AS after FROM steps),
  best AS (
    SELECT word, min((m.rank << 16) | ((v >> 32) << 8) | (after >> 32)) AS least
    FROM paired p JOIN pairs m ON m.pair = (((v & 1048575) << 20) | (after & 1048575)) GROUP BY word)
  SELECT step + 1, s.word, CASE WHEN (v >> 32) = ((least >> 8) & 255) THEN ((v >> 32) << 32) | (least >> 16) ELSE v END
  FROM steps s JOIN best b ON s.word = b.word WHERE (v >> 32) <> (least & 255))),
last AS (SELECT word, max(step) AS step FROM steps GROUP BY word)
SELECT s.word, (v & 1048575)::INTEGER AS tok FROM steps s JOIN last l ON s.word = l.word AND s.step = l.step
ORDER BY s.word, v
"""

# As above, but all places of the minimum pair that do not overlap, counted from the left. A word
# for which that creates a pair of lower rank contracts only its leftmost place in this round.
_CONTRACT_LONG = """
WITH RECURSIVE t(word, pos, tok) USING KEY (word, pos) AS (
  SELECT word, pos, tok FROM start
  UNION
  (WITH live AS (SELECT word, pos, tok FROM recurring.t WHERE tok >= 0 AND word IN (SELECT word FROM t)),
  paired AS (
    SELECT word, pos, tok, row_number() OVER w AS i, lag(tok) OVER w AS before, lead(tok) OVER w AS next_tok,
      lead(pos) OVER w AS next_pos, lead(tok, 2) OVER w AS after
    FROM live WINDOW w AS (PARTITION BY word ORDER BY pos)),
  ranked AS (SELECT p.*, m.rank, min(m.rank) OVER (PARTITION BY word) AS least
    FROM paired p JOIN merges m ON p.tok = m.a AND p.next_tok = m.b),
  places AS (SELECT *, i - row_number() OVER (PARTITION BY word ORDER BY i) AS run FROM ranked WHERE rank = least),
  chosen AS (SELECT * FROM places QUALIFY row_number() OVER (PARTITION BY word, run ORDER BY i) % 2 = 1),
  lower_pair AS (
    SELECT DISTINCT c.word FROM chosen c, (VALUES (0), (1), (2), (3)) v(side)
    JOIN merges m ON m.a = CASE side WHEN 0 THEN c.before ELSE c.rank END
      AND m.b = CASE side WHEN 1 THEN c.after WHEN 2 THEN c.rank WHEN 3 THEN c.tok ELSE c.rank END
    WHERE m.rank < c.rank),
  done AS (SELECT * FROM chosen WHERE word NOT IN (SELECT word FROM lower_pair)
    UNION ALL
    SELECT * FROM (SELECT * FROM chosen WHERE word IN (SELECT word FROM lower_pair)
      QUALIFY row_number() OVER (PARTITION BY word ORDER BY i) = 1))
  SELECT word, pos, rank::INTEGER FROM done
  UNION ALL SELECT word, next_pos, -1 FROM done))
SELECT word, pos, tok FROM t WHERE tok >= 0 ORDER BY word, pos
"""

_DECODE = """
SELECT word, unhex(string_agg(v.hex, '' ORDER BY pos)) AS bytes FROM tokens t JOIN vocabulary v ON t.tok = v.tok
GROUP BY word ORDER BY word
"""


def read_ranks(path: str) -> bytes:
    """The rank file, read where the query is built and sent to the tasks with the function."""
    with open(path, "rb") as file:
        return file.read()


class Coder:
    """The vocabulary in an in-memory database of this task."""

    def __init__(self, rank_file: bytes, pattern: str):
        rows = (line.split() for line in rank_file.splitlines() if line)
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in rows}
        self.pattern = regex.compile(pattern)
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.known: dict[str, str] = {}  # ids as text
        self.decoded: dict[str, bytes] = {}  # what ids decode to, where that is not the word itself
        self.con = duckdb.connect()
        for setting in ("threads = 1", "memory_limit = '400MB'", "temp_directory = ''", "preserve_insertion_order = false"):
            self.con.execute(f"SET {setting}")
        vocabulary = pa.table(
            {"tok": pa.array(self.ranks.values(), pa.int32()), "hex": [token.hex() for token in self.ranks]}
        )
        merges = [
            (self.ranks[token[:i]], self.ranks[token[i:]], rank)
            for token, rank in self.ranks.items()
            for i in range(1, len(token))
            if token[:i] in self.ranks and token[i:] in self.ranks
        ]
        pairs = pa.table({name: pa.array(values, pa.int64()) for name, values in zip(("a", "b", "rank"), zip(*merges))})
        for name, rows in (("vocabulary", vocabulary), ("merges", pairs)):
            self.con.register("given", rows)
            self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.con.unregister("given")
        self.con.execute("CREATE TABLE pairs AS SELECT (a << 20) | b AS pair, rank FROM merges")

    def _ask(self, sql: str, name: str, rows: pa.Table) -> pa.Table:
        self.con.register(name, rows)
        try:
            return self.con.sql(sql).to_arrow_table()
        finally:
            self.con.unregister(name)

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word, by contraction until no pair is left."""
        out: list[list[int]] = [[self.ranks[w]] if w in self.ranks else [] for w in words]
        rest = [i for i, w in enumerate(words) if w not in self.ranks and w]
        for sql, some in (
            (_CONTRACT, [i for i in rest if len(words[i]) <= LONG]),
            (_CONTRACT_LONG, [i for i in rest if len(words[i]) > LONG]),
        ):
            for part in _parts(some, [len(words[i]) for i in some]):
                sizes = np.array([len(words[i]) for i in part])
                data = np.frombuffer(b"".join(words[i] for i in part), np.uint8)
                place = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                start = {"word": np.repeat(np.arange(len(part), dtype=np.int32), sizes), "pos": place.astype(np.int32)}
                found = self._ask(sql, "start", pa.table({**start, "tok": self.byte[data]}))
                ids = found["tok"].to_numpy().tolist()
                ends = np.cumsum(np.bincount(found["word"].to_numpy(), minlength=len(part))).tolist()
                for i, low, high in zip(part, [0, *ends], ends, strict=False):
                    out[i] = ids[low:high]
        return out

    def decode_words(self, ids: list[list[int]]) -> list[bytes]:
        """The bytes of each sequence of ids, by an ordered aggregation."""
        out = [b""] * len(ids)
        filled = [i for i, x in enumerate(ids) if len(x)]
        for part in _parts(filled, [len(ids[i]) for i in filled]):
            sizes = np.array([len(ids[i]) for i in part])
            flat = np.concatenate([np.asarray(ids[i], np.int32) for i in part])
            if not set(np.unique(flat).tolist()) <= set(self.ranks.values()):
                raise ValueError("an id is not in the vocabulary")
            place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            rows = pa.table({"word": np.repeat(np.arange(len(part)), sizes), "pos": place, "tok": flat})
            for i, found in zip(part, self._ask(_DECODE, "tokens", rows)["bytes"].to_pylist(), strict=True):
                out[i] = found
        return out

    def learn(self, words: set[str]) -> None:
        """Encode and decode the words that are not remembered yet."""
        new = [w for w in words if w not in self.known]
        for at in range(0, len(new), CHUNK):
            part = new[at : at + CHUNK]
            ids = self.encode_words([w.encode() for w in part])
            for word, mine, decoded in zip(part, ids, self.decode_words(ids), strict=True):
                self.known[word] = ",".join(map(str, mine))
                if decoded != word.encode():
                    self.decoded[word] = decoded

    def forget(self, words: set[str]) -> None:
        if len(self.known) > CACHE:
            self.known = {w: self.known[w] for w in words}

    def words(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def ids_of(self, words: list[str]) -> str:
        """The ids of learned words, joined by commas."""
        return ",".join(map(self.known.__getitem__, words))

    def bytes_of(self, words: list[str]) -> bytes:
        """What the ids of learned words decode to."""
        if not self.decoded:
            return "".join(words).encode()
        return b"".join([self.decoded.get(w, w.encode()) for w in words])


def _parts(items: list[int], sizes: list[int]) -> Iterator[list[int]]:
    """The items in runs of at most CHUNK * 16 rows, or one item."""
    part, total = [], 0
    for item, size in zip(items, sizes, strict=True):
        if part and total + size > CHUNK * 16:
            yield part
            part, total = [], 0
        part.append(item)
        total += size
    if part:
        yield part


@contextmanager
def coder(rank_file: bytes, pattern: str) -> Iterator[Coder]:
    """A coder for one task. Python workers outlive their tasks, so nothing is kept in them."""
    mine = Coder(rank_file, pattern)
    try:
        yield mine
    finally:
        mine.known.clear()
        mine.con.close()


def _worded(batches: Iterator[pa.RecordBatch], c: Coder, name: str) -> Iterator[tuple[pa.RecordBatch, list[list[str]]]]:
    for batch in slices(batches, name, SLICE):
        worded = [c.words(t) for t in strings(batch, name)]
        distinct = set().union(*worded)
        c.learn(distinct)
        yield batch, worded
        c.forget(distinct)


def _id_lists(shown: list[str]) -> pa.Array:
    """Lists of ids from ids joined by commas."""
    flat = pc.split_pattern(pa.array([x for x in shown if x], pa.string()), ",").flatten().cast(pa.int32())
    sizes = [x.count(",") + 1 if x else 0 for x in shown]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), flat)


def encode(docs: DataFrame, rank_file: bytes, pattern: str, keep: list[str], text: str = "text", into: str = "ids") -> DataFrame:
    """The columns `keep` of `docs` with the ids of the whole text."""
    rows = docs.select(*keep, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with coder(rank_file, pattern) as c:
            for batch, worded in _worded(batches, c, "__text"):
                shown = [c.ids_of(words) for words in worded]
                kept = [batch.column(i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, _id_lists(shown)], names=[*keep, into])

    fields = [*rows.schema.fields[:-1], T.StructField(into, T.ArrayType(T.IntegerType()))]
    return rows.mapInArrow(run, T.StructType(fields))


def decode(tokens: DataFrame, rank_file: bytes, keep: list[str], ids: str = "ids", into: str = "bytes") -> DataFrame:
    """The columns `keep` of `tokens` with the bytes that the ids stand for; null counts as no ids."""
    rows = tokens.select(*keep, F.col(ids).alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with coder(rank_file, r"\X+") as c:
            for batch in slices(batches, "__ids", SLICE):
                found = c.decode_words([x or [] for x in column(batch, "__ids").to_pylist()])
                kept = [batch.column(i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.binary())], names=[*keep, into])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField(into, T.BinaryType())]))


def round_trip(
    docs: DataFrame, rank_file: bytes, pattern: str, keep: list[str], text: str = "text", with_ids: bool = False
) -> DataFrame:
    """The columns `keep` of `docs` with n_tokens, ids_sha256 and decoded_sha256 of each whole text, and its ids.

    The ids of each word are decoded once by the ordered aggregation; a text's bytes are those of
    its words in order.
    """
    rows = docs.select(*keep, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with coder(rank_file, pattern) as c:
            for batch, worded in _worded(batches, c, "__text"):
                sizes, shown, decoded = [], [], []
                for words in worded:
                    shown.append(c.ids_of(words))
                    sizes.append(shown[-1].count(",") + 1 if words else 0)
                    decoded.append(hashlib.sha256(c.bytes_of(words)).hexdigest())
                kept = [batch.column(i) for i in range(len(keep))]
                ids = [hashlib.sha256(x.encode()).hexdigest() for x in shown]
                yield pa.RecordBatch.from_arrays(
                    [
                        *kept, pa.array(sizes, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string()),
                        *([_id_lists(shown)] if with_ids else []),
                    ],
                    names=[*keep, *added.names],
                )

    added = T._parse_datatype_string(
        "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    )
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], *added.fields]))
