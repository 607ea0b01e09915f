"""Hard negatives by an inverted multi-index, exact by certified windows.

Index: two codebooks, one for each half of a vector, are learned by k-means. The pair of a vector's
nearest codes is its cell. For every code the radius is known: the largest distance of any row's half to it.

Search: the inner product of an anchor with any row of cell (i, j) is at most

    q1 . c1[i] + |q1| r1[i]  +  q2 . c2[j] + |q2| r2[j]

A heap over the two sorted lists of half bounds (multi-sequence) visits cells in descending order of that sum.
Anchors ask for windows of scores, each with room for a number of rows. Cells are visited
in waves; after a wave each window knows the score that a further row must reach. An anchor stops at
the first cell whose bound is below that of all its windows, which certifies that no unvisited
row belongs to the result. Cells whose lower bound is above all windows are passed over.

A wave is one join: rows of a cell in blocks of about BLOCK meet its visiting anchors in chunks
of about ASKS as a product of two matrices, whatever the size of a cell. Of each product only the best
rows of a window leave the task.

The codebooks are fitted on at most SAMPLE rows, chosen by a hash; every row is indexed and radii are
taken over all of them, so results do not depend on the sample. Vectors without structure have wide
radii; then nearly all cells are visited and the search costs anchors times rows.

Defined results: rows with a null label, a null or empty vector, a null or non-finite component, or another length
than the most frequent one (the longest of equally frequent) take no part; components are clipped to a size at which
scores fit 64 bits (for 64 of them: 2^28 after scaling). Rows with the same id are rows of their own, ties among them
by position in the table; a row without id is no anchor and comes last among ties. An
anchor without positives, and a positive without rows in its window, give no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.ranking import top_per_group
from evenkeel.llm.common import column
from evenkeel.session import staged

SAMPLE = 20_000  # rows that the codebooks are fitted on, read to the driver
CODES = 64  # at most, for each half
CELL = 256  # rows of an average cell, as far as CODES allows
BLOCK, ASKS = 2048, 512
FIRST, GROWTH = 16, 8  # cells of an anchor's first wave, and growth from wave to wave
FAR = 1 << 62
FOUND = "ask bigint, win int, score bigint, id bigint, row bigint"


@dataclass
class Codes:
    """Codebooks and radii of both halves, and the cells that have rows."""

    centres: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    filled: frozenset[int]

    def halves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        split = self.centres[0].shape[1]
        return vectors[:, :split], vectors[:, split:]

    def visits(self, vector: np.ndarray) -> Iterator[tuple[float, float, int]]:
        """(upper bound, lower bound, cell) of every filled cell, in descending order of the upper bound."""
        ups, lows, orders = [], [], []
        for half, centres, radii in zip(self.halves(vector[None, :]), self.centres, self.radii, strict=True):
            near, reach = centres @ half[0], np.linalg.norm(half[0]) * radii
            order = np.argsort(-(near + reach), kind="stable")
            ups.append((near + reach)[order].tolist())
            lows.append((near - reach)[order].tolist())
            orders.append(order.tolist())
        width = len(self.centres[1])
        heap, known = [(-(ups[0][0] + ups[1][0]), 0, 0)], {(0, 0)}
        while heap:
            bound, a, b = heapq.heappop(heap)
            cell = orders[0][a] * width + orders[1][b]
            if cell in self.filled:
                yield -bound, lows[0][a] + lows[1][b], cell
            for at in ((a + 1, b), (a, b + 1)):
                if at[0] < len(ups[0]) and at[1] < len(ups[1]) and at not in known:
                    known.add(at)
                    heapq.heappush(heap, (-(ups[0][at[0]] + ups[1][at[1]]), *at))


@dataclass
class Index:
    """rows: row, id, label, vector (int32, little endian), cell; and the rows of each cell."""

    codes: Codes
    rows: DataFrame
    sizes: dict[int, int]


def _nearest(halves: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    squares = (halves**2).sum(1)[:, None] - 2 * halves @ centres.T + (centres**2).sum(1)
    code = squares.argmin(1)
    return code, np.sqrt(((halves - centres[code]) ** 2).sum(1))


def _codebook(halves: np.ndarray, codes: int, rounds: int = 10) -> np.ndarray:
    distinct = np.unique(halves, axis=0)
    rng = np.random.default_rng(7)
    centres = distinct[rng.choice(len(distinct), min(codes, len(distinct)), replace=False)].astype(float)
    for _ in range(rounds):
        code, _ = _nearest(halves, centres)
        count = np.bincount(code, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, code, halves)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def _matrix(stored: pa.ChunkedArray | pa.Array) -> np.ndarray:
    vectors = stored.to_pylist()
    return np.frombuffer(b"".join(vectors), "<i4").reshape(len(vectors), -1).astype(np.int64)


def _assigner(centres: tuple[np.ndarray, np.ndarray]):
    split, width = centres[0].shape[1], len(centres[1])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = column(batch, "vector").flatten().to_numpy().reshape(batch.num_rows, -1)
            (a, far_a), (b, far_b) = (_nearest(half, c) for half, c in zip((vectors[:, :split], vectors[:, split:]), centres, strict=True))
            packed = [v.astype("<i4").tobytes() for v in vectors]
            made = [pa.array(packed, pa.binary()), pa.array(a * width + b, pa.int64()), pa.array(far_a), pa.array(far_b)]
            yield pa.RecordBatch.from_arrays(
                [column(batch, c) for c in ("row", "id", "label")] + made,
                names=["row", "id", "label", "vector", "cell", "far_a", "far_b"],
            )

    return assign


def vectors(table: DataFrame, scale: int = 256) -> DataFrame:
    """row, id, label and vector of integers of the rows that take part, in files."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    known = table.where("label IS NOT NULL AND size(embedding) > 0").where(sound)
    lengths = known.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    length = lengths["n"] if lengths else 1
    most = float(1 << ((62 - (length - 1).bit_length()) // 2))
    return staged(
        known.where(F.size("embedding") == length).select(
            F.monotonically_increasing_id().alias("row"),
            F.col("vec_id").cast("bigint").alias("id"),
            F.col("label").cast("bigint").alias("label"),
            F.transform(
                "embedding",
                lambda x: F.greatest(F.least(F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(most)), F.lit(-most))), F.lit(int(most))), F.lit(-int(most))),
            ).alias("vector"),
        ),
        "vectors",
    )


def build(rows: DataFrame) -> Index | None:
    """The index of (row, id, label, vector), which must be files; None of an empty table."""
    n = rows.count()
    if not n:
        return None
    share = min(1.0, SAMPLE / n)
    chosen = F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = rows.where(chosen).select("vector").limit(SAMPLE).toArrow()["vector"] if share < 1 else rows.select("vector").toArrow()["vector"]
    if not len(sample):
        sample = rows.select("vector").limit(1).toArrow()["vector"]
    points = sample.combine_chunks().flatten().to_numpy().reshape(len(sample), -1)
    codes = max(1, min(CODES, round((n / CELL) ** 0.5)))
    split = (points.shape[1] + 1) // 2
    centres = (_codebook(points[:, :split], codes), _codebook(points[:, split:], codes))
    placed = staged(
        rows.mapInArrow(
            _assigner(centres), "row bigint, id bigint, label bigint, vector binary, cell bigint, far_a double, far_b double"
        ),
        "multi-index",
    )
    # at most CODES * CODES rows
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far_a").alias("a"), F.max("far_b").alias("b")).collect()
    radii = (np.zeros(len(centres[0])), np.zeros(len(centres[1])))
    for c in cells:
        for half, code, far in ((0, c["cell"] // len(centres[1]), c["a"]), (1, c["cell"] % len(centres[1]), c["b"])):
            radii[half][code] = max(radii[half][code], far * (1 + 1e-9) + 1e-6)
    sizes = {c["cell"]: c["n"] for c in cells}
    return Index(Codes(centres, radii, frozenset(sizes)), placed.select("row", "id", "label", "vector", "cell"), sizes)


def _visitor(codes: Codes, seen: int, wave: int):
    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            who, cells = [], []
            needs, highs = column(batch, "need").to_pylist(), column(batch, "high").to_pylist()
            for i, vector in enumerate(_matrix(column(batch, "vector"))):
                open_windows = [(n, h) for n, h in zip(needs[i], highs[i], strict=True) if n <= h]
                if not open_windows:
                    continue
                least, most = min(n for n, _ in open_windows), max(h for _, h in open_windows)
                slack = 1e-9 * (abs(least) + abs(most)) if most < FAR else 1e-6
                for place, (upper, lower, cell) in enumerate(codes.visits(vector.astype(float))):
                    if place >= seen + wave or upper + slack + 1e-6 * abs(upper) < least:
                        break
                    if place >= seen and lower - slack - 1e-6 * abs(lower) <= most:
                        who.append(i)
                        cells.append(cell)
            picked = batch.take(pa.array(who, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*[column(picked, c) for c in ("ask", "label", "vector", "need", "high")], pa.array(cells, pa.int64())],
                names=["ask", "label", "vector", "need", "high", "cell"],
            )

    return visit


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows, exactly."""
    if a.shape[1] * float(np.abs(a).max()) * float(np.abs(b).max()) < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def _best(scores: np.ndarray, fits: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of the `top` largest fitting scores of each row, of equal ones the first columns."""
    n = scores.shape[1]
    if n > top and float(np.abs(scores).max()) * n < FAR:
        keys = np.where(fits, scores * n + np.arange(n - 1, -1, -1), -FAR)
        columns = np.argpartition(keys, n - top, axis=1)[:, n - top :]
        rows = np.repeat(np.arange(len(scores)), top)
        kept = fits[rows, columns.ravel()]
        return rows[kept], columns.ravel()[kept]
    rows, columns = [], []
    for r in np.flatnonzero(fits.any(1)):
        fitting = np.flatnonzero(fits[r])
        best = fitting[np.argsort(-scores[r][fitting], kind="stable")[:top]]
        rows += [r] * len(best)
        columns += best.tolist()
    return np.array(rows, np.int64), np.array(columns, np.int64)


def _scorer(same: bool, top: int):
    schema = pa.schema([("ask", pa.int64()), ("win", pa.int32()), ("score", pa.int64()), ("id", pa.int64()), ("row", pa.int64())])

    def score(asks: pa.Table, rows: pa.Table) -> pa.Table:
        if not asks.num_rows or not rows.num_rows:
            return schema.empty_table()
        rows = rows.sort_by([("id", "ascending"), ("row", "ascending")])  # nulls last
        scores = _products(_matrix(asks["vector"]), _matrix(rows["vector"]))
        who, label = asks["ask"].to_numpy(), asks["label"].to_numpy()
        row, id_ = rows["row"].to_numpy(), rows["id"]
        allowed = ((label[:, None] == rows["label"].to_numpy()[None, :]) == same) & (who[:, None] != row[None, :])
        needs, highs = asks["need"].to_pylist(), asks["high"].to_pylist()
        parts = []
        for w in range(max(map(len, needs))):
            need, high = (np.array([x[w] if w < len(x) else none for x in xs], np.int64) for xs, none in ((needs, 1), (highs, 0)))
            fits = allowed & (scores >= need[:, None]) & (scores <= high[:, None])
            r, c = _best(scores, fits, top)
            found = [pa.array(who[r]), pa.array(np.full(len(r), w, np.int32)), pa.array(scores[r, c]), id_.take(pa.array(c)), pa.array(row[c])]
            parts.append(pa.Table.from_arrays([pa.chunked_array(x) if isinstance(x, pa.Array) else x for x in found], schema=schema))
        return pa.concat_tables(parts)

    return score


def search(index: Index, asks: DataFrame, same: bool, top: int) -> DataFrame:
    """ask, win, score, id, row, rank: the `top` best rows of each window of each ask.

    `asks` are files of (ask, label, vector, low, high); a row belongs to window w if its score lies between
    low[w] and high[w], its label is equal (`same`) or differs, and it is not the asking row itself.
    """
    spark = asks.sparkSession
    best = [F.desc("score"), F.col("id").asc_nulls_last(), F.col("row")]
    found, seen, wave = staged(spark.createDataFrame([], FOUND + ", rank bigint"), "found"), 0, FIRST
    while seen < len(index.sizes):
        full = found.groupBy("ask", "win").agg(F.count("*").alias("n"), F.min("score").alias("worst")).where(F.col("n") == top)
        worst = full.groupBy("ask").agg(F.map_from_entries(F.collect_list(F.struct("win", "worst"))).alias("worst"))
        need = F.expr("transform(low, (l, w) -> coalesce(element_at(worst, w), l))")
        active = asks.join(worst, "ask", "left").select("ask", "label", "vector", need.alias("need"), "high")
        visits = staged(
            active.mapInArrow(
                _visitor(index.codes, seen, wave), "ask bigint, label bigint, vector binary, need array<bigint>, high array<bigint>, cell bigint"
            ),
            "visits",
        )
        visitors = visits.groupBy("cell").count().collect()  # one row for each cell at most
        if not visitors:
            break
        units = F.broadcast(
            spark.createDataFrame(
                [(v["cell"], -(-v["count"] // ASKS), -(-index.sizes[v["cell"]] // BLOCK)) for v in visitors],
                "cell bigint, chunks bigint, blocks bigint",
            )
        )
        left = visits.join(units, "cell").select(
            "cell", "ask", "label", "vector", "need", "high",
            F.pmod(F.xxhash64("ask"), "chunks").alias("chunk"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"),
        )
        right = index.rows.join(units, "cell").select(
            "cell", "row", "id", "label", "vector",
            F.pmod(F.xxhash64("row"), "blocks").alias("block"), F.explode(F.expr("sequence(0, chunks - 1)")).alias("chunk"),
        )
        keys = ["cell", "chunk", "block"]
        met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_scorer(same, top), FOUND)
        found = staged(top_per_group(found.drop("rank").union(met), ["ask", "win"], best, top), "found")
        seen, wave = seen + wave, wave * GROWTH
    return found


def hard_negatives(rows: DataFrame, anchor: str, positives: int = 5, negatives: int = 10, tenths: tuple[int, int] = (3, 9)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows (row, id, label, vector) for which the condition `anchor` holds. For each of an
    anchor's best `positives` of its label, the best `negatives` of other labels that score at least
    tenths[0] and at most tenths[1] tenths of the positive.
    """
    index = build(rows)
    names = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if index is None:
        return rows.sparkSession.createDataFrame([], names)
    chosen = index.rows.where(anchor).select(F.col("row").alias("ask"), F.col("id").alias("anchor_id"), "label", "vector")
    anchors = staged(chosen, "anchors", few_files=True)
    everything = anchors.withColumn("low", F.array(F.lit(-FAR))).withColumn("high", F.array(F.lit(FAR)))
    near = search(index, everything, same=True, top=positives)

    # integer bounds; a negative score has an empty window, as nine tenths of it are less than three
    least = F.expr(f"score div 10 * {tenths[0]} + (score % 10 * {tenths[0]} + 9) div 10")
    most = F.expr(f"score div 10 * {tenths[1]} + score % 10 * {tenths[1]} div 10")
    window = F.struct("rank", F.when(F.col("score") < 0, 1).otherwise(least).alias("low"), F.when(F.col("score") < 0, 0).otherwise(most).alias("high"))
    windows = near.groupBy("ask").agg(F.array_sort(F.collect_list(window)).alias("w"))
    asks = staged(
        anchors.join(windows, "ask").select("ask", "label", "vector", F.col("w.low").alias("low"), F.col("w.high").alias("high")), "asks"
    )
    far = search(index, asks, same=False, top=negatives)
    pairs = near.select("ask", (F.col("rank") - 1).cast("int").alias("win"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (
        far.join(pairs, ["ask", "win"]).join(anchors.select("ask", "anchor_id"), "ask")
        .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )


def mined(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of rows whose id is divisible by 100; labels of ids divisible by 7 move on by one modulo 10."""
    moved = F.expr("IF(coalesce(vec_id % 7 = 0, false), (label + 1) % 10, label)")
    return hard_negatives(vectors(embeddings.select("vec_id", moved.alias("label"), "embedding")), "id % 100 = 0")
