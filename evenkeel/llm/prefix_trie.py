"""A trie of the prefixes of sequences, by a recursion that halves heights as van Emde Boas trees do.

A trie of height 2h is cut at depth h: an upper trie of height h, and below each of its deepest nodes a
lower forest of height h. Both are treated alike, all at the same time, down to blocks of BLOCK steps.

- Names. A block's prefixes are named by hashes of their items, in order. The name of a longer segment
  is the hash of its halves' names; the prefix before a block (its cut prefix) is named from the
  segments that precede it, half by half. So a sequence of any length takes log2(length / BLOCK)
  rounds, each over fewer rows than the last, and no task ever holds a sequence.
- Trie. Equal names are one node. A node belongs to its smallest member; what a member owns of its own
  path is all from some depth on.
- Totals. First within blocks: a node's total is the sum of what its owner owns from it to the end of the
  block, and of what other members own there. Then, height by height, the totals of the
  roots of each lower forest are summed per cut node and grafted on all nodes of the
  upper trie above it, along the path of the cut node's owner.

Names have 128 bits. A node's (smallest member, depth) is unique too.

`trie` takes any sequences. `conversations` makes them: turns in order (null first, rows of an equal
turn by a hash of role and text), each conversation rebuilt behind the first turns of another.

Defined results: null roles and texts count as empty; rows without conv_id take no part; repeated rows are repeated
turns; an empty table gives no node; a conversation without turns is a member of the root.
Input columns other than the four named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.llm.common import column, lookup
from evenkeel.session import staged

BLOCK = 64  # steps at which the recursion ends; one task handles a block at once
CHUNK = 4096  # ids that are joined to one piece of text before they are hashed
HEAVY = 1000  # a node with more than 1 / HEAVY of all nodes as children is looked up by broadcast
ROOT = bytes(16)


class Trie(NamedTuple):
    """nodes: node (name), member (the smallest), depth, parent_member (null at the root), n_members, n_children,
    n_leaves, saved; ends: node and seq of each member that ends there."""

    nodes: DataFrame
    ends: DataFrame


def _joined(left: Column, right: Column) -> Column:
    """The name of a segment from the names of its two parts; the left one may be null."""
    both = F.substring(F.unhex(F.sha2(F.concat(left, right), 256)), F.lit(1), F.lit(16))
    return F.when(left.isNull(), right).otherwise(both)


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def positions(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """`rows`, which must be files, with `pos`: the place in its `key`, from 0, and `run`: see `_runs`.

    The whole table is sorted into ranges, so a key may be of any size.
    """
    ranged = rows.repartitionByRange(_partitions(rows), F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    return staged(ranged.withColumn("at", F.monotonically_increasing_id()), "trie-order").withColumn(
        "range", F.shiftright("at", 33)
    )


def _runs(ordered: DataFrame, key: str) -> DataFrame:
    """key, range, first, before: for each range that a key lies in, its first row there and its rows before."""
    runs = ordered.groupBy(key, "range").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy(key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def conversations(turns: DataFrame, group: int = 20) -> tuple[DataFrame, DataFrame]:
    """Sequences (seq, pos, item, weight, length) and all members (seq, length) of rebuilt conversations.

    Conversation c has the first h turns of c - c % `group`, then its own turns after the first h, where h
    is crc32 of c in decimal, modulo 4. An item is a turn's role and text, its weight the words in the text.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    item = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = staged(
        turns.where("conv_id IS NOT NULL").select(
            F.col("conv_id").cast("bigint").alias("conv"),
            "turn",
            F.substring(F.unhex(item), F.lit(1), F.lit(16)).alias("item"),
            F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("weight"),
        ),
        "trie-turns",
    )
    ordered = positions(rows, "conv", [F.col("turn").asc_nulls_first(), F.col("item")])
    runs = staged(_runs(ordered, "conv"), "trie-runs")
    sizes = runs.groupBy("conv").agg(F.sum("n").alias("n"))
    head = sizes.withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % 4).withColumn(
        "base", F.col("conv") - F.col("conv") % group
    )
    bases = sizes.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    members = staged(
        head.join(bases, "base", "left")
        .withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
        .withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
        .select("conv", "base", "h", "taken", "length"),
        "trie-members",
    )
    # a base has fewer than 2 * group members, also where ids are negative
    begun = members.groupBy("base").agg(F.collect_list(F.struct("conv", "h", "length")).alias("begun"))
    about = members.select("conv", "h", "taken", "length").join(begun.withColumnRenamed("base", "conv"), "conv", "left")
    placed = ordered.join(runs.join(about, "conv"), ["conv", "range"]).withColumn(
        "pos", F.col("at") - F.col("first") + F.col("before")
    )
    own = F.expr("IF(pos >= h, array(struct(conv AS seq, pos - h + taken AS pos, length)), array())")
    given = F.expr("transform(filter(begun, b -> pos < b.h), b -> struct(b.conv AS seq, pos, b.length AS length))")
    sequences = placed.select(F.explode(F.concat(own, F.coalesce(given, F.array()))).alias("s"), "item", "weight")
    return (
        sequences.select("s.seq", "s.pos", "item", "weight", "s.length"),
        members.select(F.col("conv").alias("seq"), "length"),
    )


def _namer(size: int):
    def name_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, name = None, None
        for batch in batches:
            names, before = [], []
            for seq, pos, item in zip(*[column(batch, c).to_pylist() for c in ("seq", "pos", "item")], strict=True):
                if block != (seq, pos // size):
                    block, name = (seq, pos // size), None
                before.append(name)
                name = hashlib.blake2b((name or b"") + item, digest_size=16).digest()
                names.append(name)
            kept = [column(batch, c) for c in ("seq", "pos", "weight", "length")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(names, pa.binary()), pa.array(before, pa.binary())],
                names=["seq", "pos", "weight", "length", "name", "before"],
            )

    return name_blocks


def _cuts(full: DataFrame, blocks: int) -> DataFrame:
    """seq, block, start, cut of every block but the first; `full` has the name of each block that another follows.

    `start` names the prefix before the block by its halves, `cut` as the node it ends at.
    """
    levels = [full]
    while 1 << len(levels) < blocks:
        pairs = levels[-1].groupBy("seq", F.shiftright("block", 1).alias("half")).agg(
            F.max(F.expr("IF(block % 2 = 0, name, NULL)")).alias("left"),
            F.max(F.expr("IF(block % 2 = 1, name, NULL)")).alias("right"),
        )
        whole = pairs.where("left IS NOT NULL AND right IS NOT NULL")
        levels.append(
            staged(whole.select("seq", F.col("half").alias("block"), _joined(F.col("left"), F.col("right")).alias("name")), "trie-halves")
        )
    starts = full.select("seq").distinct().select("seq", F.lit(0).cast("bigint").alias("block"), F.lit(None).cast("binary").alias("start"))
    for names in reversed(levels):
        upper = starts.select("seq", (F.col("block") * 2).alias("block"), "start")
        lower = upper.join(names, ["seq", "block"]).select(
            "seq", (F.col("block") + 1).alias("block"), _joined(F.col("start"), F.col("name")).alias("start")
        )
        starts = staged(upper.union(lower), "trie-starts")
    previous = starts.join(full, ["seq", "block"]).select(
        "seq", (F.col("block") + 1).alias("block"), _joined(F.col("start"), F.col("name")).alias("cut")
    )
    return staged(starts.where("block > 0").join(previous, ["seq", "block"]), "trie-cuts")


def _paths(sequences: DataFrame, longest: int) -> DataFrame:
    """seq, pos, block, node, parent, weight and whether it is the last, for every step of every sequence."""
    placed = sequences.withColumn("block", F.floor(F.col("pos") / BLOCK))
    ordered = placed.repartition(_partitions(sequences), "seq", "block").sortWithinPartitions("seq", "pos")
    named = ordered.select("seq", "pos", "item", "weight", "length").mapInArrow(
        _namer(BLOCK), "seq bigint, pos bigint, weight bigint, length bigint, name binary, before binary"
    ).withColumn("block", F.floor(F.col("pos") / BLOCK))
    last = (F.col("pos") == F.col("length") - 1).alias("last")
    if longest <= BLOCK:
        parent = F.coalesce("before", F.lit(ROOT))
        return staged(named.select("seq", "pos", "block", F.col("name").alias("node"), parent.alias("parent"), "weight", last), "trie-paths")
    named = staged(named, "trie-names")
    full = named.where(f"pos % {BLOCK} = {BLOCK - 1} AND pos < length - 1").select("seq", "block", "name")
    whole = named.join(_cuts(staged(full, "trie-blocks"), -(-longest // BLOCK)), ["seq", "block"], "left")
    parent = F.when(F.col("before").isNull(), F.coalesce("cut", F.lit(ROOT))).otherwise(_joined(F.col("start"), F.col("before")))
    return staged(
        whole.select("seq", "pos", "block", _joined(F.col("start"), F.col("name")).alias("node"), parent.alias("parent"), "weight", last),
        "trie-paths",
    )


def _nodes(paths: DataFrame, smallest: int) -> DataFrame:
    """One row for each node but the root, with the sums of what its owner owns from it to the block's end."""
    nodes = staged(
        paths.groupBy("node", "parent", "pos", "block", "weight").agg(F.min("seq").alias("seq"), F.count("*").alias("n_members")),
        "trie-nodes",
    )
    children = staged(nodes.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children")), "trie-children")
    many = children.where(F.col("n_children") * HEAVY > F.lit(nodes.count())).select("node")  # fewer than HEAVY
    owners = nodes.select(F.col("node").alias("parent"), F.col("seq").alias("parent_seq"))
    heavy = owners.join(F.broadcast(many.withColumnRenamed("node", "parent")), "parent")
    root = nodes.sparkSession.createDataFrame([(ROOT, smallest)], "parent binary, parent_seq bigint")
    placed = lookup(nodes, "parent", staged(heavy.union(root), "trie-heavy"), owners).join(children, "node", "left")
    below = Window.partitionBy("seq", "block").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("seq", "block")
    return staged(
        placed.withColumn("n_children", F.coalesce("n_children", F.lit(0)))
        .withColumn("leaves", F.sum(F.when(F.col("n_children") == 0, 1).otherwise(0)).over(below))
        .withColumn("saved", F.sum((F.col("n_members") - 1) * F.col("weight")).over(below))
        .withColumn("owned_first", F.col("pos") == F.min("pos").over(whole))
        .drop("parent", "weight"),
        "trie-tree",
    )


def _grafted(tree: DataFrame, paths: DataFrame, longest: int) -> DataFrame:
    """node, leaves, saved: what each node's subtree holds beyond its owner's part of the block."""
    within = tree.where(f"owned_first AND pos % {BLOCK} > 0").select(
        "seq", "block", F.col("pos").alias("first"), "leaves", "saved"
    )
    above = paths.join(within, ["seq", "block"]).where("pos < first")
    grafts = [staged(above.groupBy("node").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), "trie-grafts")]
    height = BLOCK
    while height < longest:
        roots = tree.where(f"pos % {2 * height} = {height}").select("node", "parent_seq", "pos", "leaves", "saved")
        # a root's total is spread over its own part and the grafts so far
        held = [g.join(roots.select("node", "parent_seq", "pos"), "node").select("parent_seq", "pos", "leaves", "saved") for g in grafts]
        parts = roots.select("parent_seq", "pos", "leaves", "saved")
        for more in held:
            parts = parts.union(more)
        cut = parts.groupBy("parent_seq", "pos").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        span = F.sequence(F.floor((F.col("pos") - height) / BLOCK), F.floor(F.col("pos") / BLOCK) - 1)
        spread = staged(cut.select(F.col("parent_seq").alias("seq"), F.explode(span).alias("block"), "leaves", "saved"), "trie-cut-totals")
        upper = paths.select("seq", "block", "node").join(spread, ["seq", "block"])
        grafts.append(staged(upper.groupBy("node").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), "trie-grafts"))
        height *= 2
    return _union(grafts).groupBy("node").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))


def _union(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.union(frame)
    return whole


def trie(sequences: DataFrame, members: DataFrame) -> Trie:
    """The trie of `sequences` (seq, pos from 0, item, weight, length), whose `members` (seq, length) include empty ones.

    A node's `saved` is the sum over its subtree of weight times the members but one.
    """
    size = members.agg(F.count("*").alias("n"), F.max("length").alias("longest"), F.min("seq").alias("smallest")).first()
    longest = size["longest"] or 0
    paths = _paths(sequences, longest)
    tree = _nodes(paths, size["smallest"])
    totals = staged(
        tree.join(_grafted(tree, paths, longest), "node", "left").select(
            "node",
            F.col("seq").alias("member"),
            (F.col("pos") + 1).alias("depth"),
            F.col("parent_seq").alias("parent_member"),
            "n_members",
            "n_children",
            (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
            (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
        ),
        "trie-totals",
    )
    top = totals.where("depth = 1").agg(
        F.count("*").alias("n_children"),
        F.greatest(F.coalesce(F.sum("n_leaves"), F.lit(0)), F.lit(1)).alias("n_leaves"),
        F.coalesce(F.sum("saved"), F.lit(0)).alias("saved"),
    )
    root = top.select(
        F.lit(ROOT).alias("node"),
        F.lit(size["smallest"]).cast("bigint").alias("member"),
        F.lit(0).cast("bigint").alias("depth"),
        F.lit(None).cast("bigint").alias("parent_member"),
        F.lit(size["n"]).cast("bigint").alias("n_members"),
        "n_children",
        "n_leaves",
        "saved",
    )
    nodes = totals.union(root if size["n"] else root.limit(0))
    ended = paths.where("last").select("node", "seq")
    return Trie(nodes, ended.union(members.where("length = 0").select(F.lit(ROOT).alias("node"), "seq")))


def _piecer(size: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Up to `size` ids of a node, which come in order, as one text."""
        part, place, node, ids = TaskContext.get().partitionId(), 0, None, []

        def piece() -> pa.RecordBatch:
            columns = [pa.array([node], pa.binary()), pa.array([part], pa.int32()), pa.array([place], pa.int64()), pa.array([",".join(map(str, ids))])]
            return pa.RecordBatch.from_arrays(columns, names=["node", "part", "place", "ids"])

        for batch in batches:
            for name, seq in zip(column(batch, "node").to_pylist(), column(batch, "seq").to_pylist(), strict=True):
                if ids and (name != node or len(ids) == size):
                    yield piece()
                    place, ids = place + 1, []
                node = name
                ids.append(seq)
        if ids:
            yield piece()

    return pieces


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node, state = None, None
    for batch in batches:
        names, sums = [], []
        for name, ids in zip(column(batch, "node").to_pylist(), column(batch, "ids").to_pylist(), strict=True):
            if name == node:
                state.update(b",")
            else:
                if state is not None:
                    names.append(node)
                    sums.append(state.hexdigest())
                node, state = name, hashlib.sha256()
            state.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(sums, pa.string())], names=["node", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])


def ends_digest(ends: DataFrame) -> DataFrame:
    """node, ends_sha256: of the ids that end at a node, ascending and joined by commas.

    A hash needs its input in order. All tasks join ids to pieces; the task of a node, however
    many end there, reads one row for each piece and keeps only the state of the hash.
    """
    parts = _partitions(ends)
    ordered = staged(ends, "trie-ends").repartitionByRange(parts, "node", "seq").sortWithinPartitions("node", "seq")
    pieces = ordered.mapInArrow(_piecer(CHUNK), "node binary, part int, place bigint, ids string")
    together = pieces.repartition(parts, "node").sortWithinPartitions("node", "part", "place")
    return together.mapInArrow(_digests, "node binary, ends_sha256 string")


def conversation_nodes(turns: DataFrame) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations, see `conversations`."""
    made = trie(*conversations(turns))
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return made.nodes.join(ends_digest(made.ends), "node", "left").select(
        F.col("member").alias("conv_id"),
        "depth",
        F.col("parent_member").alias("parent_conv_id"),
        F.col("n_members").alias("n_convs"),
        "n_children",
        "n_leaves",
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", empty).alias("ends_sha256"),
    )
