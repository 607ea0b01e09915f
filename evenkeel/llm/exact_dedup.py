"""Exact duplicates by an exchange of Golomb-coded fingerprints.

Every partition ("sender") hashes its normalised texts to 48 bits and sends the sorted distinct
hashes, Golomb-coded, to the owners of their ranges. An owner answers each sender with a bitmap
of the hashes that another sender has too. The rows of repeated hashes are suspects: only their
texts are grouped, byte for byte; a chance agreement of hashes ends there.

The rows are read again by their hash, not by their place, so nothing depends on the order or the splits in which
they come. A filter of FILTER_BITS bits, one for each possible beginning of a hash, is broadcast as 64-bit words (at
most 2 ** 20 rows, whatever the input); a row whose bit is not set stays where it is. Others are suspects, or share
the beginning of a suspect's hash: a hundredth of all rows at 10^6 suspects, all at 10^9 and more. Hashes that many
rows have are broadcast too (fewer than HEAVY), so a text that fills a third of the table meets in no task, and its
copies are combined in every task before they are shuffled.

Defined results: null counts as the empty text; of equal texts the row with the smallest
`doc_id` stays, a null `doc_id` last, and of rows with the same `doc_id` the first that is read;
an empty table gives no rows. Columns other than `doc_id` and the text are not read, and may have any names.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.ranking import top_per_group
from evenkeel.llm import golomb
from evenkeel.llm.common import bit_filter, lookup, with_bit
from evenkeel.session import staged

BITS = 48
MAX_OWNERS = 4096  # ranges of hashes; 3e10 rows make 7 million hashes each
FILTER_BITS = 26
HEAVY = 1000  # a text that more than 1 / HEAVY of all rows have is looked up by broadcast


def _hashed(docs: DataFrame, text: Column, *kept: Column) -> DataFrame:
    """`kept`, the normalised text, its SHA-256 and the first 48 bits of that as `fp`."""
    normal = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")
    hexed = docs.select(*kept, normal.alias("text")).withColumn("hex", F.sha2("text", 256))
    return hexed.withColumn("sha", F.unhex("hex")).withColumn(
        "fp", F.conv(F.substring("hex", 1, BITS // 4), 16, 10).cast("bigint")
    ).drop("hex")


def _owner_bounds(owners: int) -> np.ndarray:
    return (np.arange(owners + 1, dtype=object) * (1 << BITS) // owners).astype(np.uint64)


def _letters(owners: int):
    def send(rows: pd.DataFrame) -> pd.DataFrame:
        bounds = _owner_bounds(owners)
        hashes = np.unique(rows["fp"].to_numpy().astype(np.uint64))
        cuts = np.searchsorted(hashes, bounds)
        out = [
            (o, golomb.encode(hashes[cuts[o] : cuts[o + 1]], int(bounds[o]), int(bounds[o + 1])))
            for o in np.flatnonzero(np.diff(cuts))
        ]
        return pd.DataFrame(
            {"sender": rows["sender"].iloc[0], "owner": [int(o) for o, _ in out], "payload": [p for _, p in out]}
        )

    return send


def _answers(owners: int):
    def answer(letters: pd.DataFrame) -> pd.DataFrame:
        low = int(_owner_bounds(owners)[letters["owner"].iloc[0]])
        received = [golomb.decode(p, low) for p in letters["payload"]]
        hashes, count = np.unique(np.concatenate(received), return_counts=True)
        repeated = hashes[count > 1]
        bitmaps = [np.packbits(np.isin(r, repeated, assume_unique=True)).tobytes() for r in received]
        return pd.DataFrame(
            {"sender": letters["sender"], "owner": letters["owner"], "n": [len(r) for r in received], "bitmap": bitmaps}
        )

    return answer


def _suspects(rows: pa.Table, bitmaps: pa.Table) -> pa.Table:
    """The hashes of a sender that are repeated there or elsewhere."""
    hashes, count = np.unique(rows["fp"].to_numpy(), return_counts=True)
    answers = bitmaps.sort_by("owner")
    elsewhere = [
        np.unpackbits(np.frombuffer(b, np.uint8))[:n]
        for b, n in zip(answers["bitmap"].to_pylist(), answers["n"].to_pylist(), strict=True)
    ]
    return pa.table({"fp": hashes[np.concatenate(elsewhere).astype(bool) | (count > 1)]})


class _Exchange(NamedTuple):
    """prints: row, doc_id, sha, fp of every row; filter: see `_suspicious`; groups: sha, group_size, keep_id, n_first
    (rows that have keep_id) and first (the first of them) of texts that are repeated; heavy: those of many rows."""

    prints: DataFrame
    filter: DataFrame
    heavy: DataFrame
    groups: DataFrame


def _aligned(fp: str = "fp") -> Column:
    """The hash in the upper bits of 64, where a filter looks."""
    return F.shiftleft(F.col(fp), 64 - BITS)


def _suspicious(hashed: DataFrame, words: DataFrame) -> DataFrame:
    """`hashed` with `suspect`: whether the filter has the bit of the row's hash."""
    return with_bit(hashed.withColumn("fp", _aligned()), "fp", words, "suspect", FILTER_BITS)


def _exchange(docs: DataFrame, text: str) -> _Exchange:
    spark = docs.sparkSession
    hashed = _hashed(docs, F.col(text), F.col("doc_id"))
    placed = hashed.select(F.monotonically_increasing_id().alias("row"), "doc_id", "sha", "fp")
    prints = staged(placed.withColumn("sender", F.shiftright("row", 33).cast("int")), "dedup-prints")
    owners = max(1, min(MAX_OWNERS, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    letters = prints.select("sender", "fp").groupBy("sender").applyInPandas(
        _letters(owners), "sender int, owner int, payload binary"
    )
    bitmaps = letters.groupBy("owner").applyInPandas(_answers(owners), "sender int, owner int, n int, bitmap binary")
    suspects = prints.select("sender", "fp").groupBy("sender").cogroup(bitmaps.groupBy("sender")).applyInArrow(
        _suspects, "fp bigint"
    )
    words = bit_filter(suspects.select(_aligned().alias("fp")), FILTER_BITS)
    many = F.lit(prints.count() // HEAVY)

    order = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id")
    equal = staged(
        _suspicious(hashed, words).where("suspect").groupBy("text")
        .agg(F.min(order).alias("first"), F.count("*").alias("group_size"))
        .where("group_size > 1")
        .select(F.unhex(F.sha2("text", 256)).alias("sha"), F.col("first.doc_id").alias("keep_id"), "group_size"),
        "dedup-equal",
    )
    owned = lookup(prints.select("row", "doc_id", "sha"), "sha", equal.where(F.col("group_size") > many), equal)
    firsts = (
        owned.where("group_size IS NOT NULL AND doc_id <=> keep_id")
        .groupBy("sha", "keep_id", "group_size")
        .agg(F.min("row").alias("first"), F.count("*").alias("n_first"))
    )
    groups = staged(firsts.select("sha", "group_size", "keep_id", "n_first", "first"), "dedup-groups")
    return _Exchange(prints, words, groups.where(F.col("group_size") > many), groups)


def _readable(docs: DataFrame, reread: bool) -> DataFrame:
    return docs if reread else staged(docs, "dedup-input")


def duplicate_groups(docs: DataFrame, text: str = "text", reread: bool = False) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row, dropped ones too.

    The rows are read twice. `reread=True` says that `docs` are files, which can be read again
    in any splits; anything else is written to the shared folder first.
    """
    found = _exchange(_readable(docs.select("doc_id", text), reread), text)
    alone = F.col("group_size").isNull()
    return lookup(found.prints.select("row", "doc_id", "sha"), "sha", found.heavy, found.groups).select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        (alone | (F.col("row") == F.col("first"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, text: str = "text", reread: bool = False) -> DataFrame:
    """The rows of `docs` that stay, with all their columns; `reread` as above.

    Rows that are no suspects pass from their files to the result.
    """
    docs = _readable(docs, reread)
    made = _exchange(docs, text)
    rows = _suspicious(_hashed(docs, F.col(text), F.struct("*").alias("doc")).drop("text"), made.filter)
    found = lookup(rows.where("suspect").select("doc", "sha"), "sha", made.heavy, made.groups)
    keeper = F.col("doc.doc_id").eqNullSafe(F.col("keep_id"))
    kept = rows.where("NOT suspect").select("doc").union(
        found.where(F.col("n_first").isNull() | ((F.col("n_first") == 1) & keeper)).select("doc")
    )
    if made.groups.where("n_first > 1").limit(1).count():  # rows that also share their doc_id
        several = found.where((F.col("n_first") > 1) & keeper).withColumn("at", F.monotonically_increasing_id())
        kept = kept.union(top_per_group(several.select("doc", "sha", "at"), ["sha"], [F.col("at")], 1).select("doc"))
    return kept.select("doc.*")
