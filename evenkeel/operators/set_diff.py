"""Row-set differences. Each is one exchange: union both sides, group by the row, compare counts.

`DataFrame.subtract` would add a distinct aggregate to an anti join, and `exceptAll`
expands copies before the shuffle; here copies are combined on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions.columns import aligned, common_columns, comparable, field_type, ref
from evenkeel.functions.rowhash import row_hash
from evenkeel.operators.hash_filter import hash_filter, passing
from evenkeel.session import staged


def _row_counts(source: DataFrame, target: DataFrame, columns: list[str] | None) -> tuple[DataFrame, list[str]]:
    names = columns or common_columns(source, target)
    left, right = aligned(source, target, names)

    def side(df: DataFrame, from_source: bool) -> DataFrame:
        return df.select(
            *[comparable(ref(c), field_type(df, c)).alias(c) for c in names],
            F.lit(from_source).alias("_from_source"),
        )

    counted = (
        side(left, True)
        .union(side(right, False))
        .groupBy(*[ref(c) for c in names])
        .agg(
            F.count_if(F.col("_from_source")).alias("_s"),
            F.count_if(~F.col("_from_source")).alias("_t"),
        )
    )
    return counted, names


def except_rows(
    source: DataFrame, target: DataFrame, columns: list[str] | None = None, by_hash: bool = False
) -> DataFrame:
    """Distinct source rows that the target does not hold; NULLs are equal.

    `by_hash` suits wide tables of which few rows come out: rows are compared by a 128-bit
    hash, 32 bytes each in the shuffle, and only the rows that remain are read in full and moved. The
    hashes that remain, and a filter of them, are written out when this is called.
    """
    if by_hash:
        names = columns or common_columns(source, target)
        left, right = (_with_hashes(df, names) for df in aligned(source, target, names))
        counted, _ = _row_counts(left, right, HASHES)
        alone = staged(counted.where("_s > 0 AND _t = 0").select(*HASHES), "one-sided-rows", few_files=True)
        left = passing(left, *HASHES, hash_filter(alone, *HASHES))
        shown = left.join(alone, HASHES, "left_semi").select(*[ref(c) for c in names])
        return shown.distinct() if not _has_maps(shown) else except_rows(shown, shown.limit(0))
    counted, names = _row_counts(source, target, columns)
    return counted.where("_s > 0 AND _t = 0").select(*[ref(c) for c in names])


def two_way_except(source: DataFrame, target: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Both EXCEPT directions in one pass, with the side in `difference_type`."""
    counted, names = _row_counts(source, target, columns)
    kind = F.when(F.col("_t") == 0, "data_only_source").otherwise("data_only_target")
    return counted.where("_s = 0 OR _t = 0").select(*[ref(c) for c in names], kind.alias("difference_type"))


def common_rows(source: DataFrame, target: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Distinct rows that both sides hold."""
    counted, names = _row_counts(source, target, columns)
    return counted.where("_s > 0 AND _t > 0").select(*[ref(c) for c in names])


def _has_maps(df: DataFrame) -> bool:
    return any(isinstance(f.dataType, T.MapType) for f in df.schema.fields)


HASHES = ["_h1", "_h2"]


def _with_hashes(df: DataFrame, names: list[str]) -> DataFrame:
    """Adds the 128 bits that identify a row."""
    return df.select("*", *[row_hash(df, names, salt).alias(h) for salt, h in enumerate(HASHES, start=1)])


def multiset_diff(
    source: DataFrame, target: DataFrame, columns: list[str] | None = None, by_hash: bool = False
) -> DataFrame:
    """Rows whose copy counts differ: the row, the side with more, and how many more.

    `by_hash` suits wide tables with few differences: rows are first counted by a 128-bit
    hash, which keeps the shuffle narrow. A filter of the hashes whose counts differ is written out when this
    is called, and only rows that pass it move in full; those are compared as without `by_hash`.
    Two different rows share such a hash with a probability of 2**-128.
    """
    if by_hash:
        names = columns or common_columns(source, target)
        left, right = (_with_hashes(df, names) for df in aligned(source, target, names))
        counted, _ = _row_counts(left, right, HASHES)
        suspects = hash_filter(counted.where("_s <> _t"), *HASHES)
        source, target = (passing(df, *HASHES, suspects).drop(*HASHES) for df in (left, right))
    counted, names = _row_counts(source, target, columns)
    kind = F.when(F.col("_s") > F.col("_t"), "data_only_source").otherwise("data_only_target")
    return counted.where("_s <> _t").select(
        *[ref(c) for c in names],
        kind.alias("difference_type"),
        F.abs(F.col("_s") - F.col("_t")).alias("copies"),
    )


def multiset_counts(
    source: DataFrame, target: DataFrame, columns: list[str] | None = None, by_hash: bool = False
) -> DataFrame:
    """The six row counts for tables without a key: a row is identified by all its values, or
    with `by_hash` by a 128-bit hash of them, which shuffles 32 bytes per row."""
    if by_hash:
        names = columns or common_columns(source, target)
        sides = (_with_hashes(df, names).select(*HASHES) for df in aligned(source, target, names))
        counted, _ = _row_counts(*sides, HASHES)
    else:
        counted, _ = _row_counts(source, target, columns)
    zero = F.lit(0).cast("long")

    def total(column: Column) -> Column:
        return F.coalesce(F.sum(column), zero)

    return counted.agg(
        total(F.col("_s")).alias("source_row_count"),
        total(F.col("_t")).alias("target_row_count"),
        total(F.least("_s", "_t")).alias("matching_rows"),
        zero.alias("different_rows"),
        total(F.greatest(F.col("_s") - F.col("_t"), zero)).alias("source_only_rows"),
        total(F.greatest(F.col("_t") - F.col("_s"), zero)).alias("target_only_rows"),
    )
