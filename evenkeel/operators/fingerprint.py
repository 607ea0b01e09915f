"""Order-insensitive table fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.columns import aligned, common_columns
from evenkeel.functions.rowhash import row_hash

_PART = (1 << 21) - 1

# The xor alone would miss rows that occur an even number of times. The sum is kept as three
# 21-bit parts, each of which fits a long for up to 2**42 rows.
_MEASURES = {
    "row_count": "count(*)",
    "hash_xor": "bit_xor(_h)",
    "hash_sum_high": "sum(shiftright(_h, 42))",
    "hash_sum_middle": f"sum(shiftright(_h, 21) & {_PART}L)",
    "hash_sum_low": f"sum(_h & {_PART}L)",
}


def fingerprint(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row that is the same for the same rows in any order and partitioning."""
    hashed = df.select(row_hash(df, sorted(df.columns) if columns is None else columns).alias("_h"))
    return hashed.agg(*[F.expr(f"{measure} AS {name}") for name, measure in _MEASURES.items()])


def quick_compare(source: DataFrame, target: DataFrame) -> DataFrame:
    """Row counts of both sides and whether their fingerprints over the common columns agree.

    Each side is read once and reduced to one row. `fingerprint_match` is NULL when there is
    no common column.
    """
    columns = common_columns(source, target)
    left, right = aligned(source, target, columns) if columns else (source, target)
    both = fingerprint(left, columns).withColumn("_side", F.lit("s")).union(
        fingerprint(right, columns).withColumn("_side", F.lit("t"))
    )
    sides = both.agg(
        *[F.expr(f"max(CASE WHEN _side = '{side}' THEN {name} END) AS {side}_{name}") for side in "st" for name in _MEASURES]
    )
    equal = " AND ".join(f"s_{n} <=> t_{n}" for n in _MEASURES)
    return sides.selectExpr(
        "s_row_count AS source_row_count",
        "t_row_count AS target_row_count",
        f"{equal if columns else 'CAST(NULL AS BOOLEAN)'} AS fingerprint_match",
    )
