"""Keyed row and cell differences.

Both sides are reduced to key + row hash, unioned and grouped by key. That is one exchange
of narrow rows with map-side combine: it needs no sort, treats NULL keys as equal, and shows
duplicate keys in the same pass. Values are fetched afterwards only for the keys that differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions.columns import (
    aligned,
    common_columns,
    field_type,
    key_display,
    quoted,
    ref,
    same_keys,
)
from evenkeel.functions.rowhash import row_hash
from evenkeel.operators.comparable import comparable_columns
from evenkeel.operators.hash_filter import hash_filter, passing
from evenkeel.operators.set_diff import multiset_counts
from evenkeel.session import staged

# fixed values: difference kinds
ONLY_SOURCE = "data_only_source"
ONLY_TARGET = "data_only_target"
DIFFERENT = "data_different"
MATCH = "match"



def _value_columns(source: DataFrame, target: DataFrame, keys: list[str]) -> list[str]:
    missing = [k for k in keys if k not in source.columns or k not in target.columns]
    if missing:
        raise ValueError(f"key columns missing on one side: {missing}")
    return [c for c in common_columns(source, target) if c not in keys]


def _sides(
    source: DataFrame, target: DataFrame, keys: list[str], columns: list[str] | None
) -> tuple[DataFrame, DataFrame, list[str]]:
    values = _value_columns(source, target, keys)
    if columns is not None:
        values = [c for c in values if c in columns]
    left, right = aligned(source, target, [*keys, *values])
    return left, right, values


def _tagged(df: DataFrame, keys: list[str], values: list[str], from_source: bool) -> DataFrame:
    return df.select(
        *[ref(k) for k in keys],
        row_hash(df, values).alias("_hash"),
        F.lit(from_source).alias("_from_source"),
    )


def key_states(
    source: DataFrame,
    target: DataFrame,
    keys: list[str],
    columns: list[str] | None = None,
) -> DataFrame:
    """Every key of either side with its `difference_type`.

    With one row per side, the hashes are equal exactly when their xor is zero, so the
    shuffled state is two counts and one hash. A key that occurs twice on a side fails the
    job when its state is computed; use `multiset_counts` for tables without a key.
    """
    left, right, values = _sides(source, target, keys, columns)
    both = _tagged(left, keys, values, True).union(_tagged(right, keys, values, False))
    from_source = F.col("_from_source")
    grouped = both.groupBy(*[ref(k) for k in keys]).agg(
        F.count_if(from_source).alias("_n_source"),
        F.count_if(~from_source).alias("_n_target"),
        F.bit_xor("_hash").alias("_xor"),
    )
    duplicate = F.concat(F.lit("duplicate key: "), key_display(keys))
    state = (
        F.when(
            (F.col("_n_source") > 1) | (F.col("_n_target") > 1),
            F.raise_error(duplicate).cast("string"),
        )
        .when(F.col("_n_target") == 0, ONLY_SOURCE)
        .when(F.col("_n_source") == 0, ONLY_TARGET)
        .when(F.col("_xor") == 0, MATCH)
        .otherwise(DIFFERENT)
    )
    return grouped.select(*[ref(k) for k in keys], state.alias("difference_type"))


def _count_columns() -> list[Column]:
    kind = F.col("difference_type")
    in_source, in_target = kind != ONLY_TARGET, kind != ONLY_SOURCE
    return [
        F.count_if(in_source).alias("source_row_count"),
        F.count_if(in_target).alias("target_row_count"),
        F.count_if(kind == MATCH).alias("matching_rows"),
        F.count_if(kind == DIFFERENT).alias("different_rows"),
        F.count_if(kind == ONLY_SOURCE).alias("source_only_rows"),
        F.count_if(kind == ONLY_TARGET).alias("target_only_rows"),
    ]


def row_diff_counts(
    source: DataFrame,
    target: DataFrame,
    keys: list[str] | None = None,
    columns: list[str] | None = None,
    on_duplicate: str = "raise",
    by_hash: bool = False,
) -> DataFrame:
    """One row with the six row counts. Without keys, or with `on_duplicate="multiset"`,
    rows are compared as a whole, or with `by_hash` by a 128-bit hash."""
    if on_duplicate not in ("raise", "multiset"):
        raise ValueError(f"on_duplicate must be 'raise' or 'multiset', not {on_duplicate!r}")
    if keys and on_duplicate == "raise":
        return key_states(source, target, keys, columns).agg(*_count_columns())
    if columns is not None:
        kept = [*(keys or []), *[c for c in columns if c not in (keys or [])]]
        source = source.select(*[ref(c) for c in kept if c in source.columns])
        target = target.select(*[ref(c) for c in kept if c in target.columns])
    return multiset_counts(source, target, by_hash=by_hash)


def row_diff_rows(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that are not a match, with their kind and a display form of the key."""
    return (
        key_states(source, target, keys)
        .where(F.col("difference_type") != MATCH)
        .withColumn("key_display", key_display(keys))
    )


def as_text(column: Column, dtype: T.DataType) -> Column:
    """A value as the text shown in difference reports."""
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(column)
    return column.cast("string")


def cell_diff(
    source: DataFrame,
    target: DataFrame,
    keys: list[str],
    columns: list[str] | None = None,
    limit: int | None = None,
    table_name: str = "",
    states: DataFrame | None = None,
) -> DataFrame:
    """One row per differing cell: keys, key_display, column_name, both values as text.

    The differing keys are written out first, when this is called, and a filter of their hashes. They then pick
    rows from both tables: by broadcast when their files are small, by a shuffle join of the rows that pass the filter
    otherwise. `limit` caps the report in (key, column) order. `states` are those of the keys, where the caller has them.
    """
    left, right, values = _sides(source, target, keys, columns)
    if not values:
        raise ValueError("no common columns besides the key")
    states = key_states(source, target, keys, columns) if states is None else states
    changed = staged(
        states.where(F.col("difference_type") == DIFFERENT).select(*[ref(k) for k in keys]),
        "changed-keys",
        few_files=True,
    )
    kept = hash_filter(_with_key_hashes(changed, keys), *KEY_HASHES)
    left, right = (passing(_with_key_hashes(df, keys), *KEY_HASHES, kept).drop(*KEY_HASHES) for df in (left, right))
    old = left.join(changed, same_keys(left, changed, keys), "left_semi").alias("s")
    new = right.join(changed, same_keys(right, changed, keys), "left_semi").alias("t")
    on = [
        F.col(f"s.{quoted(k)}").eqNullSafe(F.col(f"t.{quoted(k)}")) for k in keys
    ]
    cells = [
        F.struct(
            F.lit(c).alias("column_name"),
            as_text(F.col(f"s.{quoted(c)}"), field_type(left, c)).alias("source_value"),
            as_text(F.col(f"t.{quoted(c)}"), field_type(left, c)).alias("target_value"),
            (~_same(F.col(f"s.{quoted(c)}"), F.col(f"t.{quoted(c)}"), field_type(left, c))).alias(
                "differs"
            ),
        )
        for c in values
    ]
    found = (
        old.join(new, on, "inner")
        .select(*[F.col(f"s.{quoted(k)}").alias(k) for k in keys], F.inline(F.array(*cells)))
        .where("differs")
    )
    result = found.select(
        *[ref(k) for k in keys],
        key_display(keys).alias("key_display"),
        "column_name",
        "source_value",
        "target_value",
    )
    if table_name:
        result = result.withColumn("table_name", F.lit(table_name))
    if limit is not None:
        result = result.orderBy(*[ref(k) for k in keys], "column_name").limit(limit)
    return result


KEY_HASHES = ["_key_h1", "_key_h2"]


def _with_key_hashes(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select("*", *[row_hash(df, keys, salt).alias(h) for salt, h in enumerate(KEY_HASHES, start=1)])


def _same(left: Column, right: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.MapType):
        left, right = F.array_sort(F.map_entries(left)), F.array_sort(F.map_entries(right))
    return left.eqNullSafe(right)


def drill_down(
    source: DataFrame,
    target: DataFrame,
    key: str | None = None,
    columns: list[str] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Cell differences over the comparable columns, keyed by the first of them by default."""
    kept = comparable_columns(source)
    if columns is not None:
        kept = [c for c in kept if c in columns]
    kept = [c for c in kept if c in target.columns]
    if len(kept) < 2:
        raise ValueError("a drill-down needs at least two comparable columns")
    key = key or kept[0]
    return cell_diff(source, target, [key], [c for c in kept if c != key], limit)
