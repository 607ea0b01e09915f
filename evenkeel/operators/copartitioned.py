"""Keyed differences of tables that are bucketed alike by the key: no row is exchanged.

`key_states` unions both sides, which loses how they are partitioned. Here each side is reduced by key where its
bucket is, and the buckets are joined; the values of differing rows are on both sides of that join, so cells
come from the same pass. Rows with a NULL in the key cannot be joined by plain equality, on which bucketing depends;
they are compared as by `key_states`.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.columns import field_type, key_display, quoted, ref
from evenkeel.functions.rowhash import row_hash
from evenkeel.operators.row_diff import (
    DIFFERENT,
    MATCH,
    ONLY_SOURCE,
    ONLY_TARGET,
    _count_columns,
    _same,
    as_text,
    key_states,
)
from evenkeel.session import fresh_path


def save_bucketed(df: DataFrame, keys: list[str], buckets: int, name: str | None = None, path: str | None = None) -> DataFrame:
    """`df` as a table of the session's catalog, bucketed and sorted by `keys`, one file for each bucket."""
    spark = df.sparkSession
    name = name or f"bucketed_{uuid.uuid4().hex}"
    placed = df.repartition(buckets, *[ref(k) for k in keys])
    writer = placed.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path or fresh_path(spark, "bucketed"))
    writer.saveAsTable(name)
    return spark.table(name)


def _checked(source: DataFrame, target: DataFrame, keys: list[str]) -> list[str]:
    for k in keys:
        if field_type(source, k) != field_type(target, k):
            raise ValueError(f"key {k} has two types, so the sides cannot be bucketed alike")
    values = [c for c in sorted(set(source.columns) & set(target.columns)) if c not in keys]
    unequal = [c for c in values if field_type(source, c) != field_type(target, c)]
    if unequal:
        raise ValueError(f"columns with two types: {unequal}; use key_states")
    return values


def _with_key(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [ref(k).isNotNull() for k in keys]))


def _without_key(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.where(reduce(lambda a, b: a | b, [ref(k).isNull() for k in keys]))


def _joined(source: DataFrame, target: DataFrame, keys: list[str], of_each) -> DataFrame:
    """Both sides reduced to one row per key by `of_each`, joined where their buckets are."""
    sides = [
        _with_key(df, keys).groupBy(*[ref(k) for k in keys]).agg(F.count("*").alias("n"), *of_each(df)).alias(name)
        for df, name in ((source, "s"), (target, "t"))
    ]
    return sides[0].join(sides[1], [F.col(f"s.{quoted(k)}") == F.col(f"t.{quoted(k)}") for k in keys], "full")


def _state(keys: list[str], differs: Column) -> Column:
    display = F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.coalesce(F.col(f"s.{quoted(k)}"), F.col(f"t.{quoted(k)}")).cast("string")) for k in keys])
    return (
        F.when((F.col("s.n") > 1) | (F.col("t.n") > 1), F.raise_error(F.concat(F.lit("duplicate key: "), display)).cast("string"))
        .when(F.col("t.n").isNull(), ONLY_SOURCE)
        .when(F.col("s.n").isNull(), ONLY_TARGET)
        .when(differs, DIFFERENT)
        .otherwise(MATCH)
    )


def _keys(keys: list[str]) -> list[Column]:
    return [F.coalesce(F.col(f"s.{quoted(k)}"), F.col(f"t.{quoted(k)}")).alias(k) for k in keys]


def bucketed_states(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """As `key_states`, for sides that are bucketed alike by `keys` and have the same types.

    Right for any two tables; without buckets both sides are exchanged.
    """
    values = _checked(source, target, keys)
    joined = _joined(source, target, keys, lambda df: [F.bit_xor(row_hash(df, values)).alias("h")])
    states = joined.select(*_keys(keys), _state(keys, F.col("s.h") != F.col("t.h")).alias("difference_type"))
    return states.unionByName(key_states(_without_key(source, keys), _without_key(target, keys), keys))


def bucketed_counts(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """The six counts of `row_diff_counts`."""
    return bucketed_states(source, target, keys).agg(*_count_columns())


def bucketed_cells(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """One row per differing cell, as `cell_diff`; read once, and nothing is written before.

    Rows without a whole key are no part of it.
    """
    values = _checked(source, target, keys)

    def of_each(df: DataFrame) -> list[Column]:
        return [F.first(F.struct(*[ref(c) for c in values])).alias("v")]

    cells = []
    for c in values:
        left, right = F.col("s.v")[c], F.col("t.v")[c]
        kind = field_type(source, c)
        cells.append(
            F.struct(
                F.lit(c).alias("column_name"), as_text(left, kind).alias("source_value"), as_text(right, kind).alias("target_value"),
                (~_same(left, right, kind)).alias("differs"),
            )
        )
    joined = _joined(source, target, keys, of_each)
    any_differs = F.exists(F.array(*cells), lambda x: x["differs"])
    states = joined.select(*_keys(keys), _state(keys, any_differs).alias("difference_type"), F.array(*cells).alias("cells"))
    found = states.where(F.col("difference_type") == DIFFERENT).select(*[ref(k) for k in keys], F.inline("cells")).where("differs")
    return found.select(*[ref(k) for k in keys], key_display(keys).alias("key_display"), "column_name", "source_value", "target_value")
