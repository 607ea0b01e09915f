"""Column references, shared types and null-safe key conditions."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ref(name: str) -> Column:
    """A column by its exact name, also when the name holds dots or spaces."""
    return F.col(quoted(name))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All rows of the frames, as a balanced tree: a chain would be analysed again for each frame."""
    if len(frames) <= 2:
        return reduce(DataFrame.unionByName, frames)
    half = len(frames) // 2
    return union_all(frames[:half]).unionByName(union_all(frames[half:]))


def common_columns(source: DataFrame, target: DataFrame) -> list[str]:
    """Names on both sides, matched case-sensitively, in sorted order."""
    return sorted(set(source.columns) & set(target.columns))


def field_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def shared_type(source: DataFrame, target: DataFrame, name: str) -> T.DataType:
    """The type both sides can be compared in.

    Equal types stay. A string against anything else is compared as string, because a cast
    of text to a number may fail. Otherwise Spark's own widening decides.
    """
    left, right = field_type(source, name), field_type(target, name)
    if left == right:
        return left
    if isinstance(left, T.StringType) or isinstance(right, T.StringType):
        return T.StringType()
    try:
        return source.select(ref(name)).union(target.select(ref(name))).schema[0].dataType
    except AnalysisException:
        return T.StringType()


def aligned(source: DataFrame, target: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides reduced to `columns` with equal types."""
    types = {c: shared_type(source, target, c) for c in columns}

    def side(df: DataFrame) -> DataFrame:
        if df.columns == columns and all(f.dataType == types[f.name] for f in df.schema.fields):
            return df
        return df.selectExpr(
            *[
                quoted(c) if field_type(df, c) == t else f"CAST({quoted(c)} AS {t.simpleString()}) AS {quoted(c)}"
                for c, t in types.items()
            ]
        )

    return side(source), side(target)


def literal(text: str) -> str:
    """Text as a SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def comparable(column: Column, dtype: T.DataType) -> Column:
    """Maps cannot be grouped or compared in Spark, so they become sorted entry arrays."""
    if isinstance(dtype, T.MapType):
        return F.array_sort(F.map_entries(column))
    return column


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Join condition on all keys in which NULL equals NULL."""
    return reduce(
        lambda a, b: a & b, [left[quoted(k)].eqNullSafe(right[quoted(k)]) for k in keys]
    )


def key_display(keys: list[str]) -> Column:
    """`k1=v1, k2=v2` in key order; a NULL key part shows as None."""
    parts = [
        F.concat(F.lit(f"{k}="), F.coalesce(ref(k).cast("string"), F.lit("None"))) for k in keys
    ]
    return F.concat_ws(", ", *parts)
