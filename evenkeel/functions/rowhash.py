"""64-bit row hash in which NULLs have a position.

The expression is built as SQL text: one parsed string per row instead of several gateway
calls per column keeps wide tables cheap to plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions.columns import field_type, quoted


def _inputs(value: str, dtype: T.DataType, depth: int = 0) -> list[str]:
    """What to feed to `xxhash64` for one value.

    `xxhash64` skips NULLs, so `(NULL, 'a')` and `('a', NULL)` would collide; each value is
    therefore preceded by its null flag. Inside arrays and structs the same holds, and an
    array also contributes its length.
    """
    is_null = f"{value} IS NULL"
    if isinstance(dtype, T.ArrayType):
        item = f"x{depth}"
        parts = ", ".join(_inputs(item, dtype.elementType, depth + 1))
        return [is_null, f"size({value})", f"transform({value}, {item} -> xxhash64({parts}))"]
    if isinstance(dtype, T.MapType):
        entry = T.StructType(
            [T.StructField("key", dtype.keyType), T.StructField("value", dtype.valueType)]
        )
        return _inputs(f"array_sort(map_entries({value}))", T.ArrayType(entry), depth)
    if isinstance(dtype, T.StructType):
        parts = [is_null]
        for field in dtype.fields:
            parts += _inputs(f"{value}.{quoted(field.name)}", field.dataType, depth)
        return parts
    return [is_null, value]


def row_hash(df: DataFrame, columns: list[str], salt: int | None = None) -> Column:
    """Hash of the given columns of `df`; a constant when there are none.

    Different salts give independent hashes, two of which identify a row by 128 bits.

    xxhash64 over fixed-width values is a bijection of each value for a given seed, so rows
    that differ in one number never collide; other pairs do with probability 2**-64.
    """
    parts = [p for c in columns for p in _inputs(quoted(c), field_type(df, c))]
    if salt is not None:
        parts.insert(0, str(salt))
    return F.expr(f"xxhash64({', '.join(parts)})" if parts else "0L")
