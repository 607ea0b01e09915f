"""Which columns take part in a comparison, and how values are normalised before it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions.columns import field_type, ref

# fixed values: name parts of columns that change on every load
VOLATILE_NAME_PARTS = ("date", "time", "created")


def comparable_columns(
    df: DataFrame, volatile_parts: Iterable[str] = VOLATILE_NAME_PARTS
) -> list[str]:
    """Columns that are neither timestamps nor named like load bookkeeping."""
    return [
        f.name
        for f in df.schema.fields
        if not isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))
        and not any(part in f.name.lower() for part in volatile_parts)
    ]


def kept_columns(
    columns: list[str],
    include: Iterable[str] | None = None,
    exclude: Iterable[str] = (),
    globally_excluded: Iterable[str] = (),
) -> list[str]:
    """Column choice: global exclusions first, then the include list, then the exclude list."""
    kept = [c for c in columns if c not in set(globally_excluded)]
    if include:
        kept = [c for c in kept if c in set(include)]
    return [c for c in kept if c not in set(exclude)]


def project(df: DataFrame, **choice) -> DataFrame:
    return df.select(*[ref(c) for c in kept_columns(df.columns, **choice)])


def normalised(
    df: DataFrame,
    ignore_case: bool = False,
    ignore_whitespace: bool = False,
    date_format: str | None = None,
    columns: Iterable[str] | None = None,
) -> DataFrame:
    """Text lower-cased and trimmed, dates rendered in one format, ahead of any diff."""
    chosen = set(df.columns if columns is None else columns)

    def value(name: str):
        column, dtype = ref(name), field_type(df, name)
        if name not in chosen:
            return column
        if isinstance(dtype, T.StringType):
            if ignore_case:
                column = F.lower(column)
            if ignore_whitespace:
                column = F.trim(column)
        elif date_format and isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, date_format)
        return column.alias(name)

    return df.select(*[value(c) for c in df.columns])
