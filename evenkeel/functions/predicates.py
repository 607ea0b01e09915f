"""Column filters as Spark predicates, so that they reach the scan."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.columns import ref


def _listed(value: Any) -> list:
    return list(value) if isinstance(value, (list, tuple, set, frozenset)) else [value]


_CONDITIONS = {
    "eq": lambda c, v, _: c == v,
    "ne": lambda c, v, _: c != v,
    "gt": lambda c, v, _: c > v,
    "gte": lambda c, v, _: c >= v,
    "lt": lambda c, v, _: c < v,
    "lte": lambda c, v, _: c <= v,
    "in": lambda c, v, _: c.isin(_listed(v)),
    "not_in": lambda c, v, _: ~c.isin(_listed(v)),
    "like": lambda c, v, _: c.ilike(v),
    "not_like": lambda c, v, _: ~c.ilike(v),
    "is_null": lambda c, _, __: c.isNull(),
    "is_not_null": lambda c, _, __: c.isNotNull(),
    "between": lambda c, low, high: c.between(low, high),
    "regex": lambda c, v, _: c.rlike(f"^(?:{v})"),
}


class ColumnFilter(NamedTuple):
    """One condition on one column. `like` ignores case; `regex` matches from the start."""

    column: str
    operator: str
    value: Any = None
    value2: Any = None

    def condition(self) -> Column:
        if self.operator not in _CONDITIONS:
            raise ValueError(f"unknown filter operator {self.operator!r}")
        return _CONDITIONS[self.operator](ref(self.column), self.value, self.value2)


def conjunction(filters: Iterable[ColumnFilter], columns: list[str]) -> Column:
    """All filters whose column exists, combined with AND."""
    conditions = [f.condition() for f in filters if f.column in columns]
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def apply_filters(
    df: DataFrame,
    filters: Iterable[ColumnFilter],
    order_by: list[str] | None = None,
    row_limit: int | None = None,
) -> DataFrame:
    df = df.where(conjunction(filters, df.columns))
    if row_limit is not None and not order_by:
        order_by = df.columns
    if order_by:
        df = df.orderBy(*[ref(c) for c in order_by])
    return df.limit(row_limit) if row_limit is not None else df


def date_range(column: str, start: Any, end: Any) -> ColumnFilter:
    return ColumnFilter(column, "between", start, end)


def non_null(column: str) -> ColumnFilter:
    return ColumnFilter(column, "is_not_null")


def exact(column: str, value: Any) -> ColumnFilter:
    return ColumnFilter(column, "eq", value)


def pattern(column: str, like: str) -> ColumnFilter:
    return ColumnFilter(column, "like", like)


def in_list(column: str, values: list) -> ColumnFilter:
    return ColumnFilter(column, "in", values)
