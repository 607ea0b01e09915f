"""Filter settings for the tables of a comparison."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from evenkeel.functions.columns import quoted
from evenkeel.functions.predicates import ColumnFilter, conjunction
from evenkeel.operators.comparable import kept_columns, normalised
from evenkeel.sources.inventory import eligible_tables


class TableFilter(NamedTuple):
    """Rows and columns of one table that take part. `row_limit` caps the differences that are
    reported of it, in key order; all rows are compared."""

    filters: tuple[ColumnFilter, ...] = ()
    include: tuple[str, ...] | None = None
    exclude: tuple[str, ...] = ()
    row_limit: int | None = None


class ComparisonFilter(NamedTuple):
    """Settings for all tables: one filter per table name, and which tables qualify."""

    table_filters: dict[str, TableFilter] = {}
    exclude_columns: tuple[str, ...] = ()
    name_pattern: str | None = None
    exclude_empty: bool = False
    min_rows: int = 0
    max_rows: int | None = None
    ignore_case: bool = False
    ignore_whitespace: bool = False
    date_format: str | None = None

    def tables(self, inventory: DataFrame) -> DataFrame:
        return eligible_tables(inventory, self.name_pattern, self.exclude_empty, self.min_rows, self.max_rows)

    def of(self, table_name: str) -> TableFilter:
        return self.table_filters.get(table_name, TableFilter())

    def apply(self, table_name: str, source: DataFrame, target: DataFrame, keys: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
        """Both sides of a table, filtered, cut to the compared columns and normalised.

        Predicates come first, so that they may use columns that are not compared. A filter
        applies to both sides or, if one lacks its column, to none. Keys are not normalised.
        """
        chosen = self.of(table_name)
        shared = [c for c in source.columns if c in target.columns]

        def side(df: DataFrame) -> DataFrame:
            kept = kept_columns(df.columns, chosen.include, chosen.exclude, self.exclude_columns)
            rows = df.where(conjunction(chosen.filters, shared)).selectExpr(*[quoted(c) for c in kept])
            if not (self.ignore_case or self.ignore_whitespace or self.date_format):
                return rows
            values = [c for c in kept if c not in keys]
            return normalised(rows, self.ignore_case, self.ignore_whitespace, self.date_format, values)

        return side(source), side(target)
