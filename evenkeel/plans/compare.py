"""Comparing table pairs: one result row per pair, and totals over the rows."""

from __future__ import annotations

import datetime
import time
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.functions.columns import common_columns, key_display, ref, union_all
from evenkeel.functions.ranking import with_rank
from evenkeel.operators.fingerprint import quick_compare
from evenkeel.operators.incremental import incremental_pair
from evenkeel.operators.row_diff import DIFFERENT, MATCH, cell_diff, key_states, row_diff_counts
from evenkeel.operators.schema_diff import schema_gap
from evenkeel.operators.set_diff import multiset_diff
from evenkeel.operators.table_filter import ComparisonFilter
from evenkeel.session import staged

# fixed values: texts of summaries and verdicts
SUMMARY_TEXTS = {
    "failed": "Failed: %s",
    "match": "✓ Complete match (%s rows)",
    "schema_diff_count": "%s schema diffs",
    "different_rows": "%s data diffs",
    "source_only_rows": "%s source-only",
    "target_only_rows": "%s target-only",
}
VERDICTS = ("Failed", "Differences Found", "All Match")
SUBJECTS = ("Comparison Failed - %s errors", "Differences Found - %s/%s tables", "All %s Tables Match")

MODES = ("quick", "standard", "deep")

RESULT_COLUMNS = (
    "source_table STRING, target_table STRING, mode STRING, status STRING, error_message STRING, "
    "schema_match BOOLEAN, schema_diff_count INT, source_row_count BIGINT, target_row_count BIGINT, "
    "matching_rows BIGINT, different_rows BIGINT, source_only_rows BIGINT, target_only_rows BIGINT"
)


class TablePair(NamedTuple):
    source_table: str
    target_table: str
    source: DataFrame
    target: DataFrame
    keys: tuple[str, ...] = ()
    on_duplicate: str = "raise"
    incremental_column: str | None = None

    def sides(self, settings: ComparisonFilter | None = None) -> tuple[DataFrame, DataFrame]:
        """Both tables, cut to the shared last date and filtered."""
        source, target = self.source, self.target
        if self.incremental_column:
            source, target = incremental_pair(source, target, self.incremental_column)
        if settings:
            source, target = settings.apply(self.source_table, source, target, self.keys)
        return source, target


def _quick_counts(source: DataFrame, target: DataFrame) -> DataFrame:
    """Counts as far as fingerprints tell: equal, or the whole table counts as different."""
    agree = F.col("fingerprint_match")
    s, t, zero = F.col("source_row_count"), F.col("target_row_count"), F.lit(0).cast("long")
    return quick_compare(source, target).select(
        "source_row_count",
        "target_row_count",
        F.when(agree, F.least(s, t)).otherwise(zero).alias("matching_rows"),
        F.when(~agree, F.greatest(s, t)).otherwise(zero).alias("different_rows"),
        zero.alias("source_only_rows"),
        zero.alias("target_only_rows"),
    )


def _equal_counts(spark: SparkSession, rows: int) -> DataFrame:
    counts = {
        "source_row_count": rows,
        "target_row_count": rows,
        "matching_rows": rows,
        "different_rows": 0,
        "source_only_rows": 0,
        "target_only_rows": 0,
    }
    return spark.range(0, 1, 1, 1).selectExpr(*[f"{n}L AS {name}" for name, n in counts.items()])


def compare_pair(
    pair: TablePair,
    mode: str = "quick",
    settings: ComparisonFilter | None = None,
    trust_fingerprints: bool = False,
) -> DataFrame:
    """One result row. `deep` counts like `standard`; its rows and cells come from `deep_differences`.

    With `trust_fingerprints`, a pair with equal fingerprints is reported as a match without
    shuffling its rows; the one-row fingerprint is read for that. Keys are then not checked.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    source, target = pair.sides(settings)
    gap = schema_gap(source.schema, target.schema)  # of the columns that are compared
    shared = common_columns(source, target)
    if mode == "quick" or not shared:
        counts = _quick_counts(source, target)
    elif trust_fingerprints and (found := quick_compare(source, target).first()).fingerprint_match:
        counts = _equal_counts(source.sparkSession, found.source_row_count)
    else:
        counts = row_diff_counts(source, target, list(pair.keys), on_duplicate=pair.on_duplicate, by_hash=True)
    return counts.select(
        F.lit(pair.source_table).alias("source_table"),
        F.lit(pair.target_table).alias("target_table"),
        F.lit(mode).alias("mode"),
        F.lit("completed").alias("status"),
        F.lit(None).cast("string").alias("error_message"),
        F.lit(not gap).alias("schema_match"),
        F.lit(len(gap)).alias("schema_diff_count"),
        *[c for c in counts.columns],
    )


def compare_tables(
    spark: SparkSession,
    pairs: list[TablePair],
    mode: str = "quick",
    isolate: bool = False,
    parallelism: int = 4,
    settings: ComparisonFilter | None = None,
    trust_fingerprints: bool = False,
) -> DataFrame:
    """One result row per pair.

    By default all pairs form one plan and one job; what a pair needs to know first, its cutoff
    or its fingerprints, is read for `parallelism` pairs at a time. With `isolate`, each pair
    runs as its own job; a pair that fails becomes a row with status `failed`, and each row
    also has when it started and ended (UTC), its duration and rows per second.
    """
    if not isolate:
        with ThreadPoolExecutor(max_workers=parallelism) as pool:
            compared = list(pool.map(lambda p: compare_pair(p, mode, settings, trust_fingerprints), pairs))
        return with_metrics(union_all(compared))

    def run(pair: TablePair) -> tuple:
        began, start = _now(), time.monotonic()
        try:
            row = tuple(compare_pair(pair, mode, settings, trust_fingerprints).first())
        except Exception as error:  # a failing pair must not stop the others
            message = str(error) or type(error).__name__
            row = (pair.source_table, pair.target_table, mode, "failed", message, False, 0, 0, 0, 0, 0, 0, 0)
        return (*row, began, _now(), time.monotonic() - start)

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        rows = list(pool.map(run, pairs))
    timed = spark.createDataFrame(
        rows, RESULT_COLUMNS + ", started_at TIMESTAMP_NTZ, completed_at TIMESTAMP_NTZ, duration_seconds DOUBLE"
    )
    rate = F.greatest("source_row_count", "target_row_count") / F.nullif("duration_seconds", F.lit(0.0))
    return with_metrics(timed.withColumn("rows_per_second", rate))


def _now() -> datetime.datetime:
    return datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)


def _deep_pair(pair: TablePair, settings: ComparisonFilter | None, limit: int | None) -> DataFrame:
    source, target = pair.sides(settings)
    nothing, one = F.lit(None).cast("string"), F.lit(1).cast("long")
    if pair.keys and pair.on_duplicate == "raise":
        keys = list(pair.keys)
        states = key_states(source, target, keys).where(F.col("difference_type") != MATCH)
        states = staged(states, "differing-keys", few_files=True)  # for the cells and the rows of one side
        cells = cell_diff(source, target, keys, states=states).select(
            "key_display", "column_name", "source_value", "target_value",
            F.lit(DIFFERENT).alias("difference_type"), one.alias("copies"),
        )
        rows = states.where(F.col("difference_type") != DIFFERENT).withColumn("key_display", key_display(keys))
    else:
        cells = None
        rows = multiset_diff(source, target, by_hash=True)
        rows = rows.withColumn("key_display", key_display(common_columns(source, target)))
    one_sided = rows.select(
        "key_display", nothing.alias("column_name"), nothing.alias("source_value"), nothing.alias("target_value"),
        "difference_type", ref("copies") if cells is None else one.alias("copies"),
    )
    found = one_sided if cells is None else cells.unionByName(one_sided)
    if limit is not None:
        found = found.orderBy("key_display", "difference_type", "column_name").limit(limit)
    return found.select(F.lit(pair.source_table).alias("table_name"), *found.columns)


def deep_differences(
    pairs: list[TablePair], limit: int | None = None, settings: ComparisonFilter | None = None, parallelism: int = 4
) -> DataFrame:
    """All differences of all pairs, the second half of a `deep` comparison.

    Pairs with a key give one row per differing cell and per row of one side; the others
    are compared as multisets and give one row per distinct row, with the number of `copies`
    that one side has more. The differing keys are written out when this is called,
    `parallelism` pairs at a time. `limit`, or else the `row_limit` of a table's filter, caps
    the report per pair, in the order of the displayed key.
    """

    def run(pair: TablePair) -> DataFrame:
        own = settings.of(pair.source_table).row_limit if settings else None
        return _deep_pair(pair, settings, own if limit is None else limit)

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        return union_all(list(pool.map(run, pairs)))


def is_match() -> Column:
    return (
        F.col("schema_match")
        & (F.col("source_row_count") == F.col("target_row_count"))
        & (F.col("different_rows") == 0)
        & (F.col("source_only_rows") == 0)
        & (F.col("target_only_rows") == 0)
    )


def match_percentage() -> Column:
    total = F.greatest("source_row_count", "target_row_count")
    return F.when(total == 0, F.lit(100.0)).otherwise(F.col("matching_rows") / total * 100)


def summary_text() -> Column:
    def text(name: str, column: str | Column | None = None) -> Column:
        return F.format_string(SUMMARY_TEXTS[name], name if column is None else column)

    rows = [F.when(F.col(c) > 0, text(c)) for c in ("different_rows", "source_only_rows", "target_only_rows")]
    return (
        F.when(F.col("status") == "failed", text("failed", F.coalesce("error_message", F.lit("None"))))
        .when(is_match(), text("match", "source_row_count"))
        .otherwise(F.concat_ws(", ", F.when(~F.col("schema_match"), text("schema_diff_count")), *rows))
    )


def with_metrics(results: DataFrame) -> DataFrame:
    """Adds match_percentage, is_match and summary."""
    return results.select(
        "*",
        match_percentage().alias("match_percentage"),
        is_match().alias("is_match"),
        summary_text().alias("summary"),
    )


def run_summary(results: DataFrame) -> DataFrame:
    """One row of totals over the results of a run, with the duration if it was taken."""
    failed = F.col("status") == "failed"
    duration = "duration_seconds" in results.columns
    return results.agg(
        *([F.coalesce(F.sum("duration_seconds"), F.lit(0.0)).alias("total_duration_seconds")] if duration else []),
        F.count("*").alias("total_tables"),
        F.count_if(F.col("is_match")).alias("matching_tables"),
        F.count_if(~F.col("is_match") & ~failed).alias("different_tables"),
        F.count_if(failed).alias("failed_tables"),
        F.coalesce(F.sum("source_row_count"), F.lit(0)).alias("total_source_rows"),
        F.coalesce(F.sum("target_row_count"), F.lit(0)).alias("total_target_rows"),
    )


def filter_results(results: DataFrame, status: str = "All") -> DataFrame:
    """Results by verdict: All, Matching, Different or Failed."""
    conditions = {
        "Matching": F.col("is_match"),
        "Different": ~F.col("is_match") & (F.col("status") == "completed"),
        "Failed": F.col("status") == "failed",
    }
    return results.where(conditions[status]) if status in conditions else results


def sort_results(results: DataFrame, by: str = "Table Name", descending: bool = False) -> DataFrame:
    """Results with their position in the chosen order; ties go by table name."""
    keys = {
        "Table Name": F.col("source_table"),
        "Source Rows": F.col("source_row_count"),
        "Differences": F.col("different_rows") + F.col("source_only_rows") + F.col("target_only_rows"),
    }
    if "duration_seconds" in results.columns:
        keys["Duration"] = F.col("duration_seconds")
    if by not in keys:
        raise ValueError(f"cannot sort by {by!r}; choose from {sorted(keys)}")
    key = keys[by].desc() if descending else keys[by].asc()
    return with_rank(results, [key, F.col("source_table").asc(), F.col("target_table").asc()], "position")


def row_count_chart(results: DataFrame, tables: int = 10) -> DataFrame:
    """Row counts of the first tables by name, under their short names."""
    return (
        results.orderBy("source_table", "target_table")
        .limit(tables)
        .select(
            F.element_at(F.split("source_table", r"\."), -1).alias("table_name"),
            "source_row_count",
            "target_row_count",
        )
    )


def run_verdict(totals: DataFrame) -> DataFrame:
    """Adds the verdict of a run and its one-line subject to rows of totals."""
    failed, different, total = F.col("failed_tables"), F.col("different_tables"), F.col("total_tables")
    subjects = (
        F.format_string(SUBJECTS[0], failed),
        F.format_string(SUBJECTS[1], different, total),
        F.format_string(SUBJECTS[2], total),
    )

    def choice(values) -> Column:
        return F.when(failed > 0, values[0]).when(different > 0, values[1]).otherwise(values[2])

    return totals.select("*", choice(VERDICTS).alias("verdict"), choice(subjects).alias("subject"))
