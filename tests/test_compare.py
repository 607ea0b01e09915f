import datetime

import pytest
from pyspark.sql import functions as F

from evenkeel.functions.predicates import ColumnFilter
from evenkeel.operators.incremental import cut, date_columns, incremental_cutoff, incremental_pair
from evenkeel.operators.table_filter import ComparisonFilter, TableFilter
from evenkeel.plans import compare as C
from evenkeel.plans.reports import comparison_report, difference_report
from tests.conftest import rows

SCHEMA = C.RESULT_COLUMNS


def result(name="t", status="completed", error=None, schema_match=True, gaps=0, counts=(0, 0, 0, 0, 0, 0)):
    return (name, name, "standard", status, error, schema_match, gaps, *counts)


def metrics(spark, *results):
    return C.with_metrics(spark.createDataFrame(list(results), SCHEMA))


@pytest.mark.parametrize("kwargs, percent, match, summary", [
    (dict(counts=(100, 100, 75, 25, 0, 0)), 75.0, False, "25 data diffs"),
    (dict(counts=(100, 100, 100, 0, 0, 0)), 100.0, True, "✓ Complete match (100 rows)"),
    (dict(counts=(0, 0, 0, 0, 0, 0)), 100.0, True, "✓ Complete match (0 rows)"),
    (dict(counts=(50, 55, 45, 5, 0, 5), schema_match=False, gaps=2), 45 / 55 * 100, False, "2 schema diffs, 5 data diffs, 5 target-only"),
    (dict(status="failed", error="no route"), 100.0, True, "Failed: no route"),
])
def test_metrics(spark, kwargs, percent, match, summary):
    row = metrics(spark, result(**kwargs)).first()
    assert row.match_percentage == pytest.approx(percent)
    assert (row.is_match, row.summary) == (match, summary)


@pytest.fixture(scope="module")
def run(spark):
    return metrics(
        spark,
        result("s.b", counts=(10, 10, 10, 0, 0, 0)),
        result("s.a", counts=(5, 7, 3, 2, 0, 2)),
        result("s.c", "failed", "boom", False),
    )


def test_totals_filters_and_order(run):
    assert tuple(C.run_summary(run).first()) == (3, 1, 1, 1, 15, 17)
    names = {s: rows(C.filter_results(run, s), "source_table") for s in ("All", "Matching", "Different", "Failed")}
    assert names == {"All": [("s.a",), ("s.b",), ("s.c",)], "Matching": [("s.b",)], "Different": [("s.a",)], "Failed": [("s.c",)]}
    assert rows(C.sort_results(run, "Source Rows", True), "position", "source_table") == [(1, "s.b"), (2, "s.a"), (3, "s.c")]
    assert rows(C.sort_results(run), "position", "source_table") == [(1, "s.a"), (2, "s.b"), (3, "s.c")]
    assert rows(C.row_count_chart(run, 2)) == [("a", 5, 7), ("b", 10, 10)]
    with pytest.raises(ValueError):
        C.sort_results(run, "Duration")


def test_verdict(spark):
    totals = spark.createDataFrame([(3, 1, 1, 1), (3, 2, 1, 0), (3, 3, 0, 0)], "total_tables INT, matching_tables INT, different_tables INT, failed_tables INT")
    assert rows(C.run_verdict(totals), "verdict", "subject") == [
        ("All Match", "All 3 Tables Match"),
        ("Differences Found", "Differences Found - 1/3 tables"),
        ("Failed", "Comparison Failed - 1 errors"),
    ]


def pair(spark, name, left, right, **kwargs):
    schema = "k INT, v STRING"
    return C.TablePair(name, name, spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ("k",), **kwargs)


def test_modes(spark):
    p = pair(spark, "t", [(1, "a"), (2, "b")], [(1, "a"), (2, "c"), (3, "d")])
    assert tuple(C.compare_pair(p, "quick").first())[7:] == (2, 3, 0, 3, 0, 0)
    assert tuple(C.compare_pair(p, "standard").first())[7:] == (2, 3, 1, 1, 0, 1)
    assert rows(C.deep_differences([p]), "key_display", "source_value", "target_value", "difference_type") == [
        ("k=2", "b", "c", "data_different"),
        ("k=3", None, None, "data_only_target"),
    ]
    with pytest.raises(ValueError):
        C.compare_pair(p, "thorough")


def test_early_exit_and_filters(spark):
    same = pair(spark, "t", [(1, "a"), (2, "b")], [(2, "b"), (1, "a")])
    other = pair(spark, "u", [(1, "a"), (2, "b")], [(1, "a"), (2, "c")])
    found = C.compare_tables(spark, [same, other], "standard", trust_fingerprints=True)
    assert rows(found, "source_table", "matching_rows", "different_rows", "is_match") == [("t", 2, 0, True), ("u", 1, 1, False)]
    settings = ComparisonFilter({"u": TableFilter((ColumnFilter("k", "lt", 2),))}, name_pattern="u", min_rows=1)
    assert C.compare_tables(spark, [other], "standard", settings=settings).first().is_match
    assert C.compare_tables(spark, [other], "quick", settings=ComparisonFilter(exclude_columns=("v",))).first().is_match
    with pytest.raises(ValueError):
        C.deep_differences([other], settings=ComparisonFilter(exclude_columns=("v",)))
    inventory = spark.createDataFrame([("t", 5), ("u", 5), ("u2", 0)], "table_name STRING, row_count BIGINT")
    assert rows(settings.tables(inventory), "table_name") == [("u",)]


def test_quick_without_common_columns(spark):
    p = C.TablePair("a", "b", spark.createDataFrame([(1,)], "x INT"), spark.createDataFrame([(1,)], "y INT"))
    row = C.with_metrics(C.compare_pair(p)).first()
    assert (row.schema_diff_count, row.matching_rows, row.different_rows, row.is_match) == (2, 0, 0, False)


def test_isolated_failure(spark):
    good = pair(spark, "good", [(1, "a")], [(1, "a")])
    bad = pair(spark, "bad", [(1, "a"), (1, "b")], [(1, "a")])
    found = C.compare_tables(spark, [good, bad], "standard", isolate=True)
    by_name = {r.source_table: r for r in found.collect()}
    assert by_name["good"].is_match and by_name["good"].duration_seconds > 0
    assert by_name["bad"].status == "failed" and "duplicate key" in by_name["bad"].summary
    assert rows(C.sort_results(found, "Duration"), "position")[-1] == (2,)
    with pytest.raises(Exception, match="duplicate key"):
        C.compare_tables(spark, [good, bad], "standard").collect()


def test_incremental(spark):
    day = datetime.datetime(2024, 1, 1, 0, 0, 0, 250000)
    later = day + datetime.timedelta(days=1)
    s = spark.createDataFrame([(1, day), (2, later)], "id INT, at TIMESTAMP_NTZ")
    t = spark.createDataFrame([(1, day)], "id INT, at TIMESTAMP_NTZ")
    assert date_columns(s) == ["at"]
    assert incremental_cutoff(s, t, "at").first().cutoff == day
    left, right = incremental_pair(s, t, "at")
    assert (rows(left, "id"), rows(right, "id")) == ([(1,)], [(1,)])
    assert incremental_cutoff(s, s, "at").first().cutoff is None
    assert incremental_cutoff(s, s.limit(0), "at").first().cutoff is None
    assert incremental_pair(s, s.limit(0), "at")[0].count() == 2
    assert cut(s, "at", None) is s
    p = C.TablePair("s", "t", s, t, ("id",), incremental_column="at")
    assert C.with_metrics(C.compare_pair(p, "standard")).first().is_match


def test_incremental_cutoff_is_pushed_down(spark, folder, capsys):
    events = spark.read.parquet(f"{folder}/events.parquet")
    cut(events, "ts", "2024-01-10 12:00:00.5").select("event_id").explain("formatted")
    assert "LessThanOrEqual(ts,2024-01-10T12:00:00.500" in capsys.readouterr().out


def test_reports(spark, run):
    report = comparison_report(run.where("source_table = 's.a'")).first()
    assert (report.source_rows, report.match_percentage) == ("5", "42.86%")
    none = spark.createDataFrame([("t", None, None, "int")], "table_name STRING, column_name STRING, source_value STRING, target_value STRING")
    cells = spark.range(20).select(
        F.lit("t").alias("table_name"), F.format_string("k=%02d", "id").alias("key_display"), F.lit("c").alias("column_name"),
        F.lit(None).cast("string").alias("source_value"), F.lit("x").alias("target_value"),
    )
    found = difference_report(none, cells, 3)
    assert rows(found.where("section = 'data'"), "key_display", "source_value") == [("k=00", ""), ("k=01", ""), ("k=02", "")]
    assert rows(found.where("section = 'schema'"), "column_name", "target_value") == [("", "int")]


def test_deep_lists_keyless_and_one_sided_rows(spark):
    schema = "k INT, v STRING"
    left = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], schema)
    right = spark.createDataFrame([(1, "a"), (3, "c")], schema)
    keyless = C.TablePair("t", "t", left, right)
    keyed = pair(spark, "u", [(1, "a")], [(2, "a")])
    found = C.deep_differences([keyless, keyed])
    assert rows(found, "table_name", "key_display", "difference_type", "copies") == [
        ("t", "k=1, v=a", "data_only_source", 1),
        ("t", "k=2, v=b", "data_only_source", 1),
        ("t", "k=3, v=c", "data_only_target", 1),
        ("u", "k=1", "data_only_source", 1),
        ("u", "k=2", "data_only_target", 1),
    ]


def test_row_limit_caps_the_report_and_not_the_input(spark):
    p = pair(spark, "t", [(1, "a"), (2, "b"), (3, "c")], [(2, "x"), (3, "c"), (4, "d")])
    settings = ComparisonFilter({"t": TableFilter(row_limit=2)})
    assert C.compare_tables(spark, [p], "standard", settings=settings).first().matching_rows == 1
    assert C.deep_differences([p], settings=settings).count() == 2
    assert C.deep_differences([p]).count() == 3


def test_more_than_a_thousand_differences(spark):
    left = spark.range(1500).selectExpr("id AS k", "'a' AS v")
    right = spark.range(1500).selectExpr("id AS k", "'b' AS v")
    assert C.deep_differences([C.TablePair("t", "t", left, right, ("k",))]).count() == 1500


def test_filter_on_a_column_of_one_side_applies_to_neither(spark):
    left = spark.createDataFrame([(1, "a", 9), (2, "b", 1)], "k INT, v STRING, only INT")
    right = spark.createDataFrame([(1, "a"), (2, "b")], "k INT, v STRING")
    settings = ComparisonFilter({"t": TableFilter((ColumnFilter("only", "gt", 5),), exclude=("only",))})
    row = C.compare_tables(spark, [C.TablePair("t", "t", left, right, ("k",))], "standard", settings=settings).first()
    assert (row.matching_rows, row.target_only_rows, row.schema_match) == (2, 0, True)


def test_error_without_a_message_is_isolated(spark, monkeypatch):
    def fail(*args, **kwargs):
        raise KeyError

    good = pair(spark, "good", [(1, "a")], [(1, "a")])
    monkeypatch.setattr(C, "row_diff_counts", fail)
    row = C.compare_tables(spark, [good], "standard", isolate=True).first()
    assert (row.status, row.error_message) == ("failed", "KeyError") and row.completed_at >= row.started_at


def test_rows_without_a_date_take_part(spark):
    day = datetime.datetime(2024, 1, 1)
    schema = "id INT, at TIMESTAMP_NTZ"
    s = spark.createDataFrame([(1, day), (2, day + datetime.timedelta(days=1)), (3, None)], schema)
    t = spark.createDataFrame([(1, day)], schema)
    row = C.with_metrics(C.compare_pair(C.TablePair("s", "t", s, t, ("id",), incremental_column="at"), "standard")).first()
    assert (row.matching_rows, row.source_only_rows, row.is_match) == (1, 1, False)


def test_normalisation_in_a_comparison(spark):
    p = pair(spark, "t", [(1, " Ab ")], [(1, "aB")])
    assert not C.compare_tables(spark, [p], "standard").first().is_match
    assert C.compare_tables(spark, [p], "standard", settings=ComparisonFilter(ignore_case=True, ignore_whitespace=True)).first().is_match
