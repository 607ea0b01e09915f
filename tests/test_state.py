import json
import os

import pytest
from pyspark.sql import functions as F

from evenkeel.operators.change_set import apply_change_set, change_counts, change_set, merge_statement
from evenkeel.operators.storage import (
    apply_advice,
    by_savings,
    measure_codecs,
    savings_percent,
    storage_advice,
    storage_rewrite_plan,
)
from evenkeel.session import fresh_path, shared_dir
from evenkeel.sources import history as H
from evenkeel.sources import jdbc, sinks
from evenkeel.sources.fixtures import view
from tests.conftest import rows
from tests.test_compare import metrics, result


def test_change_set_makes_target_equal_source(spark, folder):
    s, t = view(spark, folder, "orders"), view(spark, folder, "orders_t")
    changes = change_set(s, t, ["o_orderkey"])
    assert tuple(change_counts(changes).first()) == (89, 209, 79)
    after = apply_change_set(t, changes, ["o_orderkey"])
    assert after.exceptAll(s).count() == 0 and s.exceptAll(after).count() == 0


def test_change_set_with_null_key_and_composite_key(spark):
    schema = "a INT, b STRING, v INT"
    s = spark.createDataFrame([(None, "x", 1), (1, None, 2), (2, "y", 3)], schema)
    t = spark.createDataFrame([(None, "x", 9), (1, None, 2), (3, "z", 4)], schema)
    changes = change_set(s, t, ["a", "b"])
    assert rows(changes, "op", "a", "b", "v") == [("DELETE", 3, "z", None), ("INSERT", 2, "y", 3), ("UPDATE", None, "x", 1)]
    assert rows(apply_change_set(t, changes, ["a", "b"])) == rows(s)
    assert change_set(s, s, ["a", "b"]).count() == 0


def test_merge_statement():
    text = merge_statement("src.t", "tgt.t", ["k"], ["k", "v"])
    assert text.startswith("MERGE INTO `tgt`.`t` t USING `src`.`t` s ON t.`k` <=> s.`k`\n")
    assert "WHEN NOT MATCHED BY SOURCE THEN DELETE" in text


def test_shared_dir(spark):
    class Conf:
        def __init__(self, value):
            self.value = value

        def get(self, key, default):
            assert key == "spark.checkpoint.dir"
            return self.value or default

    class Context:
        master, applicationId = "yarn", "app"

    class Session:
        def __init__(self, value):
            self.conf, self.sparkContext = Conf(value), Context()

    assert shared_dir(spark) == shared_dir(spark)
    assert fresh_path(Session("hdfs://shared/"), "x").startswith("hdfs://shared/evenkeel-app/x-")
    unset = Session(None)
    unset.conf.get = lambda key, default=None: "hdfs://warehouse/" if key == "spark.sql.warehouse.dir" else default
    assert shared_dir(unset) == "hdfs://warehouse/_staging"


@pytest.fixture()
def history(spark):
    return H.History(spark, fresh_path(spark, "history"))


def test_history_round_trip(spark, history):
    history.open_run("r1", "2024-01-01 10:00:00", "src", "tgt")
    history.open_run("r2", "2024-01-02 10:00:00", "src", "tgt")
    history.complete_run("r1", "2024-01-01 11:00:00", total_tables=2, matching_tables=1, different_tables=1, failed_tables=0)
    by_id = {r.run_id: r for r in history.runs().collect()}
    assert (by_id["r1"].status, by_id["r1"].total_tables, by_id["r1"].source_database) == ("completed", 2, "src")
    assert (by_id["r2"].status, by_id["r2"].completed_at, by_id["r2"].total_tables) == ("running", None, 0)

    compared = metrics(spark, result("orders", counts=(100, 100, 99, 1, 0, 0)), result("empty")).withColumn("run_id", F.lit("r1"))
    cells = spark.createDataFrame([("orders", f"k={i:04}", "v", None, 'a "b"') for i in range(12)], "source_table STRING, key_display STRING, column_name STRING, source_value STRING, target_value STRING")
    history.save_results(H.attach_differences(compared, cells, ["source_table"], limit=10))
    history.save_results(H.attach_differences(compared.withColumn("run_id", F.lit("r2")), cells, ["source_table"], limit=1))
    found = {r.source_table: r for r in history.results("r1").collect()}
    assert len(found["orders"].data_differences) == 10 and found["empty"].data_differences == []
    first = found["orders"].data_differences[0]
    assert (first.key, first.source_value, first.target_value) == ("k=0000", None, 'a "b"')
    assert history.results().count() == 4

    gaps = spark.createDataFrame(
        [("orders", "schema_only_source", "c", "int", None, "Column exists only in source")],
        "table_name STRING, difference_type STRING, column_name STRING, source_value STRING, target_value STRING, description STRING",
    )
    listed = H.from_json_text(H.to_json_text(H.attach_schema_differences(H.attach_differences(compared, cells, ["source_table"], 5), gaps)))
    by_table = {r.source_table: r.schema_differences for r in listed.collect()}
    assert [d.column_name for d in by_table["orders"]] == ["c"] and by_table["empty"] == []

    totals = {r.metric: r.value for r in H.statistics(history.runs(), history.results("r1")).collect()}
    assert totals == {"total_runs": 2, "total_tables_compared": 2, "matching_tables": 0, "different_tables": 1, "failed_tables": 0}

    assert history.delete_run("r1", "2024-01-03 00:00:00") is True
    assert history.delete_run("r9", "2024-01-03 00:00:00") is False
    assert rows(history.runs(), "run_id") == [("r2",)]
    assert history.results("r1").count() == 0 and history.results().count() == 2
    compacted = history.compact(fresh_path(spark, "history"))
    assert rows(compacted.runs(), "run_id") == [("r2",)] and compacted.results().count() == 2


def test_empty_history(history):
    assert history.runs().count() == 0 and history.results().count() == 0
    totals = {r.metric: r.value for r in H.statistics(history.runs(), history.results()).collect()}
    assert set(totals.values()) == {0}
    assert history.cleanup("2024-01-01 00:00:00") == 0


def test_one_run_reads_one_bucket(spark, history, capsys):
    names = spark.range(200).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("run_id"))
    history.log(names.select("run_id", F.lit("opened").alias("event"), F.lit("2024-01-01").cast("timestamp_ntz").alias("at")))
    results = names.select("run_id", F.lit("t").alias("source_table"), F.array().cast(H.DIFFERENCES).alias("data_differences"))
    history.save_results(results)
    assert rows(history.results("r7"), "run_id") == [("r7",)]
    history.results("r7").explain("formatted")
    assert "PartitionFilters: [isnotnull(run_bucket" in capsys.readouterr().out
    (append,) = (d for d in os.listdir(history.results_path) if d.startswith("append="))
    found = os.listdir(f"{history.results_path}/{append}")
    assert 0 < len([d for d in found if d.startswith("run_bucket=")]) <= H.RESULT_BUCKETS


def test_parallel_appends(spark, history):
    from concurrent.futures import ThreadPoolExecutor

    def save(i):
        history.open_run(f"r{i}", "2024-01-01 10:00:00")
        one = spark.createDataFrame([(f"r{i}", "t", f"k={j}", "v", "a", "b") for j in range(3)], ", ".join(H.DIFFERENCE_ROWS.split(", ")[:6]))
        history.save_differences(one)

    with ThreadPoolExecutor(8) as pool:
        list(pool.map(save, range(8)))
    assert history.runs().count() == 8 and history.differences().count() == 24 and history.differences("r3").count() == 3


def test_all_differences_are_stored(spark, history):
    history.open_run("r1", "2024-01-01 10:00:00")
    many = spark.range(1200).selectExpr("'r1' AS run_id", "'t' AS source_table", "concat('k=', id) AS key_display", "'v' AS column_name")
    history.save_differences(many)
    assert history.differences("r1").count() == 1200
    assert history.compact(fresh_path(spark, "history")).differences().count() == 1200


def test_updates_keep_columns_that_only_the_target_has(spark):
    from evenkeel.operators.change_set import apply_change_set, change_set

    source = spark.createDataFrame([(1, "new"), (3, "x")], "k INT, v STRING")
    target = spark.createDataFrame([(1, "old", "keep"), (2, "gone", "gone")], "k INT, v STRING, own STRING")
    after = apply_change_set(target, change_set(source, target, ["k"]), ["k"])
    assert rows(after, "k", "v", "own") == [(1, "new", "keep"), (3, "x", None)]


def test_retention(history):
    for days, name in ((1, "a"), (10, "b"), (29, "c"), (31, "d"), (90, "e")):
        at = f"2024-{'03' if days < 30 else '02' if days < 60 else '01'}-{ {1: 30, 10: 21, 29: '02', 31: 29, 90: '01'}[days] } 00:00:00"
        history.open_run(name, at)
    assert history.cleanup("2024-03-31 00:00:00", 30) == 2
    assert rows(history.runs(), "run_id") == [("a",), ("b",), ("c",)]
    assert history.cleanup("2024-03-31 00:00:00", 30) == 0


def test_pages(history):
    for i in range(5):
        history.open_run(f"r{i}", f"2024-01-0{i + 1} 00:00:00")
    history.complete_run("r1", "2024-01-09 00:00:00")
    pages = [[r.run_id for r in H.page(history.runs(), 3, offset).collect()] for offset in (0, 3)]
    assert pages == [["r4", "r3", "r2"], ["r1", "r0"]]
    assert rows(H.page(history.runs(), status="completed"), "run_id") == [("r1",)]


def sizes(spark, *tables):
    """(name, current, snappy, gzip, zstd) as rows per codec."""
    data = [(n, c, s, "uncompressed", cur, 5000) for n, cur, *opts in tables for c, s in zip(("snappy", "gzip", "zstd"), opts)]
    return spark.createDataFrame(data, "table_name STRING, codec STRING, size_kb DOUBLE, current_codec STRING, current_size_kb DOUBLE, row_count BIGINT")


def test_storage_advice(spark):
    found = storage_advice(sizes(
        spark, ("t1", 1000.0, 960.0, 700.0, 600.0), ("t2", 1000.0, 970.0, 960.0, 955.0), ("t3", 1000.0, 900.0, 930.0, 940.0),
        ("t4", 1000.0, None, None, None), ("t5", 0.0, 0.0, 0.0, 0.0), ("t6", 1000.0, 400.0, 400.0, 400.0),
    ))
    assert rows(found, "table_name", "recommended_codec", "priority", "should_apply") == [
        ("t1", "zstd", "medium", True), ("t3", "snappy", "low", False), ("t6", "snappy", "high", True),
    ]
    assert [r.table_name for r in by_savings(found).collect()] == ["t6", "t1", "t3"]
    assert "could save ~40.0% space" in found.where("table_name = 't1'").first().reason
    assert rows(storage_rewrite_plan(found, "high"), "table_name") == [("t6",)]
    assert rows(storage_rewrite_plan(found, "low"), "table_name") == [("t1",), ("t6",)]
    with pytest.raises(ValueError):
        storage_rewrite_plan(found, "urgent")
    assert storage_advice(sizes(spark, ("t1", 1000.0, 960.0, 700.0, 600.0)), min_rows=5001).count() == 0


def test_savings(spark):
    assert spark.range(1).select(savings_percent(F.lit(1000.0), F.lit(600.0))).first()[0] == pytest.approx(40.0)
    assert spark.range(1).select(savings_percent(F.lit(0.0), F.lit(1.0))).first()[0] is None


def test_measure_and_apply(spark, folder):
    df = view(spark, folder, "lineitem")
    measured = measure_codecs(df, "lineitem", fraction=1.0)
    by_codec = {r.codec: r for r in measured.collect()}
    assert set(by_codec) == {"snappy", "gzip", "zstd"}
    assert all(0 < r.size_kb < r.current_size_kb for r in by_codec.values())
    assert by_codec["gzip"].row_count == df.count()
    advice = storage_advice(measured)
    out = fresh_path(spark, "rewritten")
    assert apply_advice(advice, {"lineitem": df}, out, "low", dry_run=True)[0].startswith("-- Switching from uncompressed")
    paths = apply_advice(advice, {"lineitem": df}, out, "low", dry_run=False)
    assert spark.read.parquet(paths[0]).count() == df.count()


def test_sinks(spark):
    results = metrics(spark, result("t1", counts=(100, 100, 100, 0, 0, 0)), result("t2", counts=(50, 55, 45, 5, 0, 5), schema_match=False, gaps=1))
    differences = spark.createDataFrame(
        [("t2", "schema_only_source", "c", "int", None, "Column exists only in source")],
        "table_name STRING, difference_type STRING, column_name STRING, source_value STRING, target_value STRING, description STRING",
    )
    out = fresh_path(spark, "out")
    assert sinks.write_csv(results, None, f"{out}/plain") == [f"{out}/plain/summary"]
    paths = sinks.write_csv(results, differences, f"{out}/csv")
    summary = spark.read.option("header", True).schema(sinks.CSV_SUMMARY).csv(paths[0])
    assert rows(summary, "source_table", "source_rows", "different_rows") == [("t1", 100, 0), ("t2", 50, 5)]
    counts = spark.createDataFrame([("t2", 7)], "table_name STRING, data_differences_count INT")
    sinks.write_json(sinks.json_results(results, differences, counts), f"{out}/json", "2024-01-01T00:00:00")
    documents = [json.loads(r.value) for r in spark.read.text(f"{out}/json/results").collect()]
    by_name = {d["source_table"]: d for d in documents}
    assert by_name["t2"]["schema_differences"][0]["column"] == "c" and by_name["t2"]["data_differences_count"] == 7
    assert by_name["t1"]["schema_differences"] == [] and by_name["t1"]["error_message"] is None
    assert spark.read.json(f"{out}/json/envelope").first().total_comparisons == 2
    assert sinks.json_results(results).where("data_differences_count = 0").count() == 2


def test_recommendation_formats(spark):
    advice = storage_advice(sizes(spark, ("t1", 1000.0, 960.0, 700.0, 600.0)))
    out = fresh_path(spark, "advice")
    for kind in ("csv", "json"):
        sinks.write_recommendations(advice, f"{out}/{kind}", kind)
    row = spark.read.option("header", True).csv(f"{out}/csv").first()
    assert (row["Table"], row["Savings %"], row["Current Size (MB)"]) == ("t1", "40.0%", "0.98")
    with pytest.raises(ValueError):
        sinks.write_recommendations(advice, f"{out}/xlsx", "excel")


@pytest.mark.parametrize("db_type, url, table", [
    ("sqlserver", "jdbc:sqlserver://h:1;databaseName=d;trustServerCertificate=true", "[dbo].[a]]b]"),
    ("postgresql", "jdbc:postgresql://h:1/d", '"dbo"."a]b"'),
    ("mysql", "jdbc:mysql://h:1/d", "`a]b`"),
])
def test_jdbc_options(db_type, url, table):
    connection = jdbc.Connection(db_type, "h:1", "d", "u", "p")
    found = jdbc.table_options(connection, "dbo", "a]b", "id", (1, 900), 8)
    assert (found["url"], found["dbtable"], found["user"], found["fetchsize"]) == (url, table, "u", "10000")
    assert [found[k] for k in ("partitionColumn", "lowerBound", "upperBound", "numPartitions")] == ["id", "1", "900", "8"]
    assert jdbc.row_count_options(connection, "dbo", "a]b")["query"] == f"SELECT COUNT(*) AS row_count FROM {table}"
    assert jdbc.bounds_options(connection, "dbo", "a]b", "id")["query"].endswith(f" AS high FROM {table}")
    assert "numPartitions" not in jdbc.table_options(connection, "dbo", "a]b", in_one_task=True)


def test_jdbc_errors_and_integrated_security():
    with pytest.raises(ValueError):
        jdbc.options(jdbc.Connection("oracle", "h", "d"))
    with pytest.raises(ValueError):
        jdbc.table_options(jdbc.Connection("mysql", "h", "d"), "s", "t", "id")
    with pytest.raises(ValueError):
        jdbc.table_options(jdbc.Connection("mysql", "h", "d"), "s", "t")
    found = jdbc.options(jdbc.Connection("sqlserver", "h", "d", integrated_security=True))
    assert found["url"].endswith(";integratedSecurity=true") and "user" not in found
    with pytest.raises(ValueError):
        jdbc.options(jdbc.Connection("mysql", "h", "d", integrated_security=True))


def test_jdbc_catalog_columns(spark):
    catalog = spark.createDataFrame(
        [("dbo", "t", "a", "varchar", 4294967295, None, None, "YES", 1), ("dbo", "t", "b", "decimal", None, 18, 2, "NO", 2), ("x", "t", "c", "int", None, 10, 0, "NO", 1)],
        "table_schema STRING, table_name STRING, column_name STRING, data_type STRING, character_maximum_length BIGINT, numeric_precision INT, numeric_scale INT, is_nullable STRING, ordinal_position INT",
    )
    found = jdbc.catalog_columns(catalog, "dbo")
    assert rows(found, "column_name", "max_length", "is_nullable") == [("a", -1, True), ("b", None, False)]


def test_staged_folders_can_be_removed(spark, tmp_path):
    from evenkeel.session import remove_staged, staged

    class Alone:
        """The session with a shared folder and application of its own."""

        def __init__(self):
            self.conf, self._jvm, self._jsc = self, spark._jvm, spark._jsc
            self.sparkContext = type("Context", (), {"applicationId": "alone"})

        def get(self, key, default=None):
            return str(tmp_path)

    path = fresh_path(Alone(), "x")
    spark.range(3).write.parquet(path)
    assert staged(spark.range(3), "y").count() == 3 and os.path.exists(path)
    remove_staged(Alone())
    assert not os.path.exists(path)
