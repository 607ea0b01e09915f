import glob
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from evenkeel.operators.change_set import apply_to_files, change_set
from evenkeel.session import staged
from evenkeel.sources import history as H
from evenkeel.sources.versioned_history import VersionedHistory
from evenkeel.sources.versions import Conflict, Versions
from tests.conftest import rows

SCHEMA = "k BIGINT, v STRING"


def numbers(spark, start, end, v="a"):
    return spark.range(start, end).select(F.col("id").alias("k"), F.lit(v).alias("v"))


@pytest.fixture()
def table(spark, tmp_path):
    made = Versions(spark, str(tmp_path / "t"), SCHEMA)
    made.append(numbers(spark, 0, 100).repartitionByRange(10, "k"))
    return made


def test_versions(spark, tmp_path):
    table = Versions(spark, str(tmp_path / "t"), SCHEMA)
    assert table.latest() == 0 and table.read().count() == 0
    assert [table.append(numbers(spark, i, i + 1)) for i in range(23)] == list(range(1, 24))
    assert table.read().count() == 23 and table.read(7).count() == 7 and table.read(20).count() == 20
    assert Versions(spark, table.folder, SCHEMA).read(11).count() == 11
    assert len(glob.glob(f"{table.folder}/_versions/*-files.json")) == 2
    with pytest.raises(ValueError):
        table.read(24)


def test_a_reader_keeps_its_version(spark, table):
    before = table.read()
    table.replace(lambda old: old.where("k < 0"), table.files())
    assert before.count() == 100 and table.read().count() == 0


def test_two_writers_at_once(spark, table):
    """Both commits are made from the same version; one of them is repeated."""
    other = Versions(spark, table.folder, SCHEMA)
    first = other.write(numbers(spark, 300, 310))
    latest, calls = table.latest, []

    def slow():
        found = latest()
        if not calls:
            calls.append(other.commit(first))  # the other writer takes the number that this one saw free
        return found

    table.latest = slow
    number = table.append(numbers(spark, 200, 210))
    table.latest = latest
    assert (calls, number) == ([2], 3)
    assert table.info(3)["tries"] == 2 and table.info(2)["tries"] == 1
    assert table.read().count() == 120 and table.read(2).count() == 110


def test_many_writers(spark, table):
    def write(i):
        return Versions(spark, table.folder, SCHEMA).append(numbers(spark, 1000 + i, 1001 + i))

    with ThreadPoolExecutor(6) as pool:
        made = list(pool.map(write, range(18)))
    assert sorted(made) == list(range(2, 20)) and table.read().count() == 118


def test_conflicting_changes(spark, table):
    files = table.files()
    rewritten = table.write(table.read(files=files[:2]).withColumn("v", F.lit("x")))
    table.replace(lambda old: old, [files[1]])
    with pytest.raises(Conflict):
        table.commit(rewritten, files[:2])
    assert rows(table.read().groupBy("v").count()) == [("a", 100)]


def test_vacuum(spark, table):
    table.replace(lambda old: old.withColumn("v", F.lit("b")), table.files()[:4])
    pending = table.write(numbers(spark, 500, 501))  # of a commit in progress
    assert table.vacuum(keep=2) == 0 and table.read(1).count() == 100
    assert table.vacuum() == 4 and table.numbers() == [2]
    assert table.read().count() == 100
    with pytest.raises(ValueError):
        table.read(1)
    assert table.commit(pending) == 3 and table.read().count() == 101
    assert Versions(spark, table.folder, SCHEMA).read(2).count() == 100


def test_changes_rewrite_only_their_files(spark, table):
    before, now = set(table.files()), table.read()
    wanted = now.where("k <> 11").withColumn("v", F.when(F.col("k") == 15, "new").otherwise(F.col("v"))).union(numbers(spark, 700, 702))
    assert apply_to_files(table, change_set(wanted, now, ["k"]), ["k"]) == 2
    after = set(table.files())
    assert len(before - after) == 1 and len(before & after) == 9  # 11 and 15 lie in one file
    assert rows(table.read()) == rows(wanted) and table.read(1).count() == 100
    assert apply_to_files(table, change_set(wanted, wanted, ["k"]), ["k"]) == 2  # nothing to do
    assert set(table.files()) == after and rows(table.read()) == rows(wanted)


def test_changes_read_values_of_touched_files_only(spark, table):
    now = table.read()
    changes = staged(change_set(now.withColumn("v", F.when(F.col("k") == 3, "new").otherwise(F.col("v"))), now, ["k"]), "changes")
    held = {r["_file"] for r in table.placed().where("k = 3").select("_file").collect()}
    read = []
    original = table.read
    table.read = lambda version=None, files=None, table="": read.append(files) or original(version, files, table)
    apply_to_files(table, changes, ["k"])
    assert [set(files) for files in read] == [held]


def test_null_and_composite_keys(spark, tmp_path):
    schema = "a INT, b STRING, v INT"
    old = spark.createDataFrame([(None, "x", 9), (1, None, 2), (3, "z", 4)], schema)
    new = spark.createDataFrame([(None, "x", 1), (1, None, 2), (2, "y", 3)], schema)
    table = Versions(spark, str(tmp_path / "n"), schema)
    table.append(old.repartition(3, "v"))
    apply_to_files(table, change_set(new, old, ["a", "b"]), ["a", "b"])
    assert rows(table.read()) == rows(new)


@pytest.fixture()
def history(spark, tmp_path):
    return VersionedHistory(spark, str(tmp_path / "h"))


def results(spark, *tables):
    made = spark.createDataFrame([(t, 5) for t in tables], "source_table STRING, matching_rows BIGINT")
    return made.withColumn("data_differences", F.array().cast(H.DIFFERENCES))


def differences(spark, n, table="t"):
    return spark.range(n).select(F.lit(table).alias("source_table"), F.concat(F.lit("k="), "id").alias("key_display"))


def test_a_run_is_one_version(spark, history):
    assert history.runs().count() == 0 and history.results().count() == 0
    version = history.save_run("r1", "2024-01-01", "2024-01-02", results(spark, "t", "u"), differences(spark, 7), total_tables=2)
    assert version == 1 and history.store.info(1)["run_id"] == "r1"
    row = history.runs().first()
    assert (row.run_id, row.status, row.total_tables) == ("r1", "completed", 2)
    assert history.results("r1").count() == 2 and history.differences("r1").count() == 7
    before = history.as_of(0)
    assert before.runs().count() == 0 and before.differences().count() == 0


def test_compaction_in_place(spark, history):
    for i in range(4):
        history.save_run(f"r{i}", f"2024-01-0{i + 1}", "2024-02-01", results(spark, "t"), differences(spark, 3))
    history.open_run("r9", "2024-01-09")
    history.complete_run("late", "2024-01-09")  # its opening has not arrived yet
    history.delete_run("r2", "2024-03-01")
    last, seen = history.latest(), rows(history.runs())
    assert history.compact() is history and history.latest() == last + 1
    assert rows(history.runs()) == seen and history.differences().count() == 9 and history.results("r2").count() == 0
    assert history.as_of(4).differences().count() == 12
    history.open_run("late", "2024-01-08")
    assert "late" in [r.run_id for r in history.runs().collect()]
    freed = history.vacuum()
    assert freed > 0 and rows(history.runs(), "run_id") == [("late",), ("r0",), ("r1",), ("r3",), ("r9",)]
    stored = history.spark.read.parquet(*glob.glob(f"{history.folder}/differences/*/*/*.parquet"))
    assert stored.where("run_id = 'r2'").count() == 0  # nothing of it is left on disk
    assert os.path.isdir(f"{history.folder}/_versions")


def test_one_run_reads_one_bucket(spark, history, capsys):
    names = spark.range(60).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("run_id"))
    history.log(names.select("run_id", F.lit("opened").alias("event"), F.lit("2024-01-01").cast("timestamp_ntz").alias("at")))
    history.save_results(names.select("run_id", F.lit("t").alias("source_table"), F.array().cast(H.DIFFERENCES).alias("data_differences")))
    assert rows(history.results("r7"), "run_id") == [("r7",)]
    history.results("r7").explain("formatted")
    assert "PartitionFilters: [isnotnull(run_bucket" in capsys.readouterr().out
