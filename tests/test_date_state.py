import glob
import os

import pytest
from pyspark.sql import functions as F

from evenkeel.operators.date_state import DateState, compare_dates
from evenkeel.operators.incremental import incremental_pair
from evenkeel.operators.row_diff import key_states
from tests.conftest import rows

SCHEMA = "k BIGINT, v STRING"


def days(spark, n, start=1, end=9):
    """`n` rows a day in January; the last of each third day has no date."""
    whole = spark.range((end - start) * n).select(
        F.col("id").alias("k"), F.lit("a").alias("v"), F.expr(f"date_add(DATE'2024-01-01', CAST({start - 1} + id / {n} AS INT))").alias("d")
    )
    return whole.withColumn("d", F.when(F.col("k") != 7, F.col("d")))


def write(df, path, mode="error"):
    df.repartition("d").write.mode(mode).partitionBy("d").parquet(path)
    return path


def broken(path, but):
    """Make the files of all dates but some unreadable, with the same name, length and time."""
    for file in glob.glob(f"{path}/d=*/*.parquet"):
        if not any(f"d={d}/" in file for d in but):
            known = os.stat(file)
            with open(file, "wb") as out:
                out.write(b"x" * known.st_size)
            os.utime(file, ns=(known.st_atime_ns, known.st_mtime_ns))


@pytest.fixture()
def pair(spark, tmp_path):
    source = write(days(spark, 10), str(tmp_path / "s"))
    changed = days(spark, 10, end=7).withColumn("v", F.when(F.col("k") == 33, "b").otherwise(F.col("v")))
    target = write(changed, str(tmp_path / "t"))
    return DateState(spark, str(tmp_path / "state"), SCHEMA, "d", ["k"]), source, target


def test_as_without_memory(spark, pair):
    state, source, target = pair
    found = rows(compare_dates(state, source, target))
    sides = [spark.read.parquet(p).select("k", "v", F.col("d").cast("date").alias("d")) for p in (source, target)]
    plain = key_states(*incremental_pair(*sides, "d"), ["d", "k"]).where("difference_type <> 'match'")
    assert found == rows(plain.withColumn("d", F.col("d").cast("string"))) == [("2024-01-04", 33, "data_different")]
    counts = {r.date: (r.source_row_count, r.target_row_count, r.differs) for r in state.dates().collect()}
    assert counts["2024-01-04"] == (10, 10, True) and counts["2024-01-05"] == (10, 10, False) and counts[None] == (1, 1, False)
    assert max(d for d in counts if d) == "2024-01-06"


def test_a_late_row_reads_one_date(spark, pair):
    state, source, target = pair
    state.refresh("source", source)
    state.refresh("target", target)
    version = state.store.latest()
    assert state.refresh("source", source) == [] and state.store.latest() == version
    late = spark.createDataFrame([(1000, "late")], SCHEMA).withColumn("d", F.lit("2024-01-02"))
    late.write.mode("append").partitionBy("d").parquet(target)
    broken(source, ["2024-01-02", "2024-01-04"])  # the 4th differs, so its rows are compared
    broken(target, ["2024-01-02", "2024-01-04"])
    assert state.refresh("source", source) == []
    assert state.refresh("target", target) == ["2024-01-02"]
    assert rows(state.differences(source, target)) == [("2024-01-02", 1000, "data_only_target"), ("2024-01-04", 33, "data_different")]
    assert state.store.info(state.store.latest())["read"] == 1


def test_dates_that_go_and_come(spark, pair, tmp_path):
    state, source, target = pair
    state.refresh("source", source)
    state.refresh("target", target)
    fewer = write(days(spark, 10).where("d <> '2024-01-03'"), str(tmp_path / "fewer"))
    state.refresh("source", fewer)
    gone = {r.date: r for r in state.dates().collect()}["2024-01-03"]
    assert (gone.source_row_count, gone.target_row_count, gone.differs) == (0, 10, True)
    assert state.differences(fewer, target).where("d = '2024-01-03'").count() == 10


def test_rows_without_a_date_that_change(spark, pair):
    state, source, target = pair
    compare_dates(state, source, target)
    spark.createDataFrame([(2000, "x")], SCHEMA).withColumn("d", F.lit(None).cast("string")).write.mode("append").partitionBy("d").parquet(target)
    assert state.refresh("target", target) == [None]
    assert (None, 2000, "data_only_target") in rows(state.differences(source, target))
