"""Codec measurement by files, publishing after a check, and paging by cursor."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from evenkeel.operators.storage import Mismatch, measure_codecs, measure_files, publish, publish_version
from evenkeel.sources import history as H
from evenkeel.sources.versions import Versions
from tests.conftest import rows


@pytest.fixture()
def table(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(40_000).select("id", F.md5(F.col("id").cast("string")).alias("s"), F.lit("same").alias("c"))
    df.repartition(20).write.option("compression", "none").parquet(path)
    return path


def test_only_the_chosen_files_are_read(spark, table):
    total = sum(os.path.getsize(f) for f in glob.glob(f"{table}/*.parquet"))
    first = {r.codec: r for r in measure_files(spark, table, "t", 0.2)[0].collect()}
    bound = first["zstd"].sampled_bytes
    assert bound <= 0.2 * total and first["zstd"].sampled_files <= 4
    sizes, columns = measure_files(spark, table, "t", 0.2)
    assert {r.codec: r.size_kb for r in sizes.collect()} == {c: r.size_kb for c, r in first.items()}
    row = first["gzip"]
    assert (row.current_codec, row.row_count, row.current_size_kb) == ("uncompressed", 40_000, total / 1024)
    by_column = {(r.codec, r.column_name): r for r in columns.collect()}
    assert set(by_column) == {(k, c) for k in ("snappy", "gzip", "zstd") for c in ("id", "s", "c")}
    for codec in first:
        whole = sum(by_column[codec, c].size_kb for c in ("id", "s", "c"))
        assert whole < first[codec].size_kb < whole * 1.2  # footers and headers are the rest
    assert by_column["zstd", "c"].size_kb < 0.05 * by_column["zstd", "s"].size_kb


def test_sizes_of_the_whole_table(spark, table, tmp_path):
    """With all files in the sample the sizes are those of the files written."""
    sizes = {r.codec: r.size_kb for r in measure_files(spark, table, "t", 1.0)[0].collect()}
    measured = {r.codec: r.size_kb for r in measure_codecs(spark.read.parquet(table), "t", fraction=1.0).collect()}
    for codec in sizes:
        out = str(tmp_path / codec)
        spark.read.parquet(table).write.option("compression", codec).parquet(out)
        written = sum(os.path.getsize(f) for f in glob.glob(f"{out}/*.parquet")) / 1024
        assert sizes[codec] == pytest.approx(written, rel=0.01) and measured[codec] == pytest.approx(written, rel=0.05)


def test_estimate_of_a_sample(spark, table):
    whole = {r.codec: r.size_kb for r in measure_files(spark, table, "t", 1.0)[0].collect()}
    some = {r.codec: r.size_kb for r in measure_files(spark, table, "t", 0.15)[0].collect()}
    assert all(some[c] == pytest.approx(whole[c], rel=0.1) for c in whole)


def lose_a_row(df, codec, path):
    df.limit(df.count() - 1).write.option("compression", codec).parquet(path)


def test_publish(spark, table, tmp_path):
    spark.sql("DROP TABLE IF EXISTS publish_me")
    spark.read.parquet(table).write.option("path", str(tmp_path / "old")).saveAsTable("publish_me")
    before = rows(spark.table("publish_me"))

    def location():
        found = spark.sql("DESCRIBE FORMATTED publish_me").where("col_name = 'Location'").first()
        return found.data_type.removeprefix("file:")

    with pytest.raises(Mismatch):
        publish(spark, "publish_me", "zstd", str(tmp_path / "bad"), write=lose_a_row)
    assert location() == str(tmp_path / "old") and rows(spark.table("publish_me")) == before
    path = publish(spark, "publish_me", "zstd", str(tmp_path / "new"))
    assert location() == path and rows(spark.table("publish_me")) == before
    codecs = duckdb.sql(f"SELECT DISTINCT compression FROM parquet_metadata('{path}/*.parquet')").fetchall()
    assert codecs == [("ZSTD",)]
    spark.sql("DROP TABLE publish_me")


def test_publish_a_version(spark, tmp_path):
    table = Versions(spark, str(tmp_path / "v"), "id BIGINT")
    table.append(spark.range(100))
    with pytest.raises(Mismatch):
        publish_version(table, "zstd", rewritten=lambda old: old.where("id <> 5"))
    assert table.latest() == 1 and table.read().count() == 100
    assert publish_version(table, "zstd") == 2
    assert table.read().count() == 100 and table.read(1).count() == 100
    assert all(".zstd." in f for f in table.files())


def test_pages_by_cursor(spark):
    started = F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_interval(0, 0, 0, CAST(id / 7 AS INT))")  # seven runs start at a time
    runs = spark.range(60).select(F.format_string("r%03d", "id").alias("run_id"), started.alias("started_at"), F.when(F.col("id") % 5 > 0, "completed").otherwise("failed").alias("status"))
    for status in (None, "completed"):
        after, pages = None, []
        while True:
            found = H.page_after(runs, 9, after, status)
            if not found.count():
                break
            assert found.collect() == H.page(runs, 9, 9 * len(pages), status).collect()
            pages.append(found)
            after = H.cursor(found)
        assert sum(p.count() for p in pages) == (60 if status is None else 48)
    assert H.cursor(runs.limit(0)) is None
