import shutil

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from evenkeel.sources import footers
from evenkeel.sources import inventory as inv
from evenkeel.sources.fixtures import TABLES
from tests.conftest import rows


def written(spark, tmp_path, codec="zstd", files=3):
    df = spark.range(3000).select(
        F.col("id").alias("k"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("s"), F.array("id", "id").alias("a"),
        F.struct(F.col("id").alias("x"), F.lit(1).alias("y")).alias("b"),
    )
    path = str(tmp_path / f"{codec}{files}")
    df.repartition(files).write.option("compression", codec).parquet(path)
    return df, path


def expected(path):
    """Per column: codecs, values, nulls, bytes; by another reader of footers."""
    return duckdb.sql(
        f"""SELECT split_part(path_in_schema, ', ', 1) AS c, string_agg(DISTINCT lower(compression), ',') AS codec, sum(num_values)::BIGINT,
        sum(total_compressed_size)::BIGINT, sum(total_uncompressed_size)::BIGINT FROM parquet_metadata('{path}/*.parquet') GROUP BY 1 ORDER BY 1"""
    ).fetchall()


@pytest.mark.parametrize("codec", ["snappy", "zstd", "gzip"])
def test_columns_against_another_reader(spark, tmp_path, codec):
    df, path = written(spark, tmp_path, codec)
    read = footers.column_sizes(footers.footers(spark, {"t": path}))
    got = [tuple(r) for r in read.orderBy("column_name").select("column_name", "codec", "value_count", "compressed_bytes", "uncompressed_bytes").collect()]
    assert got == expected(path)
    nulls = {r.column_name: r.null_count for r in read.collect()}
    assert nulls["k"] == 0 and nulls["s"] == 1000


def test_given_tables(spark, folder):
    sizes = {r.table_name: r for r in entry.queries()["table_inventory"](spark, folder).collect()}
    assert set(sizes) == set(TABLES)
    for name, row in sizes.items():
        codec, n, large = duckdb.sql(
            f"""SELECT lower(any_value(compression)), (SELECT count(*) FROM '{folder}/{name}.parquet'), sum(total_uncompressed_size)::BIGINT
            FROM parquet_metadata('{folder}/{name}.parquet')"""
        ).fetchall()[0]
        length = spark.read.format("binaryFile").load(f"{folder}/{name}.parquet").select("length").first()[0]
        assert (row.compression, row.row_count, row.file_count) == (codec, n, 1)
        assert row.total_size_kb == length / 1024 and row.uncompressed_kb == large / 1024


def test_many_files_and_codecs(spark, tmp_path):
    df, path = written(spark, tmp_path, "zstd", 5)
    df.limit(100).write.mode("append").option("compression", "gzip").parquet(path)
    row = footers.table_sizes(footers.footers(spark, {"t": path})).first()
    assert (row.row_count, row.compression) == (3100, "gzip,zstd") and row.file_count >= 6


def test_schemas_are_spark_s(spark, tmp_path, folder):
    _, path = written(spark, tmp_path)
    given = {n: f"{folder}/{n}.parquet" for n in TABLES}
    found = footers.schemas(spark, {"t": path, **given})
    assert found["t"].simpleString() == spark.read.parquet(path).schema.simpleString()
    for name in TABLES:
        kinds = [(f.name, f.dataType) for f in spark.read.parquet(given[name]).schema.fields]
        assert [(f.name, f.dataType) for f in found[name].fields] == kinds


def test_merged_and_conflicting_schemas(spark, tmp_path):
    path = str(tmp_path / "m")
    spark.range(5).write.parquet(path)
    spark.range(5).select("id", F.lit("x").alias("more")).write.mode("append").parquet(path)
    assert sorted(footers.schemas(spark, {"m": path})["m"].names) == ["id", "more"]
    spark.range(5).select(F.col("id").cast("string")).write.mode("append").parquet(path)
    with pytest.raises(ValueError, match="disagree"):
        footers.schemas(spark, {"m": path})


def test_files_that_cannot_be_opened(spark, tmp_path):
    _, path = written(spark, tmp_path)
    with open(f"{path}/part-broken.parquet", "wb") as file:
        file.write(b"no parquet at all")
    row = footers.table_sizes(footers.footers(spark, {"t": path})).first()
    assert row.row_count is None and row.file_count == 4 and row.total_bytes > 0
    assert footers.footers(spark, {"t": path}).where("error IS NOT NULL").count() == 1


def test_an_altered_file_changes_the_schema_queries(spark, folder, tmp_path):
    """The queries describe the files they are given, not what is known of the test tables."""
    names = ("column_inventory", "schema_diff", "schema_diff_database", "column_presence", "schema_sync_plan", "catalog_inventory")
    before = {n: rows(entry.queries()[n](spark, folder)) for n in names}
    altered = tmp_path / "sf"
    shutil.copytree(folder, altered)
    for name, column in (("orders", "o_extra"), ("customer", "c_extra")):
        more = spark.read.parquet(f"{folder}/{name}.parquet").withColumn(column, F.lit(1.5)).coalesce(1)
        (altered / f"{name}.parquet").unlink()
        more.write.parquet(str(altered / f"{name}.parquet"))
    for n in names:
        assert rows(entry.queries()[n](spark, str(altered))) != before[n], n
    found = entry.queries()["schema_diff"](spark, str(altered)).where("column_name = 'o_extra'").first()
    assert (found.difference_type, found.source_value) == ("schema_only_source", "double")


def test_inventory_of_an_empty_table(spark, tmp_path):
    spark.range(0).write.parquet(str(tmp_path / "e"))
    row = inv.table_inventory(spark, {"e": str(tmp_path / "e")}).first()
    assert (row.row_count, row.compression) == (0, "unknown")
