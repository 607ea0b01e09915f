"""What the footers of Parquet files say: schemas, codecs, and rows and bytes per column.

Spark itself reads footers for schemas only. Here tasks read the ends of files, a group of files each, through
pyarrow; no data page is read. Stores that pyarrow cannot open give an `error` instead.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from evenkeel.functions.columns import union_all

FILES_PER_TASK = 64
FOOTERS = (
    "table_name string, path string, file_bytes bigint, file_rows bigint, spark_schema string, column_name string, position int, "
    "codec string, value_count bigint, null_count bigint, compressed_bytes bigint, uncompressed_bytes bigint, error string"
)


def parquet_files(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """table_name, path and length of the data files of each table; only their names are read."""
    listed = union_all(
        [
            spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
            .select(F.lit(name).alias("table_name"), "path", "length")
            for name, path in paths.items()
        ]
    )
    return listed.where(~F.col("path").rlike(r"/[_.][^/=]*$"))


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [f.split(" ")[0] for f in FOOTERS.split(", ")]
    for batch in batches:
        found = []
        for table, path, length in zip(batch["table_name"], batch["path"], batch["length"], strict=True):
            try:
                store, inside = pafs.FileSystem.from_uri(path)
                with store.open_input_file(inside) as file:
                    found += [(table, path, length, *row, None) for row in _columns(pq.ParquetFile(file))]
            except (OSError, ValueError, NotImplementedError) as error:
                found.append((table, path, length, *[None] * 9, str(error)[:200]))
        yield pd.DataFrame(found, columns=names).astype(
            {n: "Int64" for n in ("file_rows", "position", "value_count", "null_count", "compressed_bytes", "uncompressed_bytes")}
        )


def _columns(file: pq.ParquetFile) -> list[tuple]:
    """One row per column; nested columns are summed over their leaves."""
    whole, sums = file.metadata, {}
    stored = (whole.metadata or {}).get(b"org.apache.spark.sql.parquet.row.metadata")
    schema = stored.decode() if stored else from_arrow_schema(file.schema_arrow, prefer_timestamp_ntz=True).json()
    for group in range(whole.num_row_groups):
        for leaf in range(whole.num_columns):
            chunk = whole.row_group(group).column(leaf)
            name = chunk.path_in_schema.split(".")[0]
            nulls = chunk.statistics.null_count if chunk.statistics and chunk.statistics.has_null_count else None
            codec, values, none, small, large = sums.get(name, (set(), 0, 0, 0, 0))
            none = None if none is None or nulls is None else none + nulls
            sums[name] = (
                codec | {chunk.compression.lower()}, values + chunk.num_values, none,
                small + chunk.total_compressed_size, large + chunk.total_uncompressed_size,
            )
    return [
        (whole.num_rows, schema, name, position, ",".join(sorted(sums[name][0])) if name in sums else None, *sums.get(name, (None, 0, 0, 0, 0))[1:])
        for position, name in enumerate(file.schema_arrow.names, start=1)
    ]


def footers(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """One row for each file and column of the tables in `paths`, from the ends of their files."""
    files = parquet_files(spark, paths)
    tasks = max(1, -(-files.count() // FILES_PER_TASK))
    return files.repartition(tasks, F.xxhash64("path") % tasks).mapInPandas(_read, FOOTERS)


def column_sizes(read: DataFrame) -> DataFrame:
    """Rows, nulls, bytes and codecs of each column of each table, from `footers`."""
    sums = [F.sum(c).alias(c) for c in ("value_count", "null_count", "compressed_bytes", "uncompressed_bytes")]
    return read.where("column_name IS NOT NULL").groupBy("table_name", "column_name").agg(
        F.min("position").alias("position"), _codecs().alias("codec"), *sums
    )


def table_sizes(read: DataFrame) -> DataFrame:
    """Files, rows, bytes and codecs of each table, from `footers`.

    A file that could not be read counts with its bytes; its rows and codec are not known, which makes the table's rows null.
    """
    per_file = read.groupBy("table_name", "path").agg(
        F.max("file_bytes").alias("file_bytes"), F.max("file_rows").alias("file_rows"), F.sum("uncompressed_bytes").alias("uncompressed_bytes"),
        F.collect_set("codec").alias("codecs"), F.max("error").alias("error"),
    )
    known = F.count("error") == 0
    return per_file.groupBy("table_name").agg(
        F.count("*").alias("file_count"),
        F.when(known, F.sum("file_rows")).alias("row_count"),
        F.sum("file_bytes").alias("total_bytes"),
        F.when(known, F.sum("uncompressed_bytes")).alias("uncompressed_bytes"),
        F.coalesce(F.nullif(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("codecs")))), ","), F.lit("")), F.lit("unknown")).alias("compression"),
    )


def _codecs():
    return F.array_join(F.array_sort(F.collect_set("codec")), ",")


def schemas(spark: SparkSession, paths: dict[str, str]) -> dict[str, T.StructType]:
    """The schema of each table, all from one job. Files of a table that differ are merged by name, the first file's
    columns first; a table that pyarrow cannot open is left to Spark's own inference."""
    kinds = footers(spark, paths).groupBy("table_name", "spark_schema").agg(F.min("path").alias("path"))
    rows = kinds.orderBy("table_name", "path").collect()  # one row for each kind of file
    found: dict[str, T.StructType] = {}
    for row in rows:
        if row["spark_schema"] is None:
            found[row["table_name"]] = spark.read.parquet(paths[row["table_name"]]).schema
            continue
        schema = found.setdefault(row["table_name"], T.StructType())
        for field in T.StructType.fromJson(json.loads(row["spark_schema"])).fields:
            known = {f.name: f for f in schema.fields}.get(field.name)
            if known is None:
                schema.add(T.StructField(field.name, field.dataType, True))
            elif known.dataType != field.dataType:
                raise ValueError(f"{row['table_name']}: files disagree on the type of {field.name}")
    return found


def tables(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """The tables in `paths` with the schemas that their files have."""
    return {name: spark.read.schema(schema).parquet(paths[name]) for name, schema in schemas(spark, paths).items()}
