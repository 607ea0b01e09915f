"""Inventories: which tables exist, how large they are, and what columns they have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions.columns import literal, quoted, union_all
from evenkeel.operators.keys import key_check
from evenkeel.session import staged
from evenkeel.sources import footers

COLUMN_INVENTORY = T.StructType(
    [
        T.StructField("table_name", T.StringType()),
        T.StructField("column_name", T.StringType()),
        T.StructField("data_type", T.StringType()),
        T.StructField("max_length", T.IntegerType()),
        T.StructField("numeric_precision", T.IntegerType()),
        T.StructField("numeric_scale", T.IntegerType()),
        T.StructField("is_nullable", T.BooleanType()),
        T.StructField("ordinal_position", T.IntegerType()),
    ]
)


def _type_parts(dtype: T.DataType) -> tuple[str, int | None, int | None, int | None]:
    """Type name, length, precision, scale."""
    if isinstance(dtype, (T.VarcharType, T.CharType)):
        return dtype.typeName(), dtype.length, None, None
    if isinstance(dtype, T.DecimalType):
        return "decimal", None, dtype.precision, dtype.scale
    return dtype.simpleString(), None, None, None


def column_records(schema: T.StructType, table_name: str) -> list[tuple]:
    """The declared columns of one table as plain rows of the column inventory."""
    records = []
    for position, field in enumerate(schema.fields, start=1):
        name, length, precision, scale = _type_parts(field.dataType)
        records.append((table_name, field.name, name, length, precision, scale, field.nullable, position))
    return records


def declared_columns(spark: SparkSession, schema: T.StructType | DataFrame, table_name: str) -> DataFrame:
    """Column inventory from a declared schema; no data is read."""
    if isinstance(schema, DataFrame):
        schema = schema.schema
    return spark.createDataFrame(column_records(schema, table_name), COLUMN_INVENTORY)


def column_profile(df: DataFrame, table_name: str) -> DataFrame:
    """What the data of each column holds: the longest text, and whether a NULL occurs.

    Reads every column, in one aggregate. It describes data, not the schema; comparisons of
    schemas use `declared_columns`.
    """
    measures = [F.expr("count(*) AS _rows")]
    for i, field in enumerate(df.schema.fields):
        name = quoted(field.name)
        measures.append(F.expr(f"count({name}) AS _n{i}"))
        if isinstance(field.dataType, T.StringType):
            measures.append(F.expr(f"max(length({name})) AS _l{i}"))
    rows = []
    for i, record in enumerate(column_records(df.schema, table_name)):
        _, name, type_name, length, precision, scale, _, position = record
        measured = f"_l{i}" if isinstance(df.schema[i].dataType, T.StringType) else length
        numbers = [f"CAST({'NULL' if n is None else n} AS INT)" for n in (measured, precision, scale)]
        values = [literal(table_name), literal(name), literal(type_name), *numbers, f"_n{i} < _rows", str(position)]
        fields = [f"'{f.name}', {v}" for f, v in zip(COLUMN_INVENTORY.fields, values)]
        rows.append(f"named_struct({', '.join(fields)})")
    return df.agg(*measures).selectExpr(f"inline(array({', '.join(rows)}))")


def full_type() -> Column:
    """Type with its length or precision, from the columns of a column inventory."""
    name, length = F.col("data_type"), F.col("max_length")
    precision, scale = F.col("numeric_precision"), F.col("numeric_scale")
    return (
        F.when(length == -1, F.concat(name, F.lit("(MAX)")))
        .when(length > 0, F.concat(name, F.lit("("), length, F.lit(")")))
        .when((precision > 0) & scale.isNotNull(), F.concat(name, F.lit("("), precision, F.lit(","), scale, F.lit(")")))
        .when(precision > 0, F.concat(name, F.lit("("), precision, F.lit(")")))
        .otherwise(name)
    )


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table with its row count, in one job."""
    return union_all(
        [df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count") for name, df in tables.items()]
    )


def file_sizes(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """File count, bytes and codec per table. Only file names and lengths are read."""
    files = union_all(
        [
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .load(path)
            .select(F.lit(name).alias("table_name"), "path", "length")
            for name, path in paths.items()
        ]
    )
    codec = F.regexp_extract("path", r"\.(snappy|gz|zstd|lz4|br)\.[a-z]+$", 1)
    return (
        files.where(~F.col("path").rlike(r"/[_.][^/]*$"))
        .groupBy("table_name")
        .agg(
            F.count("*").alias("file_count"),
            F.sum("length").alias("total_bytes"),
            F.max(F.when(codec == "", "unknown").otherwise(codec)).alias("compression"),
        )
    )


def table_inventory(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Tables with exact row counts, file sizes and codecs, from the ends of their files.

    Rows of tables that the tasks cannot open (see `footers`) are counted by Spark.
    """
    read = footers.footers(spark, paths)
    sizes = staged(footers.table_sizes(read), "table-sizes", few_files=True)
    unread = [r["table_name"] for r in sizes.where("row_count IS NULL").collect()]  # names of tables
    if unread:
        counted = row_counts({name: spark.read.parquet(paths[name]) for name in unread})
        sizes = sizes.join(counted.withColumnRenamed("row_count", "counted"), "table_name", "left").withColumn(
            "row_count", F.coalesce("row_count", "counted")
        )
    return sizes.select(
        "table_name",
        "row_count",
        "file_count",
        (F.col("total_bytes") / 1024).alias("total_size_kb"),
        (F.col("total_bytes") / 1024 / 1024).alias("total_size_mb"),
        (F.col("uncompressed_bytes") / 1024).alias("uncompressed_kb"),
        "compression",
    )


def catalog_tables(spark: SparkSession, namespace: str | None = None, pattern: str | None = None) -> dict[str, DataFrame]:
    """The tables and views of a namespace of the session's catalog by name; temporary views have no namespace."""
    listed = spark.catalog.listTables(namespace, pattern) if namespace else spark.catalog.listTables(pattern=pattern)
    return {
        t.name: spark.table(".".join(quoted(part) for part in ([] if t.isTemporary else t.namespace or []) + [t.name]))
        for t in sorted(listed, key=lambda t: t.name)
    }


def catalog_inventory(spark: SparkSession, namespace: str | None = None, pattern: str | None = None) -> DataFrame:
    """Tables of a namespace with exact row counts and their numbers of columns, in one job."""
    tables = catalog_tables(spark, namespace, pattern)
    if not tables:
        return spark.createDataFrame([], "table_name STRING, row_count BIGINT, column_count INT")
    widths = F.create_map(*[F.lit(x) for name, df in tables.items() for x in (name, len(df.columns))])
    return row_counts(tables).withColumn("column_count", F.element_at(widths, F.col("table_name")))


def table_profile(df: DataFrame, table_name: str, keys: list[str]) -> DataFrame:
    """Columns of one table together with its row count and the state of its key."""
    missing = [k for k in keys if k not in df.columns]
    if missing:
        raise ValueError(f"no such key columns in {table_name}: {missing}")
    checked = key_check(df, keys).select(
        F.lit(table_name).alias("table_name"), "row_count", F.col("is_unique").alias("key_is_unique")
    )
    return (
        declared_columns(df.sparkSession, df, table_name)
        .join(checked, "table_name")
        .select(
            "table_name",
            "row_count",
            "ordinal_position",
            "column_name",
            full_type().alias("full_type"),
            "is_nullable",
            F.col("column_name").isin(keys).alias("is_key"),
            "key_is_unique",
        )
    )


def table_presence(source: DataFrame, target: DataFrame) -> DataFrame:
    """Tables of two inventories: common, source_only or target_only."""
    s = source.select("table_name", F.lit(True).alias("_s"))
    t = target.select("table_name", F.lit(True).alias("_t"))
    presence = (
        F.when(F.col("_t").isNull(), "source_only").when(F.col("_s").isNull(), "target_only").otherwise("common")
    )
    return s.join(t, "table_name", "full_outer").select("table_name", presence.alias("presence"))


def eligible_tables(
    inventory: DataFrame,
    name_pattern: str | None = None,
    exclude_empty: bool = False,
    min_rows: int = 0,
    max_rows: int | None = None,
) -> DataFrame:
    """Tables to compare: name (from its start, any case) and row count bounds."""
    keep = F.col("row_count") >= min_rows
    if name_pattern:
        keep &= F.col("table_name").rlike(f"(?i)^(?:{name_pattern})")
    if exclude_empty:
        keep &= F.col("row_count") != 0
    if max_rows:
        keep &= F.col("row_count") <= max_rows
    return inventory.where(keep)


def select_tables(inventory: DataFrame, pattern: str | None = None, preset: str | None = None) -> DataFrame:
    """Tables by free regex (anywhere in the name, any case) or by a preset such as `dim_*`."""
    if preset and preset != "All":
        pattern = "^" + preset.replace("*", ".*")
    return inventory.where(F.col("table_name").rlike(f"(?i){pattern}")) if pattern else inventory


def with_restricted_flag(inventory: DataFrame) -> DataFrame:
    """Marks tables that must be compared alone: names that contain `fact` or `link`."""
    return inventory.withColumn("is_restricted", F.lower("table_name").rlike("fact|link"))


def check_selection(table_names: list[str]) -> list[str]:
    """The selection, or an error when a restricted table is not alone in it."""
    restricted = [t for t in table_names if "fact" in t.lower() or "link" in t.lower()]
    if restricted and len(table_names) > 1:
        raise ValueError(f"compare these tables one at a time: {restricted}")
    return table_names
