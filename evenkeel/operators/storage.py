"""Advice on the parquet codec of a table: measure, choose, rewrite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.functions.columns import literal, quoted
from evenkeel.functions.text import fixed
from evenkeel.operators.fingerprint import quick_compare
from evenkeel.session import fresh_path, staged
from evenkeel.sources import footers
from evenkeel.sources.inventory import file_sizes
from evenkeel.sources.versions import Versions

# fixed values: codecs to choose from, in the order that settles ties, and what speaks for each
CODECS = ("snappy", "gzip", "zstd")
CODEC_REASONS = {
    "snappy": "snappy has minimal CPU cost with decent savings",
    "gzip": "gzip provides small files at a higher CPU cost",
    "zstd": "zstd provides good balance of space savings and performance",
}
PRIORITIES = ("low", "medium", "high")


def measure_codecs(
    df: DataFrame,
    table_name: str,
    current_codec: str = "uncompressed",
    fraction: float = 0.1,
    seed: int = 7,
) -> DataFrame:
    """Size per codec, scaled up from a sample of `fraction` of the rows, whatever their number.

    Runs when called: the sample is drawn and written once, the codecs are tried on that copy,
    and the rows of `df` are counted (for a plain parquet table from the file footers).
    """
    spark = df.sparkSession
    total = df.count()
    paths = {codec: fresh_path(spark, f"codec-{codec}") for codec in ("uncompressed", *CODECS)}
    df.sample(fraction=fraction, seed=seed).write.option("compression", "uncompressed").parquet(paths["uncompressed"])
    sample = spark.read.schema(df.schema).parquet(paths["uncompressed"])
    for codec in CODECS:
        sample.write.option("compression", codec).parquet(paths[codec])
    sizes = file_sizes(spark, paths).select(
        F.col("table_name").alias("codec"), (F.col("total_bytes") / 1024 / fraction).alias("size_kb")
    )
    current = sizes.where(F.col("codec") == current_codec).select(
        F.lit(table_name).alias("table_name"), F.col("size_kb").alias("current_size_kb")
    )
    return (
        sizes.where(F.col("codec") != "uncompressed")
        .select(F.lit(table_name).alias("table_name"), "codec", "size_kb")
        .join(current, "table_name")
        .select(
            "table_name",
            "codec",
            "size_kb",
            F.lit(current_codec).alias("current_codec"),
            "current_size_kb",
            F.lit(total).cast("long").alias("row_count"),
        )
    )


def measure_files(
    spark: SparkSession, path: str, table_name: str, fraction: float = 0.1, seed: int = 7
) -> tuple[DataFrame, DataFrame]:
    """Sizes per codec as from `measure_codecs`, and sizes per codec and column, from a sample of whole files.

    Files are chosen by their names alone, in the order of a hash, up to `fraction` of the bytes (but at least one
    file, the first in that order); no other file is read. Rows, codec and size of the whole table come from the ends of its
    files. The sample is written once in each codec and its sizes, read from those files, are scaled up by rows.
    """
    whole = staged(footers.table_sizes(footers.footers(spark, {table_name: path})), "table-sizes").first()
    listed = footers.parquet_files(spark, {table_name: path}).select("path", "length", F.xxhash64(F.lit(seed), "path").alias("h"))
    chosen, size = [], 0
    for row in listed.orderBy("h").toLocalIterator():  # names of files; ends when the share is reached
        if chosen and size + row["length"] > fraction * whole["total_bytes"]:
            break
        chosen.append(row["path"])
        size += row["length"]
    sample = spark.read.parquet(*chosen)  # columns that only folder names hold take no room in files
    paths = {codec: fresh_path(spark, f"codec-{codec}") for codec in CODECS}
    for codec in CODECS:
        sample.write.option("compression", codec).parquet(paths[codec])
    read = staged(footers.footers(spark, paths), "codec-footers", few_files=True)
    tried = footers.table_sizes(read)
    scale = F.lit(float(whole["row_count"])) / F.nullif(F.col("row_count"), F.lit(0))
    sizes = tried.select(
        F.lit(table_name).alias("table_name"),
        F.col("table_name").alias("codec"),
        (F.col("total_bytes") / 1024 * scale).alias("size_kb"),
        F.lit(whole["compression"]).alias("current_codec"),
        F.lit(whole["total_bytes"] / 1024).alias("current_size_kb"),
        F.lit(whole["row_count"]).cast("long").alias("row_count"),
        F.lit(len(chosen)).alias("sampled_files"),
        F.lit(size).cast("long").alias("sampled_bytes"),
    )
    per_column = footers.column_sizes(read).withColumnRenamed("table_name", "codec_tried").join(
        tried.select(F.col("table_name").alias("codec_tried"), scale.alias("scale")), "codec_tried"
    )
    columns = per_column.select(
        F.lit(table_name).alias("table_name"),
        F.col("codec_tried").alias("codec"),
        "column_name",
        (F.col("compressed_bytes") / 1024 * F.col("scale")).alias("size_kb"),
        (F.col("uncompressed_bytes") / 1024 * F.col("scale")).alias("plain_kb"),
    )
    return sizes, columns


def savings_percent(current: Column, size: Column) -> Column:
    """Share saved by a size; NULL when the size is unknown or the table empty."""
    return (current - size) / F.nullif(current, F.lit(0.0)) * 100


def storage_advice(sizes: DataFrame, min_rows: int = 1000, min_savings: float = 5.0, apply_above: float = 10.0) -> DataFrame:
    """The best codec per table from rows of (table, codec, size), where it is worth a change."""
    order = F.array_position(F.array(*[F.lit(c) for c in CODECS]), F.col("codec"))
    savings = savings_percent(F.col("current_size_kb"), F.col("size_kb"))
    options = sizes.where(F.col("row_count") >= min_rows).select("*", savings.alias("savings"), order.alias("place"))
    best = (
        options.where((F.col("savings") > 0) & (F.col("place") > 0))
        .groupBy("table_name", "current_codec")
        .agg(F.max(F.struct("savings", (-F.col("place")).alias("place"), "codec", "size_kb", "current_size_kb")).alias("best"))
        .select("table_name", "current_codec", "best.*")
    )
    saved_mb = (F.col("current_size_kb") - F.col("size_kb")) / 1024
    percent = F.col("savings")
    reason = F.concat(
        F.lit("Switching from "), "current_codec", F.lit(" to "), "codec", F.lit(" compression could save ~"),
        fixed(percent, 1), F.lit("% space. "), F.element_at(F.create_map(*[F.lit(x) for kv in CODEC_REASONS.items() for x in kv]), F.col("codec")),
    )
    return best.where((F.col("codec") != F.col("current_codec")) & (percent >= min_savings)).select(
        "table_name",
        "current_codec",
        F.col("codec").alias("recommended_codec"),
        (F.col("current_size_kb") / 1024).alias("current_size_mb"),
        (F.col("size_kb") / 1024).alias("estimated_size_mb"),
        saved_mb.alias("estimated_savings_mb"),
        percent.alias("estimated_savings_percent"),
        reason.alias("reason"),
        F.when((percent > 50) | (saved_mb > 1000), "high")
        .when((percent > 25) | (saved_mb > 100), "medium")
        .otherwise("low")
        .alias("priority"),
        (percent > apply_above).alias("should_apply"),
    )


def by_savings(advice: DataFrame) -> DataFrame:
    return advice.orderBy(F.col("estimated_savings_mb").desc(), "table_name")


def storage_rewrite_plan(advice: DataFrame, min_priority: str = "medium") -> DataFrame:
    """What to rewrite, as statements; nothing is changed."""
    if min_priority not in PRIORITIES:
        raise ValueError(f"priority must be one of {PRIORITIES}, not {min_priority!r}")
    wanted = PRIORITIES[PRIORITIES.index(min_priority) :]
    def name(table: Column) -> Column:
        parts = F.transform(F.split(table, r"\."), lambda p: F.concat(F.lit("`"), F.replace(p, F.lit("`"), F.lit("``")), F.lit("`")))
        return F.array_join(parts, ".")

    comment = F.regexp_replace("reason", r"[\r\n]+", " ")  # a comment ends with its line
    statement = F.concat(
        F.lit("-- "), comment, F.lit("\nCREATE TABLE "), name(F.concat("table_name", F.lit("_"), "recommended_codec")),
        F.lit(" USING parquet OPTIONS (compression '"), "recommended_codec", F.lit("') AS SELECT * FROM "), name(F.col("table_name")),
    )
    return advice.where(F.col("should_apply") & F.col("priority").isin(*wanted)).select(
        "table_name", "recommended_codec", "priority", statement.alias("statement")
    )


def apply_advice(
    advice: DataFrame, tables: dict[str, DataFrame], folder: str, min_priority: str = "medium", dry_run: bool = True
) -> list[str]:
    """Statements of the plan, or, without `dry_run`, the paths of the rewritten tables.

    The plan has one row per table, so it is read to the driver; the tables are not.
    """
    plan = storage_rewrite_plan(advice.where(F.col("table_name").isin(*tables)), min_priority)
    rows = plan.orderBy("table_name").collect()
    if dry_run:
        return [row["statement"] for row in rows]
    written = []
    for row in rows:
        path = f"{folder}/{row['table_name']}"
        rewrite(tables[row["table_name"]], row["recommended_codec"], path)
        written.append(path)
    return written


def rewrite(df: DataFrame, codec: str, path: str) -> None:
    """Writes the table to a new path in the given codec."""
    df.write.option("compression", codec).parquet(path)


class Mismatch(RuntimeError):
    """A rewritten table does not hold the rows of the one it was to replace."""


def _same_rows(old: DataFrame, new: DataFrame) -> None:
    found = quick_compare(old, new).first()
    if not found["fingerprint_match"] or found["source_row_count"] != found["target_row_count"]:
        raise Mismatch(f"{found['source_row_count']} rows were to be rewritten, {found['target_row_count']} are there and differ")


def publish(spark: SparkSession, table: str, codec: str, path: str | None = None, write=rewrite) -> str:
    """Rewrite a table of the session's catalog in another codec and switch it to the new files; their path.

    The new files are written beside the old ones and read back; the table's location changes only if
    their fingerprint is that of the table. Otherwise `Mismatch` is raised and nothing has changed. The old files stay.
    """
    path = path or fresh_path(spark, "published")
    old = spark.table(table)
    write(old, codec, path)
    _same_rows(old, spark.read.schema(old.schema).parquet(path))
    name = ".".join(quoted(part) for part in table.split("."))
    spark.sql(f"ALTER TABLE {name} SET LOCATION {literal(path)}")
    spark.catalog.refreshTable(table)
    return path


def publish_version(table: Versions, codec: str, name: str = "", rewritten=None) -> int:
    """Rewrite a versioned table in another codec as a new version, after the same check; the version.

    Writers that append meanwhile are not disturbed; if one removes files, `Conflict` is raised.
    """
    base = table.latest()
    files = [f for f in table.files(base) if f.startswith(f"{name}/" if name else "")]
    old = table.read(files=files, table=name)
    new = table.write(rewritten(old) if rewritten else old, table=name, codec=codec)
    _same_rows(old, table.read(files=new, table=name))
    return table.commit(new, files, operation="rewrite", codec=codec)
