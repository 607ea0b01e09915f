"""Schema differences between two column inventories, and the plan that removes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions.columns import quoted, ref
from evenkeel.sources.inventory import column_records, full_type

# fixed values: difference kinds
ONLY_SOURCE = "schema_only_source"
ONLY_TARGET = "schema_only_target"
DIFFERENT = "schema_different"

# fixed values: descriptions and severities
COLUMN_TEXTS = {
    ONLY_SOURCE: "Column exists only in source",
    ONLY_TARGET: "Column exists only in target",
    DIFFERENT: "Column definition differs",
}
TABLE_TEXTS = {
    ONLY_SOURCE: "Table exists only in source database",
    ONLY_TARGET: "Table exists only in target database",
}
SEVERITIES = {"match": "info", ONLY_SOURCE: "error", ONLY_TARGET: "error", DIFFERENT: "warning"}

# what two column definitions must share to be equal, besides the name
ATTRIBUTES = ("data_type", "max_length", "numeric_precision", "numeric_scale", "is_nullable")


def _looked_up(texts: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for item in texts.items() for x in item]), key)


def _joined(source_columns: DataFrame, target_columns: DataFrame) -> DataFrame:
    def side(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(
            "table_name",
            "column_name",
            full_type().alias(f"{prefix}_value"),
            F.struct(*ATTRIBUTES).alias(f"{prefix}_definition"),
        )

    return side(source_columns, "source").join(
        side(target_columns, "target"), ["table_name", "column_name"], "full_outer"
    )


def _differs() -> Column:
    return ~F.col("source_definition").eqNullSafe(F.col("target_definition"))


def _column_kind() -> Column:
    return (
        F.when(F.col("target_definition").isNull(), ONLY_SOURCE)
        .when(F.col("source_definition").isNull(), ONLY_TARGET)
        .otherwise(DIFFERENT)
    )


def schema_diff(source_columns: DataFrame, target_columns: DataFrame) -> DataFrame:
    """Columns on one side only, or defined differently. Names match case-sensitively."""
    kind = F.col("difference_type")
    return (
        _joined(source_columns, target_columns)
        .where(_differs())
        .withColumn("difference_type", _column_kind())
        .select(
            "table_name",
            "difference_type",
            "column_name",
            "source_value",
            "target_value",
            _looked_up(COLUMN_TEXTS, kind).alias("description"),
            _looked_up(SEVERITIES, kind).alias("severity"),
        )
    )


def schema_diff_database(
    source_columns: DataFrame, target_columns: DataFrame, tables: list[str] | None = None
) -> DataFrame:
    """Table-level differences, and column-level ones for the tables both sides have.

    Each inventory is read once: a table that one side lacks is recognised by a window over
    its columns and collapsed to one row.
    """
    if tables is not None:
        source_columns = source_columns.where(F.col("table_name").isin(tables))
        target_columns = target_columns.where(F.col("table_name").isin(tables))
    columns_of_table = Window.partitionBy("table_name")
    flagged = (
        _joined(source_columns, target_columns)
        .withColumn("_in_source", F.bool_or(F.col("source_definition").isNotNull()).over(columns_of_table))
        .withColumn("_in_target", F.bool_or(F.col("target_definition").isNotNull()).over(columns_of_table))
        .where(_differs())
    )
    both = F.col("_in_source") & F.col("_in_target")
    kind = F.col("difference_type")
    description = F.when(both, _looked_up(COLUMN_TEXTS, kind)).otherwise(_looked_up(TABLE_TEXTS, kind))
    return (
        flagged.withColumn("difference_type", _column_kind())
        .select(
            "table_name",
            "difference_type",
            *[F.when(both, F.col(c)).alias(c) for c in ("column_name", "source_value", "target_value")],
            description.alias("description"),
            _looked_up(SEVERITIES, kind).alias("severity"),
        )
        .distinct()
    )


def column_presence(source_columns: DataFrame, target_columns: DataFrame) -> DataFrame:
    """Columns that only one side has."""
    return schema_diff(source_columns, target_columns).where(F.col("difference_type") != DIFFERENT).select(
        "table_name",
        "column_name",
        "difference_type",
        F.coalesce("source_value", "target_value").alias("full_type"),
    )


def one_sided_sample(
    df: DataFrame, other: DataFrame, order_by: list[str], rows: int = 10, max_columns: int = 5
) -> DataFrame:
    """The first `rows` rows of the first `max_columns` columns that `other` lacks: a sample to look at.

    `column_presence` lists all such columns.
    """
    columns = sorted(set(df.columns) - set(other.columns))[:max_columns]
    if not columns:
        raise ValueError("no one-sided columns")
    return df.orderBy(*[ref(c) for c in order_by]).select(*[ref(c) for c in columns]).limit(rows)


def schema_gap(source: T.StructType, target: T.StructType) -> list[str]:
    """Names of the columns that differ between two declared schemas; no job is run.

    Nullability is left out, because files declare every column nullable.
    """

    def definitions(schema: T.StructType) -> dict[str, tuple]:
        return {r[1]: r[2:6] for r in column_records(schema, "")}

    s, t = definitions(source), definitions(target)
    return sorted(name for name in s.keys() | t.keys() if s.get(name) != t.get(name))


def schema_sync_plan(differences: DataFrame, target_table: str) -> DataFrame:
    """One action per schema difference. Removals are commented out, as they lose data."""
    kind, column = F.col("difference_type"), F.col("column_name")
    name = F.concat(F.lit("`"), F.replace(column, F.lit("`"), F.lit("``")), F.lit("`"))
    table = ".".join(quoted(part) for part in target_table.split("."))
    whole_table = column.isNull()
    action = (
        F.when(whole_table & (kind == ONLY_SOURCE), "create_table")
        .when(kind == ONLY_SOURCE, "add_column")
        .when(kind == ONLY_TARGET, "drop_column")
        .otherwise("alter_column")
    )
    statement = (
        F.when(whole_table, F.concat(F.lit("-- Table missing in target: "), F.col("table_name")))
        .when(kind == ONLY_SOURCE, F.concat(F.lit(f"ALTER TABLE {table} ADD COLUMN "), name, F.lit(" "), F.col("source_value")))
        .when(kind == ONLY_TARGET, F.concat(F.lit(f"-- ALTER TABLE {table} DROP COLUMN "), name))
        .otherwise(F.concat(F.lit(f"ALTER TABLE {table} ALTER COLUMN "), name, F.lit(" TYPE "), F.col("source_value")))
    )
    return differences.where(~(whole_table & (kind == ONLY_TARGET))).select(
        action.alias("action"), "table_name", "column_name", "source_value", "target_value", statement.alias("statement")
    )
