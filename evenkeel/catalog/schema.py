"""Inventories and schema differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.catalog import query
from evenkeel.functions.columns import union_all
from evenkeel.operators.incremental import date_columns
from evenkeel.operators.schema_diff import (
    column_presence,
    one_sided_sample,
    schema_diff,
    schema_diff_database,
    schema_sync_plan,
)
from evenkeel.sources import footers
from evenkeel.sources import inventory as inv
from evenkeel.sources.fixtures import TABLES, ctes, view, views_of_files

def _split(columns: str) -> list[tuple[str, str]]:
    return [tuple(c.strip().split(" ", 1)) for c in columns.split(",")]


TYPE_NAMES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "date": "DATE",
              "timestamp_ntz": "TIMESTAMP", "array<float>": "FLOAT[]"}


def columns_sql(name: str, relation: str | None = None, columns: str | None = None) -> str:
    """SQL for the declared column inventory of one table, from the checking database's own description.

    Files declare every column nullable and text without a length.
    """
    cases = " ".join(f"WHEN '{theirs}' THEN '{ours}'" for ours, theirs in TYPE_NAMES.items())
    return (
        f"SELECT '{name}' AS table_name, column_name, CASE column_type {cases} ELSE column_type END AS data_type, "
        "NULL::INT AS max_length, NULL::INT AS numeric_precision, NULL::INT AS numeric_scale, true AS is_nullable, "
        f"(row_number() OVER ())::INT AS ordinal_position FROM (DESCRIBE SELECT * FROM {relation or name})"
    )


def profile_sql(name: str) -> str:
    """SQL for what the data of one table's columns holds."""
    selects = []
    for position, (column, kind) in enumerate(_split(TABLES[name]), start=1):
        length = f"max(length({column}))::INT" if kind == "string" else "NULL::INT"
        selects.append(
            f"SELECT '{name}' AS table_name, '{column}' AS column_name, '{kind}' AS data_type, {length} AS max_length, "
            f"NULL::INT AS numeric_precision, NULL::INT AS numeric_scale, count({column}) < count(*) AS is_nullable, "
            f"{position} AS ordinal_position FROM {name}"
        )
    return "\nUNION ALL ".join(selects)


FULL_TYPE = "CASE WHEN max_length > 0 THEN concat(data_type, '(', max_length, ')') ELSE data_type END"

# the two sides of the database comparison: relation and columns per table name
DRIFTED = "o_orderkey bigint, o_custkey int, o_orderstatus string, o_totalprice double, o_orderdate date, o_load string"
SOURCE_DB = {n: (n, TABLES[n]) for n in ("orders", "lineitem", "events", "nation", "region")}
TARGET_DB = {
    "orders": ("orders_drifted", DRIFTED),
    "lineitem": ("lineitem_t", TABLES["lineitem"]),
    "events": ("events_t", TABLES["events"]),
    "nation": ("nation", TABLES["nation"]),
    "supplier": ("supplier", TABLES["supplier"]),
}


def _databases(spark, folder):
    """The column inventories of both databases, from the schemas of their files."""
    sides = (SOURCE_DB, TARGET_DB)
    found = views_of_files(spark, folder, sorted({relation for side in sides for relation, _ in side.values()}))
    return [union_all([inv.declared_columns(spark, found[relation], name) for name, (relation, _) in side.items()]) for side in sides]


def _orders(spark, folder):
    """The column inventories of `orders` on both sides."""
    found = views_of_files(spark, folder, ["orders", "orders_drifted"])
    return [inv.declared_columns(spark, found[name], "orders") for name in ("orders", "orders_drifted")]


def _database_sql(side) -> str:
    return "\nUNION ALL ".join(columns_sql(name, relation, columns) for name, (relation, columns) in side.items())


SIDES = ctes(
    "orders_drifted",
    "lineitem_t",
    "events_t",
    more=f"""s AS (SELECT *, {FULL_TYPE} AS full_type FROM ({_database_sql(SOURCE_DB)})),
t AS (SELECT *, {FULL_TYPE} AS full_type FROM ({_database_sql(TARGET_DB)})),
column_diff AS (
  SELECT coalesce(s.table_name, t.table_name) AS table_name,
    CASE WHEN t.column_name IS NULL THEN 'schema_only_source' WHEN s.column_name IS NULL THEN 'schema_only_target' ELSE 'schema_different' END AS difference_type,
    coalesce(s.column_name, t.column_name) AS column_name, s.full_type AS source_value, t.full_type AS target_value,
    CASE WHEN t.column_name IS NULL THEN 'Column exists only in source' WHEN s.column_name IS NULL THEN 'Column exists only in target' ELSE 'Column definition differs' END AS description,
    CASE WHEN t.column_name IS NULL OR s.column_name IS NULL THEN 'error' ELSE 'warning' END AS severity
  FROM s FULL OUTER JOIN t ON s.table_name = t.table_name AND s.column_name = t.column_name
  WHERE s.data_type IS DISTINCT FROM t.data_type OR s.max_length IS DISTINCT FROM t.max_length OR s.is_nullable IS DISTINCT FROM t.is_nullable)
""",
)


@query("column_inventory", "\nUNION ALL ".join(columns_sql(n) for n in TABLES))
def _(spark, folder):
    found = views_of_files(spark, folder, list(TABLES))
    return union_all([inv.declared_columns(spark, found[n], n) for n in TABLES])


@query("column_profile", "\nUNION ALL ".join(profile_sql(n) for n in TABLES))
def _(spark, folder):
    return union_all([inv.column_profile(view(spark, folder, n), n) for n in TABLES])


COUNTS = "\nUNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in TABLES)


@query("row_counts", COUNTS)
def _(spark, folder):
    return inv.row_counts({n: view(spark, folder, n) for n in TABLES})


def _paths(folder):
    return {n: f"{folder}/{n}.parquet" for n in TABLES}


@query("table_inventory")
def _(spark, folder):
    """Sizes are not in any table, so no SQL checks them; a test compares them with the files."""
    return inv.table_inventory(spark, _paths(folder))


@query("table_codecs", f"SELECT table_name, row_count, 1::BIGINT AS file_count, 'snappy' AS compression FROM ({COUNTS})")
def _(spark, folder):
    return inv.table_inventory(spark, _paths(folder)).select("table_name", "row_count", "file_count", "compression")


@query(
    "column_footers",
    "\nUNION ALL ".join(
        f"SELECT '{n}' AS table_name, '{c}' AS column_name, {i} AS position, 'snappy' AS codec, "
        f"(SELECT {'count(*)' if '<' not in kind else f'sum(greatest(len({c}), 1))::BIGINT'} FROM {n}) AS value_count, "
        f"(SELECT count(*) - count({c}) FROM {n}) AS null_count"
        for n in TABLES
        for i, (c, kind) in enumerate(_split(TABLES[n]), start=1)
    ),
)
def _(spark, folder):
    """Codec, values and nulls of every column, from the ends of the files."""
    return footers.column_sizes(footers.footers(spark, _paths(folder))).drop("compressed_bytes", "uncompressed_bytes")


@query("column_sizes")
def _(spark, folder):
    """With bytes, which no table holds."""
    return footers.column_sizes(footers.footers(spark, _paths(folder)))


@query(
    "table_profile",
    f"""WITH c AS ({columns_sql('customer')})
SELECT table_name, (SELECT count(*) FROM customer) AS row_count, ordinal_position, column_name, {FULL_TYPE} AS full_type, is_nullable,
  column_name = 'c_custkey' AS is_key, (SELECT count(*) = count(DISTINCT c_custkey) FROM customer) AS key_is_unique FROM c""",
)
def _(spark, folder):
    return inv.table_profile(view(spark, folder, "customer"), "customer", ["c_custkey"])


@query(
    "table_presence",
    SIDES
    + """SELECT coalesce(a.table_name, b.table_name) AS table_name,
  CASE WHEN b.table_name IS NULL THEN 'source_only' WHEN a.table_name IS NULL THEN 'target_only' ELSE 'common' END AS presence
FROM (SELECT DISTINCT table_name FROM s) a FULL OUTER JOIN (SELECT DISTINCT table_name FROM t) b ON a.table_name = b.table_name""",
)
def _(spark, folder):
    def counted(side):
        return inv.row_counts({name: view(spark, folder, relation) for name, (relation, _) in side.items()})

    return inv.table_presence(counted(SOURCE_DB), counted(TARGET_DB))


def _counted(spark, folder):
    return inv.row_counts({n: view(spark, folder, n) for n in TABLES})


@query(
    "eligible_tables",
    f"SELECT * FROM ({COUNTS}) WHERE regexp_matches(table_name, '^(?:[a-o])', 'i') AND row_count <> 0 AND row_count BETWEEN 20 AND 50000",
)
def _(spark, folder):
    return inv.eligible_tables(_counted(spark, folder), "[A-O]", True, 20, 50000)


@query("select_tables", f"SELECT * FROM ({COUNTS}) WHERE regexp_matches(table_name, 'e[nm]', 'i')")
def _(spark, folder):
    return inv.select_tables(_counted(spark, folder), pattern="E[NM]")


@query("select_tables_preset", f"SELECT * FROM ({COUNTS}) WHERE starts_with(table_name, 'p')")
def _(spark, folder):
    return inv.select_tables(_counted(spark, folder), preset="p*")


@query(
    "restricted_tables",
    """SELECT concat(source, '_link') AS table_name, count(*) AS row_count, true AS is_restricted FROM documents GROUP BY source
UNION ALL SELECT lang, count(*), false FROM documents GROUP BY lang
UNION ALL SELECT concat('Fact_', lang), count(*), true FROM documents GROUP BY lang""",
)
def _(spark, folder):
    documents = view(spark, folder, "documents")

    def named(column, group):
        return documents.groupBy(group).count().select(column.alias("table_name"), F.col("count").alias("row_count"))

    tables = union_all(
        [
            named(F.concat("source", F.lit("_link")), "source"),
            named(F.col("lang"), "lang"),
            named(F.concat(F.lit("Fact_"), F.col("lang")), "lang"),
        ]
    )
    return inv.with_restricted_flag(tables)


@query(
    "schema_diff",
    SIDES + "SELECT * FROM column_diff WHERE table_name = 'orders'",
)
def _(spark, folder):
    return schema_diff(*_orders(spark, folder))


@query(
    "schema_diff_database",
    SIDES
    + """SELECT * FROM column_diff WHERE table_name IN (SELECT table_name FROM s) AND table_name IN (SELECT table_name FROM t)
UNION ALL SELECT DISTINCT table_name, 'schema_only_source', NULL, NULL, NULL, 'Table exists only in source database', 'error'
FROM s WHERE table_name NOT IN (SELECT table_name FROM t)
UNION ALL SELECT DISTINCT table_name, 'schema_only_target', NULL, NULL, NULL, 'Table exists only in target database', 'error'
FROM t WHERE table_name NOT IN (SELECT table_name FROM s)""",
)
def _(spark, folder):
    return schema_diff_database(*_databases(spark, folder))


@query(
    "column_presence",
    SIDES
    + """SELECT table_name, column_name, difference_type, coalesce(source_value, target_value) AS full_type
FROM column_diff WHERE table_name = 'orders' AND difference_type <> 'schema_different'""",
)
def _(spark, folder):
    return column_presence(*_orders(spark, folder))


@query("one_sided_sample", "SELECT o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 10")
def _(spark, folder):
    return one_sided_sample(view(spark, folder, "orders"), view(spark, folder, "orders_drifted"), ["o_orderkey"])


@query(
    "schema_sync_plan",
    SIDES
    + """SELECT CASE difference_type WHEN 'schema_only_source' THEN 'add_column' WHEN 'schema_only_target' THEN 'drop_column' ELSE 'alter_column' END AS action,
  table_name, column_name, source_value, target_value,
  CASE difference_type WHEN 'schema_only_source' THEN concat('ALTER TABLE `dbo`.`orders` ADD COLUMN `', column_name, '` ', source_value)
    WHEN 'schema_only_target' THEN concat('-- ALTER TABLE `dbo`.`orders` DROP COLUMN `', column_name, '`')
    ELSE concat('ALTER TABLE `dbo`.`orders` ALTER COLUMN `', column_name, '` TYPE ', source_value) END AS statement
FROM column_diff WHERE table_name = 'orders'""",
)
def _(spark, folder):
    return schema_sync_plan(schema_diff(*_orders(spark, folder)), "dbo.orders")


DATED = [(n, c) for n in TABLES for c, kind in _split(TABLES[n]) if kind == "timestamp_ntz"]


@query(
    "date_columns",
    "\nUNION ALL ".join(
        f"SELECT '{n}' AS table_name, '{c}' AS column_name, min({c}) AS first_value, max({c}) AS last_value FROM {n}"
        for n, c in DATED
    ),
)
def _(spark, folder):
    ranges = []
    for name in TABLES:
        df = view(spark, folder, name)
        for column in date_columns(df):
            ranges.append(
                df.agg(F.min(column).alias("first_value"), F.max(column).alias("last_value")).select(
                    F.lit(name).alias("table_name"), F.lit(column).alias("column_name"), "first_value", "last_value"
                )
            )
    return union_all(ranges)


LISTED = ("customer", "nation", "orders")


@query(
    "catalog_inventory",
    "\nUNION ALL ".join(
        f"SELECT 'ek_{n}' AS table_name, (SELECT count(*) FROM {n}) AS row_count, (SELECT count(*)::INT FROM (DESCRIBE SELECT * FROM {n})) AS column_count"
        for n in LISTED
    ),
)
def _(spark, folder):
    """Tables that are known to the session by name."""
    for name, df in views_of_files(spark, folder, list(LISTED)).items():
        df.createOrReplaceTempView(f"ek_{name}")
    return inv.catalog_inventory(spark, pattern="ek_*")
