"""Formats, reports and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.catalog import query
from evenkeel.catalog.compare import results, results_ctes
from evenkeel.catalog.schema import SIDES
from evenkeel.functions import text as X
from evenkeel.functions.columns import union_all
from evenkeel.operators.row_diff import cell_diff
from evenkeel.operators.schema_diff import schema_diff
from evenkeel.plans.reports import comparison_report, difference_report
from evenkeel.session import fresh_path
from evenkeel.sources import inventory as inv
from evenkeel.sources import sinks
from evenkeel.sources.fixtures import ctes, view

_LADDER = " ".join(
    f"WHEN b < {1024.0 ** (i + 1)!r}::DOUBLE THEN printf('%.2f {unit}', b / {1024.0**i!r}::DOUBLE)"
    for i, unit in enumerate(X.BYTE_UNITS[:-1])
)


@query(
    "fmt_bytes",
    f"SELECT doc_id, CASE {_LADDER} ELSE printf('%.2f PB', b / {1024.0**5!r}::DOUBLE) END AS formatted FROM (SELECT doc_id, n_chars::DOUBLE * n_chars * n_chars * n_chars AS b FROM documents)",
)
def _(spark, folder):
    size = F.col("n_chars").cast("double") * F.col("n_chars") * F.col("n_chars") * F.col("n_chars")
    return view(spark, folder, "documents").select("doc_id", X.format_bytes(size).alias("formatted"))


@query("fmt_number", "SELECT o_orderkey, format('{:,}', o_orderkey * o_custkey) AS formatted FROM orders")
def _(spark, folder):
    return view(spark, folder, "orders").select(
        "o_orderkey", X.format_number(F.col("o_orderkey") * F.col("o_custkey")).alias("formatted")
    )


@query(
    "fmt_percentage",
    """SELECT event_id, CASE WHEN total = 0 THEN '0.0%' ELSE concat(printf('%.1f', event_id::DOUBLE / total * 100), '%') END AS formatted
FROM (SELECT event_id, user_id % 7 AS total FROM events)""",
)
def _(spark, folder):
    return view(spark, folder, "events").select(
        "event_id", X.format_percentage(F.col("event_id"), F.col("user_id") % 7).alias("formatted")
    )


@query(
    "fmt_duration",
    """SELECT event_id, CASE WHEN s < 60 THEN printf('%.1fs', s)
  WHEN s < 3600 THEN concat(floor(s / 60)::BIGINT, 'm ', floor(s % 60)::BIGINT, 's')
  WHEN s < 86400 THEN concat(floor(s / 3600)::BIGINT, 'h ', floor((s / 60) % 60)::BIGINT, 'm')
  ELSE concat(floor(s / 86400)::BIGINT, 'd ', floor((s / 3600) % 24)::BIGINT, 'h') END AS formatted
FROM (SELECT event_id, value * value AS s FROM events)""",
)
def _(spark, folder):
    return view(spark, folder, "events").select(
        "event_id", X.format_duration(F.col("value") * F.col("value")).alias("formatted")
    )


@query(
    "fmt_table_name",
    "SELECT doc_id, concat('[', source, '].[', lang, ']') AS formatted, concat(source, '.', lang) AS full_name FROM documents",
)
def _(spark, folder):
    schema, table = F.col("source"), F.col("lang")
    return view(spark, folder, "documents").select(
        "doc_id", X.format_table_name(schema, table).alias("formatted"), X.full_name(schema, table).alias("full_name")
    )


@query(
    "fmt_truncate",
    """SELECT doc_id, CASE WHEN length(text) <= 50 THEN text ELSE concat(substring(text, 1, 47), '...') END AS truncated,
  CASE WHEN length(text) <= 200 THEN text ELSE concat(substring(text, 1, 200), '...') END AS shortened FROM documents""",
)
def _(spark, folder):
    return view(spark, folder, "documents").select(
        "doc_id", X.truncate(F.col("text")).alias("truncated"), X.shortened(F.col("text")).alias("shortened")
    )


@query(
    "display_names",
    ctes("wl_sessions")
    + """SELECT session_id, concat(coalesce(program_name, 'Unknown'), ' (', coalesce(host_name, 'Unknown'), ')') AS display_name,
  memory_usage * 8 / 1024::DOUBLE AS memory_mb FROM wl_sessions""",
)
def _(spark, folder):
    return view(spark, folder, "wl_sessions").select(
        "session_id",
        X.source_name(F.col("program_name"), F.col("host_name")).alias("display_name"),
        (F.col("memory_usage") * 8 / 1024).alias("memory_mb"),
    )


@query(
    "comparison_report",
    results_ctes()
    + """SELECT source_table, target_table, status, schema_match, format('{:,}', source_row_count) AS source_rows,
  format('{:,}', target_row_count) AS target_rows, format('{:,}', matching_rows) AS matching_rows,
  format('{:,}', different_rows) AS different_rows, format('{:,}', source_only_rows) AS source_only,
  format('{:,}', target_only_rows) AS target_only, concat(printf('%.2f', match_percentage), '%') AS match_percentage, summary FROM results""",
)
def _(spark, folder):
    return comparison_report(results(spark, folder))


def _order_schema_differences(spark, folder):
    return schema_diff(
        inv.declared_columns(spark, view(spark, folder, "orders"), "orders"),
        inv.declared_columns(spark, view(spark, folder, "orders_drifted"), "orders"),
    )


def _cells(source: str, target: str, key: str, columns: list[str]) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{source}' AS table_name, concat('{key}=', s.{key}) AS key_display, '{c}' AS column_name, "
        f"CAST(s.{c} AS VARCHAR) AS source_value, CAST(t.{c} AS VARCHAR) AS target_value "
        f"FROM {source} s JOIN {target} t ON s.{key} = t.{key} WHERE s.{c} IS DISTINCT FROM t.{c}"
        for c in columns
    )


@query(
    "difference_report",
    SIDES
    + f""", cells AS ({_cells('orders', 'orders_t', 'o_orderkey', ['o_custkey', 'o_orderstatus', 'o_totalprice'])}
UNION ALL {_cells('events', 'events_t', 'event_id', ['value'])})
SELECT table_name, 'schema' AS section, '' AS key_display, column_name, coalesce(source_value, '') AS source_value, coalesce(target_value, '') AS target_value
FROM column_diff WHERE table_name = 'orders'
UNION ALL SELECT table_name, 'data', key_display, column_name, coalesce(source_value, ''), coalesce(target_value, '') FROM cells
QUALIFY row_number() OVER (PARTITION BY table_name ORDER BY key_display, column_name) <= 100""",
)
def _(spark, folder):
    cells = [
        cell_diff(view(spark, folder, s), view(spark, folder, t), [key], table_name=s).drop(key)
        for s, t, key in (("orders", "orders_t", "o_orderkey"), ("events", "events_t", "event_id"))
    ]
    return difference_report(_order_schema_differences(spark, folder), union_all(cells), 100)


@query(
    "sink_csv_roundtrip",
    results_ctes()
    + """SELECT source_table, target_table, status, schema_match, source_row_count AS source_rows, target_row_count AS target_rows,
  matching_rows, different_rows, source_only_rows AS source_only, target_only_rows AS target_only, match_percentage FROM results""",
)
def _(spark, folder):
    paths = sinks.write_csv(results(spark, folder), _order_schema_differences(spark, folder), fresh_path(spark, "csv"))
    return spark.read.option("header", True).schema(sinks.CSV_SUMMARY).csv(paths[0])


@query(
    "sink_csv_schema_differences",
    SIDES
    + """SELECT table_name AS "table", difference_type AS "type", column_name AS "column", coalesce(source_value, '') AS source,
  coalesce(target_value, '') AS target, description FROM column_diff WHERE table_name = 'orders'""",
)
def _(spark, folder):
    paths = sinks.write_csv(results(spark, folder), _order_schema_differences(spark, folder), fresh_path(spark, "csv"))
    written = spark.read.option("header", True).option("emptyValue", "").option("nullValue", "\u0000").csv(paths[1])
    return written


@query(
    "sink_json_roundtrip",
    SIDES
    + """, listed AS (SELECT string_agg(concat_ws('|', column_name, difference_type, coalesce(source_value, '-'), coalesce(target_value, '-')), ';' ORDER BY column_name) AS l
  FROM column_diff WHERE table_name = 'orders')
SELECT 'nation' AS source_table, (SELECT count(*) FROM nation) AS source_row_count, '' AS schema_differences, 0::BIGINT AS data_differences_count
UNION ALL SELECT 'orders', (SELECT count(*) FROM orders), (SELECT l FROM listed),
  (SELECT count(*) FROM orders s JOIN orders_drifted t ON s.o_orderkey = t.o_orderkey WHERE s.o_custkey <> t.o_custkey)
  + (SELECT count(*) FROM orders s JOIN orders_drifted t ON s.o_orderkey = t.o_orderkey WHERE s.o_orderstatus <> t.o_orderstatus)
  + (SELECT count(*) FROM orders s JOIN orders_drifted t ON s.o_orderkey = t.o_orderkey WHERE s.o_totalprice IS DISTINCT FROM t.o_totalprice)""",
)
def _(spark, folder):
    from evenkeel.plans.compare import TablePair, compare_tables

    orders, drifted, nation = (view(spark, folder, n) for n in ("orders", "orders_drifted", "nation"))
    compared = compare_tables(
        spark,
        [TablePair("orders", "orders", orders, drifted, ("o_orderkey",)), TablePair("nation", "nation", nation, nation, ("n_nationkey",))],
        "standard",
    )
    counts = (
        cell_diff(orders, drifted, ["o_orderkey"], table_name="orders")
        .groupBy("table_name")
        .agg(F.count("*").alias("data_differences_count"))
    )
    path = fresh_path(spark, "json")
    document = sinks.json_results(compared, _order_schema_differences(spark, folder), counts)
    sinks.write_json(document, path, "2024-02-01T00:00:00")
    stored = spark.read.schema(document.schema).json(f"{path}/results")
    shown = F.transform(
        "schema_differences",
        lambda d: F.concat_ws("|", d["column"], d["type"], F.coalesce(d["source"], F.lit("-")), F.coalesce(d["target"], F.lit("-"))),
    )
    return stored.select(
        "source_table", "source_row_count", F.array_join(shown, ";").alias("schema_differences"), "data_differences_count"
    )
