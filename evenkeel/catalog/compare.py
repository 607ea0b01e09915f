"""Comparison of table pairs, run totals and incremental loads."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.catalog import query
from evenkeel.catalog.schema import _split
from evenkeel.functions.columns import union_all
from evenkeel.functions.predicates import ColumnFilter
from evenkeel.operators.fingerprint import quick_compare
from evenkeel.operators.incremental import incremental_cutoff, incremental_pair
from evenkeel.operators.row_diff import row_diff_counts
from evenkeel.operators.table_filter import ComparisonFilter, TableFilter
from evenkeel.plans import compare as C
from evenkeel.sources.fixtures import TABLES, ctes, view

# source, target, key, schema differences between the two
PAIRS = [
    ("orders", "orders_t", "o_orderkey", 0),
    ("orders", "orders_drifted", "o_orderkey", 4),
    ("events", "events_t", "event_id", 0),
    ("lineitem", "lineitem_t", "", 0),
    ("nation", "nation", "n_nationkey", 0),
    ("region", "region", "r_regionkey", 0),
]


def table_pairs(spark, folder):
    return [
        C.TablePair(f"src.{s}", f"tgt.{t}", view(spark, folder, s), view(spark, folder, t), (key,) if key else ())
        for s, t, key, _ in PAIRS
    ]


def _common(source: str, target: str) -> list[str]:
    columns = [c for c, _ in _split(TABLES[source])]
    return [c for c in columns if c != "o_orderpriority"] if target == "orders_drifted" else columns


def _counts_sql(source: str, target: str, key: str) -> str:
    columns = _common(source, target)
    if not key:
        names = ", ".join(columns)
        extra = f"(SELECT count(*) FROM (SELECT {names} FROM {{}} EXCEPT ALL SELECT {names} FROM {{}}))"
        lost, added = extra.format(source, target), extra.format(target, source)
        return (
            f"SELECT (SELECT count(*) FROM {source}) AS source_row_count, (SELECT count(*) FROM {target}) AS target_row_count, "
            f"(SELECT count(*) FROM {source}) - {lost} AS matching_rows, 0::BIGINT AS different_rows, "
            f"{lost} AS source_only_rows, {added} AS target_only_rows"
        )
    same = " AND ".join(f"s.{c} IS NOT DISTINCT FROM t.{c}" for c in columns)
    return (
        f"SELECT count(s.{key}) AS source_row_count, count(t.{key}) AS target_row_count, "
        f"count(*) FILTER (s.{key} = t.{key} AND {same}) AS matching_rows, "
        f"count(*) FILTER (s.{key} = t.{key} AND NOT ({same})) AS different_rows, "
        f"count(*) FILTER (t.{key} IS NULL) AS source_only_rows, count(*) FILTER (s.{key} IS NULL) AS target_only_rows "
        f"FROM {source} s FULL OUTER JOIN {target} t ON s.{key} = t.{key}"
    )


def _quick_sql(source: str, target: str) -> str:
    names = ", ".join(_common(source, target))
    return (
        f"SELECT (SELECT count(*) FROM {source}) AS source_row_count, (SELECT count(*) FROM {target}) AS target_row_count, "
        f"(SELECT count(*) FROM (SELECT {names} FROM {source} EXCEPT ALL SELECT {names} FROM {target})) = 0 "
        f"AND (SELECT count(*) FROM (SELECT {names} FROM {target} EXCEPT ALL SELECT {names} FROM {source})) = 0 AS fingerprint_match"
    )


def _results_sql(mode: str) -> str:
    parts = []
    for source, target, key, gap in PAIRS:
        if mode == "quick":
            counts = (
                "SELECT source_row_count, target_row_count, "
                "CASE WHEN fingerprint_match THEN least(source_row_count, target_row_count) ELSE 0 END AS matching_rows, "
                "CASE WHEN fingerprint_match THEN 0 ELSE greatest(source_row_count, target_row_count) END AS different_rows, "
                f"0::BIGINT AS source_only_rows, 0::BIGINT AS target_only_rows FROM ({_quick_sql(source, target)})"
            )
        else:
            counts = _counts_sql(source, target, key)
        parts.append(
            f"SELECT 'src.{source}' AS source_table, 'tgt.{target}' AS target_table, '{mode}' AS mode, 'completed' AS status, "
            f"NULL::VARCHAR AS error_message, {str(gap == 0).lower()} AS schema_match, {gap} AS schema_diff_count, * FROM ({counts})"
        )
    return "\nUNION ALL ".join(parts)


METRICS = """metrics AS (SELECT *,
  CASE WHEN greatest(source_row_count, target_row_count) = 0 THEN 100.0::DOUBLE
       ELSE matching_rows::DOUBLE / greatest(source_row_count, target_row_count) * 100 END AS match_percentage,
  schema_match AND source_row_count = target_row_count AND different_rows = 0 AND source_only_rows = 0 AND target_only_rows = 0 AS is_match
  FROM raw),
results AS (SELECT *, CASE WHEN is_match THEN concat('✓ Complete match (', source_row_count, ' rows)') ELSE
  concat_ws(', ', CASE WHEN NOT schema_match THEN concat(schema_diff_count, ' schema diffs') END,
    CASE WHEN different_rows > 0 THEN concat(different_rows, ' data diffs') END,
    CASE WHEN source_only_rows > 0 THEN concat(source_only_rows, ' source-only') END,
    CASE WHEN target_only_rows > 0 THEN concat(target_only_rows, ' target-only') END) END AS summary FROM metrics)
"""


def results_ctes(mode: str = "standard") -> str:
    return ctes("orders_t", "orders_drifted", "events_t", "lineitem_t", more=f"raw AS ({_results_sql(mode)}),\n{METRICS}")


def results(spark, folder, mode="standard"):
    return C.compare_tables(spark, table_pairs(spark, folder), mode)


@query(
    "quick_compare",
    ctes("orders_t", "events_t", "lineitem_t")
    + "\nUNION ALL ".join(
        f"SELECT '{s}' AS source_table, '{t}' AS target_table, * FROM ({_quick_sql(s, t)})"
        for s, t in [("orders", "orders_t"), ("events", "events_t"), ("lineitem", "lineitem_t"), ("lineitem", "lineitem"), ("embeddings", "embeddings")]
    ),
)
def _(spark, folder):
    compared = []
    for s, t in [("orders", "orders_t"), ("events", "events_t"), ("lineitem", "lineitem_t"), ("lineitem", "lineitem"), ("embeddings", "embeddings")]:
        pair = quick_compare(view(spark, folder, s), view(spark, folder, t))
        compared.append(pair.select(F.lit(s).alias("source_table"), F.lit(t).alias("target_table"), "*"))
    return union_all(compared)


@query("compare_tables", results_ctes() + "SELECT * FROM results")
def _(spark, folder):
    return results(spark, folder)


@query("compare_tables_quick", results_ctes("quick") + "SELECT * FROM results")
def _(spark, folder):
    return results(spark, folder, "quick")


@query("compare_tables_isolated", results_ctes() + "SELECT * FROM results")
def _(spark, folder):
    timed = C.compare_tables(spark, table_pairs(spark, folder), "standard", isolate=True)
    return timed.drop("started_at", "completed_at", "duration_seconds", "rows_per_second")


def _cells_sql(source: str, target: str, key: str) -> str:
    return "\nUNION ALL ".join(
        f"SELECT 'src.{source}' AS table_name, concat('{key}=', s.{key}) AS key_display, '{c}' AS column_name, "
        f"CAST(s.{c} AS VARCHAR) AS source_value, CAST(t.{c} AS VARCHAR) AS target_value, 'data_different' AS difference_type "
        f"FROM {source} s JOIN {target} t ON s.{key} = t.{key} WHERE s.{c} IS DISTINCT FROM t.{c}"
        for c in _common(source, target)
        if c != key
    )


@query(
    "deep_differences",
    ctes("orders_t", "orders_drifted", "events_t") + "\nUNION ALL ".join(_cells_sql(s, t, k) for s, t, k, _ in PAIRS if k),
)
def _(spark, folder):
    return C.deep_differences(table_pairs(spark, folder)).where("difference_type = 'data_different'").drop("copies")


def _one_sided_sql(source: str, target: str, key: str) -> str:
    return (
        f"SELECT 'src.{source}' AS table_name, 'data_only_source' AS difference_type, count(*) AS found, count(*)::BIGINT AS copies "
        f"FROM {source} WHERE {key} NOT IN (SELECT {key} FROM {target}) HAVING count(*) > 0 "
        f"UNION ALL SELECT 'src.{source}', 'data_only_target', count(*), count(*)::BIGINT "
        f"FROM {target} WHERE {key} NOT IN (SELECT {key} FROM {source}) HAVING count(*) > 0"
    )


def _multiset_sql(source: str, target: str) -> str:
    columns = ", ".join(_common(source, target))
    more = []
    for kind, a, b in (("data_only_source", source, target), ("data_only_target", target, source)):
        surplus = f"SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b}"
        more.append(
            f"SELECT 'src.{source}' AS table_name, '{kind}' AS difference_type, count(DISTINCT shown) AS found, "
            f"count(*)::BIGINT AS copies FROM (SELECT CAST(x AS VARCHAR) AS shown FROM ({surplus}) x) HAVING count(*) > 0"
        )
    return " UNION ALL ".join(more)


@query(
    "compare_tables_deep",
    ctes(
        "orders_t",
        "orders_drifted",
        "events_t",
        "lineitem_t",
        more="cells AS (" + "\nUNION ALL ".join(_cells_sql(s, t, k) for s, t, k, _ in PAIRS if k) + ")\n",
    )
    + "SELECT table_name, difference_type, sum(found)::BIGINT AS found, sum(copies)::BIGINT AS copies FROM (\n"
    + "SELECT table_name, difference_type, count(*) AS found, count(*)::BIGINT AS copies FROM cells GROUP BY ALL\nUNION ALL "
    + "\nUNION ALL ".join(_one_sided_sql(s, t, k) if k else _multiset_sql(s, t) for s, t, k, _ in PAIRS)
    + ") GROUP BY ALL",
)
def _(spark, folder):
    found = C.deep_differences(table_pairs(spark, folder))
    return found.groupBy("table_name", "difference_type").agg(F.count("*").alias("found"), F.sum("copies").alias("copies"))


@query(
    "comparison_metrics",
    results_ctes() + "SELECT source_table, target_table, match_percentage, is_match, summary FROM results",
)
def _(spark, folder):
    return results(spark, folder).select("source_table", "target_table", "match_percentage", "is_match", "summary")


@query("compare_tables_early_exit", results_ctes() + "SELECT * FROM results")
def _(spark, folder):
    return C.compare_tables(spark, table_pairs(spark, folder), "standard", trust_fingerprints=True)


@query(
    "compare_filtered",
    ctes(
        "orders_t",
        more="""s AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderpriority ILIKE '%urgent' AND o_custkey > 100),
t AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders_t WHERE o_orderpriority ILIKE '%urgent' AND o_custkey > 100)""",
    )
    + """SELECT count(s.o_orderkey) AS source_row_count, count(t.o_orderkey) AS target_row_count,
  count(*) FILTER (s.o_orderkey = t.o_orderkey AND s.o_orderstatus = t.o_orderstatus AND s.o_totalprice IS NOT DISTINCT FROM t.o_totalprice) AS matching_rows,
  count(*) FILTER (s.o_orderkey = t.o_orderkey AND NOT (s.o_orderstatus = t.o_orderstatus AND s.o_totalprice IS NOT DISTINCT FROM t.o_totalprice)) AS different_rows,
  count(*) FILTER (t.o_orderkey IS NULL) AS source_only_rows, count(*) FILTER (s.o_orderkey IS NULL) AS target_only_rows
FROM s FULL OUTER JOIN t ON s.o_orderkey = t.o_orderkey""",
)
def _(spark, folder):
    settings = ComparisonFilter(
        {
            "orders": TableFilter(
                (ColumnFilter("o_orderpriority", "like", "%urgent"), ColumnFilter("o_custkey", "gt", 100)),
                exclude=("o_orderdate", "o_custkey"),
            )
        },
        exclude_columns=("o_orderpriority",),
    )
    pair = C.TablePair("orders", "orders", view(spark, folder, "orders"), view(spark, folder, "orders_t"), ("o_orderkey",))
    return C.compare_tables(spark, [pair], "standard", settings=settings).select(
        "source_row_count", "target_row_count", "matching_rows", "different_rows", "source_only_rows", "target_only_rows"
    )


TOTALS = """SELECT count(*) AS total_tables, count(*) FILTER (is_match) AS matching_tables,
  count(*) FILTER (NOT is_match AND status <> 'failed') AS different_tables, count(*) FILTER (status = 'failed') AS failed_tables,
  sum(source_row_count)::BIGINT AS total_source_rows, sum(target_row_count)::BIGINT AS total_target_rows FROM results"""


@query("run_summary", results_ctes() + TOTALS)
def _(spark, folder):
    return C.run_summary(results(spark, folder))


@query("results_filter", results_ctes() + "SELECT * FROM results WHERE NOT is_match AND status = 'completed'")
def _(spark, folder):
    return C.filter_results(results(spark, folder), "Different")


@query(
    "results_sorted",
    results_ctes()
    + """SELECT *, row_number() OVER (ORDER BY different_rows + source_only_rows + target_only_rows DESC, source_table, target_table) AS position
FROM results""",
)
def _(spark, folder):
    return C.sort_results(results(spark, folder), "Differences", descending=True)


@query(
    "row_count_top10",
    results_ctes()
    + """SELECT split_part(source_table, '.', 2) AS table_name, source_row_count, target_row_count
FROM results ORDER BY source_table, target_table LIMIT 10""",
)
def _(spark, folder):
    return C.row_count_chart(results(spark, folder))


@query(
    "incremental_cutoff",
    ctes("events_t")
    + """SELECT *, CASE WHEN source_max <> target_max THEN least(source_max, target_max) END AS cutoff
FROM (SELECT (SELECT max(ts) FROM events) AS source_max, (SELECT max(ts) FROM events_t) AS target_max)""",
)
def _(spark, folder):
    return incremental_cutoff(view(spark, folder, "events"), view(spark, folder, "events_t"), "ts")


@query(
    "incremental_compare",
    ctes(
        "events_t",
        more="""cutoff AS (SELECT least((SELECT max(ts) FROM events), (SELECT max(ts) FROM events_t)) AS last_ts),
s AS (SELECT * FROM events WHERE ts <= (SELECT last_ts FROM cutoff)),
t AS (SELECT * FROM events_t WHERE ts <= (SELECT last_ts FROM cutoff))""",
    )
    + _counts_sql("events", "events_t", "event_id").replace("FROM events s FULL OUTER JOIN events_t t", "FROM s FULL OUTER JOIN t"),
)
def _(spark, folder):
    source, target = incremental_pair(view(spark, folder, "events"), view(spark, folder, "events_t"), "ts")
    return row_diff_counts(source, target, ["event_id"])


@query(
    "incremental_null_dates",
    ctes(
        more="""s0 AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts END AS ts FROM events),
last_day AS (SELECT max(ts) - INTERVAL 1 DAY AS last_ts FROM s0),
t0 AS (SELECT * FROM s0 WHERE (ts IS NULL AND event_id % 2 = 0) OR ts <= (SELECT last_ts FROM last_day)),
cutoff AS (SELECT least((SELECT max(ts) FROM s0), (SELECT max(ts) FROM t0)) AS last_ts),
s AS (SELECT * FROM s0 WHERE ts IS NULL OR ts <= (SELECT last_ts FROM cutoff)),
t AS (SELECT * FROM t0 WHERE ts IS NULL OR ts <= (SELECT last_ts FROM cutoff))"""
    )
    + """SELECT count(s.event_id) AS source_row_count, count(t.event_id) AS target_row_count,
  count(*) FILTER (s.event_id = t.event_id) AS matching_rows, 0::BIGINT AS different_rows,
  count(*) FILTER (t.event_id IS NULL) AS source_only_rows, count(*) FILTER (s.event_id IS NULL) AS target_only_rows
FROM s FULL OUTER JOIN t ON s.event_id = t.event_id""",
)
def _(spark, folder):
    """Rows without a date take part in an incremental comparison."""
    source = view(spark, folder, "events").select(
        "event_id", F.when(F.col("event_id") % 7 != 0, F.col("ts")).alias("ts")
    )
    last = source.agg((F.max("ts") - F.expr("INTERVAL 1 DAY")).alias("last_ts")).first().last_ts
    target = source.where((F.col("ts").isNull() & (F.col("event_id") % 2 == 0)) | (F.col("ts") <= F.lit(last)))
    return row_diff_counts(*incremental_pair(source, target, "ts"), ["event_id"])


@query(
    "compare_normalised",
    """SELECT count(*) AS source_row_count, count(*) AS target_row_count, count(*) AS matching_rows, 0::BIGINT AS different_rows,
  0::BIGINT AS source_only_rows, 0::BIGINT AS target_only_rows FROM customer""",
)
def _(spark, folder):
    """Text that differs in case and surrounding blanks alone is equal."""
    customer = view(spark, folder, "customer")
    text = [f.name for f in customer.schema.fields if f.dataType.simpleString() == "string"]
    target = customer.withColumns({c: F.concat(F.lit("  "), F.upper(c)) for c in text})
    pair = C.TablePair("customer", "customer", customer, target, ("c_custkey",))
    settings = ComparisonFilter(ignore_case=True, ignore_whitespace=True)
    return C.compare_tables(spark, [pair], "standard", settings=settings).select(
        "source_row_count", "target_row_count", "matching_rows", "different_rows", "source_only_rows", "target_only_rows"
    )


@query(
    "compare_filtered_one_sided",
    ctes("orders_drifted")
    + _counts_sql("orders", "orders_drifted", "o_orderkey"),
)
def _(spark, folder):
    """A filter on a column that one side lacks applies to neither."""
    settings = ComparisonFilter({"orders": TableFilter((ColumnFilter("o_orderpriority", "like", "%urgent"),))})
    pair = C.TablePair("orders", "orders", view(spark, folder, "orders"), view(spark, folder, "orders_drifted"), ("o_orderkey",))
    return C.compare_tables(spark, [pair], "standard", settings=settings).select(
        "source_row_count", "target_row_count", "matching_rows", "different_rows", "source_only_rows", "target_only_rows"
    )
