"""Target tables and workload logs derived from the test tables.

The test data has one copy of each table, so a target is the table with known deletions,
insertions and changes, and the workload logs are computed from `events`. The SQL runs in
Spark and DuckDB alike; `{name}` marks an input.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from evenkeel.sources import footers
from evenkeel.sources.tables import table

# fixed values: the test tables and their column types
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

AS_OF = "2024-02-01 00:00:00"

# name -> (inputs, SQL)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "orders_t": (
        ("orders",),
        """
SELECT o_orderkey,
  CASE WHEN o_orderkey % 29 = 0 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey,
  CASE WHEN o_orderkey % 13 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 23 = 0 THEN NULL
       WHEN o_orderkey % 13 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
  o_orderdate, o_orderpriority
FROM {orders} WHERE o_orderkey % 17 <> 0
UNION ALL
SELECT o_orderkey + 10000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
FROM {orders} WHERE o_orderkey % 19 = 0""",
    ),
    "lineitem_t": (
        ("lineitem",),
        """
SELECT * FROM {lineitem} WHERE l_orderkey % 17 <> 0
UNION ALL
SELECT * FROM {lineitem} WHERE l_orderkey % 37 = 0""",
    ),
    "events_t": (
        ("events",),
        """
SELECT event_id, ts, user_id, event_type,
  CASE WHEN event_id % 31 = 0 THEN value + 0.5 ELSE value END AS value, props
FROM {events} WHERE ts < TIMESTAMP '2024-01-25 00:00:00'""",
    ),
    # the orders target as a drifted schema: one column gone, one new, two types changed
    "orders_drifted": (
        ("orders_t",),
        """
SELECT o_orderkey, CAST(o_custkey AS INT) AS o_custkey, o_orderstatus, o_totalprice,
  CAST(o_orderdate AS DATE) AS o_orderdate, concat('load-', o_orderstatus) AS o_load
FROM {orders_t}""",
    ),
    # orders as another system writes them: other case, padded text
    "orders_padded": (
        ("orders",),
        """
SELECT o_orderkey, o_custkey, lower(o_orderstatus) AS o_orderstatus, o_totalprice, o_orderdate,
  concat('  ', lower(o_orderpriority), ' ') AS o_orderpriority
FROM {orders}""",
    ),
    "wl_sessions": (
        ("events",),
        """
SELECT user_id AS session_id,
  CASE user_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'etl' WHEN 2 THEN 'bi' WHEN 3 THEN 'api'
                   WHEN 4 THEN 'web' ELSE 'batch' END AS program_name,
  CASE WHEN user_id % 11 = 0 THEN NULL
       ELSE concat('host', CAST(user_id % 4 AS STRING)) END AS host_name,
  concat('login', CAST(user_id % 2 AS STRING)) AS login_name,
  CASE user_id % 5 WHEN 0 THEN 'suspended' WHEN 1 THEN 'running' WHEN 2 THEN 'running'
                   ELSE 'sleeping' END AS status,
  CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cpu_time,
  count(*) AS reads,
  count(CASE WHEN event_type = 'purchase' THEN 1 END) AS writes,
  user_id % 50 AS memory_usage,
  user_id % 2 AS open_transaction_count,
  min(ts) AS login_time, max(ts) AS last_request_start_time, max(ts) AS last_request_end_time,
  CASE WHEN user_id % 25 = 1 THEN 0 ELSE 1 END AS is_user_process
FROM {events} GROUP BY user_id""",
    ),
    "wl_requests": (
        ("wl_sessions",),
        """
SELECT session_id, session_id + 1000 AS request_id,
  CASE WHEN session_id % 5 = 0 THEN session_id % 7 + 1 ELSE 0 END AS blocking_session_id,
  CASE WHEN session_id % 5 = 0 THEN 'LCK_M_X' ELSE 'CXPACKET' END AS wait_type,
  cpu_time % 60000 AS wait_time,
  concat('KEY:', CAST(session_id % 9 AS STRING)) AS wait_resource,
  concat('SELECT ', CAST(session_id % 40 AS STRING)) AS query_text,
  status, 'SELECT' AS command
FROM {wl_sessions} WHERE status <> 'sleeping'""",
    ),
    "wl_query_stats": (
        ("events",),
        """
SELECT md5(k) AS query_hash, concat('SELECT * FROM q', k) AS query_text,
  CASE event_type WHEN 'signup' THEN 'etl' WHEN 'view' THEN 'bi' WHEN 'click' THEN 'api'
                  WHEN 'purchase' THEN 'web' ELSE 'batch' END AS program_name,
  count(*) * 50 AS execution_count,
  CAST(sum(cents) * max(w) AS BIGINT) AS total_worker_time,
  CAST(sum(cents) * max(w) * 2 AS BIGINT) AS total_elapsed_time,
  CAST(sum(cents) * max(w) AS BIGINT) AS total_logical_reads,
  count(*) * 3 AS total_logical_writes, count(*) * 7 AS total_physical_reads,
  max(ts) AS last_execution_time
FROM (SELECT event_type, ts, CAST(round(value * 100) AS BIGINT) AS cents, k,
        CASE WHEN CAST(k AS INT) % 10 = 0 THEN 60000 ELSE 80 END AS w
      FROM (SELECT *, replace(replace(props, '{{"k": ', ''), '}}', '') AS k FROM {events}) a) b
GROUP BY k, event_type""",
    ),
    "wl_locks": (
        ("events",),
        """
SELECT user_id AS request_session_id,
  CASE event_id % 4 WHEN 0 THEN 'DATABASE' WHEN 1 THEN 'OBJECT' WHEN 2 THEN 'KEY' ELSE 'PAGE' END AS resource_type,
  CASE event_id % 3 WHEN 0 THEN 'S' WHEN 1 THEN 'X' ELSE 'IX' END AS request_mode,
  CASE WHEN event_id % 7 = 0 THEN 'WAIT' ELSE 'GRANT' END AS request_status,
  concat('r', CAST(event_id % 5 AS STRING)) AS resource_description
FROM {events}""",
    ),
    "wl_waits": (
        ("events",),
        """
SELECT user_id AS session_id, event_type AS wait_type, count(*) AS waiting_tasks_count,
  CAST(sum(CAST(round(value) AS BIGINT)) AS BIGINT) AS wait_time_ms,
  count(*) % 5 AS signal_wait_time_ms
FROM {events} GROUP BY user_id, event_type""",
    ),
    # a run history: one run per user, one compared table per event type
    "run_log": (
        ("events",),
        """
SELECT concat('run-', CAST(user_id AS STRING)) AS run_id, min(ts) AS started_at,
  CASE WHEN user_id % 7 = 3 THEN NULL ELSE max(ts) END AS completed_at,
  CASE WHEN user_id % 7 = 3 THEN 'running' WHEN user_id % 11 = 5 THEN 'failed' ELSE 'completed' END AS status
FROM {events} GROUP BY user_id""",
    ),
    "result_log": (
        ("events", "events_t"),
        """
SELECT concat('run-', CAST(user_id AS STRING)) AS run_id,
  event_type AS source_table, concat(event_type, '_copy') AS target_table,
  CASE WHEN user_id % 11 = 5 AND event_type = 'error' THEN 'failed' ELSE 'completed' END AS status,
  CASE WHEN user_id % 11 = 5 AND event_type = 'error' THEN 'unreachable' END AS error_message,
  CAST(sum(in_source) AS BIGINT) AS source_row_count,
  CAST(sum(in_target) AS BIGINT) AS target_row_count,
  CAST(sum(in_target) - sum(changed) AS BIGINT) AS matching_rows,
  CAST(sum(changed) AS BIGINT) AS different_rows,
  CAST(sum(in_source) - sum(in_target) AS BIGINT) AS source_only_rows,
  CAST(0 AS BIGINT) AS target_only_rows
FROM (
  SELECT user_id, event_type, 1 AS in_source, 0 AS in_target, 0 AS changed FROM {events}
  UNION ALL
  SELECT user_id, event_type, 0, 1, CASE WHEN event_id % 31 = 0 THEN 1 ELSE 0 END FROM {events_t}
) both_sides GROUP BY user_id, event_type""",
    ),
    # sizes per codec for groups of documents, as a measurement would deliver them
    "codec_sizes": (
        ("documents",),
        """
SELECT concat('docs.', source, '_', lang) AS table_name, codec, 'uncompressed' AS current_codec,
  count(*) * 100 AS row_count,
  CAST(sum(n_chars) AS DOUBLE) AS current_size_kb,
  CAST(CASE WHEN codec = 'gzip' AND sum(n_chars) % 9 = 0 THEN NULL
            ELSE sum(n_chars * percent) END AS DOUBLE) / 100 AS size_kb
FROM (SELECT source, lang, n_chars, codec,
        CASE codec WHEN 'snappy' THEN 97 - doc_id % 7 WHEN 'gzip' THEN 100 - n_chars % 90
                   ELSE 99 - doc_id % 60 END AS percent
      FROM (SELECT source, lang, n_chars, doc_id, 'snappy' AS codec FROM {documents}
            UNION ALL SELECT source, lang, n_chars, doc_id, 'gzip' FROM {documents}
            UNION ALL SELECT source, lang, n_chars, doc_id, 'zstd' FROM {documents}) c) p
GROUP BY source, lang, codec""",
    ),
}


def view(spark: SparkSession, folder: str, name: str, given: dict[str, DataFrame] | None = None) -> DataFrame:
    """A derived view, or the parquet table of that name; `given` tables are taken as they are."""
    if name not in VIEWS:
        return given[name] if given else table(spark, folder, name, TABLES.get(name))
    inputs, sql = VIEWS[name]
    return spark.sql(sql, **{i: view(spark, folder, i, given) for i in inputs})


def views_of_files(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """Views and tables with the columns that the files have, whatever TABLES says; one job reads all schemas."""
    needed = sorted({base for name in names for base in _bases(name)})
    given = footers.tables(spark, {n: f"{folder}/{n}.parquet" for n in needed})
    return {name: view(spark, folder, name, given) for name in names}


def _bases(name: str) -> set[str]:
    """The parquet tables that a view is made of."""
    return {base for i in VIEWS[name][0] for base in _bases(i)} if name in VIEWS else {name}


@lru_cache(maxsize=None)
def _closure(name: str) -> tuple[str, ...]:
    """Views that `name` needs, dependencies first."""
    if name not in VIEWS:
        return ()
    needed: list[str] = []
    for i in VIEWS[name][0]:
        needed += [n for n in _closure(i) if n not in needed]
    return (*needed, name)


def ctes(*names: str, more: str = "") -> str:
    """`WITH` clause that defines the named views for a checking query, plus further CTEs."""
    ordered: list[str] = []
    for name in names:
        ordered += [n for n in _closure(name) if n not in ordered]
    parts = [f"{n} AS ({VIEWS[n][1].format(**{i: i for i in VIEWS[n][0]})})" for n in ordered]
    if more.strip():
        parts.append(more.strip())
    return "WITH " + ",\n".join(parts)
