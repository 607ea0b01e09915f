"""Change sets, run history and storage advice."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from evenkeel.catalog import query
from evenkeel.functions.columns import union_all
from evenkeel.operators.change_set import apply_change_set, change_counts, change_set
from evenkeel.operators.row_diff import cell_diff
from evenkeel.operators.storage import CODEC_REASONS, measure_codecs, measure_files, publish, storage_advice, storage_rewrite_plan
from evenkeel.plans.compare import run_verdict
from evenkeel.session import fresh_path, staged
from evenkeel.sources import history as H
from evenkeel.sources.fixtures import AS_OF, ctes, view
from evenkeel.sources.sinks import recommendation_table

KEY = ["o_orderkey"]

CHANGES = """changes AS (
  SELECT CASE WHEN t.o_orderkey IS NULL THEN 'INSERT' ELSE 'UPDATE' END AS op, s.*
  FROM orders s LEFT JOIN orders_t t ON s.o_orderkey = t.o_orderkey
  WHERE t.o_orderkey IS NULL OR s.o_custkey IS DISTINCT FROM t.o_custkey OR s.o_orderstatus IS DISTINCT FROM t.o_orderstatus
    OR s.o_totalprice IS DISTINCT FROM t.o_totalprice OR s.o_orderdate IS DISTINCT FROM t.o_orderdate
    OR s.o_orderpriority IS DISTINCT FROM t.o_orderpriority
  UNION ALL SELECT 'DELETE', o_orderkey, NULL, NULL, NULL, NULL, NULL FROM orders_t ANTI JOIN orders USING (o_orderkey))"""


def _changes(spark, folder):
    return change_set(view(spark, folder, "orders"), view(spark, folder, "orders_t"), KEY)


@query("change_set", ctes("orders_t", more=CHANGES) + " SELECT * FROM changes")
def _(spark, folder):
    return _changes(spark, folder)


@query(
    "change_counts",
    ctes("orders_t", more=CHANGES)
    + """ SELECT count(*) FILTER (op = 'INSERT') AS inserts, count(*) FILTER (op = 'UPDATE') AS updates,
  count(*) FILTER (op = 'DELETE') AS deletes FROM changes""",
)
def _(spark, folder):
    return change_counts(_changes(spark, folder))


@query("apply_change_set", "SELECT * FROM orders")
def _(spark, folder):
    return apply_change_set(view(spark, folder, "orders_t"), _changes(spark, folder), KEY)


TOTALS = """totals AS (SELECT run_id, count(*) AS total_tables,
  count(*) FILTER (matching_rows > 0 AND different_rows = 0 AND source_only_rows = 0 AND target_only_rows = 0) AS matching_tables,
  count(*) FILTER (different_rows > 0 OR source_only_rows > 0 OR target_only_rows > 0) AS different_tables,
  count(*) FILTER (status = 'failed') AS failed_tables FROM result_log GROUP BY run_id)"""

RUNS = f"""{TOTALS},
runs AS (SELECT r.run_id, r.started_at, r.completed_at, 'src' AS source_database, 'tgt' AS target_database,
  CASE WHEN r.completed_at IS NULL THEN 0 ELSE t.total_tables END AS total_tables,
  CASE WHEN r.completed_at IS NULL THEN 0 ELSE t.matching_tables END AS matching_tables,
  CASE WHEN r.completed_at IS NULL THEN 0 ELSE t.different_tables END AS different_tables,
  CASE WHEN r.completed_at IS NULL THEN 0 ELSE t.failed_tables END AS failed_tables, r.status
  FROM run_log r JOIN totals t ON r.run_id = t.run_id)
"""

HISTORY = ctes("run_log", "result_log", more=RUNS)


def _run_events(spark, folder):
    """The run log as the events a history stores."""
    log = view(spark, folder, "run_log")
    totals = H.result_totals(view(spark, folder, "result_log"), ["run_id"])
    opened = log.select(
        "run_id",
        F.lit("opened").alias("event"),
        F.col("started_at").alias("at"),
        F.lit("src").alias("source_database"),
        F.lit("tgt").alias("target_database"),
    )
    completed = (
        log.where("completed_at IS NOT NULL")
        .join(totals, "run_id")
        .select("run_id", F.lit("completed").alias("event"), F.col("completed_at").alias("at"), "status", *[c for c in totals.columns if c != "run_id"])
    )
    return opened.unionByName(completed, allowMissingColumns=True)


def _runs(spark, folder):
    return H.runs_from_events(_run_events(spark, folder))


@query("history_runs", HISTORY + "SELECT * FROM runs")
def _(spark, folder):
    history = H.History(spark, fresh_path(spark, "history"))
    history.log(_run_events(spark, folder))
    return history.runs()


EVENT_CELLS = """cells AS (
  SELECT concat('run-', s.user_id) AS run_id, s.event_type AS source_table, concat('event_id=', s.event_id) AS key_display,
    'value' AS column_name, CAST(s.value AS VARCHAR) AS source_value, CAST(t.value AS VARCHAR) AS target_value
  FROM events s JOIN events_t t ON s.event_id = t.event_id WHERE s.value IS DISTINCT FROM t.value)"""


def _stored(spark, folder):
    """A history with the run log and its results."""
    history = H.History(spark, fresh_path(spark, "history"))
    with ThreadPoolExecutor(2) as pool:  # every append has a folder of its own
        log = pool.submit(history.log, _run_events(spark, folder))
        history.save_results(view(spark, folder, "result_log"))
        log.result()
    return history


@query("history_results", ctes("result_log") + " SELECT * FROM result_log")
def _(spark, folder):
    return _stored(spark, folder).results().select(*view(spark, folder, "result_log").columns)


@query("history_differences", ctes("run_log", "events_t", more=EVENT_CELLS) + " SELECT * FROM cells WHERE run_id IN (SELECT run_id FROM run_log)")
def _(spark, folder):
    events, target = view(spark, folder, "events"), view(spark, folder, "events_t")
    owner = [F.concat(F.lit("run-"), "user_id").alias("run_id"), F.col("event_type").alias("source_table")]
    # the owners are part of the key, so they come with the differences
    owned = [df.select("event_id", "value", *owner) for df in (events, target)]
    cells = cell_diff(*owned, ["run_id", "source_table", "event_id"], ["value"])
    history = _stored(spark, folder)
    history.save_differences(cells.withColumn("key_display", F.concat(F.lit("event_id="), "event_id")))
    return history.differences().drop("difference_type")


@query(
    "history_statistics",
    HISTORY
    + """SELECT unnest(['total_runs', 'total_tables_compared', 'matching_tables', 'different_tables', 'failed_tables']) AS metric,
  unnest([(SELECT count(*) FROM runs), sum(total_tables)::BIGINT, sum(matching_tables)::BIGINT, sum(different_tables)::BIGINT,
    sum(failed_tables)::BIGINT]) AS value FROM totals""",
)
def _(spark, folder):
    return H.statistics(_runs(spark, folder), view(spark, folder, "result_log"))


@query("history_recent", HISTORY + "SELECT * FROM runs ORDER BY started_at DESC, run_id LIMIT 5")
def _(spark, folder):
    return H.page(_runs(spark, folder), 5)


@query("history_page", HISTORY + "SELECT * FROM runs WHERE status = 'completed' ORDER BY started_at DESC, run_id LIMIT 20 OFFSET 10")
def _(spark, folder):
    return H.page(_runs(spark, folder), 20, 10, "completed")


@query("history_seek", HISTORY + "SELECT * FROM runs WHERE status = 'completed' ORDER BY started_at DESC, run_id LIMIT 20 OFFSET 20")
def _(spark, folder):
    """The second page, by the cursor behind the first."""
    runs = staged(_runs(spark, folder), "runs")
    return H.page_after(runs, 20, H.cursor(H.page_after(runs, 20, status="completed")), "completed")


@query("history_delete", HISTORY + "SELECT * FROM result_log WHERE run_id <> 'run-8'")
def _(spark, folder):
    history = H.History(spark, fresh_path(spark, "history"))
    history.log(_run_events(spark, folder))
    log = view(spark, folder, "result_log")
    history.save_results(log)
    history.delete_run("run-8", AS_OF)
    return history.results().select(*log.columns)


KEPT = f"started_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY"


@query(
    "history_cleanup",
    HISTORY
    + f"""SELECT 'runs' AS kind, run_id, count(*) AS kept FROM runs WHERE {KEPT} GROUP BY run_id
UNION ALL SELECT 'results', run_id, count(*) FROM result_log WHERE run_id IN (SELECT run_id FROM runs WHERE {KEPT}) GROUP BY run_id""",
)
def _(spark, folder):
    history = H.History(spark, fresh_path(spark, "history"))
    history.log(_run_events(spark, folder))
    history.save_results(view(spark, folder, "result_log"))
    history.cleanup(AS_OF, 30)
    runs, results = history.runs(), history.results()
    return union_all(
        [
            df.groupBy("run_id").agg(F.count("*").alias("kept")).select(F.lit(kind).alias("kind"), "run_id", "kept")
            for kind, df in (("runs", runs), ("results", results))
        ]
    )


@query(
    "run_verdict",
    HISTORY
    + """SELECT run_id, total_tables, matching_tables, different_tables, failed_tables,
  CASE WHEN failed_tables > 0 THEN 'Failed' WHEN different_tables > 0 THEN 'Differences Found' ELSE 'All Match' END AS verdict,
  CASE WHEN failed_tables > 0 THEN concat('Comparison Failed - ', failed_tables, ' errors')
    WHEN different_tables > 0 THEN concat('Differences Found - ', different_tables, '/', total_tables, ' tables')
    ELSE concat('All ', total_tables, ' Tables Match') END AS subject FROM totals""",
)
def _(spark, folder):
    return run_verdict(H.result_totals(view(spark, folder, "result_log"), ["run_id"]))


_REASON_SQL = " ".join(f"WHEN '{c}' THEN '{r}'" for c, r in CODEC_REASONS.items())
ADVICE = f"""options AS (
  SELECT *, (current_size_kb - size_kb) / nullif(current_size_kb, 0) * 100 AS savings,
    CASE codec WHEN 'snappy' THEN 1 WHEN 'gzip' THEN 2 ELSE 3 END AS place FROM codec_sizes WHERE row_count >= 1000),
best AS (SELECT * FROM options WHERE savings > 0 QUALIFY row_number() OVER (PARTITION BY table_name ORDER BY savings DESC, place) = 1),
advice AS (
  SELECT table_name, current_codec, codec AS recommended_codec, current_size_kb / 1024 AS current_size_mb,
    size_kb / 1024 AS estimated_size_mb, (current_size_kb - size_kb) / 1024 AS estimated_savings_mb,
    savings AS estimated_savings_percent,
    concat('Switching from ', current_codec, ' to ', codec, ' compression could save ~', printf('%.1f', savings), '% space. ',
      CASE codec {_REASON_SQL} END) AS reason,
    CASE WHEN savings > 50 OR (current_size_kb - size_kb) / 1024 > 1000 THEN 'high'
      WHEN savings > 25 OR (current_size_kb - size_kb) / 1024 > 100 THEN 'medium' ELSE 'low' END AS priority,
    savings > 10 AS should_apply
  FROM best WHERE savings >= 5)"""


def _advice(spark, folder):
    return storage_advice(view(spark, folder, "codec_sizes"))


@query("storage_advice", ctes("codec_sizes", more=ADVICE) + " SELECT * FROM advice")
def _(spark, folder):
    return _advice(spark, folder)


@query(
    "storage_rewrite_plan",
    ctes("codec_sizes", more=ADVICE)
    + """ SELECT table_name, recommended_codec, priority, concat('-- ', reason, chr(10), 'CREATE TABLE `', replace(table_name, '.', '`.`'), '_', recommended_codec,
  '` USING parquet OPTIONS (compression ''', recommended_codec, ''') AS SELECT * FROM `', replace(table_name, '.', '`.`'), '`') AS statement
FROM advice WHERE should_apply AND priority IN ('medium', 'high')""",
)
def _(spark, folder):
    return storage_rewrite_plan(_advice(spark, folder))


@query(
    "storage_export",
    ctes("codec_sizes", more=ADVICE)
    + """ SELECT table_name AS "Table", current_codec AS "Current Compression", recommended_codec AS "Recommended",
  printf('%.2f', current_size_mb) AS "Current Size (MB)", printf('%.2f', estimated_size_mb) AS "Estimated Size (MB)",
  printf('%.2f', estimated_savings_mb) AS "Savings (MB)", concat(printf('%.1f', estimated_savings_percent), '%') AS "Savings %",
  priority AS "Priority", reason AS "Reason" FROM advice""",
)
def _(spark, folder):
    return recommendation_table(_advice(spark, folder))


MEASURED = ("lineitem", "orders", "documents")


@query("storage_measurement")
def _(spark, folder):
    """Sizes are not in any table, so no SQL checks them; a test compares them with the files written."""
    return union_all([measure_codecs(view(spark, folder, name), name) for name in MEASURED])


@query("storage_measurement_files")
def _(spark, folder):
    return union_all([measure_files(spark, f"{folder}/{name}.parquet", name)[0] for name in MEASURED])


@query("storage_columns")
def _(spark, folder):
    """Sizes per column of three tables in three codecs."""
    return union_all([measure_files(spark, f"{folder}/{name}.parquet", name)[1] for name in MEASURED])


@query("publish_codec", "SELECT * FROM orders")
def _(spark, folder):
    """A table of the catalog after its files were rewritten, checked and switched."""
    name = f"published_{uuid.uuid4().hex}"
    view(spark, folder, "orders").write.option("path", fresh_path(spark, "orders")).saveAsTable(name)
    publish(spark, name, "zstd")
    return spark.table(name)


@query(
    "apply_change_set_own_columns",
    "SELECT o.*, CASE WHEN o.o_orderkey % 17 <> 0 THEN concat('kept ', o.o_orderkey) END AS own FROM orders o",
)
def _(spark, folder):
    """Columns that only the target has survive an update."""
    target = view(spark, folder, "orders_t").withColumn("own", F.concat(F.lit("kept "), "o_orderkey"))
    return apply_change_set(target, change_set(view(spark, folder, "orders"), view(spark, folder, "orders_t"), KEY), KEY)
