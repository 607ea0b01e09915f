"""Versioned tables and the versioned run history."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.catalog import query
from evenkeel.catalog.diffs import ORDER_KEY
from evenkeel.catalog.digests import BUCKET
from evenkeel.catalog.state import EVENT_CELLS, HISTORY, _run_events
from evenkeel.operators.change_set import apply_to_files, change_set
from evenkeel.operators.date_state import DateState, compare_dates
from evenkeel.operators.digest_tree import differing_buckets, digest_tree
from evenkeel.operators.row_diff import cell_diff
from evenkeel.session import fresh_path
from evenkeel.sources.fixtures import AS_OF, TABLES, ctes, view
from evenkeel.sources.versioned_history import VersionedHistory
from evenkeel.sources.versions import Versions


def _orders(spark, rows, files=8):
    table = Versions(spark, fresh_path(spark, "orders"), TABLES["orders"])
    table.append(rows.repartitionByRange(files, "o_orderkey"))
    return table


@query("apply_to_files", "SELECT * FROM orders")
def _(spark, folder):
    """The change set brings a versioned copy of the target in line with the source."""
    source, target = view(spark, folder, "orders"), view(spark, folder, "orders_t")
    table = _orders(spark, target)
    apply_to_files(table, change_set(source, target, ORDER_KEY), ORDER_KEY)
    return table.read()


LATE = "o_orderkey BETWEEN 1000 AND 1100"


@query(
    "apply_to_files_late",
    f"""SELECT o_orderkey, CASE WHEN {LATE} THEN 'L' ELSE o_orderstatus END AS o_orderstatus, NOT ({LATE}) AS before
FROM orders WHERE o_orderkey % 13 <> 0 OR NOT ({LATE})""",
)
def _(spark, folder):
    """Late changes to a few neighbouring orders, and which rows the version before them has as they are."""
    orders = view(spark, folder, "orders")
    table = _orders(spark, orders)
    changed = orders.where(LATE).where("o_orderkey % 13 <> 0").withColumn("o_orderstatus", F.lit("L"))
    apply_to_files(table, change_set(orders.where(f"NOT ({LATE})").union(changed), orders, ORDER_KEY), ORDER_KEY)
    old = table.read(1).select("o_orderkey", F.col("o_orderstatus").alias("old"))
    now = table.read(2).join(old, "o_orderkey").select("o_orderkey", "o_orderstatus", "old")
    return now.select("o_orderkey", "o_orderstatus", (F.col("o_orderstatus") == F.col("old")).alias("before"))


@query("table_versions", "SELECT 1 AS version, count(*) AS n FROM orders_t UNION ALL SELECT 2, count(*) FROM orders".replace("orders_t", f"({ctes('orders_t')} SELECT * FROM orders_t)"))
def _(spark, folder):
    """Row counts of both versions."""
    source, target = view(spark, folder, "orders"), view(spark, folder, "orders_t")
    table = _orders(spark, target)
    apply_to_files(table, change_set(source, target, ORDER_KEY), ORDER_KEY)
    counts = [table.read(v).agg(F.count("*").alias("n")).select(F.lit(v).alias("version"), "n") for v in table.numbers()]
    return counts[0].union(counts[1])


def _history(spark, folder):
    """Version 1 has the events, 2 the results, 3 the differences; in 4 runs 8 and 9 are deleted, 5 is compact."""
    events, target = view(spark, folder, "events"), view(spark, folder, "events_t")
    owner = [F.concat(F.lit("run-"), "user_id").alias("run_id"), F.col("event_type").alias("source_table")]
    owned = [df.select("event_id", "value", *owner) for df in (events, target)]
    cells = cell_diff(*owned, ["run_id", "source_table", "event_id"], ["value"])
    history = VersionedHistory(spark, fresh_path(spark, "history"))
    history.log(_run_events(spark, folder))
    history.save_results(view(spark, folder, "result_log"))
    history.save_differences(cells.withColumn("key_display", F.concat(F.lit("event_id="), "event_id")))
    gone = view(spark, folder, "run_log").where("run_id IN ('run-8', 'run-9')").select("run_id")
    history.log(gone.select("run_id", F.lit("deleted").alias("event"), F.lit(AS_OF).cast("timestamp_ntz").alias("at")))
    return history.compact()


@query("versioned_history_runs", HISTORY + "SELECT * FROM runs WHERE run_id NOT IN ('run-8', 'run-9')")
def _(spark, folder):
    return _history(spark, folder).runs()


@query("versioned_history_results", ctes("result_log") + " SELECT * FROM result_log WHERE run_id NOT IN ('run-8', 'run-9')")
def _(spark, folder):
    return _history(spark, folder).results().select(*view(spark, folder, "result_log").columns)


@query(
    "versioned_history_as_of",
    ctes("run_log", "events_t", "result_log", more=EVENT_CELLS)
    + """ SELECT 2 AS version, (SELECT count(*) FROM run_log) AS runs, (SELECT count(*) FROM result_log) AS results, 0 AS differences
UNION ALL SELECT 3, (SELECT count(*) FROM run_log), (SELECT count(*) FROM result_log), (SELECT count(*) FROM cells WHERE run_id IN (SELECT run_id FROM run_log))
UNION ALL SELECT 5, (SELECT count(*) FROM run_log WHERE run_id NOT IN ('run-8', 'run-9')),
  (SELECT count(*) FROM result_log WHERE run_id NOT IN ('run-8', 'run-9')), (SELECT count(*) FROM cells WHERE run_id NOT IN ('run-8', 'run-9'))""",
)
def _(spark, folder):
    """What three versions of one history hold."""
    history = _history(spark, folder)
    counts = None
    for version in (2, 3, 5):
        then = history.as_of(version)
        parts = [("runs", then.runs()), ("results", then.results()), ("differences", then.differences())]
        for name, df in parts:
            one = df.agg(F.count("*").alias("n")).select(F.lit(version).alias("version"), F.lit(name).alias("name"), "n")
            counts = one if counts is None else counts.union(one)
    return counts.groupBy("version").agg(
        *[F.sum(F.when(F.col("name") == n, F.col("n"))).alias(n) for n in ("runs", "results", "differences")]
    )


@query(
    "history_digests",
    ctes("orders_t")
    + f"""SELECT {BUCKET.format(key='o_orderkey', level=2)} AS bucket, count(*) AS source_row_count, count(t) AS target_row_count
FROM (SELECT s.o_orderkey, t.o_orderkey AS t FROM orders s LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 97 <> 5) t USING (o_orderkey))
GROUP BY bucket HAVING count(*) > count(t)""",
)
def _(spark, folder):
    """Buckets that changed between the digests of two runs."""
    history = VersionedHistory(spark, fresh_path(spark, "history"))
    orders = view(spark, folder, "orders")
    for run, rows in (("r1", orders.where("o_orderkey % 97 <> 5")), ("r2", orders)):
        history.open_run(run, AS_OF)
        history.save_digests(run, "orders", "source", digest_tree(rows, ORDER_KEY, 2, by="md5"))
    return differing_buckets(history.digests("r2", "orders", "source"), history.digests("r1", "orders", "source"), 2)


def _by_day(spark, folder, name, path):
    """A view of the events, written in one folder per day."""
    rows = view(spark, folder, name).withColumn("day", F.col("ts").cast("date"))
    rows.repartition("day").write.partitionBy("day").parquet(path)
    return path


DAYS = """days AS (
  SELECT CAST(ts AS DATE) AS d, event_id, value, NULL::DOUBLE AS other, 1 AS s, 0 AS t FROM events
  UNION ALL SELECT CAST(ts AS DATE), event_id, NULL, value, 0, 1 FROM events_t),
cut AS (SELECT least(max(d) FILTER (s = 1), max(d) FILTER (t = 1)) AS cutoff FROM days)"""


def _day_state(spark, folder):
    state = DateState(spark, fresh_path(spark, "date-state"), TABLES["events"], "day", ["event_id"])
    paths = [_by_day(spark, folder, name, fresh_path(spark, name)) for name in ("events", "events_t")]
    return state, paths


@query(
    "date_state",
    ctes("events_t", more=DAYS)
    + """ SELECT CAST(d AS VARCHAR) AS date, sum(s)::BIGINT AS source_row_count, sum(t)::BIGINT AS target_row_count, NOT bool_and(same) AS differs
FROM (SELECT d, event_id, sum(s) AS s, sum(t) AS t, sum(s) = 1 AND sum(t) = 1 AND max(value) IS NOT DISTINCT FROM max(other) AS same
  FROM days WHERE d <= (SELECT cutoff FROM cut) GROUP BY d, event_id) GROUP BY d""",
)
def _(spark, folder):
    """Digests of two loads of different age, by day."""
    state, (source, target) = _day_state(spark, folder)
    state.refresh("source", source)
    state.refresh("target", target)
    return state.dates()


@query(
    "date_state_late_rows",
    ctes("events_t", more=DAYS)
    + """ SELECT CAST(d AS VARCHAR) AS day, event_id, CASE WHEN count(*) = 2 THEN 'data_different' ELSE 'data_only_target' END AS difference_type FROM (
  SELECT d, event_id, value, other FROM days WHERE d <= (SELECT cutoff FROM cut)
  UNION ALL SELECT (SELECT min(d) FROM days), -1, NULL, 1.0) GROUP BY d, event_id HAVING count(*) = 1 OR max(value) IS DISTINCT FROM max(other)""",
)
def _(spark, folder):
    """A later run, after one row has come late on the target: only its day is read again."""
    state, (source, target) = _day_state(spark, folder)
    compare_dates(state, source, target)
    first = state.dates().agg(F.min("date").alias("day"))
    late = first.select(
        F.lit(-1).cast("bigint").alias("event_id"), F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(0).cast("bigint").alias("user_id"),
        F.lit("late").alias("event_type"), F.lit(1.0).alias("value"), F.lit("").alias("props"), "day",
    )
    late.write.mode("append").partitionBy("day").parquet(target)
    return compare_dates(state, source, target)
