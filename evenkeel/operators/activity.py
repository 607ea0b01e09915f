"""Operators over the logs of sessions, requests, query statistics, locks and waits.

A hot session or query may hold a large share of a log, so the log is aggregated per join
key before every join; the joined sides are then unique per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.functions.scores import per_execution
from evenkeel.session import staged

PROGRAM_HOST = ["program_name", "host_name"]


def _known(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("Unknown"))


def _seconds_until(as_of: str, column: str) -> Column:
    """Whole-second boundaries between a timestamp and `as_of`."""
    until = F.unix_seconds(F.lit(as_of).cast("timestamp"))
    return until - F.unix_seconds(F.col(column).cast("timestamp"))


def _user_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.where(F.col("is_user_process") == 1)


def blocking_counts(sessions: DataFrame, requests: DataFrame) -> DataFrame:
    """Sessions blocked per blocking (program, host). A missing host counts as '' and a
    missing program blocks nobody."""
    blocked = requests.where("blocking_session_id > 0").select("blocking_session_id", "session_id").distinct()
    blockers = sessions.where("program_name IS NOT NULL").select(
        F.col("session_id").alias("blocking_session_id"),
        "program_name",
        F.coalesce("host_name", F.lit("")).alias("host_name"),
    )
    return (
        blocked.join(blockers, "blocking_session_id")
        .groupBy(*PROGRAM_HOST)
        .agg(F.count_distinct("session_id").alias("blocking_count"))
    )


def connection_sources(sessions: DataFrame, requests: DataFrame, as_of: str) -> DataFrame:
    """Resource use per (program, host, login).

    Sums run over session-request pairs: a session counts once per request, and once when it
    has none.
    """
    per_session = requests.groupBy("session_id").agg(
        F.count("request_id").alias("_requests"),
        F.count("*").alias("_pairs"),
        F.count_if(F.col("blocking_session_id") > 0).alias("_blocked"),
    )
    joined = _user_sessions(sessions).join(per_session, "session_id", "left")
    pairs = F.coalesce("_pairs", F.lit(1))
    requests_of = F.coalesce("_requests", F.lit(0))

    def total(column: Column) -> Column:
        return F.sum(column * pairs).cast("long")

    def measure(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    idle = F.when(F.col("status") == "sleeping", pairs - requests_of).otherwise(0)
    grouped = joined.groupBy("program_name", "host_name", "login_name").agg(
        F.count_distinct("session_id").alias("session_count"),
        F.sum(requests_of).alias("active_requests"),
        F.sum(idle).alias("idle_connections"),
        total(measure("cpu_time")).alias("total_cpu_ms"),
        total(measure("reads")).alias("total_reads"),
        total(measure("writes")).alias("total_writes"),
        total(measure("memory_usage") * 8).alias("total_memory_kb"),
        total((F.coalesce("open_transaction_count", F.lit(0)) > 0).cast("int")).alias("open_transactions"),
        F.max(F.coalesce(_seconds_until(as_of, "last_request_start_time"), F.lit(0))).alias("longest_transaction_seconds"),
        F.coalesce(F.sum("_blocked"), F.lit(0)).alias("blocked_count"),
    )
    blocking = blocking_counts(sessions, requests).select(
        F.col("program_name").alias("_program"), F.col("host_name").alias("_host"), "blocking_count"
    )
    same_source = (F.col("program_name") == F.col("_program")) & (
        F.coalesce("host_name", F.lit("")) == F.col("_host")
    )
    return grouped.join(blocking, same_source, "left").select(
        _known("program_name").alias("program_name"),
        _known("host_name").alias("host_name"),
        _known("login_name").alias("login_name"),
        *[c for c in grouped.columns if c not in ("program_name", "host_name", "login_name")],
        F.coalesce("blocking_count", F.lit(0)).alias("blocking_count"),
    )


def blocking_pairs(sessions: DataFrame, requests: DataFrame) -> DataFrame:
    """One row per blocked request with what is known about both sides.

    Blocker sessions and their requests are joined first, by a key that is unique; the one
    join in which a blocker may be hot comes last, where adaptive execution can split it.
    """
    names = sessions.select("session_id", *PROGRAM_HOST)
    blocker_requests = requests.select(
        "session_id", F.col("query_text").alias("blocking_query")
    )
    blockers = names.join(blocker_requests, "session_id", "full_outer").select(
        F.col("session_id").alias("blocking_session_id"),
        _known("program_name").alias("blocking_program"),
        _known("host_name").alias("blocking_host"),
        "blocking_query",
    )
    blocked = (
        requests.where("blocking_session_id > 0")
        .join(names, "session_id")
        .select(
            "blocking_session_id",
            F.col("session_id").alias("blocked_session_id"),
            _known("program_name").alias("blocked_program"),
            _known("host_name").alias("blocked_host"),
            "wait_type",
            F.col("wait_time").alias("wait_time_ms"),
            "wait_resource",
            F.col("query_text").alias("blocked_query"),
        )
    )
    return blocked.join(blockers, "blocking_session_id", "left").select(
        "blocking_session_id",
        "blocked_session_id",
        _known("blocking_program").alias("blocking_program"),
        _known("blocking_host").alias("blocking_host"),
        "blocked_program",
        "blocked_host",
        "wait_type",
        "wait_time_ms",
        (F.col("wait_time_ms") / 1000.0).alias("wait_time_seconds"),
        "wait_resource",
        "blocking_query",
        "blocked_query",
    )


def session_details(sessions: DataFrame, requests: DataFrame) -> DataFrame:
    """User sessions with their current request, if any."""
    r = requests.select(
        "session_id",
        F.col("status").alias("request_status"),
        "command",
        "wait_type",
        "wait_time",
        "blocking_session_id",
        *[c for c in ("logical_reads",) if c in requests.columns],
        F.col("query_text").alias("current_query"),
    )
    s = _user_sessions(sessions).select(
        "session_id",
        "program_name",
        "host_name",
        "login_name",
        "status",
        "cpu_time",
        (F.col("memory_usage") * 8).alias("memory_kb"),
        "reads",
        "writes",
        "open_transaction_count",
        "last_request_start_time",
        "last_request_end_time",
    )
    return s.join(r, "session_id", "left")


def query_patterns(stats: DataFrame, top_n: int | None = None) -> DataFrame:
    """Query statistics with averages per execution and the number of plans per query.

    Server queries about the server itself are left out; statistics without a query hash count
    as one query. `top_n` is for a display: the most expensive are then chosen and written out
    first, which runs when called, and plans are counted for their queries alone; the count
    still covers all statistics.
    """
    shown = stats.where(
        F.col("query_text").isNotNull()
        & ~F.col("query_text").like("%sys.dm_%")
        & ~F.col("query_text").like("%INFORMATION_SCHEMA%")
    )
    executions = F.col("execution_count")
    wanted = shown
    hashes = shown.select("query_hash")
    if top_n is not None:
        order = [F.col("total_worker_time").desc(), F.col("query_hash"), F.col("program_name")]
        wanted = staged(shown.orderBy(*order).limit(top_n), "top-queries")
        chosen = wanted.select(F.col("query_hash").alias("_chosen")).distinct()
        hashes = hashes.join(chosen, F.col("query_hash").eqNullSafe(F.col("_chosen")), "left_semi")
    plans = hashes.groupBy(F.col("query_hash").alias("_hash")).agg(F.count("*").alias("plan_count"))
    return wanted.join(plans, F.col("query_hash").eqNullSafe(F.col("_hash"))).select(
        "query_hash",
        "query_text",
        F.coalesce("program_name", F.lit("Cached")).alias("source_program"),
        F.lit("").alias("source_host"),
        "execution_count",
        F.expr("total_worker_time div 1000").alias("total_worker_time_ms"),
        F.expr("total_elapsed_time div 1000").alias("total_elapsed_time_ms"),
        "total_logical_reads",
        "total_logical_writes",
        "total_physical_reads",
        per_execution(F.col("total_worker_time") / 1000.0, executions).alias("avg_worker_time_ms"),
        per_execution(F.col("total_elapsed_time") / 1000.0, executions).alias("avg_elapsed_time_ms"),
        per_execution(F.col("total_logical_reads").cast("double"), executions).alias("avg_logical_reads"),
        "last_execution_time",
        "plan_count",
    )


def expensive_ranked(stats: DataFrame, top_n: int = 20) -> DataFrame:
    """The costliest statistics with their rank. The window sees only the limited rows."""
    order = [F.col("total_worker_time").desc(), F.col("query_hash"), F.col("program_name")]
    top = stats.where("query_text IS NOT NULL").orderBy(*order).limit(top_n)
    return top.select(
        F.coalesce("program_name", F.lit("Cached")).alias("program_name"),
        "query_hash",
        "query_text",
        "execution_count",
        F.expr("total_worker_time div 1000").alias("total_cpu_ms"),
        "total_logical_reads",
        F.expr("total_elapsed_time div 1000").alias("total_elapsed_ms"),
        F.row_number().over(Window.orderBy(*order)).cast("long").alias("cost_rank"),
    )


def lock_counts(locks: DataFrame, sessions: DataFrame) -> DataFrame:
    """Locks per session, resource and mode, without database locks."""
    by = ["resource_type", "request_mode", "request_status", "resource_description"]
    counted = (
        locks.where(F.col("resource_type") != "DATABASE")
        .groupBy(F.col("request_session_id").alias("session_id"), *by)
        .agg(F.count("*").alias("lock_count"))
    )
    names = _user_sessions(sessions).select("session_id", *PROGRAM_HOST)
    return counted.join(names, "session_id").select(
        "session_id", _known("program_name").alias("program_name"), _known("host_name").alias("host_name"), *by, "lock_count"
    )


def wait_stats(waits: DataFrame, sessions: DataFrame, min_wait_ms: int = 100) -> DataFrame:
    """Wait totals per program, host and wait type above a threshold."""
    sums = ["waiting_tasks_count", "wait_time_ms", "signal_wait_time_ms"]
    per_session = waits.groupBy("session_id", "wait_type").agg(*[F.sum(c).alias(c) for c in sums])
    names = _user_sessions(sessions).select("session_id", *PROGRAM_HOST)
    return (
        per_session.join(names, "session_id")
        .groupBy(*PROGRAM_HOST, "wait_type")
        .agg(
            F.sum("waiting_tasks_count").alias("waiting_tasks_count"),
            F.sum("wait_time_ms").alias("total_wait_time_ms"),
            F.sum("signal_wait_time_ms").alias("total_signal_wait_time_ms"),
        )
        .where(F.col("total_wait_time_ms") > min_wait_ms)
        .select(
            _known("program_name").alias("program_name"),
            _known("host_name").alias("host_name"),
            "wait_type",
            "waiting_tasks_count",
            "total_wait_time_ms",
            "total_signal_wait_time_ms",
        )
    )


def pool_stats(sessions: DataFrame, as_of: str) -> DataFrame:
    """Connections per program and host by state, their age and idle time."""

    def with_status(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    age = _seconds_until(as_of, "login_time")
    return (
        _user_sessions(sessions)
        .groupBy(*PROGRAM_HOST)
        .agg(
            F.count("*").alias("total_connections"),
            with_status("sleeping").alias("idle_connections"),
            with_status("running").alias("active_connections"),
            with_status("suspended").alias("waiting_connections"),
            F.avg(age).cast("long").alias("avg_connection_age_seconds"),
            F.max(_seconds_until(as_of, "last_request_end_time")).alias("max_idle_time_seconds"),
        )
        .select(
            _known("program_name").alias("program_name"),
            _known("host_name").alias("host_name"),
            "total_connections",
            "idle_connections",
            "active_connections",
            "waiting_connections",
            "avg_connection_age_seconds",
            "max_idle_time_seconds",
        )
    )
