"""Workload operators against plain Python over small logs."""

import datetime

import pytest

from evenkeel.operators import activity as A
from evenkeel.plans import workload as W
from evenkeel.session import fresh_path
from evenkeel.sources.fixtures import AS_OF, view
from tests.conftest import rows

T0 = datetime.datetime(2024, 1, 31, 23, 59, 0)
SESSIONS = "session_id BIGINT, program_name STRING, host_name STRING, login_name STRING, status STRING, cpu_time BIGINT, reads BIGINT, writes BIGINT, memory_usage BIGINT, open_transaction_count BIGINT, login_time TIMESTAMP_NTZ, last_request_start_time TIMESTAMP_NTZ, last_request_end_time TIMESTAMP_NTZ, is_user_process INT"
REQUESTS = "session_id BIGINT, request_id BIGINT, blocking_session_id BIGINT, wait_type STRING, wait_time BIGINT, wait_resource STRING, query_text STRING, status STRING, command STRING"


def session_row(sid, program="p", host="h", status="sleeping", cpu=100, user=1, open_txns=0):
    return (sid, program, host, "l", status, cpu, 1, 2, 3, open_txns, T0, T0, T0, user)


def request_row(sid, rid, blocker=0, wait=10, text="q"):
    return (sid, rid, blocker, "LCK", wait, "KEY:1", text, "running", "SELECT")


@pytest.fixture(scope="module")
def logs(spark):
    sessions = [
        session_row(1, "app", "h1", "running"), session_row(2, "app", "h1"), session_row(3, None, None, "running", cpu=None),
        session_row(4, "app", None, "running"), session_row(5, "sys", "h1", user=0), session_row(6, "app", "h1", "running"),
    ]
    requests = [
        request_row(1, 10, 4, 31000, "x" * 600), request_row(1, 11, 4, 5), request_row(3, 12, 1), request_row(4, 13, 99),
        request_row(6, 14, 1, 40050),
    ]
    return spark.createDataFrame(sessions, SESSIONS), spark.createDataFrame(requests, REQUESTS)


def test_sources_count_session_request_pairs(logs):
    found = {(r.program_name, r.host_name): r for r in A.connection_sources(*logs, AS_OF).collect()}
    assert set(found) == {("app", "h1"), ("app", "Unknown"), ("Unknown", "Unknown")}
    app = found["app", "h1"]
    assert (app.session_count, app.active_requests, app.idle_connections, app.total_cpu_ms) == (3, 3, 1, 400)
    assert (app.blocked_count, app.blocking_count, app.total_memory_kb) == (3, 2, 96)
    assert app.longest_transaction_seconds == 60
    assert found["app", "Unknown"].blocking_count == 1
    assert (found["Unknown", "Unknown"].blocking_count, found["Unknown", "Unknown"].total_cpu_ms) == (0, 0)


def test_blocking_pairs_and_hotspots(logs):
    pairs = A.blocking_pairs(*logs)
    # session 1 blocks with two requests, so each session it blocks gives two rows
    assert rows(pairs, "blocking_session_id", "blocked_session_id", "blocking_program") == [
        (1, 3, "app"), (1, 3, "app"), (1, 6, "app"), (1, 6, "app"), (4, 1, "app"), (4, 1, "app"), (99, 4, "Unknown"),
    ]
    longest = pairs.where("wait_time_ms = 31000").first()
    assert len(longest.blocked_query) == 600 and longest.blocking_host == "Unknown"
    spots = rows(W.blocking_hotspots(pairs), "kind", "magnitude", "hotspot")
    assert ("frequent_blocker", 4, "app (h1): blocking 4 sessions") in spots
    # a tie in the binary value of 40.05 rounds as printf does
    assert ("long_wait", 40050, f"Long wait: app waiting {40050 / 1000:.1f}s for LCK on KEY:1") in spots


def test_session_details(logs):
    found = A.session_details(*logs)
    assert found.count() == 6 and found.where("session_id = 5").count() == 0
    assert found.where("session_id = 2").first().current_query is None


STATS = "query_hash STRING, query_text STRING, program_name STRING, execution_count BIGINT, total_worker_time BIGINT, total_elapsed_time BIGINT, total_logical_reads BIGINT, total_logical_writes BIGINT, total_physical_reads BIGINT, last_execution_time TIMESTAMP_NTZ"


def stat(qhash, program, executions, worker_us, elapsed_us=0, reads=0, text="SELECT 1"):
    return (qhash, text, program, executions, worker_us, elapsed_us, reads, 0, 0, T0)


@pytest.fixture(scope="module")
def stats(spark):
    return spark.createDataFrame(
        [
            stat("a", "p1", 2000, 9_000_000, 1_999_999), stat("a", "p2", 10, 8_000_000), stat("a", "p2", 10, 10),
            stat("b", None, 0, 7_000_000), stat("c", "p1", 1, 6_000_000, 6_000_000), stat("d", "p3", 1, 1, text="SELECT * FROM sysXdm_x"),
            stat("e", "p3", 1, 1, text="from sys.dm_exec"), stat("f", "p3", 1, 1, text="INFORMATION_SCHEMA.t"), stat("g", "p3", 1, 1, text=None),
        ],
        STATS,
    )


def test_patterns(stats):
    found = {(r.query_hash, r.source_program, r.total_worker_time_ms): r for r in A.query_patterns(stats, None).collect()}
    assert {k[0] for k in found} == {"a", "b", "c", "d"}
    assert found["a", "p1", 9000].plan_count == 3 and found["a", "p1", 9000].avg_worker_time_ms == pytest.approx(4.5)
    cached = found["b", "Cached", 7000]
    assert (cached.avg_worker_time_ms, cached.avg_elapsed_time_ms, cached.avg_logical_reads) == (0, 0, 0)
    top = rows(A.query_patterns(stats, 2), "query_hash", "source_program", "plan_count")
    assert top == [("a", "p1", 3), ("a", "p2", 3)]


def test_findings(stats):
    patterns = A.query_patterns(stats, None)
    assert rows(W.redundant_queries(patterns), "query_hash", "systems_involved", "total_executions", "potential_savings_percent", "severity") == [
        ("a", "p1, p2", 2020, 20.0, "medium")
    ]
    assert rows(W.n_plus_one(patterns), "query_hash", "systems_involved", "severity") == [("a", "p1", "high")]
    assert rows(W.expensive_queries(patterns), "query_hash", "cost_score") == [("c", 6.0)]
    assert rows(A.expensive_ranked(stats, 2), "cost_rank", "query_hash") == [(1, "a"), (2, "a")]


def test_issues_at_the_threshold(spark):
    schema = "program_name STRING, host_name STRING, login_name STRING, session_count INT, idle_connections INT, open_transactions INT, longest_transaction_seconds INT, blocking_count INT"
    at = spark.createDataFrame([("p", "h", "l", 50, 20, 5, 300, 5)], schema)
    assert W.connection_issues(at).count() == 0
    above = spark.createDataFrame([("p", "h", "l", 51, 21, 5, 301, 6), ("p", "h", "l", 1, 21, 0, 0, 0)], schema)
    assert rows(W.connection_issues(above), "message") == [
        ("Frequent blocker: p (h) blocking 6 sessions",), ("High connection count (51) from p (h)",),
        ("Idle connections with open transactions from p (h): 5 open txns",), ("Long-running transaction (301s) from p (h)",),
    ]


def test_whole_analysis(spark, logs, stats):
    found = W.analyze(*logs, stats, AS_OF, W.Thresholds(sessions=2))
    summary = {r.metric: r.value for r in W.workload_summary(found).collect()}
    assert summary["total_systems"] == 3 and summary["total_connections"] == 5 and summary["blocking_chains"] == 7
    assert summary["recommendations"] == found.recommendations.count()
    assert ("MEDIUM", "High connection count (3) from app (h1)") in rows(found.recommendations, "priority", "message")
    ranked = found.scorecards.orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == [1, 2, 3]
    assert [r.resource_score for r in ranked] == sorted((r.resource_score for r in ranked), reverse=True)
    assert rows(W.system_report(found, "nobody"), "section", "subject") == [("error", "System 'nobody' not found")]
    assert rows(W.system_report(found, "app").where("section = 'scorecard'"), "section") == [("scorecard",)]
    path = fresh_path(spark, "report")
    W.write_report(found, path)
    lines = [r.value for r in spark.read.text(path).collect()]
    assert {"## Summary", "### High Priority", "- Total Systems: 3"} <= set(lines)


def test_log_sizes_of_the_fixtures(spark, folder):
    assert [view(spark, folder, f"wl_{n}").count() for n in ("sessions", "requests", "query_stats")] == [15, 9, 440]


def test_pool_and_wait_thresholds(spark, logs):
    pools = {(r.program_name, r.host_name): r for r in A.pool_stats(logs[0], AS_OF).collect()}
    assert (pools["app", "h1"].total_connections, pools["app", "h1"].idle_connections, pools["app", "h1"].active_connections) == (3, 1, 2)
    assert pools["app", "h1"].avg_connection_age_seconds == 60
    waits = spark.createDataFrame([(1, "W", 1, 60, 1), (2, "W", 1, 40, 1), (6, "W", 1, 1, 1), (3, "W", 1, 100, 1)], "session_id INT, wait_type STRING, waiting_tasks_count INT, wait_time_ms INT, signal_wait_time_ms INT")
    assert rows(A.wait_stats(waits, logs[0]), "program_name", "total_wait_time_ms") == [("app", 101)]


def test_statistics_without_a_hash_are_kept(spark):
    schema = (
        "query_hash STRING, query_text STRING, program_name STRING, execution_count BIGINT, total_worker_time BIGINT, "
        "total_elapsed_time BIGINT, total_logical_reads BIGINT, total_logical_writes BIGINT, total_physical_reads BIGINT, "
        "last_execution_time TIMESTAMP_NTZ"
    )
    stats = spark.createDataFrame(
        [(None, "a", None, 1, 9_000_000, 0, 0, 0, 0, None), (None, "b", "p", 1, 5, 0, 0, 0, 0, None), ("h", "c", "p", 1, 7, 0, 0, 0, 0, None)], schema
    )
    from evenkeel.operators.activity import query_patterns

    for top_n, expected in ((None, [("a", 2), ("b", 2), ("c", 1)]), (1, [("a", 2)])):
        assert sorted((r.query_text, r.plan_count) for r in query_patterns(stats, top_n).collect()) == expected


def test_totals_are_not_cut(spark):
    from evenkeel.functions.scores import is_expensive
    from evenkeel.plans.workload import expensive_queries

    patterns = spark.range(150).selectExpr(
        "concat('h', id) AS query_hash", "'p' AS source_program", "2000.0D AS avg_worker_time_ms", "0.0D AS avg_logical_reads",
        "0.0D AS avg_elapsed_time_ms", "id AS total_worker_time_ms", "id AS total_logical_reads", "id AS total_physical_reads",
    )
    assert patterns.where(is_expensive()).count() == 150
    assert expensive_queries(patterns).count() == 150 and expensive_queries(patterns, 20).count() == 20
