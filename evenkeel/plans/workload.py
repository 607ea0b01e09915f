"""Workload analysis: issues, hotspots, redundancies, scorecards and recommendations."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.columns import union_all
from evenkeel.functions.ranking import top_per_group, with_rank
from evenkeel.functions.scores import is_expensive, query_cost, system_score
from evenkeel.functions.text import fixed, shortened, source_name
from evenkeel.operators import activity
from evenkeel.session import staged_together

# fixed values: advice and message texts
CONSOLIDATE = "Consider consolidating this query to a single service or caching layer"
BATCH = "Potential N+1 pattern - consider batching or caching"
ISSUE_TEXTS = {
    "connection_count": "High connection count (%s) from %s",
    "idle_transactions": "Idle connections with open transactions from %s: %s open txns",
    "long_transaction": "Long-running transaction (%ss) from %s",
    "frequent_blocker": "Frequent blocker: %s blocking %s sessions",
}
HOTSPOT_TEXTS = {
    "frequent_blocker": "%s: blocking %s sessions",
    "long_wait": "Long wait: %s waiting %ss for %s on %s",
}
ADVICE_TEXTS = {
    "idle": "%s idle connections vs %s active. Consider reducing connection pool sizes.",
    "issue": "%s",
    "query": "Query consuming %ss CPU avg (%s executions). Review: %s",
    "hotspot": "Blocking hotspot - %s",
    "redundancy": "%s - Query: %s...",
    "utilisation": "%s has low connection utilization (%s%%). Consider reducing pool size.",
}


class Thresholds(NamedTuple):
    """When a source counts as an issue, and a system as poorly used."""

    sessions: int = 50
    idle_sessions: int = 20
    transaction_seconds: int = 300
    blocked_sessions: int = 5
    utilisation_percent: float = 10
    utilisation_connections: int = 10


class Analysis(NamedTuple):
    sources: DataFrame
    patterns: DataFrame
    blocking: DataFrame
    issues: DataFrame
    expensive: DataFrame
    hotspots: DataFrame
    scorecards: DataFrame
    redundancies: DataFrame
    recommendations: DataFrame


def connection_totals(sources: DataFrame) -> DataFrame:
    return sources.agg(
        F.count("*").alias("total_systems"),
        F.coalesce(F.sum("session_count"), F.lit(0)).alias("total_connections"),
        F.coalesce(F.sum("active_requests"), F.lit(0)).alias("active_connections"),
        F.coalesce(F.sum("idle_connections"), F.lit(0)).alias("idle_connections"),
    )


def connection_issues(sources: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """One row per source and broken rule. All rules are checked in one pass."""
    who = source_name(F.col("program_name"), F.col("host_name"))

    def rule(kind: str, broken: Column, *values: Column) -> Column:
        text = F.format_string(ISSUE_TEXTS[kind], *values)
        return F.when(broken, F.struct(F.lit(kind).alias("issue_type"), text.alias("message")))

    sessions, idle = F.col("session_count"), F.col("idle_connections")
    open_txns, age, blocking = F.col("open_transactions"), F.col("longest_transaction_seconds"), F.col("blocking_count")
    rules = F.array(
        rule("connection_count", sessions > limits.sessions, sessions, who),
        rule("idle_transactions", (idle > limits.idle_sessions) & (open_txns > 0), who, open_txns),
        rule("long_transaction", age > limits.transaction_seconds, age, who),
        rule("frequent_blocker", blocking > limits.blocked_sessions, who, blocking),
    )
    return sources.select(
        "program_name", "host_name", "login_name", F.inline(F.filter(rules, lambda r: r.isNotNull()))
    )


def expensive_queries(patterns: DataFrame, top_n: int | None = None) -> DataFrame:
    """The patterns that exceed a threshold, or the `top_n` costliest of them for a display."""
    found = patterns.where(is_expensive()).withColumn("cost_score", query_cost())
    order = [F.col("cost_score").desc(), "query_hash", "source_program"]
    return found if top_n is None else found.orderBy(*order).limit(top_n)


def blocking_hotspots(pairs: DataFrame, min_sessions: int = 2, long_wait_ms: int = 30000) -> DataFrame:
    """Sources that block several sessions, and single long waits."""
    blocker = F.concat("blocking_program", F.lit(" ("), "blocking_host", F.lit(")"))
    frequent = (
        pairs.groupBy(blocker.alias("blocker"))
        .agg(F.count("*").alias("magnitude"))
        .where(F.col("magnitude") >= min_sessions)
        .select(
            F.lit("frequent_blocker").alias("kind"),
            "magnitude",
            F.format_string(HOTSPOT_TEXTS["frequent_blocker"], "blocker", "magnitude").alias("hotspot"),
        )
    )
    waiting = pairs.where(F.col("wait_time_ms") > long_wait_ms).select(
        F.lit("long_wait").alias("kind"),
        F.col("wait_time_ms").alias("magnitude"),
        F.format_string(
            HOTSPOT_TEXTS["long_wait"],
            "blocked_program",
            fixed(F.col("wait_time_ms") / 1000, 1),
            "wait_type",
            "wait_resource",
        ).alias("hotspot"),
    )
    return frequent.unionByName(waiting)


def redundant_queries(patterns: DataFrame, with_systems: bool = False) -> DataFrame:
    """Queries that several systems run. Patterns are first reduced to one row per query and
    system, so a query with many plans stays small. `with_systems` adds the systems as an array."""
    per_system = (
        patterns.where("query_hash <> ''")
        .groupBy("query_hash", "source_program")
        .agg(
            F.sum("execution_count").alias("executions"),
            F.max(F.struct("total_worker_time_ms", "query_text")).alias("top"),
        )
    )
    systems = F.size("systems")
    return (
        per_system.groupBy("query_hash")
        .agg(
            F.collect_set("source_program").alias("systems"),
            F.sum("executions").alias("total_executions"),
            F.max("top").alias("top"),
        )
        .where(systems > 1)
        .select(
            "query_hash",
            shortened(F.col("top.query_text"), 100).alias("query_pattern"),
            F.array_join(F.array_sort("systems"), ", ").alias("systems_involved"),
            *([F.array_sort("systems").alias("systems")] if with_systems else []),
            "total_executions",
            F.least(F.lit(50.0), (systems - 1) * F.lit(20.0)).alias("potential_savings_percent"),
            F.lit(CONSOLIDATE).alias("recommendation"),
            F.when(F.col("total_executions") > 1000, "medium").otherwise("low").alias("severity"),
            F.col("top.total_worker_time_ms").alias("total_worker_time_ms"),
        )
    )


def n_plus_one(
    patterns: DataFrame, executions: int = 1000, elapsed_ms: float = 10, with_systems: bool = False
) -> DataFrame:
    """Cheap queries that run very often. `with_systems` adds the system as an array."""
    return patterns.where(
        (F.col("execution_count") > executions) & (F.col("avg_elapsed_time_ms") < elapsed_ms)
    ).select(
        "query_hash",
        shortened(F.col("query_text"), 100).alias("query_pattern"),
        F.col("source_program").alias("systems_involved"),
        *([F.array("source_program").alias("systems")] if with_systems else []),
        F.col("execution_count").alias("total_executions"),
        F.lit(80.0).alias("potential_savings_percent"),
        F.lit(BATCH).alias("recommendation"),
        F.lit("high").alias("severity"),
        "total_worker_time_ms",
    )


def redundancies(patterns: DataFrame) -> DataFrame:
    """Both kinds of findings, with the systems as text and as an array."""
    return redundant_queries(patterns, True).unionByName(n_plus_one(patterns, with_systems=True))


def redundancy_report(findings: DataFrame, shown: int = 5) -> DataFrame:
    """All high findings and the first medium and low ones, by executions."""
    order = [F.col("total_executions").desc(), F.col("query_hash"), F.col("systems_involved")]
    columns = ["severity", "query_pattern", "systems_involved", "total_executions", "potential_savings_percent", "recommendation"]
    lesser = top_per_group(findings.where("severity <> 'high'"), ["severity"], order, shown)
    return findings.where("severity = 'high'").select(*columns).unionByName(lesser.select(*columns))


def system_scorecards(sources: DataFrame, patterns: DataFrame) -> DataFrame:
    """Sources with their queries, score and rank."""
    queries = patterns.groupBy(F.col("source_program").alias("system_name")).agg(
        F.sum("execution_count").alias("_total_queries"),
        F.count("*").alias("_patterns"),
        F.count_if(is_expensive()).alias("_expensive"),
    )
    zero = F.lit(0).cast("long")
    cards = (
        sources.withColumnRenamed("program_name", "system_name")
        .join(queries, "system_name", "left")
        .select(
            "system_name",
            "host_name",
            "login_name",
            F.col("session_count").alias("total_connections"),
            F.col("active_requests").alias("active_connections"),
            "idle_connections",
            F.when(F.col("session_count") > 0, F.col("active_requests") / F.col("session_count") * 100)
            .otherwise(0.0)
            .alias("connection_pool_efficiency"),
            (F.col("total_cpu_ms") / 1000.0).alias("cpu_cost_seconds"),
            F.col("total_reads").alias("io_reads"),
            F.col("total_writes").alias("io_writes"),
            (F.col("total_memory_kb") / 1024.0).alias("memory_mb"),
            F.coalesce("_total_queries", zero).alias("total_queries"),
            F.coalesce("_patterns", zero).alias("distinct_query_patterns"),
            F.coalesce("_expensive", zero).alias("expensive_queries"),
            F.col("blocked_count").alias("times_blocked"),
            F.col("blocking_count").alias("times_blocking"),
        )
        .withColumn("resource_score", system_score())
    )
    return with_rank(cards, [F.col("resource_score").desc(), F.col("system_name"), F.col("host_name"), F.col("login_name")])


def resource_distribution(scorecards: DataFrame, systems: int = 10) -> DataFrame:
    """CPU seconds and I/O per 10 000 of the top-ranked systems."""
    return scorecards.where(F.col("rank") <= systems).select(
        "rank",
        "system_name",
        "cpu_cost_seconds",
        ((F.col("io_reads") + F.col("io_writes")) / 10000).alias("io_per_10k"),
    )


def workload_recommendations(
    sources: DataFrame,
    issues: DataFrame,
    expensive: DataFrame,
    hotspots: DataFrame,
    findings: DataFrame,
    scorecards: DataFrame,
    limits: Thresholds = Thresholds(),
    queries: int = 5,
    sources_blocking: int = 3,
    redundant: int = 3,
    systems: int = 3,
    pattern_length: int = 50,
) -> DataFrame:
    """Advice as (priority, category, message). Each rule shows the head of its input, as long
    as its parameter says, and messages quote `pattern_length` characters of a query."""

    def advice(df: DataFrame, priority: str, category: str, kind: str, *values) -> DataFrame:
        text = F.format_string(ADVICE_TEXTS[kind], *values)
        return df.select(F.lit(priority).alias("priority"), F.lit(category).alias("category"), text.alias("message"))

    idle, active = F.col("idle_connections"), F.col("active_connections")
    top_queries = expensive.orderBy(F.col("cost_score").desc(), "query_hash", "source_program").limit(queries)
    top_hotspots = hotspots.orderBy("kind", F.col("magnitude").desc(), "hotspot").limit(sources_blocking)
    top_findings = (
        findings.where("severity = 'high'")
        .orderBy(F.col("total_worker_time_ms").desc(), "query_hash", "systems_involved")
        .limit(redundant)
    )
    efficiency = F.col("connection_pool_efficiency")
    return union_all(
        [
            advice(connection_totals(sources).where(idle > active * 2), "HIGH", "connections", "idle", idle, active),
            advice(issues, "MEDIUM", "connections", "issue", "message"),
            advice(
                top_queries.where("avg_worker_time_ms > 5000"),
                "HIGH",
                "queries",
                "query",
                fixed(F.col("avg_worker_time_ms") / 1000, 1),
                "execution_count",
                shortened(F.col("query_text"), 80),
            ),
            advice(top_hotspots, "HIGH", "blocking", "hotspot", "hotspot"),
            advice(
                top_findings, "MEDIUM", "redundancy", "redundancy", "recommendation", F.substring("query_pattern", 1, pattern_length)
            ),
            advice(
                scorecards.where(F.col("rank") <= systems).where(
                    (efficiency < limits.utilisation_percent)
                    & (F.col("total_connections") > limits.utilisation_connections)
                ),
                "LOW",
                "utilisation",
                "utilisation",
                "system_name",
                fixed(efficiency, 1),
            ),
        ]
    )


def analyze(
    sessions: DataFrame,
    requests: DataFrame,
    stats: DataFrame,
    as_of: str,
    limits: Thresholds = Thresholds(),
    top_n: int | None = None,
) -> Analysis:
    """The whole analysis over all statistics, or with `top_n` over the costliest ones alone.

    Runs when called: sources, patterns and blocking pairs are written out once, since several
    findings read each of them."""
    sources, patterns, blocking = staged_together(
        {
            "sources": activity.connection_sources(sessions, requests, as_of),
            "patterns": activity.query_patterns(stats, top_n),
            "blocking": activity.blocking_pairs(sessions, requests),
        }
    )
    issues = connection_issues(sources, limits)
    expensive = expensive_queries(patterns)
    hotspots = blocking_hotspots(blocking)
    findings = redundancies(patterns)
    scorecards = system_scorecards(sources, patterns)
    advice = workload_recommendations(sources, issues, expensive, hotspots, findings, scorecards, limits)
    return Analysis(sources, patterns, blocking, issues, expensive, hotspots, scorecards, findings, advice)


def workload_summary(analysis: Analysis) -> DataFrame:
    """The counts of an analysis as (metric, value) rows."""
    totals = connection_totals(analysis.sources)
    names = totals.columns
    from_totals = totals.select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names]))
    )
    counted = {
        "blocking_chains": analysis.blocking,
        "expensive_queries": analysis.expensive,
        "redundancy_issues": analysis.redundancies,
        "recommendations": analysis.recommendations,
    }
    counts = [df.agg(F.count("*").alias("value")).select(F.lit(n).alias("metric"), "value") for n, df in counted.items()]
    return union_all([from_totals, *counts])


def system_report(analysis: Analysis, system_name: str, top_n: int = 20) -> DataFrame:
    """All findings on one system as (section, subject, measure); one `error` row if unknown."""

    def section(df: DataFrame, name: str, subject: Column, measure: Column) -> DataFrame:
        return df.select(F.lit(name).alias("section"), subject.alias("subject"), measure.cast("double").alias("measure"))

    cards = analysis.scorecards.where(F.col("system_name") == system_name)
    queries = analysis.patterns.where(F.col("source_program") == system_name).withColumn("cost_score", query_cost())
    top = queries.orderBy(F.col("cost_score").desc(), "query_hash").limit(top_n)
    pairs = analysis.blocking

    def session(side: str) -> Column:
        return F.concat(f"{side}_program", F.lit(" ("), f"{side}_host", F.lit(") session "), f"{side}_session_id")

    missing = cards.agg(F.count("*").alias("n")).where("n = 0")
    wait = F.col("wait_time_seconds")
    return union_all(
        [
            section(
                cards.orderBy("rank").limit(1), "scorecard",
                F.concat("system_name", F.lit(" / "), "host_name", F.lit(" / "), "login_name"), F.col("resource_score"),
            ),
            section(top, "queries", shortened(F.col("query_text"), 200), F.col("cost_score")),
            section(pairs.where(F.col("blocking_program") == system_name), "blocking_others", session("blocked"), wait),
            section(pairs.where(F.col("blocked_program") == system_name), "blocked_by_others", session("blocking"), wait),
            section(
                analysis.redundancies.where(F.array_contains("systems", system_name)),
                "redundancies", F.col("query_pattern"), F.col("total_executions"),
            ),
            section(missing, "error", F.lit(f"System '{system_name}' not found"), F.lit(None)),
        ]
    )


def recommendation_lines(analysis: Analysis) -> DataFrame:
    """The analysis report as ordered lines of text."""
    headings = [(1, "HIGH", "### High Priority"), (2, "MEDIUM", "### Medium Priority"), (3, "LOW", "### Low Priority")]
    spark = analysis.sources.sparkSession
    heads = spark.createDataFrame([(p, 0, line) for p, _, line in headings] + [(0, 0, "## Summary")], "part INT, place INT, line STRING")
    part = F.when(F.col("priority") == "HIGH", 1).when(F.col("priority") == "MEDIUM", 2).otherwise(3)
    advice = analysis.recommendations.select(
        part.alias("part"), F.lit(1).alias("place"), F.concat(F.lit("- "), "message").alias("line")
    )
    label = F.initcap(F.replace("metric", F.lit("_"), F.lit(" ")))
    totals = (
        workload_summary(analysis)
        .where(~F.col("metric").isin("expensive_queries", "redundancy_issues", "recommendations"))
        .select(F.lit(0).alias("part"), F.lit(1).alias("place"), F.concat(F.lit("- "), label, F.lit(": "), "value").alias("line"))
    )
    return union_all([heads, totals, advice])


def write_report(analysis: Analysis, path: str) -> None:
    """The report as text files whose lines are in order."""
    recommendation_lines(analysis).orderBy("part", "place", "line").select("line").write.text(path)
