"""Resource and cost scores. Weights are fixed values of the scoring model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def source_score() -> Column:
    """Cost of a connection source: CPU s + I/O per 10 000 + MB + 10 per blocked, 20 per blocking."""
    return (
        F.col("total_cpu_ms") / 1000.0
        + (F.col("total_reads") + F.col("total_writes")) / 10000.0
        + F.col("total_memory_kb") / 1024.0
        + (F.col("blocked_count") + F.col("blocking_count") * 2) * 10
    )


def query_cost() -> Column:
    """Cost of a query pattern: CPU s + logical reads per 1000 + physical reads per 100."""
    return (
        F.col("total_worker_time_ms") / 1000.0
        + F.col("total_logical_reads") / 1000.0
        + F.col("total_physical_reads") / 100.0
    )


def is_expensive(cpu_ms: float = 1000, logical_reads: float = 10000, elapsed_ms: float = 5000) -> Column:
    return (
        (F.col("avg_worker_time_ms") > cpu_ms)
        | (F.col("avg_logical_reads") > logical_reads)
        | (F.col("avg_elapsed_time_ms") > elapsed_ms)
    )


def system_score() -> Column:
    """Score of a system: 10 per CPU s + I/O per 10 000 + MB + 20 per blocked session + 5 per expensive query."""
    return (
        F.col("cpu_cost_seconds") * 10
        + (F.col("io_reads") + F.col("io_writes")) / 10000
        + F.col("memory_mb")
        + F.col("times_blocking") * 20
        + F.col("expensive_queries") * 5
    )


def per_execution(total: Column, executions: Column) -> Column:
    return F.when(executions > 0, total / F.nullif(executions, F.lit(0))).otherwise(F.lit(0.0))
