"""History of comparison runs on parquet.

Parquet has no UPDATE or DELETE, so the run table is a log: a run is opened, completed and
deleted by appended events, and its state is read from the latest of each. Every append
goes to a folder of its own, so writers do not disturb each other. Results and differences are
partitioned by a hash bucket of the run, so that reading one run reads few files. Data
differences are rows of their own table, as many as there are; `compact` merges the appends.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.functions.columns import ref
from evenkeel.functions.ranking import top_per_group

RUN_EVENTS = (
    "run_id STRING, event STRING, at TIMESTAMP_NTZ, source_database STRING, target_database STRING, "
    "total_tables BIGINT, matching_tables BIGINT, different_tables BIGINT, failed_tables BIGINT, status STRING"
)

RESULTS = (
    "run_id STRING, source_table STRING, target_table STRING, mode STRING, started_at TIMESTAMP_NTZ, "
    "completed_at TIMESTAMP_NTZ, duration_seconds DOUBLE, status STRING, error_message STRING, "
    "schema_match BOOLEAN, schema_diff_count INT, source_row_count BIGINT, target_row_count BIGINT, "
    "matching_rows BIGINT, different_rows BIGINT, source_only_rows BIGINT, target_only_rows BIGINT, "
    "schema_differences STRING, data_differences STRING"
)

DIFFERENCE_ROWS = (
    "run_id STRING, source_table STRING, key_display STRING, column_name STRING, source_value STRING, "
    "target_value STRING, difference_type STRING"
)

DIGESTS = (
    "run_id STRING, source_table STRING, side STRING, level INT, bucket BIGINT, row_count BIGINT, hash_xor BIGINT, "
    "hash_sum_high BIGINT, hash_sum_middle BIGINT, hash_sum_low BIGINT"
)

RESULT_BUCKETS = 64

DIFFERENCES = "array<struct<key:string,column_name:string,source_value:string,target_value:string>>"
SCHEMA_DIFFERENCES = (
    "array<struct<difference_type:string,column_name:string,source_value:string,target_value:string,description:string>>"
)
LISTS = {"data_differences": DIFFERENCES, "schema_differences": SCHEMA_DIFFERENCES}


def runs_from_events(events: DataFrame) -> DataFrame:
    """One row per run that was not deleted: when it was opened, and how it was closed last."""
    kind = F.col("event")
    counters = ["total_tables", "matching_tables", "different_tables", "failed_tables"]
    closed = F.when(kind == "completed", F.col("at"))
    last = F.max_by(F.struct(*counters, "status"), closed)
    return (
        events.groupBy("run_id")
        .agg(
            F.min(F.when(kind == "opened", F.col("at"))).alias("started_at"),
            F.max(closed).alias("completed_at"),
            F.max_by("source_database", F.when(kind == "opened", F.col("at"))).alias("source_database"),
            F.max_by("target_database", F.when(kind == "opened", F.col("at"))).alias("target_database"),
            last.alias("_last"),
            F.bool_or(kind == "deleted").alias("_deleted"),
        )
        .where(~F.col("_deleted") & F.col("started_at").isNotNull())
        .select(
            "run_id",
            "started_at",
            "completed_at",
            "source_database",
            "target_database",
            *[F.coalesce(F.col("_last").getField(c), F.lit(0).cast("long")).alias(c) for c in counters],
            F.coalesce(F.col("_last").getField("status"), F.lit("running")).alias("status"),
        )
    )


def result_totals(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Tables by outcome. A table without rows on both sides is in no bucket."""
    differing = (F.col("different_rows") > 0) | (F.col("source_only_rows") > 0) | (F.col("target_only_rows") > 0)
    return results.groupBy(*[ref(c) for c in by or []]).agg(
        F.count("*").alias("total_tables"),
        F.count_if(~differing & (F.col("matching_rows") > 0)).alias("matching_tables"),
        F.count_if(differing).alias("different_tables"),
        F.count_if(F.col("status") == "failed").alias("failed_tables"),
    )


def statistics(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Totals over the history as (metric, value) rows."""
    totals = result_totals(results).withColumnRenamed("total_tables", "total_tables_compared")
    per_metric = F.array(
        *[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in totals.columns]
    )
    run_count = runs.agg(F.count("*").alias("value")).select(F.lit("total_runs").alias("metric"), "value")
    return totals.select(F.inline(per_metric)).unionByName(run_count)


def page(runs: DataFrame, limit: int = 50, offset: int = 0, status: str | None = None) -> DataFrame:
    """Runs, newest first."""
    if status:
        runs = runs.where(F.col("status") == status)
    return runs.orderBy(F.col("started_at").desc(), "run_id").offset(offset).limit(limit)


def page_after(
    runs: DataFrame, limit: int = 50, after: tuple | None = None, status: str | None = None
) -> DataFrame:
    """The runs that follow the one at `after` = (started_at, run_id), newest first; without it the first page.

    Unlike an offset, the cursor reaches any page at the cost of the first: earlier runs are filtered in the scan,
    every task keeps `limit` rows, and runs that were added meanwhile move no page.
    """
    if status:
        runs = runs.where(F.col("status") == status)
    if after is not None:
        started, run_id = F.lit(str(after[0])).cast("timestamp_ntz"), F.lit(after[1])
        runs = runs.where((F.col("started_at") < started) | ((F.col("started_at") == started) & (F.col("run_id") > run_id)))
    return runs.orderBy(F.col("started_at").desc(), "run_id").limit(limit)


def cursor(rows: DataFrame) -> tuple | None:
    """The cursor behind the last run of a page; None behind an empty one."""
    last = rows.orderBy("started_at", F.col("run_id").desc()).select("started_at", "run_id").first()
    return None if last is None else (last["started_at"], last["run_id"])


def without_run(frame: DataFrame, run_id: str) -> DataFrame:
    return frame.where(F.col("run_id") != run_id)


def expired_runs(runs: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Ids of the runs that started more than `days` before `as_of`."""
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL '{int(days)}' DAY")
    return runs.where(F.col("started_at") < cutoff).select("run_id")


def cleanup(runs: DataFrame, results: DataFrame, as_of: str, days: int = 30) -> tuple[DataFrame, DataFrame]:
    """Runs and results that retention keeps."""
    expired = expired_runs(runs, as_of, days)
    return runs.join(expired, "run_id", "left_anti"), results.join(expired, "run_id", "left_anti")


def attach_differences(results: DataFrame, differences: DataFrame, by: list[str], limit: int) -> DataFrame:
    """Results with their first `limit` data differences as a list, for a display, and how many there are.

    The store keeps all of them: `History.save_differences`.
    """
    order = [F.col("key_display"), F.col("column_name")]
    first = top_per_group(differences, by, order, limit)
    found = differences.groupBy(*[ref(c) for c in by]).agg(F.count("*").alias("data_difference_count"))
    results = results.join(found, by, "left").withColumn(
        "data_difference_count", F.coalesce("data_difference_count", F.lit(0).cast("long"))
    )
    entry = F.struct(F.col("key_display").alias("key"), "column_name", "source_value", "target_value")
    lists = first.groupBy(*[ref(c) for c in by]).agg(F.array_sort(F.collect_list(entry)).alias("data_differences"))
    return results.join(lists, by, "left").withColumn(
        "data_differences", F.coalesce(F.col("data_differences").cast(DIFFERENCES), F.array().cast(DIFFERENCES))
    )


def attach_schema_differences(results: DataFrame, differences: DataFrame) -> DataFrame:
    """Results with the schema differences of their source table as a list; a table has at
    most as many as columns."""
    entry = F.struct("difference_type", "column_name", "source_value", "target_value", "description")
    lists = differences.groupBy(F.col("table_name").alias("source_table")).agg(
        F.array_sort(F.collect_list(entry)).alias("schema_differences")
    )
    empty = F.array().cast(SCHEMA_DIFFERENCES)
    return results.join(lists, "source_table", "left").withColumn(
        "schema_differences", F.coalesce(F.col("schema_differences").cast(SCHEMA_DIFFERENCES), empty)
    )


def to_json_text(results: DataFrame) -> DataFrame:
    """Difference lists as JSON text."""
    lists = [c for c in LISTS if c in results.columns]
    return results.withColumns({c: F.to_json(c, {"ignoreNullFields": "false"}) for c in lists})


def from_json_text(results: DataFrame) -> DataFrame:
    return results.withColumns({c: F.from_json(F.coalesce(c, F.lit("[]")), kind) for c, kind in LISTS.items()})


def _conforming(frame: DataFrame, schema: str) -> DataFrame:
    """The columns of a stored table; those that `frame` lacks are NULL, others are left out."""
    wanted = frame.sparkSession.createDataFrame([], schema).schema.fields
    return frame.select(
        *[(F.col(f.name) if f.name in frame.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted]
    )


def _bucket(run_id: Column) -> Column:
    return F.pmod(F.xxhash64(run_id), F.lit(RESULT_BUCKETS)).cast("int")


def _append(path: str) -> str:
    """A folder of its own for one append, which the readers see as a partition."""
    return f"{path}/append={uuid.uuid4().hex}"


class History:
    """A run history in one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.runs_path = f"{folder}/runs"
        self.results_path = f"{folder}/results"
        self.differences_path = f"{folder}/differences"
        self.digests_path = f"{folder}/digests"

    def log(self, events: DataFrame) -> None:
        """Appends run events; columns they lack are NULL."""
        _conforming(events, RUN_EVENTS).write.parquet(_append(self.runs_path))

    def _stored(self, path: str, schema: str) -> DataFrame:
        """A stored table, which is empty before the first write."""
        try:
            return self.spark.read.schema(f"{schema}, append STRING").parquet(path).drop("append")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _event(self, run_id: str, event: str, at: str, **values) -> DataFrame:
        base = self.spark.range(0, 1, 1, 1).select(
            F.lit(run_id).alias("run_id"), F.lit(event).alias("event"), F.lit(at).cast("timestamp_ntz").alias("at")
        )
        return base.select("*", *[F.lit(v).cast("string" if isinstance(v, str) else "long").alias(k) for k, v in values.items()])

    def open_run(self, run_id: str, at: str, source_database: str = "", target_database: str = "") -> str:
        self.log(self._event(run_id, "opened", at, source_database=source_database, target_database=target_database))
        return run_id

    def complete_run(self, run_id: str, at: str, status: str = "completed", **counters: int) -> None:
        self.log(self._event(run_id, "completed", at, status=status, **counters))

    def delete_run(self, run_id: str, at: str) -> bool:
        """Marks a run as deleted; False when there is no such run."""
        found = self.run(run_id).first() is not None
        if found:
            self.log(self._event(run_id, "deleted", at))
        return found

    def cleanup(self, as_of: str, days: int = 30) -> int:
        """Marks expired runs as deleted and returns how many."""
        expired = expired_runs(self.runs(), as_of, days)
        count = expired.count()
        if count:
            self.log(expired.select("run_id", F.lit("deleted").alias("event"), F.lit(as_of).cast("timestamp_ntz").alias("at")))
        return count

    def save_results(self, results: DataFrame) -> None:
        """Appends results, which carry their `run_id`; columns they lack are NULL."""
        self._save(_conforming(to_json_text(results), RESULTS), self.results_path)

    def save_differences(self, differences: DataFrame) -> None:
        """Appends data differences, which carry `run_id` and `source_table`: all of them."""
        self._save(_conforming(differences, DIFFERENCE_ROWS), self.differences_path)

    def save_digests(self, run_id: str, source_table: str, side: str, tree: DataFrame) -> None:
        """Appends the digest tree that one side of a table had in a run."""
        named = {"run_id": run_id, "source_table": source_table, "side": side}
        self._save(_conforming(tree.withColumns({k: F.lit(v) for k, v in named.items()}), DIGESTS), self.digests_path)

    def digests(self, run_id: str, source_table: str, side: str) -> DataFrame:
        """The digest tree that was stored for one side of a table."""
        stored = self._of_runs(self.digests_path, DIGESTS, run_id)
        return stored.where((F.col("source_table") == source_table) & (F.col("side") == side))

    def _save(self, rows: DataFrame, path: str) -> None:
        """The rebalance hint gathers a bucket in few files and lets adaptive execution split one
        that is too large for a task."""
        bucketed = rows.withColumn("run_bucket", _bucket(F.col("run_id"))).hint("rebalance", F.col("run_bucket"))
        bucketed.write.partitionBy("run_bucket").parquet(_append(path))

    def runs(self) -> DataFrame:
        return runs_from_events(self._stored(self.runs_path, RUN_EVENTS))

    def run(self, run_id: str) -> DataFrame:
        return runs_from_events(self._stored(self.runs_path, RUN_EVENTS).where(F.col("run_id") == run_id))

    def results(self, run_id: str | None = None) -> DataFrame:
        """Results of the runs that still exist, or of one run; then only its bucket is read."""
        return from_json_text(self._of_runs(self.results_path, RESULTS, run_id))

    def differences(self, run_id: str | None = None) -> DataFrame:
        """Data differences of the runs that still exist, or of one run."""
        return self._of_runs(self.differences_path, DIFFERENCE_ROWS, run_id)

    def _of_runs(self, path: str, schema: str, run_id: str | None) -> DataFrame:
        stored = self._stored(path, schema + ", run_bucket INT")
        if run_id is not None:
            stored = stored.where(
                (F.col("run_bucket") == _bucket(F.lit(run_id))) & (F.col("run_id") == run_id)
            )
        stored = stored.drop("run_bucket")
        kept = self.runs() if run_id is None else self.run(run_id)
        return stored.join(kept.select("run_id"), "run_id", "left_semi")

    def compact(self, folder: str) -> "History":
        """A copy of the history without deleted runs, in a new folder."""
        fresh = History(self.spark, folder)
        events = self._stored(self.runs_path, RUN_EVENTS)
        fresh.log(events.join(self.runs().select("run_id"), "run_id", "left_semi"))
        fresh.save_results(self.results())
        fresh.save_differences(self.differences())
        fresh._save(_conforming(self._of_runs(self.digests_path, DIGESTS, None), DIGESTS), fresh.digests_path)
        return fresh
