"""A run history whose changes are versions: whole, readable at any age, and compacted in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.sources.history import (
    DIFFERENCE_ROWS,
    DIGESTS,
    RESULTS,
    RUN_EVENTS,
    History,
    _bucket,
    _conforming,
    to_json_text,
)
from evenkeel.sources.versions import Versions

BUCKETED = {"results": RESULTS, "differences": DIFFERENCE_ROWS, "digests": DIGESTS}


class VersionedHistory(History):
    """The operations of `History` over one list of versions, at the latest or at a given one.

    A commit adds files of all tables that it changes at once, so a run is seen with its results or not at all.
    `compact` shortens the events of each run to at most two and removes what deleted runs have left; old versions
    stay readable until `vacuum`.
    """

    def __init__(self, spark: SparkSession, folder: str, version: int | None = None) -> None:
        super().__init__(spark, folder)
        self.folder, self.version = folder, version
        self.runs_path, self.results_path, self.differences_path, self.digests_path = "runs", "results", "differences", "digests"
        self.store = Versions(
            spark, folder, {"runs": RUN_EVENTS, **{name: f"{schema}, run_bucket INT" for name, schema in BUCKETED.items()}}
        )

    def as_of(self, version: int) -> VersionedHistory:
        """The history as it was at a version."""
        return VersionedHistory(self.spark, self.folder, version)

    def latest(self) -> int:
        return self.store.latest()

    def log(self, events: DataFrame) -> None:
        self.store.append(_conforming(events, RUN_EVENTS), table="runs", operation="events")

    def _stored(self, path: str, schema: str) -> DataFrame:
        return self.store.read(self.version, table=path)

    def _written(self, table: str, rows: DataFrame) -> list[str]:
        bucketed = rows.withColumn("run_bucket", _bucket(F.col("run_id"))).hint("rebalance", F.col("run_bucket"))
        return self.store.write(bucketed, ["run_bucket"], table)

    def _save(self, rows: DataFrame, path: str) -> None:
        self.store.commit(self._written(path, rows), operation=path)

    def save_run(
        self,
        run_id: str,
        opened: str,
        completed: str,
        results: DataFrame,
        differences: DataFrame | None = None,
        source_database: str = "",
        target_database: str = "",
        status: str = "completed",
        **counters: int,
    ) -> int:
        """A whole run as one version: its events, results and differences; the number of the version."""
        events = self._event(run_id, "opened", opened, source_database=source_database, target_database=target_database).unionByName(
            self._event(run_id, "completed", completed, status=status, **counters), allowMissingColumns=True
        )
        files = self.store.write(_conforming(events, RUN_EVENTS), table="runs")
        files += self._written("results", _conforming(to_json_text(results.withColumn("run_id", F.lit(run_id))), RESULTS))
        if differences is not None:
            files += self._written("differences", _conforming(differences.withColumn("run_id", F.lit(run_id)), DIFFERENCE_ROWS))
        return self.store.commit(files, operation="run", run_id=run_id)

    def compact(self, folder: str | None = None) -> History:
        """Make a version with few files and without what deleted runs have left. With a `folder`, a copy as in `History`.

        Events are rewritten; of the other tables only the buckets of deleted runs, or those of many files.
        """
        if folder is not None:
            return super().compact(folder)
        base = self.store.latest()
        files = self.store.files(base)
        now = self.as_of(base)
        events = self.store.read(files=files, table="runs")
        gone = events.where("event = 'deleted'").select("run_id").distinct()
        state = now.runs()
        opened = state.select(
            "run_id", F.lit("opened").alias("event"), F.col("started_at").alias("at"), "source_database", "target_database"
        )
        counters = ["total_tables", "matching_tables", "different_tables", "failed_tables", "status"]
        closed = state.where("completed_at IS NOT NULL").select(
            "run_id", F.lit("completed").alias("event"), F.col("completed_at").alias("at"), *counters
        )
        # events of runs that were not opened yet wait as they are
        waiting = events.join(gone, "run_id", "left_anti").join(state.select("run_id"), "run_id", "left_anti")
        short = opened.unionByName(closed, allowMissingColumns=True).unionByName(waiting, allowMissingColumns=True)
        old = [f for f in files if f.startswith("runs/")]
        add = self.store.write(_conforming(short, RUN_EVENTS).hint("rebalance"), table="runs")

        emptied = {r[0] for r in gone.select(_bucket(F.col("run_id"))).distinct().collect()}  # at most RESULT_BUCKETS
        for table in BUCKETED:
            by_bucket: dict[int, list[str]] = {}
            for f in files:
                if f.startswith(f"{table}/"):
                    by_bucket.setdefault(int(f.split("run_bucket=")[1].split("/")[0]), []).append(f)
            dirty = [f for bucket, names in by_bucket.items() if bucket in emptied or len(names) > 1 for f in names]
            if dirty:
                kept = self.store.read(files=dirty, table=table).join(gone, "run_id", "left_anti")
                add += self.store.write(kept.hint("rebalance", F.col("run_bucket")), ["run_bucket"], table)
                old += dirty
        self.store.commit(add, old, operation="compact")
        return self

    def vacuum(self, keep: int = 1) -> int:
        """Delete the files that only versions before the last `keep` need."""
        return self.store.vacuum(keep)
