"""Incremental comparison with a memory: digests per date and side, so that a run reads changed dates only.

Both tables lie in one folder per date (`<column>=<date>/`). A run lists the files of a side; a date whose files
are those of the last run (names, lengths, times) keeps its digest, any other date is read again. Dates whose
digests then differ between the sides are the only ones whose rows are compared. As in any comparison of
loads of different age, both sides are cut at the lower of their last dates.

The state is a versioned table: a run that fails leaves the last state, and old states can be read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions.columns import ref
from evenkeel.functions.rowhash import row_hash
from evenkeel.operators.digest_tree import DIGEST
from evenkeel.operators.fingerprint import _MEASURES
from evenkeel.operators.row_diff import MATCH, key_states
from evenkeel.session import staged
from evenkeel.sources.footers import parquet_files
from evenkeel.sources.versions import Versions

STATE = "side STRING, date STRING, files BIGINT, signature BIGINT, " + ", ".join(f"{m} BIGINT" for m in DIGEST)
NO_DATE = "__HIVE_DEFAULT_PARTITION__"  # fixed value: the folder of rows without a date


class DateState:
    """The state of one pair of tables, in `folder`. `schema` has the columns without the date."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType | str, column: str, keys: list[str]) -> None:
        self.spark, self.column, self.keys = spark, column, keys
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        self.store = Versions(spark, folder, STATE)

    def read(self, version: int | None = None) -> DataFrame:
        return self.store.read(version)

    def rows(self, path: str, dates: list[str | None] | None = None) -> DataFrame:
        """The rows of a side with their date as text, or those of some dates; other folders are not read."""
        whole = T.StructType([*self.schema.fields, T.StructField(self.column, T.StringType())])
        stored = self.spark.read.schema(whole).parquet(path)
        if dates is None:
            return stored
        known = [d for d in dates if d is not None]
        wanted = ref(self.column).isin(known) if known else F.lit(False)
        return stored.where(wanted | ref(self.column).isNull() if None in dates else wanted)

    def _signatures(self, path: str) -> DataFrame:
        """date, files, signature: from names, lengths and times of files, no file is opened."""
        times = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime")
        files = parquet_files(self.spark, {"t": path}).join(times, "path")
        date = F.regexp_extract("path", f"/{self.column}=([^/]+)/", 1)
        seen = F.xxhash64("path", "length", "modificationTime")
        return files.groupBy(F.nullif(date, F.lit(NO_DATE)).alias("date")).agg(F.count("*").alias("files"), F.bit_xor(seen).alias("signature"))

    def refresh(self, side: str, path: str) -> list[str | None]:
        """Bring a side's digests up to date; the dates that were read.

        Dates that are gone are forgotten. The dates of a table pass through the driver.
        """
        now = staged(self._signatures(path), "signatures", few_files=True)
        known = staged(self.read().where(F.col("side") == side), "known-dates", few_files=True)
        same = (F.col("n.date").eqNullSafe(F.col("k.date"))) & (F.col("n.files") == F.col("k.files")) & (F.col("n.signature") == F.col("k.signature"))
        changed = [r["date"] for r in now.alias("n").join(known.alias("k"), same, "left_anti").select("date").collect()]
        kept = known.alias("k").join(now.alias("n"), same, "left_semi")
        gone = known.count() - kept.count()
        if not changed and not gone:
            return []
        rows = self.rows(path, changed)
        hashed = rows.select(ref(self.column).alias("date"), row_hash(rows, sorted(self.schema.names)).alias("_h"))
        digests = hashed.groupBy("date").agg(*[F.expr(f"{_MEASURES[m]} AS {m}") for m in DIGEST])
        fresh = now.alias("n").join(digests.alias("d"), F.col("n.date").eqNullSafe(F.col("d.date"))).select(
            F.lit(side).alias("side"), "n.date", "files", "signature", *DIGEST
        )
        others = self.read().where(F.col("side") != side)
        files = self.store.files()
        state = staged(kept.unionByName(fresh).unionByName(others), "date-state", few_files=True)
        self.store.commit(self.store.write(state.coalesce(1)), files, side=side, read=len(changed))
        return changed

    def _compared(self) -> DataFrame:
        """Digests of both sides up to the cutoff, rows without a date included."""
        state = self.read()
        last = state.where("date IS NOT NULL").groupBy("side").agg(F.max("date").alias("last")).agg(
            F.min("last").alias("cutoff"), F.count("*").alias("sides")
        ).first()
        if last["sides"] == 2:
            state = state.where(F.col("date").isNull() | (F.col("date") <= last["cutoff"]))
        return state

    def dates(self) -> DataFrame:
        """date, source_row_count, target_row_count and differs, of every date up to the cutoff."""
        state = self._compared()
        s, t = (state.where(F.col("side") == side).alias(side[0]) for side in ("source", "target"))
        same = " AND ".join(f"s.{m} <=> t.{m}" for m in DIGEST)
        return s.join(t, F.col("s.date").eqNullSafe(F.col("t.date")), "full").selectExpr(
            "coalesce(s.date, t.date) AS date",
            "coalesce(s.row_count, 0L) AS source_row_count",
            "coalesce(t.row_count, 0L) AS target_row_count",
            f"NOT ({same}) AS differs",
        )

    def differences(self, source: str, target: str) -> DataFrame:
        """The keys that are not a match, from the rows of differing dates."""
        dates = [r["date"] for r in self.dates().where("differs").select("date").collect()]
        sides = [self.rows(path, dates) for path in (source, target)]
        return key_states(*sides, [self.column, *self.keys]).where(F.col("difference_type") != MATCH)


def compare_dates(state: DateState, source: str, target: str) -> DataFrame:
    """Refresh both sides and give the differing keys."""
    state.refresh("source", source)
    state.refresh("target", target)
    return state.differences(source, target)
