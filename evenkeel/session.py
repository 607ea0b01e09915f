"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession


def session(app_name: str = "evenkeel", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume: UTC and adaptive execution."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        # call sites of every column expression cost half the time it takes to build a wide plan
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for written intermediate tables: `spark.checkpoint.dir`.

    Where it is unset, a folder below `spark.sql.warehouse.dir`, which every executor of a
    cluster has to reach as well. No machine-local temporary folder is ever used.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return (configured or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staging").rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has been written to.

    All paths of an application lie in one folder; `remove_staged` deletes it.
    """
    return f"{shared_dir(spark)}/evenkeel-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def remove_staged(spark: SparkSession) -> None:
    """Delete all that this application has staged. Results that still read it cannot be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/evenkeel-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, label: str, few_files: bool = False) -> DataFrame:
    """`df` written to the shared folder and read back.

    Used where one result feeds several branches or decides a join. It cuts the lineage at a
    place that survives executor loss, and the file sizes let the planner broadcast it only
    if it is below `spark.sql.autoBroadcastJoinThreshold`. `few_files` is for a small rest of
    a large input: it is gathered first, so that not every task writes a tiny file.
    """
    path = fresh_path(df.sparkSession, label)
    (df.hint("rebalance") if few_files else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_together(frames: dict[str, DataFrame]) -> list[DataFrame]:
    """Several independent frames, staged by jobs that run at the same time."""
    with ThreadPoolExecutor(max_workers=len(frames)) as pool:
        return list(pool.map(lambda item: staged(item[1], item[0]), frames.items()))
