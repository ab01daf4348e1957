"""Session construction and the shared scratch area used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_folders: dict[str, tempfile.TemporaryDirectory] = {}


def build_session(app: str = "kohort", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators rely on; everything else stays as the cluster set it."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.legacy.timeParserPolicy", "CORRECTED")
        # skips the call-site lookup on every column expression, which dominates wide generated selects
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a folder of its own, which goes with the process.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder every executor can reach.")
    if sc.applicationId not in _own_folders:
        _own_folders[sc.applicationId] = tempfile.TemporaryDirectory(prefix="kohort-shared-", ignore_cleanup_errors=True)
    return _own_folders[sc.applicationId].name


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Spark deletes the shuffle files of queries that end inside. Else they stay until the driver happens to collect garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def stage_table(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Later passes then scan a columnar table (with pruning and pushdown) instead of repeating the
    shuffles behind ``df``, and losing an executor does not lose the intermediate result. The shuffles
    that made it are deleted. ``options`` go to the Parquet writer.
    """
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    with shuffles_dropped(df.sparkSession):
        df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def task_count(df: DataFrame) -> int | None:
    """Number of tasks that read ``df``, or None behind a shuffle, where asking would run it. What is persisted is read as it is kept."""
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]:
        return None
    return df.rdd.getNumPartitions()


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of an input with fewer partitions than cores; larger inputs are left alone.

    For work that is heavy per row (parsing, tokenising, distances) on a small file.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = task_count(df)
    return df.repartition(cores) if tasks is not None and tasks < cores else df
