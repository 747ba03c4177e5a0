"""Session defaults and durable staging."""

from __future__ import annotations

import contextlib
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_storing = threading.Lock()
_stored_now: dict = {}


def build_session(app: str = "daymart", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and skew handling on.

    On a cluster leave ``master`` unset: it comes from spark-submit, as do executor sizes.
    Adaptive execution picks the reducer count from real shuffle sizes, so the initial
    partition number only has to be large enough for the largest shuffle.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Where nothing is named, staged tables go beside the session's own ones, into the warehouse.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if warehouse.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share; the warehouse is one of the driver's machine")
    return f"{warehouse}/staged"


@contextlib.contextmanager
def _dropping_shuffles(spark: SparkSession):
    """Shuffle files go as soon as their job is done, while any thread stores a step; then as it was before."""
    with _storing:
        if not _stored_now.get("threads"):
            _stored_now["before"] = spark.conf.get(CLEANUP)
            spark.conf.set(CLEANUP, "true")
        _stored_now["threads"] = _stored_now.get("threads", 0) + 1
    try:
        yield
    finally:
        with _storing:
            _stored_now["threads"] -= 1
            if not _stored_now["threads"]:
                spark.conf.set(CLEANUP, _stored_now["before"])


def stage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them back.

    This cuts lineage, so a lost executor re-reads instead of recomputing, and several readers cost
    one computation. The stored files also tell Spark the true size: a join with a staged table is
    broadcast when it is below the broadcast threshold and shuffled when it is not, while the
    estimate for a table that came out of joins is far too high to choose by.

    Nothing goes back behind a stored step, so its shuffle files are dropped as soon as it is written;
    a chain of steps then needs the disk of its largest one.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    with _dropping_shuffles(spark):
        df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._stage_folder = path
    return stored


def unstage(*stored: DataFrame) -> None:
    """Delete what ``stage`` wrote, once nothing will read it again; a chain of steps then leaves less behind."""
    for df in stored:
        spark, jvm = df.sparkSession, df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._stage_folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
