"""The comment log: append-only parquet, a folder per metric, and the header deltas of its batches."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daymart import schemas
from daymart.operators.annotations import accepted_requests, annotation_docs, merged_headers, upsert_counts
from daymart.session import stage


def read_comments(spark: SparkSession, path: str) -> DataFrame:
    """The log. Filters on metric prune folders."""
    return spark.read.schema(schemas.COMMENT_LOG).parquet(path)


def stamped(accepted: DataFrame) -> DataFrame:
    """Log rows with an identity and the current UTC time."""
    return accepted.select(
        F.uuid().alias("comment_id"),
        "country",
        "date",
        "metric",
        "user",
        "text",
        F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("timestamp_ntz").alias("ts"),
    )


def append_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("metric").parquet(path)


def headers_path(path: str) -> str:
    """Where a log's header deltas lie: beside it."""
    return f"{path.rstrip('/')}_headers"


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the log as (country, date, metric, created_at, n_comments), merged from the batches' deltas.

    Every batch adds a row for each document it touches: the first time in it and how many comments. Their
    smallest time and summed count are what ``annotation_docs`` makes of the whole log.
    """
    try:
        deltas = spark.read.schema(schemas.COMMENT_HEADERS).parquet(headers_path(path) + "/*")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schemas.COMMENT_HEADERS)
    return merged_headers(deltas)


def append_comments(requests: DataFrame, alias: DataFrame, path: str) -> dict[str, int]:
    """Append submitted comments; returns how many met an existing document and how many made one.

    Nothing is deduplicated: sending a comment twice stores it twice. The log itself is not read: a batch
    meets the documents by their headers. Rows are written before their delta; after a failure between the
    two, ``rebuild_headers`` puts the headers right.
    """
    spark = requests.sparkSession
    # Staged once: identity and time must be the same for counting and writing, also after a retry.
    rows = stage(stamped(accepted_requests(requests, alias)))
    result = upsert_counts(read_headers(spark, path), rows).first().asDict()
    append_rows(rows, path)
    annotation_docs(rows).write.parquet(f"{headers_path(path)}/{uuid.uuid4().hex}")
    return {name: int(number) for name, number in result.items()}


def _replace_headers(spark: SparkSession, path: str, headers: DataFrame) -> None:
    """One delta instead of all there are; a reader in between counts both, so no batch may run meanwhile."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(headers_path(path))
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = [status.getPath() for status in files.listStatus(folder)] if files.exists(folder) else []
    stage(headers).write.parquet(f"{headers_path(path)}/{uuid.uuid4().hex}")
    for place in old:
        files.delete(place, True)


def compact_headers(spark: SparkSession, path: str) -> None:
    """Merge the deltas into one, so that a batch reads a row for each document and not for each batch."""
    _replace_headers(spark, path, read_headers(spark, path))


def rebuild_headers(spark: SparkSession, path: str) -> None:
    """The headers anew from the whole log."""
    _replace_headers(spark, path, annotation_docs(read_comments(spark, path)))
