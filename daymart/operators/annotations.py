"""Comments: the append log, its documents, and both sides of reading them.

A document is the set of comments of one (country, date, metric). Comments stay rows at any size; what a
document adds to them, when it began and how many it holds, is a header row of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daymart.functions.fixed_values import FIRST_DAY, LAST_DAY, NEWEST_COMMENTS, NO_COMMENTS
from daymart.functions.scalars import clamp_day, comment_line, filled
from daymart.operators.canonical import canonicalize

KEYS = ("country", "date", "metric")
# Tasks that share the newest comments of one key before they meet in one.
SALTS = 32


def accepted_requests(requests: DataFrame, alias: DataFrame, first: str = FIRST_DAY, last: str = LAST_DAY) -> DataFrame:
    """Submitted comments as log rows: one per target entity, names put right, dates clamped to ``first``..``last``.

    Requests without a user, a text or a target are left out. Identity and time are added on writing.
    """
    cleaned = requests.select(
        F.explode("countries").alias("country"),
        clamp_day(F.col("date"), first, last).alias("date"),
        "metric",
        F.trim("user").alias("user"),
        F.trim("comment").alias("text"),
    ).where(filled(F.col("user")).isNotNull() & filled(F.col("text")).isNotNull())
    return canonicalize(cleaned, alias, trimmed=True).where(filled(F.col("country")).isNotNull())


def upsert_counts(log: DataFrame, incoming: DataFrame) -> DataFrame:
    """How many incoming comments meet an existing document and how many documents are new.

    ``log`` may be the comments themselves or any headers of them; only their keys are read.
    """
    new_keys = incoming.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    # Distinct first, which combines map-side: a busy key of the log crosses the shuffle once per task.
    old_keys = log.select(*KEYS).distinct().withColumn("old", F.lit(True))
    return (
        new_keys.join(old_keys, list(KEYS), "left")
        .agg(
            # The first comment of a new document creates it; those after it find it there.
            F.sum(F.when(F.col("old"), F.col("n")).otherwise(F.col("n") - 1)).alias("matched"),
            F.sum(F.when(F.col("old"), 0).otherwise(1)).alias("created"),
        )
        .na.fill(0)
    )


def annotation_docs(log: DataFrame) -> DataFrame:
    """Headers (country, date, metric, created_at, n_comments), counted map-side; one row per document of any size."""
    return log.groupBy(*KEYS).agg(F.min("ts").alias("created_at"), F.count(F.lit(1)).alias("n_comments"))


def merged_headers(deltas: DataFrame) -> DataFrame:
    """Headers of several parts of a log as those of the whole: they add up in any order and grouping."""
    return deltas.groupBy(*KEYS).agg(F.min("created_at").alias("created_at"), F.sum("n_comments").alias("n_comments"))


def read_annotations(rows: DataFrame, country: str, metric: str, start: str, end: str) -> DataFrame:
    """Headers or comments of one entity and metric (exact names) dated in the inclusive range."""
    return rows.where(
        (F.col("country") == country)
        & (F.col("metric") == metric)
        & F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    )


def annotate_series(series: DataFrame, docs: DataFrame) -> DataFrame:
    """Attach the header of the same (country, date, metric) as a nullable struct; names match exactly.

    A day keeps one row. Its comments are the rows of the log with the same three keys.
    """
    header = docs.select(*KEYS, F.struct("created_at", "n_comments").alias("annotation"))
    return series.join(header, list(KEYS), "left").select(*series.columns, "annotation")


def comment_rows(log: DataFrame, series: DataFrame | None = None) -> DataFrame:
    """One row per comment, of all documents or of those that a series' days have."""
    rows = log.select(*KEYS, "user", "text", "ts")
    return rows if series is None else rows.join(series.select(*KEYS), list(KEYS), "left_semi")


def latest_comments(
    log: DataFrame,
    start: str | None = None,
    end: str | None = None,
    by: Sequence[str] = ("country", "metric"),
    newest: int = NEWEST_COMMENTS,
) -> DataFrame:
    """The newest comments per entity and metric, ranked from 1; without a range, of all comments.

    Spark limits each group inside every map task before a shuffle. A hot key is limited again in
    SALTS tasks, so the last one gets ``newest`` rows from each of these and not from each map task.
    The comment's identity settles equal times.
    """
    if start:
        log = log.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        log = log.where(F.col("date") <= F.lit(end).cast("date"))
    salted = log.withColumn("_salt", F.pmod(F.xxhash64("comment_id"), F.lit(SALTS)))
    for keys in ([*by, "_salt"], list(by)):
        recent = Window.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("comment_id"))
        salted = salted.withColumn("position", F.row_number().over(recent)).where(F.col("position") <= newest)
    return salted.drop("_salt")


def comment_lines(latest: DataFrame, requested: DataFrame, by: Sequence[str] = ("country", "metric")) -> DataFrame:
    """Printed lines per requested key, newest first; a key without comments gets one placeholder."""
    lines = latest.select(*by, "position", comment_line(F.col("ts"), F.col("user"), F.col("text")).alias("line"))
    return (
        requested.select(*by)
        .distinct()
        .join(lines, list(by), "left")
        .select(*by, F.coalesce("position", F.lit(0)).alias("position"), F.coalesce("line", F.lit(NO_COMMENTS)).alias("line"))
    )
