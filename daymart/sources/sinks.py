"""Writing results. Ordering happens here, once, and only where a reader needs it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> int:
    """Replace a parquet table and return the rows written, counted during the write itself.

    The old files go first; ``versions.replace_table`` replaces without a moment in which there is no table.
    """
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    counted.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return seen.get["rows"]


def write_mart(mart: DataFrame, path: str) -> int:
    """Replace the mart, a folder per year, entities together inside it.

    Range partitioning by (year, country, d) cuts a large year or a large entity into several files
    and keeps the column statistics of each file narrow, so entity filters skip files. A large mart
    therefore never turns into one file per year.
    """
    return write_table(by_year(mart), path, ["year"])


def by_year(mart: DataFrame) -> DataFrame:
    """The mart with its year, laid out as ``write_mart`` stores it."""
    dated = mart.withColumn("year", F.year("d"))
    keys = [F.col("year"), F.col("country"), F.col("d")]
    return dated.repartitionByRange(*keys).sortWithinPartitions("year", "country", "d")


def write_bucketed(df: DataFrame, table: str, buckets: int, entity: str = "country", day: str = "d") -> None:
    """Replace a catalogue table bucketed by entity: later windows and joins by entity need no shuffle."""
    (
        df.write.mode("overwrite")
        .format("parquet")
        .bucketBy(buckets, entity)
        .sortBy(entity, day)
        .saveAsTable(table)
    )


def write_csv(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """CSV with a header. With ``order`` the files together are globally sorted."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per row; nested comments stay nested."""
    df.write.mode("overwrite").json(path)
