"""Daily series: filtering, filling, resampling and diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daymart.functions.fixed_values import (
    FEW_WEEKS,
    MIN_WEEKS,
    NO_FEATURES,
    NO_SERIES,
    WINDOW_DAYS,
)
from daymart.functions.scalars import lenient_date, lenient_double, number_or_null, week_ending


def date_span(df: DataFrame, day: str = "d") -> DataFrame:
    """First and last day of the table."""
    return df.agg(F.min(F.to_date(day)).alias("first_day"), F.max(F.to_date(day)).alias("last_day"))


def valid_points(df: DataFrame, day: str = "date", value: str = "value") -> DataFrame:
    """Points whose date and value can both be read; text columns are read leniently."""
    kinds = dict(df.dtypes)
    readable_day = lenient_date(F.col(day)) if kinds[day] == "string" else F.col(day).cast("date")
    readable = lenient_double(F.col(value)) if kinds[value] == "string" else number_or_null(F.col(value))
    return df.withColumns({day: readable_day, value: readable}).na.drop(subset=[day, value])


def look_back(df: DataFrame, end: str, days: int = WINDOW_DAYS, not_before: str | None = None, day: str = "d") -> DataFrame:
    """The last ``days`` days up to and including ``end``, but never before ``not_before``."""
    last = F.lit(end).cast("date")
    first = F.date_sub(last, days)
    if not_before:
        first = F.greatest(first, F.lit(not_before).cast("date"))
    return df.where(F.col(day).between(first, last))


def daily_interpolated(df: DataFrame, value: str, entity: str = "country", day: str = "d") -> DataFrame:
    """One row per calendar day between each entity's first and last day, gaps filled on a straight line.

    Days after the last known value repeat it; days before the first stay null. Each known point
    produces the days up to the next one, so filling needs one shuffle by entity and no join.
    """
    whole = (
        Window.partitionBy(entity).orderBy(day).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    ordered = Window.partitionBy(entity).orderBy(day)
    spanned = df.select(entity, F.to_date(day).alias(day), number_or_null(F.col(value)).alias("_v")).select(
        "*",
        F.min(day).over(whole).alias("_first"),
        F.max(day).over(whole).alias("_last"),
        F.count("_v").over(whole).alias("_known"),
    )
    # An entity without any value keeps its first row, so that its days still appear.
    anchors = spanned.where(
        F.col("_v").isNotNull() | ((F.col("_known") == 0) & (F.col(day) == F.col("_first")))
    ).select(
        "*",
        F.lag(day).over(ordered).alias("_before"),
        F.lead(day).over(ordered).alias("_next"),
        F.lead("_v").over(ordered).alias("_next_v"),
    )
    start = F.when(F.col("_before").isNull(), F.col("_first")).otherwise(F.col(day))
    stop = F.coalesce(F.date_sub("_next", 1), F.col("_last"))
    share = F.datediff("_day", F.col(day)) / F.datediff("_next", F.col(day))
    return (
        anchors.withColumn("_day", F.explode(F.sequence(start, stop)))
        .select(
            entity,
            F.col("_day").alias("_d"),
            F.when(F.col("_day") < F.col(day), None)
            .when(F.col("_next").isNull(), F.col("_v"))
            .otherwise(F.col("_v") + (F.col("_next_v") - F.col("_v")) * share)
            .alias(value),
        )
        .withColumnRenamed("_d", day)
    )


def weekly_mean(daily: DataFrame, value: str, entity: str = "country", day: str = "d") -> DataFrame:
    """Mean per entity and week; a week is named by the Sunday that ends it."""
    return daily.groupBy(entity, week_ending(F.col(day)).alias("week")).agg(F.avg(value).alias(value))


def yearly_last(df: DataFrame, value: str = "value", entity: str = "country", day: str = "date") -> DataFrame:
    """Last known value of each calendar year; years without one, inside the span, appear as null."""
    per_year = (
        df.where(F.col(value).isNotNull())
        .groupBy(entity, F.year(day).alias("_year"))
        .agg(F.max_by(value, day).alias("_value"))
    )
    following = F.lead("_year").over(Window.partitionBy(entity).orderBy("_year"))
    return (
        per_year.withColumn("_stop", F.coalesce(following - 1, F.col("_year")))
        .withColumn("year", F.explode(F.sequence("_year", "_stop")))
        .select(entity, "year", F.when(F.col("year") == F.col("_year"), F.col("_value")).alias(value))
    )


def series_stats(daily: DataFrame, value: str, entity: str = "country", day: str = "d") -> DataFrame:
    """Length, known points, first and last day of each filled series, and its number of known weeks.

    Weeks are summed up first, so both groupings use the shuffle the filling already made.
    """
    weeks = daily.groupBy(entity, week_ending(F.col(day)).alias("_week")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count(value).alias("_known"),
        F.min(day).alias("_first"),
        F.max(day).alias("_last"),
    )
    return weeks.groupBy(entity).agg(
        F.sum("_n").alias("len"),
        F.sum("_known").alias("nnz"),
        F.min("_first").alias("first"),
        F.max("_last").alias("last"),
        F.sum(F.when(F.col("_known") > 0, 1).otherwise(0)).alias("weeks"),
    )


def series_report(
    requested: DataFrame,
    stats: DataFrame,
    entity: str = "country",
    min_weeks: int = MIN_WEEKS,
    has_features: Column | None = None,
) -> DataFrame:
    """One row per requested entity: usable or not, and why not."""
    found = requested.select(entity).distinct().join(stats, entity, "left")
    usable_features = F.lit(True) if has_features is None else has_features
    reason = (
        F.when(F.col("len").isNull(), NO_SERIES)
        .when(F.col("weeks") < min_weeks, FEW_WEEKS)
        .when(~usable_features, NO_FEATURES)
        .otherwise("")
    )
    return found.select(
        entity,
        (reason == "").alias("ok"),
        reason.alias("reason"),
        F.coalesce("len", F.lit(0)).cast("long").alias("len"),
        F.coalesce("nnz", F.lit(0)).cast("long").alias("nnz"),
        "first",
        "last",
    )
