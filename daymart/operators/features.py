"""Six numbers describing each entity's weekly series, and their standardised form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daymart.functions.fixed_values import MIN_WEEKS
from daymart.functions.scalars import finite_or_null, guarded_growth, zero_if_null
from daymart.operators.series import daily_interpolated, weekly_mean

FEATURES = ("growth", "volatility", "peak_level", "time_to_peak", "recent_mean", "recent_trend")


def weekly_features(weekly: DataFrame, value: str, entity: str = "country", min_weeks: int = MIN_WEEKS) -> DataFrame:
    """Features per entity with at least ``min_weeks`` known weeks; unknown ones become 0.

    All windows share (entity, week), and the final grouping keeps that partitioning, so the
    weekly means are not shuffled again.
    """
    ordered = Window.partitionBy(entity).orderBy("week")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    three = ordered.rowsBetween(-2, Window.currentRow)

    w = F.col(value)
    # A missing week repeats the one before it; from zero, any rise is infinite and no change unknown.
    change = F.when(
        F.col("_before") == 0,
        F.when(F.col("_carried") != 0, F.lit(float("inf")) * F.signum("_carried")),
    ).otherwise(F.col("_carried") / F.nullif(F.col("_before"), F.lit(0.0)) - 1)

    numbered = (
        weekly.select(
            entity,
            "week",
            w.alias("_w"),
            F.last(value, ignorenulls=True).over(so_far).alias("_carried"),
            F.row_number().over(ordered).alias("_nth"),
            F.count(F.lit(1)).over(whole).alias("_n"),
            F.max(value).over(whole).alias("_peak"),
        )
        .withColumn("_before", F.lag("_carried").over(ordered))
        .withColumn("_change", finite_or_null(change))
        .withColumn("_spread", F.when(F.count("_change").over(three) == 3, F.stddev_samp("_change").over(three)))
        .withColumn("_from_end", F.col("_n") - F.col("_nth") + 1)
    )

    def from_end(k: int):
        return F.max(F.when(F.col("_from_end") == k, F.col("_w")))

    first = F.max(F.when(F.col("_nth") == 1, F.col("_w")))
    return (
        numbered.groupBy(entity)
        .agg(
            F.count("_w").alias("_known"),
            F.max("_n").alias("_n"),
            first.alias("_first"),
            from_end(1).alias("_end"),
            from_end(4).alias("_end4"),
            F.avg(F.when(F.col("_from_end") <= 8, F.col("_spread"))).alias("_volatility"),
            F.avg(F.when(F.col("_from_end") <= 4, F.col("_w"))).alias("_recent"),
            F.max("_peak").alias("_peak"),
            F.min(F.when(F.col("_w") == F.col("_peak"), F.col("week"))).alias("_peak_week"),
            F.min("week").alias("_start"),
        )
        .where(F.col("_known") >= min_weeks)
        .select(
            entity,
            zero_if_null(guarded_growth(F.col("_end"), F.col("_first"))).alias("growth"),
            zero_if_null(F.col("_volatility")).alias("volatility"),
            zero_if_null(F.col("_peak")).alias("peak_level"),
            F.datediff("_peak_week", "_start").alias("time_to_peak"),
            zero_if_null(F.col("_recent")).alias("recent_mean"),
            zero_if_null(F.when(F.col("_n") >= 5, guarded_growth(F.col("_end"), F.col("_end4")))).alias("recent_trend"),
        )
    )


def series_features(days: DataFrame, value: str, entity: str = "country", day: str = "d") -> DataFrame:
    """Features straight from entity-day rows: fill, weekly means, features."""
    daily = daily_interpolated(days, value, entity, day)
    return weekly_features(weekly_mean(daily, value, entity, day), value, entity)


def standardize(features: DataFrame, columns: Sequence[str] = FEATURES) -> DataFrame:
    """Each column minus its mean over its population deviation; a constant column becomes 0.

    Means and deviations are one row, read as a scalar.
    """
    moments = features.agg(
        F.struct(
            *[F.avg(c).alias(f"{c}_mean") for c in columns],
            *[F.stddev_pop(c).alias(f"{c}_dev") for c in columns],
        )
    ).scalar()
    scaled = {
        c: F.when(moments[f"{c}_dev"] > 0, (F.col(c) - moments[f"{c}_mean"]) / moments[f"{c}_dev"]).otherwise(0.0)
        for c in columns
    }
    return features.withColumns(scaled)
