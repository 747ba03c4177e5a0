"""A metric request from name to rows, and the frame a chart of it needs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daymart.functions.fixed_values import (
    GDP_METRIC,
    GDP_METRICS,
    GDP_VS_CASES_METRIC,
    METRIC_COLUMNS,
)
from daymart.functions.scalars import match_key, number_or_null, zero_if_null
from daymart.operators.annotations import annotate_series
from daymart.operators.asof import asof_join, gdp_with_cases
from daymart.operators.canonical import canonicalize, clean_alias, distinct_entities
from daymart.operators.series import valid_points, yearly_last
from daymart.operators.snapshots import bubble_points


def allowed_metrics() -> list[str]:
    """Every metric that can be asked for, sorted."""
    return sorted({*METRIC_COLUMNS, *GDP_METRICS})


def in_range(
    mart: DataFrame, start: str | None, end: str | None, entities: Sequence[str] | None, exact_names: bool = False
) -> DataFrame:
    """The inclusive day range and the chosen entities, filtered before anything else is computed."""
    days = mart.withColumn("d", F.to_date("d")) if dict(mart.dtypes)["d"] != "date" else mart
    if start:
        days = days.where(F.col("d") >= F.lit(start).cast("date"))
    if end:
        days = days.where(F.col("d") <= F.lit(end).cast("date"))
    if entities is not None:
        name = F.col("country") if exact_names else match_key(F.col("country"))
        days = days.where(name.isin([e if exact_names else e.upper() for e in entities]))
    return days


def metric_series(
    mart: DataFrame,
    metric: str,
    start: str | None = None,
    end: str | None = None,
    entities: Sequence[str] | None = None,
    yearly: DataFrame | None = None,
) -> DataFrame:
    """(country, date, metric, value) of one metric for all entities, or the chosen ones.

    An unknown metric is an error before any plan is built. The composite metric gives two series.
    """
    name = metric.upper()
    if name not in allowed_metrics():
        raise ValueError(f"unknown metric {metric!r}; allowed: {allowed_metrics()}")
    days = in_range(mart, start, end, entities)
    if name in GDP_METRICS:
        if yearly is None:
            raise ValueError(f"{name} needs the yearly table")
        # The mart's key is (country, d), so a day has one row already.
        if name == GDP_VS_CASES_METRIC:
            return gdp_with_cases(days, yearly)
        days, column = asof_join(days.select("country", "d"), yearly), "gdp_ppp_per_capita"
    else:
        column = name.lower()
    return days.select(
        "country", F.col("d").alias("date"), F.lit(name).alias("metric"), F.col(column).cast("double").alias("value")
    )


def all_metrics(mart: DataFrame, metrics: Sequence[str] | None = None) -> DataFrame:
    """Every plain metric of the mart as rows, from one scan."""
    wanted = [m for m in (metrics or METRIC_COLUMNS) if m.lower() in mart.columns]
    wide = mart.select("country", F.col("d").alias("date"), *[F.col(m.lower()).cast("double").alias(m) for m in wanted])
    return wide.unpivot(["country", "date"], wanted, "metric", "value")


def metric_response(series: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """A series as it is handed out: unknown values as 0.0, comments attached."""
    answered = series.withColumn("value", zero_if_null(F.col("value")))
    return answered if docs is None else annotate_series(answered, docs)


def chart_frame(
    mart: DataFrame,
    yearly: DataFrame,
    alias: DataFrame,
    metric: str,
    start: str | None = None,
    end: str | None = None,
    entities: Sequence[str] | None = None,
) -> DataFrame:
    """Rows to draw: bubbles for the composite metric, year bars for the yearly value, else the series.

    Yearly metrics keep only entities that occur in the yearly table under their canonical name; where
    none do, the frame is empty with its usual columns.
    """
    name = metric.upper()
    if name in GDP_METRICS:
        lookup = clean_alias(alias)
        known = distinct_entities(yearly, lookup).withColumnRenamed("country", "_canonical")
        mart = (
            canonicalize(mart, lookup, out="_canonical", trimmed=True)
            .join(known, "_canonical", "left_semi")
            .drop("_canonical")
        )
    if name == GDP_VS_CASES_METRIC:
        # The joined day holds both values already: they stay side by side.
        days = asof_join(in_range(mart, start, end, entities).select("country", "d", "new_cases_per_100k"), yearly)
        wide = days.select(
            "country",
            F.col("d").alias("date"),
            number_or_null(F.col("gdp_ppp_per_capita")).alias(GDP_METRIC),
            zero_if_null(F.col("new_cases_per_100k")).alias("NEW_CASES_PER_100K"),
            F.year("d").alias("year"),
        )
        return bubble_points(wide, GDP_METRIC, "NEW_CASES_PER_100K")
    points = valid_points(metric_response(metric_series(mart, metric, start, end, entities, yearly)))
    return yearly_last(points) if name == GDP_METRIC else points
