"""One row per entity (or entity and year), pivots and the points drawn from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daymart.functions.fixed_values import BUBBLE_OFFSET, BUBBLE_SCALE


def latest_snapshot(
    df: DataFrame, values: Sequence[str], entity: str = "country", day: str = "d"
) -> DataFrame:
    """Values on each entity's last day; an entity with a null there is dropped.

    ``max_by`` per column keeps fixed-width buffers, so this is one hash aggregation with
    map-side combine and no self-join.
    """
    last = df.groupBy(entity).agg(
        F.max(day).alias(day), *[F.max_by(value, day).alias(value) for value in values]
    )
    return last.na.drop(subset=list(values))


def yearly_snapshot(
    df: DataFrame, values: Sequence[str], entity: str = "country", day: str = "d"
) -> DataFrame:
    """Values on each entity's last *complete* day of each year; incomplete days are dropped first."""
    complete = df.na.drop(subset=[*values, day])
    return complete.groupBy(entity, F.year(day).alias("year")).agg(
        F.max(day).alias(day), *[F.max_by(value, day).alias(value) for value in values]
    )


def correlation(points: DataFrame, x: str, y: str) -> DataFrame:
    """Number of points and their Pearson correlation, one row."""
    return points.agg(F.count(F.lit(1)).alias("n_points"), F.corr(x, y).alias("correlation"))


def entity_series(df: DataFrame, entities: Sequence[str], column: str, entity: str = "country", day: str = "d") -> DataFrame:
    """One column of the chosen entities; an absent column or entity gives no rows."""
    if column not in df.columns:
        return df.select(entity, day).limit(0)
    return df.where(F.col(entity).isin(list(entities))).select(entity, day, column)


def keep_selected(df: DataFrame, selected: DataFrame, entity: str = "country", max_entities: int | None = None) -> DataFrame:
    """Rows of the selected entities that exist. ``max_entities`` is the caller's own top-n choice."""
    chosen = selected.select(entity).distinct()
    if max_entities is not None:
        chosen = chosen.orderBy(entity).limit(max_entities)
    return df.join(chosen, entity, "left_semi")


def pivot_metrics(
    series: DataFrame, metrics: Sequence[str], entity: str = "country", day: str = "date"
) -> DataFrame:
    """Metric rows to columns, one row per entity and day, with the year added.

    The metric list is given, so no job runs to find it. Two rows for one cell are an error.
    """
    cells = [
        F.when(
            F.count(F.when(F.col("metric") == metric, 1)) > 1,
            F.raise_error(F.format_string("more than one %s on a day", F.lit(metric))).cast("double"),
        )
        .otherwise(F.max(F.when(F.col("metric") == metric, F.col("value"))))
        .alias(metric)
        for metric in metrics
    ]
    return series.groupBy(entity, day).agg(*cells).withColumn("year", F.year(day))


def bubble_points(pivoted: DataFrame, x: str, y: str, entity: str | None = "country") -> DataFrame:
    """Drawable points: both values known, x positive, y not negative, with a size relative to the largest y.

    Sizes are relative within each entity, as one chart shows one entity; with ``entity=None`` the
    whole table is one chart. No positive y, no points. The largest y comes from a separate
    aggregation, which is small and combines map-side.
    """
    points = pivoted.where((F.col(x) > 0) & (F.col(y) >= 0))
    if entity is None:
        sized = points.withColumn("_top", points.agg(F.max(y)).scalar())
    else:
        sized = points.join(points.groupBy(entity).agg(F.max(y).alias("_top")), entity)
    return (
        sized.where(F.col("_top") > 0)
        .withColumn("bubble_size", F.col(y) / F.col("_top") * BUBBLE_SCALE + BUBBLE_OFFSET)
        .drop("_top")
    )


def melt_years(wide: DataFrame, ids: Sequence[str], value: str = "gdp_ppp_per_capita") -> DataFrame:
    """A column per year to a row per year; empty cells are dropped, a heading that is no year is an error."""
    years = [c for c in wide.columns if c not in ids]
    for heading in years:
        int(heading)
    return (
        wide.unpivot(list(ids), years, "year", value)
        .where(F.col(value).isNotNull())
        .withColumn("year", F.col("year").cast("int"))
    )
