"""Latest-known yearly value for each entity-day.

The yearly table is turned into validity intervals [year, next_year), so every day meets
at most one interval and the join never fans out. The literal form (join all earlier years,
rank, keep the first) multiplies each day by its number of earlier years before dropping them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daymart.functions.scalars import match_key
from daymart.operators.canonical import canonicalize, clean_alias


def validity_intervals(yearly: DataFrame, value: str = "gdp_ppp_per_capita") -> DataFrame:
    """(entity_key, from_year, to_year, value): one row per entity and year, next year exclusive.

    Two rows for one entity and year are reduced to the larger value before the window, which
    therefore holds at most one row per calendar year.
    """
    per_year = yearly.groupBy(
        match_key(F.col("country")).alias("entity_key"), F.col("year").alias("from_year")
    ).agg(F.max(value).alias(value))
    by_year = Window.partitionBy("entity_key").orderBy("from_year")
    return per_year.withColumn("to_year", F.lead("from_year").over(by_year))


def asof_join(
    days: DataFrame, yearly: DataFrame, entity: str = "country", day: str = "d", value: str = "gdp_ppp_per_capita"
) -> DataFrame:
    """Left join of each day to the yearly value in force that year, null before the first one.

    ``days`` must hold one row per (entity, day); see :func:`one_row_per_day`.
    """
    # A yearly table read from storage has its true size: a small one is broadcast and the days stay put.
    intervals = validity_intervals(yearly, value)
    year = F.year(day)
    in_force = (
        (match_key(F.col(entity)) == F.col("entity_key"))
        & (F.col("from_year") <= year)
        & (F.col("to_year").isNull() | (year < F.col("to_year")))
    )
    return days.join(intervals, in_force, "left").drop("entity_key", "from_year", "to_year")


def one_row_per_day(df: DataFrame, entity: str, day: str, prefer: str) -> DataFrame:
    """Keep one row per (entity, day), the one with the smallest ``prefer``.

    Grouping is by entity *and* day, so an entity with many rows spreads over its days.
    """
    first = Window.partitionBy(entity, day).orderBy(F.col(prefer).asc_nulls_last())
    return df.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")


def enrich_mart(mart: DataFrame, yearly: DataFrame, alias: DataFrame, unique_days: bool = True) -> DataFrame:
    """The mart under canonical names with ``gdp_ppp_per_capita`` attached.

    Two raw names may share a canonical one; the smaller raw name keeps the day. Only names that are
    the target of an alias can meet that way, so only their rows are shuffled to be compared; all
    others stay in the task that read them. This relies on the mart's key, one row per raw name and
    day; for a table without it pass ``unique_days=False`` and every row is compared.
    """
    lookup = clean_alias(alias)
    named = canonicalize(mart.withColumn("_raw", F.col("country")), lookup)
    if unique_days:
        targets = lookup.select(F.col("canonical").alias("_target")).distinct()
        marked = named.join(targets, F.col("country") == F.col("_target"), "left")
        alone = marked.where(F.col("_target").isNull())
        meeting = one_row_per_day(marked.where(F.col("_target").isNotNull()), "country", "d", "_raw")
        days = alone.unionByName(meeting).drop("_target")
    else:
        days = one_row_per_day(named, "country", "d", "_raw")
    return asof_join(days.drop("_raw"), canonicalize(yearly, lookup))


def gdp_with_cases(
    days: DataFrame, yearly: DataFrame, entity: str = "country", day: str = "d", cases: str = "new_cases_per_100k"
) -> DataFrame:
    """Two metrics stacked as rows: the yearly value and the daily cases, where the former exists.

    One join and one scan; the two legs come from an unpivot of the joined row.
    """
    joined = asof_join(days.select(entity, day, cases), yearly, entity, day)
    return (
        joined.where(F.col("gdp_ppp_per_capita").isNotNull())
        .select(
            F.col(entity).alias("country"),
            F.col(day).alias("date"),
            F.col("gdp_ppp_per_capita").alias("GDP_PPP_PER_CAPITA"),
            F.col(cases).alias("NEW_CASES_PER_100K"),
        )
        .unpivot(["country", "date"], ["GDP_PPP_PER_CAPITA", "NEW_CASES_PER_100K"], "metric", "value")
    )


def asof_union(
    days: DataFrame,
    yearly: DataFrame,
    entity: str = "country",
    day: str = "d",
    value: str = "gdp_ppp_per_capita",
    span_years: int = 4,
) -> DataFrame:
    """``asof_join`` for two large sides, without a join and without the key of ``days`` being unique.

    Both sides are one stream of events of an entity, and a day takes the last value before it by a window. The
    stream is cut into spans of years, so that an entity with a third of all rows spreads over tasks; what an
    earlier span leaves behind is put in front of each later one, once per entity and span, until a new
    value takes its place. A day without entity or date, or before the first value, has none.
    """
    span = F.floor(F.col("_year") / span_years)
    left = days.select(
        match_key(F.col(entity)).alias("_key"), F.year(day).alias("_year"), F.struct(*[F.col(f"`{c}`") for c in days.columns]).alias("_row")
    ).withColumn("_span", span)
    known = yearly.where(F.col("country").isNotNull() & F.col("year").isNotNull())
    # One row per entity and year, as in validity_intervals; a struct, so that an unknown value is a value too.
    per_year = (
        known.groupBy(match_key(F.col("country")).alias("_key"), F.col("year").cast("int").alias("_year"))
        .agg(F.struct(F.max(value).alias("v")).alias("_held"))
        .withColumn("_span", span)
    )
    last = left.agg(F.max("_span")).scalar()
    by_span = Window.partitionBy("_key").orderBy("_span")
    left_behind = per_year.groupBy("_key", "_span").agg(F.max_by("_held", "_year").alias("_held"))
    until = F.coalesce(F.lead("_span").over(by_span), last)
    carried = (
        left_behind.withColumn("_until", until)
        .where(F.col("_until") > F.col("_span"))
        .select("_key", F.explode(F.sequence(F.col("_span") + 1, "_until")).alias("_span"), "_held")
    )
    stream = left.unionByName(per_year, allowMissingColumns=True).unionByName(carried, allowMissingColumns=True)
    # In a span: what was carried into it (no year), then year by year its value before its days.
    before = Window.partitionBy("_key", "_span").orderBy(F.col("_year").asc_nulls_first(), F.col("_row").isNotNull())
    held = F.last("_held", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return stream.withColumn("_held", held).where(F.col("_row").isNotNull()).select("_row.*", F.col("_held.v").alias(value))
