"""Row patterns inside each entity's day sequence: rising runs and spikes.

Both are built from windows over (entity, day). A window group holds one entity's days, so its
size is bounded by the calendar, and every window shares one shuffle and one sort. The final
grouping by run reuses that same partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from daymart.functions.fixed_values import (
    PATTERN_HEADINGS,
    SPIKE_MULTIPLIER,
    SPIKES,
    STREAK_LENGTH,
    STREAKS,
    SURGE_LENGTH,
    SURGES,
)


def _days(entity: str, day: str) -> WindowSpec:
    return Window.partitionBy(entity).orderBy(day)


def _with_runs(df: DataFrame, value: str, entity: str, day: str) -> DataFrame:
    """Add ``_up`` (value above the previous row's) and ``_run`` (constant along rows that keep rising).

    A null on either side is not a rise. Days are compared row to row; gaps in the calendar count
    for nothing.
    """
    up = F.coalesce(F.col(value) > F.lag(value).over(_days(entity, day)), F.lit(False))
    return df.withColumn("_up", up).withColumn(
        "_run", F.sum(F.when(F.col("_up"), 0).otherwise(1)).over(_days(entity, day))
    )


def rising_runs(df: DataFrame, value: str, min_len: int, entity: str = "country", day: str = "d") -> DataFrame:
    """Longest stretches of at least ``min_len`` rising rows, with first, last and summed values.

    The row before the first rise is not part of the run.
    """
    return (
        _with_runs(df.select(entity, day, value), value, entity, day)
        .where("_up")
        .groupBy(entity, "_run")
        .agg(
            F.min(day).alias("start_day"),
            F.max(day).alias("end_day"),
            F.count(F.lit(1)).alias("n_days"),
            F.min_by(value, day).alias("start_value"),
            F.max_by(value, day).alias("end_value"),
            F.sum(value).alias("total_value"),
        )
        .where(F.col("n_days") >= min_len)
        .drop("_run")
    )


def rising_streaks(
    df: DataFrame, min_len: int = STREAK_LENGTH, value: str = "new_cases", entity: str = "country", day: str = "d"
) -> DataFrame:
    """Rising streaks of cases."""
    return rising_runs(df, value, min_len, entity, day).select(
        F.col(entity).alias("country"),
        "start_day",
        "end_day",
        F.col("n_days").alias("streak_len"),
        F.col("start_value").alias("start_cases"),
        F.col("end_value").alias("end_cases"),
    )


def surges(
    df: DataFrame,
    min_len: int = SURGE_LENGTH,
    value: str = "daily_vaccinations",
    entity: str = "country",
    day: str = "d",
) -> DataFrame:
    """Vaccination surges: rising runs with the doses given along the run."""
    return rising_runs(df, value, min_len, entity, day).select(
        F.col(entity).alias("country"),
        "start_day",
        "end_day",
        F.col("n_days").alias("surge_len"),
        F.col("total_value").alias("total_new_shots"),
        F.col("start_value").alias("start_shots"),
        F.col("end_value").alias("end_shots"),
    )


def _spike(value: Column, prev: Column, multiplier: float) -> Column:
    return F.coalesce((prev > 0) & (value >= F.lit(float(multiplier)) * prev), F.lit(False))


def _jump(value: Column, prev: Column) -> Column:
    return F.round((value / F.nullif(prev, F.lit(0.0)) - 1) * 100, 1)


def spike_days(
    df: DataFrame,
    multiplier: float = SPIKE_MULTIPLIER,
    value: str = "new_cases",
    entity: str = "country",
    day: str = "d",
) -> DataFrame:
    """Days whose value is at least ``multiplier`` times the previous row's positive value."""
    now, prev = F.col(value).cast("double"), F.col("_prev").cast("double")
    return (
        df.select(entity, day, value)
        .withColumn("_prev", F.lag(value).over(_days(entity, day)))
        .where(_spike(now, prev, multiplier))
        .select(
            F.col(entity).alias("country"),
            F.col(day).alias("spike_day"),
            F.col("_prev").alias("prev_cases"),
            F.col(value).alias("spike_cases"),
            _jump(now, prev).alias("pct_jump"),
        )
    )


def tag_runs(df: DataFrame, value: str, min_len: int, entity: str = "country", day: str = "d") -> DataFrame:
    """Every day of the series with the run it lies in: span start and exclusive span end, else null.

    A run's days are exactly its rows, so the tag comes from the run's own window; no range join.
    """
    run = Window.partitionBy(entity, "_run", "_up")
    long_enough = F.col("_up") & (F.count(F.lit(1)).over(run) >= min_len)
    return (
        _with_runs(df.select(entity, day, value), value, entity, day)
        .withColumn("span_start", F.when(long_enough, F.min(day).over(run)))
        .withColumn("span_end", F.when(long_enough, F.date_add(F.max(day).over(run), 1)))
        .drop("_up", "_run")
    )


def tag_spikes(
    df: DataFrame,
    multiplier: float = SPIKE_MULTIPLIER,
    value: str = "new_cases",
    entity: str = "country",
    day: str = "d",
) -> DataFrame:
    """Every day of the series with spike value, previous value and jump, null on other days."""
    now, prev = F.col(value).cast("double"), F.col("_prev").cast("double")
    hit = _spike(now, prev, multiplier)
    return (
        df.select(entity, day, value)
        .withColumn("_prev", F.lag(value).over(_days(entity, day)))
        .withColumn("spike_value", F.when(hit, now))
        .withColumn("prev_value", F.when(hit, prev))
        .withColumn("pct_jump", F.when(hit, _jump(now, prev)))
        .drop("_prev")
    )


def find_pattern(
    df: DataFrame,
    pattern: str,
    min_len: int | None = None,
    multiplier: float | None = None,
    entity: str = "country",
    day: str = "d",
) -> DataFrame:
    """The named pattern with its default parameter where none is given."""
    if pattern == STREAKS:
        return rising_streaks(df, min_len or STREAK_LENGTH, entity=entity, day=day)
    if pattern == SPIKES:
        return spike_days(df, multiplier or SPIKE_MULTIPLIER, entity=entity, day=day)
    if pattern == SURGES:
        return surges(df, min_len or SURGE_LENGTH, entity=entity, day=day)
    raise ValueError(f"unknown pattern {pattern!r}; choose one of {sorted(PATTERN_HEADINGS)}")


def with_headings(matches: DataFrame, pattern: str) -> DataFrame:
    """Keep the pattern's columns that are present, in order, under their display headings."""
    headings = PATTERN_HEADINGS[pattern]
    return matches.select(*[c for c in headings if c in matches.columns]).withColumnsRenamed(headings)


def run_summaries(df: DataFrame, value: str, entity: str = "country", day: str = "d") -> DataFrame:
    """What a month's rows say about rising runs, so that months can be summarised apart and stitched later.

    ``entity, month, part, n, first_day, first_value, second_day, second_value, last_day, last_value, rest_total``:
    a month's rows are cut before every row that does not rise, and each stretch is a row, numbered by ``part``.
    Only the first stretch may go on from the month before, only the last into the month after; of those between
    only the ones with a rise are kept. Summaries of different months add up by union.
    """
    month = Window.partitionBy(entity, "month").orderBy(day)
    rows = df.select(entity, day, value, F.trunc(day, "month").alias("month"))
    up = F.coalesce(F.col(value) > F.lag(value).over(month), F.lit(False))
    parts = rows.withColumn("_up", up).withColumn("part", F.sum(F.when(F.col("_up"), 0).otherwise(1)).over(month) - 1)
    second = F.when(F.col("_up"), F.struct(F.col(day).alias("d"), F.col(value).alias("v")))
    summed = parts.groupBy(entity, "month", "part").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(day).alias("first_day"),
        F.min_by(value, day).alias("first_value"),
        F.min(second).alias("_second"),
        F.max(day).alias("last_day"),
        F.max_by(value, day).alias("last_value"),
        F.sum(F.when(F.col("_up"), F.col(value))).alias("rest_total"),
    )
    ends = Window.partitionBy(entity, "month")
    kept = summed.withColumn("_last", F.max("part").over(ends)).where((F.col("n") > 1) | (F.col("part") == 0) | (F.col("part") == F.col("_last")))
    return kept.select(
        entity, "month", "part", "n", "first_day", "first_value", F.col("_second.d").alias("second_day"),
        F.col("_second.v").alias("second_value"), "last_day", "last_value", "rest_total",
    )


def stitched_runs(summaries: DataFrame, min_len: int, entity: str = "country") -> DataFrame:
    """``rising_runs`` of all months whose summaries are given, without the rows themselves.

    The first stretch of a month goes on from the stretch before it if its first value rises above that one's
    last. Of a run of stretches only the very first row is no rise.
    """
    order = Window.partitionBy(entity).orderBy("month", "part")
    goes_on = F.coalesce((F.col("part") == 0) & (F.col("first_value") > F.lag("last_value").over(order)), F.lit(False))
    chained = summaries.withColumn("_on", goes_on).withColumn("_run", F.sum(F.when(F.col("_on"), 0).otherwise(1)).over(order))
    begun = F.when(F.col("_on"), F.struct(F.col("first_day").alias("d"), F.col("first_value").alias("v"))).otherwise(
        F.when(F.col("n") > 1, F.struct(F.col("second_day").alias("d"), F.col("second_value").alias("v")))
    )
    total = F.coalesce("rest_total", F.lit(0)) + F.when(F.col("_on"), F.col("first_value")).otherwise(F.lit(0))
    return (
        chained.groupBy(entity, "_run")
        .agg(
            F.min(begun).alias("_begun"),
            F.max("last_day").alias("end_day"),
            F.sum(F.col("n") - F.when(F.col("_on"), 0).otherwise(1)).alias("n_days"),
            F.max_by("last_value", "last_day").alias("end_value"),
            F.sum(total).alias("total_value"),
        )
        .where((F.col("n_days") >= min_len) & (F.col("n_days") > 0))
        .select(entity, F.col("_begun.d").alias("start_day"), "end_day", "n_days", F.col("_begun.v").alias("start_value"), "end_value", "total_value")
    )


def tag_spans(
    days: DataFrame, spans: DataFrame, entity: str = "country", day: str = "d", start: str = "start_day", end: str = "end_day", keep_all: bool = False
) -> DataFrame:
    """Days beside every span of their entity that holds them, first and last day included; spans may overlap.

    Spans are listed under each week they touch and days under theirs, so both meet by equality and a range check
    is left for few candidates; an entity spreads over its weeks. Any stored matches serve as spans. With
    ``keep_all`` a day without a span stays, its span columns null. A span that ends before it starts holds none.
    """
    def week(column):
        return F.floor(F.unix_date(column) / 7)

    others = [c for c in spans.columns if c != entity]
    valid = spans.where(F.col(start) <= F.col(end))
    listed = valid.select(
        F.col(entity).alias("_entity"),
        F.explode(F.sequence(week(F.col(start)), week(F.col(end)))).alias("_week"),
        F.struct(*[F.col(c) for c in others]).alias("_span"),
    )
    binned = days.withColumn("_at", week(F.col(day)))
    inside = (
        (F.col(entity) == F.col("_entity"))
        & (F.col("_at") == F.col("_week"))
        & F.col(day).between(F.col(f"_span.{start}"), F.col(f"_span.{end}"))
    )
    return binned.join(listed, inside, "left" if keep_all else "inner").select(*days.columns, "_span.*")
