"""One Spark query per operator, over the star-schema tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daymart.functions import fixed_values as fixed
from daymart.functions.scalars import clamp_day, ordered_range
from daymart.operators import annotations, asof, canonical, clustering, features, forecast, frequent, patterns, profile, quantiles, series
from daymart.operators import snapshots, tiers
from daymart.operators.asof import enrich_mart
from daymart.plans import cluster_run, forecast_run, metric_series, pattern_query
from daymart.sources.sql import run_sql
from daymart.sources.tables import clean_yearly, csv_rows, wide_numbers
from daymart.session import stage
from workload import views as v

Query = Callable[[SparkSession, str], DataFrame]
GDP = "gdp_ppp_per_capita"
CASES = "new_cases_per_100k"
PRICE = "daily_vaccinations"


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    """Sums of doubles depend on their order in the last digits; results are compared rounded."""
    return df.withColumns({c: F.round(c, places) for c in columns})


def enriched(spark: SparkSession, folder: str) -> DataFrame:
    return enrich_mart(v.nation_day(spark, folder), v.nation_year(spark, folder), v.alias(spark, folder))


def asof_yearly(spark, folder):
    return metric_series.metric_series(
        v.nation_day(spark, folder), "gdp_ppp_per_capita", yearly=v.nation_year(spark, folder)
    )


def asof_union(spark, folder):
    """The same as ``asof_yearly`` from one stream of days and yearly values."""
    days = v.nation_day(spark, folder).select("country", "d")
    joined = asof.asof_union(days, v.nation_year(spark, folder))
    return joined.select("country", F.col("d").alias("date"), F.lit("GDP_PPP_PER_CAPITA").alias("metric"), F.col(GDP).alias("value"))


def two_metric_stack(spark, folder):
    return metric_series.metric_series(
        v.nation_day(spark, folder), fixed.GDP_VS_CASES_METRIC, yearly=v.nation_year(spark, folder)
    ).orderBy("country", "date", "metric")


def metric_series_long(spark, folder):
    return metric_series.metric_response(metric_series.all_metrics(v.nation_day(spark, folder)))


def one_metric(spark, folder):
    nations = [f"nation_{i}" for i in range(12)]
    return metric_series.metric_series(
        v.nation_day(spark, folder), "new_deaths", "1996-03-01", "1999-06-30", nations
    ).orderBy("country", "date")


def sql_series(spark, folder):
    return run_sql(
        spark,
        "SELECT country, d AS date, new_cases AS value FROM {mart} WHERE d BETWEEN :first AND :last",
        {"first": "1996-03-01", "last": "1999-06-30"},
        mart=v.nation_day(spark, folder),
    )


def date_span_defaults(spark, folder):
    span = series.date_span(v.nation_day(spark, folder))
    lo, hi = (F.lit(x).cast("date") for x in (fixed.FIRST_DAY, fixed.LAST_DAY))
    chosen = ordered_range(F.greatest(lo, "first_day"), F.least(hi, "last_day"))
    return span.select(
        "first_day",
        "last_day",
        chosen["start"].alias("start_day"),
        chosen["end"].alias("end_day"),
        clamp_day(F.col("last_day")).alias("clamped"),
        clamp_day(F.lit("")).alias("clamped_empty"),
    )


def canonical_entities(spark, folder):
    return canonical.distinct_entities(v.nation_day(spark, folder), v.alias(spark, folder)).orderBy("country")


def eligible_metrics(spark, folder):
    names = v.nation_day(spark, folder).select("country").distinct()
    flagged = canonical.gdp_eligibility(names, v.nation_year(spark, folder), v.alias(spark, folder))
    return canonical.metric_choices(flagged)


def coverage_gaps(spark, folder):
    return canonical.coverage_gaps(v.nation_day(spark, folder), v.nation_year(spark, folder)).orderBy("missing_in", "country")


def coverage_counts(spark, folder):
    return canonical.gap_counts(canonical.coverage_gaps(v.nation_day(spark, folder), v.nation_year(spark, folder)))


def pivot_points(spark, folder):
    points = metric_series.chart_frame(
        v.nation_day(spark, folder), v.nation_year(spark, folder), v.alias(spark, folder), fixed.GDP_VS_CASES_METRIC
    )
    return rounded(points, "bubble_size")


def gdp_bars(spark, folder):
    return metric_series.chart_frame(
        v.nation_day(spark, folder), v.nation_year(spark, folder), v.alias(spark, folder), fixed.GDP_METRIC
    )


def melt_years(spark, folder):
    return snapshots.melt_years(v.yearly_wide(spark, folder), ["country"])


def yearly_clean(spark, folder):
    return clean_yearly(v.yearly_text(spark, folder))


def _lines(df):
    return df.select(F.to_csv(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value"))


def yearly_csv(spark, folder):
    """The yearly file line by line, with padded headings and every kind of unreadable cell."""
    return clean_yearly(csv_rows(_lines(v.yearly_text(spark, folder)), " Sr.No ,Country , Year, GDP_PPP_Per_Capita "))


def wide_csv(spark, folder):
    """The file with a column per year line by line, then a row per year."""
    wide = v.yearly_wide(spark, folder)
    header = "S No, " + " , ".join("Country" if c == "country" else c for c in wide.columns)
    numbered = wide.select(F.lit("1").alias("S No"), "*")
    return snapshots.melt_years(wide_numbers(csv_rows(_lines(numbered), header)), ["country"])


def yearly_last(spark, folder):
    return series.yearly_last(v.nation_day(spark, folder), "new_deaths", day="d")


def rising_streaks(spark, folder):
    return patterns.rising_streaks(v.nation_day(spark, folder), value=PRICE).orderBy("country", "start_day")


def stitched_streaks(spark, folder):
    """Streaks from stored summaries of the years before and of the last one, each summarised by itself."""
    mart = v.nation_day(spark, folder)
    early = F.col("d") < F.lit("1998-01-01").cast("date")
    parts = [stage(patterns.run_summaries(mart.where(part), PRICE)) for part in (early, ~early)]
    runs = patterns.stitched_runs(parts[0].unionByName(parts[1]), 3)
    return runs.select(
        "country", "start_day", "end_day", F.col("n_days").alias("streak_len"), F.col("start_value").alias("start_cases"), F.col("end_value").alias("end_cases")
    ).orderBy("country", "start_day")


def stitched_surges(spark, folder):
    """Surges of every month summarised by itself, with the doses given along each."""
    runs = patterns.stitched_runs(patterns.run_summaries(v.nation_day(spark, folder), PRICE), 5)
    shown = runs.select(
        "country", "start_day", "end_day", F.col("n_days").alias("surge_len"), F.col("total_value").alias("total_new_shots"),
        F.col("start_value").alias("start_shots"), F.col("end_value").alias("end_shots"),
    )
    return rounded(shown, "total_new_shots", places=2)


def span_overlay(spark, folder):
    """Every day under the stored matches of two patterns at once; a day may lie in several."""
    mart = v.nation_day(spark, folder)
    stored = [
        patterns.rising_runs(mart, value, length).select("country", F.lit(name).alias("pattern"), "start_day", "end_day")
        for name, value, length in (("prices", PRICE, 3), ("orders", "new_cases", 2))
    ]
    return patterns.tag_spans(mart.select("country", "d", "new_cases"), stage(stored[0].unionByName(stored[1])), keep_all=True)


def spike_days(spark, folder):
    return patterns.spike_days(v.nation_day(spark, folder), value=PRICE).orderBy("country", "spike_day")


def surges(spark, folder):
    return rounded(patterns.surges(v.nation_day(spark, folder)), "total_new_shots", places=2)


def pattern_dispatch(spark, folder):
    mart = v.nation_day(spark, folder)
    stacked = None
    for name in (fixed.STREAKS, fixed.SPIKES, fixed.SURGES):
        shown = patterns.with_headings(patterns.find_pattern(mart, name), name)
        day = "Spike Day" if name == fixed.SPIKES else "Start Day"
        length = F.lit(None).cast("long") if name == fixed.SPIKES else F.col(
            "Streak Length (days)" if name == fixed.STREAKS else "Surge Length (days)"
        )
        part = shown.select(
            F.lit(name).alias("pattern"), F.col("Country").alias("country"), F.col(f"`{day}`").alias("day"), length.alias("n_days")
        )
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked


def match_tags(spark, folder):
    return patterns.tag_runs(v.nation_day(spark, folder), PRICE, 3)


def spike_points(spark, folder):
    return patterns.tag_spikes(v.nation_day(spark, folder), value=PRICE)


def tier_table(spark, folder):
    return tiers.tier_order(tiers.tiers(enriched(spark, folder)))


def tier_roster(spark, folder):
    return tiers.tier_roster(tiers.tiers(enriched(spark, folder))).orderBy("tier_ord", "country")


def tier_series(spark, folder):
    mart = enriched(spark, folder).select("country", "d", GDP, CASES)
    return rounded(tiers.tier_series(mart, tiers.tiers(mart), CASES), CASES, places=10)


def latest_snapshot(spark, folder):
    return snapshots.latest_snapshot(enriched(spark, folder), [GDP, "new_deaths"])


def yearly_snapshot(spark, folder):
    return snapshots.yearly_snapshot(enriched(spark, folder), [GDP, "new_deaths"])


def snapshot_correlation(spark, folder):
    points = snapshots.yearly_snapshot(enriched(spark, folder), [GDP, CASES])
    return rounded(snapshots.correlation(points, GDP, CASES), "correlation")


def entity_extract(spark, folder):
    named = [f"NATION_{i}" for i in range(12)]
    return snapshots.entity_series(v.nation_day(spark, folder), named, CASES)


def selected_entities(spark, folder):
    chosen = v.nation_year(spark, folder).select("country")
    return snapshots.keep_selected(v.nation_day(spark, folder).select("country", "d", "new_cases"), chosen)


def annotation_docs(spark, folder):
    return annotations.annotation_docs(v.topic_comments(spark, folder))


def annotation_range(spark, folder):
    """One key over some of its days."""
    docs = annotations.annotation_docs(v.topic_comments(spark, folder))
    return annotations.read_annotations(docs, "click", "NEW_CASES", "2024-01-05", "2024-01-12")


def annotated_comments(spark, folder):
    """The comments that belong to the days of a series."""
    days = metric_series.metric_series(v.user_day(spark, folder), "NEW_DEATHS")
    return annotations.comment_rows(v.user_comments(spark, folder), days)


def annotated_series(spark, folder):
    docs = annotations.annotation_docs(v.user_comments(spark, folder))
    answered = metric_series.metric_response(
        metric_series.metric_series(v.user_day(spark, folder), "NEW_DEATHS"), docs
    )
    return answered.select(
        "country",
        "date",
        "metric",
        "value",
        F.col("annotation.created_at").alias("created_at"),
        F.col("annotation.n_comments").alias("n_comments"),
    )


def exploded_docs(spark, folder):
    return annotations.comment_rows(v.user_comments(spark, folder))


def latest_comments(spark, folder):
    return annotations.latest_comments(v.topic_comments(spark, folder))


def comment_lines(spark, folder):
    asked = v.user_day(spark, folder).select("country").distinct().select("country", F.lit("NEW_DEATHS").alias("metric"))
    latest = annotations.latest_comments(v.user_comments(spark, folder))
    return annotations.comment_lines(latest, asked)


def comment_upserts(spark, folder):
    return annotations.upsert_counts(v.topic_comments(spark, folder), v.user_comments(spark, folder).unionByName(v.topic_comments(spark, folder)))


def comment_fanout(spark, folder):
    accepted = annotations.accepted_requests(v.comment_requests(spark, folder), v.alias(spark, folder), "1996-01-01", "2000-12-31")
    return accepted.groupBy("country", "date", "metric", "user", "text").agg(F.count(F.lit(1)).alias("n"))


def comment_batches(spark, folder):
    """Requests before a day and those from it on: what the second batch meets of the first, by its headers alone."""
    accepted = annotations.accepted_requests(v.comment_requests(spark, folder), v.alias(spark, folder), "1996-01-01", "2000-12-31")
    early = F.col("date") < F.lit("1998-01-01").cast("date")
    again = F.col("user").endswith("7")
    second = accepted.where(~early)
    # Two deltas of the first batch, as two appends would leave them.
    deltas = [
        annotations.annotation_docs(part.withColumn("ts", F.col("date").cast("timestamp_ntz"))) for part in (accepted.where(early), accepted.where(again & ~early))
    ]
    headers = annotations.merged_headers(deltas[0].unionByName(deltas[1]))
    return annotations.upsert_counts(headers, second).withColumn("accepted", second.agg(F.count(F.lit(1))).scalar())


def merged_documents(spark, folder):
    """Headers of the whole log from the headers of its batches, one a day."""
    log = v.topic_comments(spark, folder)
    deltas = log.groupBy(*annotations.KEYS, F.hour("ts").alias("batch")).agg(F.min("ts").alias("created_at"), F.count(F.lit(1)).alias("n_comments"))
    return annotations.merged_headers(deltas)


def densify_interpolate(spark, folder):
    return rounded(series.daily_interpolated(v.user_day(spark, folder), "new_deaths"), "new_deaths")


def weekly_mean(spark, folder):
    daily = series.daily_interpolated(v.user_day(spark, folder), PRICE)
    return rounded(series.weekly_mean(daily, PRICE), PRICE)


def look_back_weeks(spark, folder):
    days = series.look_back(v.user_day(spark, folder), "2024-01-26", 30, "2024-01-05")
    return rounded(series.weekly_mean(series.daily_interpolated(days, "new_cases"), "new_cases"), "new_cases")


def _requested(spark, folder):
    return v.table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("country"))


def diagnostics(spark, folder):
    points = v.user_day(spark, folder).where(F.col("new_deaths").isNotNull())
    stats = series.series_stats(series.daily_interpolated(points, "new_deaths"), "new_deaths")
    return series.series_report(_requested(spark, folder), stats).orderBy(F.desc("ok"), "country")


def feature_table(spark, folder):
    return rounded(
        features.series_features(v.user_day(spark, folder), PRICE),
        "growth", "volatility", "peak_level", "recent_mean", "recent_trend", places=8,
    )


def standardized_features(spark, folder):
    # Read twice, for the moments and for the rows.
    found = stage(features.series_features(v.user_day(spark, folder), PRICE))
    return rounded(features.standardize(found), *features.FEATURES, places=4)


def _run(spark, folder):
    return cluster_run.cluster_entities(v.user_day(spark, folder), PRICE, "2024-01-28", 60, "2024-01-02")


def clusters(spark, folder):
    return clustering.cluster_order(_run(spark, folder).labelled)


def pca_points(spark, folder):
    return rounded(_run(spark, folder).view, "pc1", "pc2", places=4)


def silhouette(spark, folder):
    return rounded(_run(spark, folder).silhouette, "silhouette", places=5)


def cluster_report(spark, folder):
    return _run(spark, folder).report.orderBy(F.desc("ok"), "country")


def silhouette_widths(spark, folder):
    """Silhouette of a labelling that SQL can state too: whether a user's recent mean exceeds the average."""
    found = stage(features.series_features(v.user_day(spark, folder), PRICE))
    scaled = features.standardize(found)
    labelled = scaled.withColumn("cluster", F.when(F.round("recent_mean", 9) > 0, 1).otherwise(0))
    return rounded(clustering.silhouette_widths(labelled), "width", places=4)


def forecast_series(spark, folder):
    """Every event type's series under weights that its name gives."""
    points = metric_series.metric_response(metric_series.metric_series(v.event_day(spark, folder), "NEW_CASES"))
    size = F.char_length("country")
    weighted = points.withColumns({"a": 0.1 + 0.05 * size, "b": 0.02 * size, "c": 0.3 - 0.02 * size, "p": 0.8 + 0.02 * size})
    return rounded(forecast.forecast_all(weighted, weights=("a", "b", "c", "p")), "value", places=4)


def forecast_fit(spark, folder):
    """How far the fit of every event type's series gets below the best point of the grid it starts from."""
    points = metric_series.metric_response(metric_series.metric_series(v.event_day(spark, folder), "NEW_CASES"))
    fitted = forecast.fit_series(points)
    return fitted.select(
        "country", "metric", F.date_from_unix_date("first").alias("first_day"), "n_days",
        F.round("start_error", 2).alias("start_error"), (F.col("squared_error") <= F.col("start_error")).alias("no_worse"),
    )


def forecast_request(spark, folder):
    """A whole request: some entities, a range, a horizon of their own; fitted values are counted, history is summed."""
    named = [f"NATION_{i}" for i in range(12)]
    return _counted(forecast_run.forecast_metric(v.nation_day(spark, folder), "new_cases", 21, "1996-03-01", "1996-12-31", named))


def _counted(segments):
    return segments.groupBy("country", "metric", "kind").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("date").alias("first_day"),
        F.max("date").alias("last_day"),
        F.round(F.sum(F.when(F.col("kind") == "history", F.col("value"))), 2).alias("history_total"),
    )


def forecast_history(spark, folder):
    """Every user's series: many short fits; history rows can be checked in SQL, forecasts by count."""
    points = metric_series.metric_response(metric_series.metric_series(v.user_day(spark, folder), PRICE.upper()))
    return _counted(forecast.forecast_all(points))


def column_profile(spark, folder):
    return rounded(
        profile.column_profile(v.table(spark, folder, "lineitem")), "mean", "std", "min_value", "max_value", "p25", "p50", "p75", places=4
    )


def mart_profile(spark, folder):
    mart = profile.infinities_to_null(enriched(spark, folder))
    return rounded(profile.column_profile(mart), "mean", "std", "min_value", "max_value", "p25", "p50", "p75", places=4)


def value_quartiles(spark, folder):
    found = quantiles.exact_quantiles(v.table(spark, folder, "events"), "value", [0.1, 0.5, 0.9], ["event_type"])
    return rounded(found, "min_value", "max_value", "q0", "q1", "q2")


def top_values(spark, folder):
    return frequent.frequent_values(v.table(spark, folder, "lineitem"))


def correlation_matrix(spark, folder):
    return rounded(profile.correlation_matrix(v.table(spark, folder, "lineitem")), "correlation")


def duplicate_rows(spark, folder):
    return profile.duplicate_rows(v.table(spark, folder, "lineitem"))


def chosen_entities(spark, folder):
    """The caller's own first-n choice."""
    days = v.nation_day(spark, folder).select("country", "d", "new_cases")
    return snapshots.keep_selected(days, days.select("country"), max_entities=7)


def pattern_request(spark, folder):
    """Streaks of some entities in a range, with the caller's own length; the case count is the day's turnover."""
    mart = v.nation_day(spark, folder).withColumn("new_cases", F.col(PRICE))
    named = [f"NATION_{i}" for i in range(12)]
    return pattern_query.pattern_matches(mart, fixed.STREAKS, "1996-03-01", "1999-06-30", named, min_len=2)


def pivot_back(spark, folder):
    """Metric rows as columns again, null where a day has no value."""
    mart = v.nation_day(spark, folder)
    names = [c.upper() for c in mart.columns if c.upper() in fixed.METRIC_COLUMNS]
    return snapshots.pivot_metrics(metric_series.all_metrics(mart, names), names)


def spike_request(spark, folder):
    """Every day of the range, spikes by the caller's own multiplier beside it."""
    return pattern_query.pattern_overlay(
        v.nation_day(spark, folder).select("country", "d", "new_cases"), fixed.SPIKES, "1996-03-01", "1999-06-30", multiplier=2.0
    )


def cluster_checks(spark, folder):
    """What holds for any good partition: all entities are in it, each has its own mean as the nearest, and it
    costs no more than splitting them by their recent mean."""
    run = _run(spark, folder)
    points = run.labels.select("country", "cluster", *features.FEATURES)
    means = points.groupBy("cluster").agg(F.array(*[F.avg(c) for c in features.FEATURES]).alias("m"))
    every = means.agg(F.collect_list(F.struct("cluster", "m"))).scalar()
    point = F.array(*features.FEATURES)
    away = F.transform("_means", lambda c: F.struct(F.aggregate(F.zip_with(point, c["m"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, x: t + x).alias("far"), c["cluster"].alias("of")))
    near = points.withColumn("_means", every).select("cluster", away.alias("_away"))
    own = F.filter("_away", lambda x: x["of"] == F.col("cluster"))[0]["far"]
    cost = near.agg(
        F.count(F.lit(1)).alias("n_entities"),
        F.sum((own > F.array_min(F.transform("_away", lambda x: x["far"])) + 1e-6).cast("long")).alias("misplaced"),
        F.sum(own).alias("cost"),
    )
    half = points.withColumn("side", F.round("recent_mean", 9) > 0).groupBy("side").agg(
        sum(F.var_pop(c) for c in features.FEATURES) * F.count(F.lit(1))
    ).toDF("side", "part")
    reference = half.agg(F.sum("part")).scalar()
    return cost.select("n_entities", "misplaced", (F.col("cost") <= reference).alias("no_worse_than_halves"))


def weekly_metric_series(spark, folder):
    """All metrics of the mart, filled and averaged by week, in one job: the metric is part of the entity."""
    long = metric_series.metric_response(metric_series.all_metrics(v.user_day(spark, folder)))
    keyed = long.select(F.concat_ws("/", "country", "metric").alias("country"), F.col("date").alias("d"), "value")
    return rounded(series.weekly_mean(series.daily_interpolated(keyed, "value"), "value"), "value")


QUERIES: dict[str, Query] = {
    "enriched_mart": enriched,
    "metric_series_long": metric_series_long,
    "metric_series": one_metric,
    "sql_series": sql_series,
    "date_span_defaults": date_span_defaults,
    "canonical_entities": canonical_entities,
    "asof_yearly": asof_yearly,
    "asof_union": asof_union,
    "two_metric_stack": two_metric_stack,
    "pivot_points": pivot_points,
    "pivot_back": pivot_back,
    "gdp_bars": gdp_bars,
    "melt_years": melt_years,
    "yearly_clean": yearly_clean,
    "yearly_csv": yearly_csv,
    "wide_csv": wide_csv,
    "yearly_last": yearly_last,
    "rising_streaks": rising_streaks,
    "stitched_streaks": stitched_streaks,
    "stitched_surges": stitched_surges,
    "span_overlay": span_overlay,
    "spike_days": spike_days,
    "surges": surges,
    "pattern_dispatch": pattern_dispatch,
    "match_tags": match_tags,
    "spike_points": spike_points,
    "eligible_metrics": eligible_metrics,
    "coverage_gaps": coverage_gaps,
    "coverage_counts": coverage_counts,
    "tiers": tier_table,
    "tier_roster": tier_roster,
    "tier_series": tier_series,
    "latest_snapshot": latest_snapshot,
    "yearly_snapshot": yearly_snapshot,
    "snapshot_correlation": snapshot_correlation,
    "entity_extract": entity_extract,
    "selected_entities": selected_entities,
    "annotation_docs": annotation_docs,
    "annotated_series": annotated_series,
    "exploded_docs": exploded_docs,
    "latest_comments": latest_comments,
    "comment_lines": comment_lines,
    "comment_upserts": comment_upserts,
    "comment_fanout": comment_fanout,
    "comment_batches": comment_batches,
    "merged_documents": merged_documents,
    "annotation_range": annotation_range,
    "annotated_comments": annotated_comments,
    "densify_interpolate": densify_interpolate,
    "weekly_mean": weekly_mean,
    "weekly_metric_series": weekly_metric_series,
    "look_back_weeks": look_back_weeks,
    "diagnostics": diagnostics,
    "features": feature_table,
    "standardized_features": standardized_features,
    "clusters": clusters,
    "cluster_checks": cluster_checks,
    "pca_points": pca_points,
    "silhouette": silhouette,
    "silhouette_widths": silhouette_widths,
    "cluster_report": cluster_report,
    "forecast": forecast_series,
    "forecast_fit": forecast_fit,
    "forecast_request": forecast_request,
    "forecast_segments": forecast_history,
    "column_profile": column_profile,
    "mart_profile": mart_profile,
    "value_quartiles": value_quartiles,
    "top_values": top_values,
    "correlation_matrix": correlation_matrix,
    "duplicate_rows": duplicate_rows,
    "chosen_entities": chosen_entities,
    "pattern_request": pattern_request,
    "spike_request": spike_request,
}
