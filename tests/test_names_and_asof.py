import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from daymart.functions import fixed_values as fixed
from daymart.operators import asof, canonical
from daymart.plans import metric_series
from tests.conftest import day

YEARLY = "country string, year int, gdp_ppp_per_capita double"


@pytest.fixture(scope="module")
def alias(spark):
    rows = [("usa", "United States"), ("USA", "United States"), ("Usa", "Zed"), (None, "X"), ("y", None)]
    return spark.createDataFrame(rows, "alias string, canonical string")


def test_duplicate_aliases_do_not_multiply_rows(spark, alias):
    df = spark.createDataFrame([("UsA",), ("France",), (None,)], "country string")
    got = sorted(str(r.country) for r in canonical.canonicalize(df, alias).collect())
    assert got == ["France", "None", "United States"]


def test_typed_names_are_trimmed(spark, alias):
    df = spark.createDataFrame([(" usa ",), (" Chad ",)], "country string")
    assert sorted(r.country for r in canonical.canonicalize(df, alias, trimmed=True).collect()) == ["Chad", "United States"]


def test_distinct_and_eligible(spark, alias):
    mart = spark.createDataFrame([("usa",), ("USA",), ("Chad",), ("",), (None,)], "country string")
    assert sorted(r.country for r in canonical.distinct_entities(mart, alias).collect()) == ["Chad", "United States"]
    yearly = spark.createDataFrame([("United States", 2000, 1.0)], YEARLY)
    names = spark.createDataFrame([("usa",), ("Chad",)], "country string")
    flagged = canonical.gdp_eligibility(names, yearly, alias)
    assert {r.country: r.gdp_allowed for r in flagged.collect()} == {"usa": True, "Chad": False}
    chosen = canonical.metric_choices(flagged).groupBy("country").count().collect()
    assert {r.country: r["count"] for r in chosen} == {"usa": 13, "Chad": 11}


def test_catalogue_helpers():
    assert len(metric_series.allowed_metrics()) == 15
    assert set(fixed.GDP_METRICS) <= set(metric_series.allowed_metrics())


def test_coverage(spark):
    a = spark.createDataFrame([(" x ",), ("y",)], "country string")
    b = spark.createDataFrame([("x",), ("z",)], "country string")
    gaps = canonical.coverage_gaps(a, b)
    assert {(r.country, r.missing_in) for r in gaps.collect()} == {("y", "right"), ("z", "left")}
    assert {r.missing_in: r.n_missing for r in canonical.gap_counts(gaps).collect()} == {"left": 1, "right": 1}


def test_asof_edges(spark):
    days = spark.createDataFrame(
        [("a", day("1999-12-31")), ("a", day("2000-01-01")), ("a", day("2005-06-01")), ("B", day("2001-01-01")), ("c", day("2001-01-01"))],
        "country string, d date",
    )
    yearly = spark.createDataFrame([("A", 2000, 1.0), ("A", 2003, 3.0), ("A", 2003, 2.0), ("b", 2001, 9.0)], YEARLY)
    got = {(r.country, r.d.year): r.gdp_ppp_per_capita for r in asof.asof_join(days, yearly).collect()}
    assert got == {("a", 1999): None, ("a", 2000): 1.0, ("a", 2005): 3.0, ("B", 2001): 9.0, ("c", 2001): None}


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    years=st.lists(st.tuples(st.sampled_from("ab"), st.integers(1995, 2005), st.integers(0, 5).map(float)), min_size=1, max_size=12),
    days=st.sets(st.tuples(st.sampled_from("abc"), st.integers(1994, 2006)), min_size=1, max_size=12),
)
def test_intervals_equal_the_literal_form(spark, years, days):
    left = spark.createDataFrame([(c, day(f"{y}-07-01")) for c, y in days], "country string, d date")
    right = spark.createDataFrame(years, YEARLY)
    got = {(r.country, r.d.year): r.gdp_ppp_per_capita for r in asof.asof_join(left, right).collect()}
    want = {}
    for c, y in days:
        earlier = [(year, v) for name, year, v in years if name == c and year <= y]
        want[(c, y)] = max(earlier)[1] if earlier else None
    assert got == want


@pytest.mark.parametrize("unique_days", [True, False])
def test_enriched_mart_merges_aliased_names(spark, unique_days):
    mart = spark.createDataFrame(
        [("USA", day("2001-01-01"), 1.0), ("United States", day("2001-01-01"), 2.0), ("usa", day("2001-01-02"), 3.0), ("Chad", day("2001-01-01"), 4.0)],
        "country string, d date, new_cases double",
    )
    alias = spark.createDataFrame([("usa", "United States")], "alias string, canonical string")
    yearly = spark.createDataFrame([("united states", 2000, 7.0)], YEARLY)
    got = sorted(tuple(r) for r in asof.enrich_mart(mart, yearly, alias, unique_days).collect())
    assert got == [
        ("Chad", day("2001-01-01"), 4.0, None),
        ("United States", day("2001-01-01"), 1.0, 7.0),
        ("United States", day("2001-01-02"), 3.0, 7.0),
    ]


def test_stack_keeps_null_cases_but_needs_gdp(spark):
    days = spark.createDataFrame([("a", day("2001-01-01"), None), ("b", day("2001-01-01"), 1.0)], "country string, d date, new_cases_per_100k double")
    yearly = spark.createDataFrame([("a", 2000, 7.0)], YEARLY)
    got = metric_series.metric_series(days, "gdp_vs_cases_per100k_year", yearly=yearly)
    assert sorted((r.country, r.metric, r.value) for r in got.collect()) == [("a", "GDP_PPP_PER_CAPITA", 7.0), ("a", "NEW_CASES_PER_100K", None)]


def test_metric_series_range_names_and_errors(spark):
    mart = spark.createDataFrame(
        [("Chad", day("2001-01-01"), 1.0), ("Chad", day("2001-01-02"), None), ("Mali", day("2001-01-02"), 3.0)],
        "country string, d date, new_cases double",
    )
    got = metric_series.metric_series(mart, "new_Cases", "2001-01-02", "2001-01-02", ["CHAD"])
    assert [(r.country, r.metric, r.value) for r in got.collect()] == [("Chad", "NEW_CASES", None)]
    assert [r.value for r in metric_series.metric_response(got).collect()] == [0.0]
    with pytest.raises(ValueError, match="allowed"):
        metric_series.metric_series(mart, "nope")
    with pytest.raises(ValueError):
        metric_series.metric_series(mart, fixed.GDP_METRIC)


def test_timestamps_after_midnight_of_the_last_day_are_kept(spark):
    mart = spark.createDataFrame([("a", "2001-01-02 15:00:00", 1.0)], "country string, d string, new_cases double")
    mart = mart.withColumn("d", F.col("d").cast("timestamp_ntz"))
    assert metric_series.metric_series(mart, "NEW_CASES", "2001-01-01", "2001-01-02").count() == 1


def test_chart_frame_is_empty_with_columns_when_nobody_is_eligible(spark):
    mart = spark.createDataFrame([("a", day("2001-01-01"), 1.0)], "country string, d date, new_cases_per_100k double")
    yearly = spark.createDataFrame([("b", 2000, 7.0)], YEARLY)
    alias = spark.createDataFrame([], "alias string, canonical string")
    frame = metric_series.chart_frame(mart, yearly, alias, fixed.GDP_VS_CASES_METRIC)
    assert frame.count() == 0 and "bubble_size" in frame.columns
