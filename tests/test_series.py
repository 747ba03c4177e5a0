import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from daymart.functions import scalars
from daymart.operators import features, series
from tests.conftest import day


def daily(df):
    rows = series.daily_interpolated(df, "v").orderBy("country", "d").collect()
    out = {}
    for r in rows:
        out.setdefault(r.country, []).append(r.v)
    return out


def test_trailing_repeats_leading_stays_unknown(make_series):
    df = make_series({"a": [1.0, 2.0, None, None], "b": [None, 2.0, None, 5.0], "c": [None, None]})
    assert daily(df) == {"a": [1.0, 2.0, 2.0, 2.0], "b": [None, 2.0, 3.5, 5.0], "c": [None, None]}


def test_missing_days_are_filled(make_series):
    assert daily(make_series({"a": [0.0, "skip", "skip", 3.0]})) == {"a": [0.0, 1.0, 2.0, 3.0]}


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.sampled_from([None, "skip", 1.0, 2.0, 7.0]), min_size=1, max_size=30))
def test_filling_agrees_with_pandas(make_series, values):
    kept = [(i, v) for i, v in enumerate(values) if v != "skip"]
    if not kept:
        return
    index = pd.date_range("2024-01-01", periods=len(values), freq="D")[[i for i, _ in kept]]
    want = pd.Series([np.nan if v is None else v for _, v in kept], index=index).asfreq("D").interpolate("time")
    got = daily(make_series({"a": values}))["a"]
    assert np.allclose([np.nan if v is None else v for v in got], want.to_numpy(), equal_nan=True)


def test_weeks_end_on_sunday(spark):
    df = spark.createDataFrame([(day("2024-01-07"),), (day("2024-01-08"),), (day("2024-01-13"),)], "d date")
    got = [r[0] for r in df.select(scalars.week_ending(F.col("d"))).collect()]
    assert got == [day("2024-01-07"), day("2024-01-14"), day("2024-01-14")]


def test_yearly_last_shows_gap_years(spark):
    rows = [("a", "2020-01-01", 1.0), ("a", "2020-05-01", None), ("a", "2022-03-01", 3.0)]
    df = spark.createDataFrame(rows, "country string, date string, value double").withColumn("date", F.to_date("date"))
    got = [(r.year, r.value) for r in series.yearly_last(df).orderBy("year").collect()]
    assert got == [(2020, 1.0), (2021, None), (2022, 3.0)]


def test_features_by_hand(make_series):
    """Five weeks from Monday 2024-01-01, each of one value, so that the weekly means are those values."""
    weeks = {
        "flat": [0, 0, 0, 0, 0],
        "climb": [1, 2, 4, 4, 4],
        "drop": [8, 8, 4, 2, 1],
    }
    got = {r.country: r for r in features.series_features(make_series({k: [float(x) for x in v for _ in range(7)] for k, v in weeks.items()}), "v").collect()}
    want = {
        # growth, volatility, peak, days to peak, mean of four weeks, trend over the last four
        "flat": (0.0, 0.0, 0.0, 0, 0.0, 0.0),
        # changes 1, 1, 0, 0: deviations of (1, 1, 0) and (1, 0, 0) are both 0.5773502692
        "climb": (3.0, 0.5773502692, 4.0, 14, 3.5, 1.0),
        # changes 0, -1/2, -1/2, -1/2: deviations 0.2886751346 and 0
        "drop": (-0.875, 0.1443375673, 8.0, 0, 3.75, -0.875),
    }
    names = ("growth", "volatility", "peak_level", "time_to_peak", "recent_mean", "recent_trend")
    for name, numbers in want.items():
        assert [got[name][n] for n in names] == pytest.approx(list(numbers), abs=1e-5), name


def test_few_weeks_give_no_features(make_series):
    assert features.series_features(make_series({"a": [1.0] * 15}), "v").count() == 0


def test_standardize_uses_population_deviation_and_keeps_constants_at_zero(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("b", 3.0, 5.0)], "country string, x double, y double")
    rows = features.standardize(df, ["x", "y"]).orderBy("country").collect()
    assert [(r.x, r.y) for r in rows] == [(-1.0, 0.0), (1.0, 0.0)]


def test_report_reasons(spark, make_series):
    df = make_series({"long": [1.0] * 40, "short": [1.0] * 10})
    stats = series.series_stats(series.daily_interpolated(df, "v"), "v")
    asked = spark.createDataFrame([("long",), ("short",), ("absent",)], "country string")
    got = {r.country: (r.ok, r.reason, r.len) for r in series.series_report(asked, stats).collect()}
    assert got == {
        "long": (True, "", 40),
        "short": (False, "insufficient-weekly-points", 10),
        "absent": (False, "empty-or-non-datetime", 0),
    }


def test_look_back_keeps_both_ends(make_series):
    df = make_series({"a": [1.0] * 60})
    assert series.look_back(df, "2024-02-15", 30).count() == 31
    assert series.look_back(df, "2024-02-15", 30, "2024-02-01").count() == 15
    assert series.look_back(df, "2024-02-15", 0).count() == 1


def test_valid_points_reads_text_leniently(spark):
    rows = [("2024-01-01", "1.5"), ("2024-13-01", "1"), ("2024-01-02", "x"), ("2024-01-03", "NaN"), ("2024-01-04", "2d")]
    df = spark.createDataFrame(rows, "date string, value string")
    assert [(r.date, r.value) for r in series.valid_points(df).collect()] == [(day("2024-01-01"), 1.5)]


def test_clamp_and_swap(spark):
    df = spark.createDataFrame([(None,), ("",), ("1999-01-01",), ("2021-05-05",), ("2030-01-01",)], "d string")
    got = [r[0].isoformat() for r in df.select(scalars.clamp_day(F.col("d"))).collect()]
    assert got == ["2020-01-01", "2020-01-01", "2020-01-01", "2021-05-05", "2023-12-31"]
    swapped = spark.range(1).select(scalars.ordered_range(F.lit("b"), F.lit("a")).alias("r")).first().r
    assert (swapped.start, swapped.end) == ("a", "b")
