"""What the physical plans must look like, and results when one key holds a third of all rows."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from daymart.operators import annotations, asof, patterns, profile, quantiles, series, snapshots
from daymart.operators.features import series_features
from tests.conftest import SMALL
from workload import views


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df) -> int:
    return len(re.findall(r"Exchange hashpartitioning", plan_of(df)))


@pytest.fixture(scope="module")
def mart(spark, tmp_path_factory):
    """A stored mart, so that plans start at a scan."""
    path = str(tmp_path_factory.mktemp("mart") / "m")
    views.nation_day(spark, SMALL).write.parquet(path)
    return spark.read.parquet(path)


def test_runs_take_one_shuffle(mart):
    assert exchanges(patterns.rising_runs(mart, "new_cases", 3)) == 1
    assert exchanges(patterns.tag_runs(mart, "new_cases", 3)) == 1
    assert exchanges(patterns.spike_days(mart)) == 1


def test_features_take_one_shuffle(mart):
    assert exchanges(series_features(mart, "new_cases")) == 1
    assert exchanges(series.series_stats(series.daily_interpolated(mart, "new_cases"), "new_cases")) == 1


@pytest.fixture(scope="module")
def yearly(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("yearly") / "y")
    views.nation_year(spark, SMALL).write.parquet(path)
    return spark.read.parquet(path)


def test_small_yearly_table_is_broadcast_and_days_stay_put(mart, yearly):
    joined = asof.asof_join(mart, yearly)
    # The yearly table alone is shuffled, for its intervals.
    assert exchanges(joined) <= 2 and "BroadcastHashJoin" in plan_of(joined)


def test_large_yearly_table_is_shuffled(spark, mart, yearly):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = asof.asof_join(mart, yearly)
        assert "SortMergeJoin" in plan_of(joined) and "Broadcast" not in plan_of(joined)
        large = sorted(map(str, joined.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert large == sorted(map(str, asof.asof_join(mart, yearly).collect()))


def test_only_aliased_names_are_compared(spark, mart):
    plan = plan_of(asof.enrich_mart(mart, views.nation_year(spark, SMALL), views.alias(spark, SMALL)))
    assert plan.count("WindowGroupLimit") == 2
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_snapshots_hash_without_sorting(mart):
    plan = plan_of(snapshots.latest_snapshot(mart, ["new_cases", "new_deaths"]))
    assert "HashAggregate" in plan and "Sort" not in plan and "Join" not in plan


def test_newest_comments_are_limited_before_the_shuffle(spark):
    plan = plan_of(annotations.latest_comments(views.topic_comments(spark, SMALL)))
    assert re.search(r"Final(.|\n)*Exchange(.|\n)*Partial", plan)


def test_columns_and_filters_reach_the_scan(mart):
    from daymart.plans.metric_series import metric_series

    plan = plan_of(metric_series(mart, "NEW_DEATHS", "1996-01-01", "1997-01-01"))
    assert "ReadSchema: struct<country:string,d:date,new_deaths:double>" in plan
    assert "GreaterThanOrEqual(d" in plan


def test_skewed_comments(spark):
    """A third of 30,000 comments on one key, and all of them at one moment."""
    log = spark.range(30_000).select(
        F.col("id").cast("string").alias("comment_id"),
        F.when(F.col("id") < 10_000, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 5_000)).alias("country"),
        F.lit("2024-01-01").cast("date").alias("date"),
        F.lit("M").alias("metric"),
        F.lit("u").alias("user"),
        F.lit("same text").alias("text"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("ts"),
    )
    docs = annotations.annotation_docs(log)
    assert docs.agg(F.sum("n_comments")).first()[0] == 30_000
    assert docs.where("country = 'hot'").first().n_comments == 10_000
    latest = annotations.latest_comments(log)
    assert latest.where("country = 'hot'").count() == 200
    assert latest.count() == 200 + 20_000


def test_quantiles_take_four_passes_at_most(spark, monkeypatch):
    """Whatever the size and the magnitudes; every window has at most PARTS rows of a group and part."""
    passes = []
    inner = quantiles._counted

    def watched(rows, digit, *keys):
        counted = inner(rows, digit, *keys)
        passes.append(counted.groupBy(*keys).count().agg(F.max("count")).first()[0])
        return counted

    monkeypatch.setattr(quantiles, "_counted", watched)
    for n in (20_000, 400_000):
        passes.clear()
        df = spark.range(n).select((F.col("id") * 7919 % n).cast("double").alias("x"))
        got = quantiles.exact_quantiles(df, "x", [0.0, 0.37, 0.5, 1.0]).first()
        assert [got.q0, got.q1, got.q2, got.q3] == pytest.approx([0, 0.37 * (n - 1), 0.5 * (n - 1), n - 1])
        assert len(passes) <= quantiles.PASSES and max(passes) <= quantiles.PARTS
    passes.clear()
    wide = spark.range(30_000).select(F.pow(F.lit(10.0), (F.rand(3) - 0.5) * 600).alias("x"), F.when(F.col("id") % 3 > 0, "g").alias("g")).persist()
    for row in quantiles.exact_quantiles(wide, "x", [0.1, 0.5, 0.9], ["g"]).collect():
        values = [r.x for r in wide.where(F.col("g").eqNullSafe(F.lit(row.g))).collect()]
        assert [row.q0, row.q1, row.q2] == pytest.approx(list(np.quantile(values, [0.1, 0.5, 0.9])), rel=1e-12)
    assert len(passes) <= 4
    wide.unpersist()


def test_quantiles_of_extreme_values(spark):
    values = [-1.7e308, 1.7e308, 0.0, 1e-300, 2e-300, 3e-300, 5.0, 5.0, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = quantiles.exact_quantiles(df, "x", [0.25, 0.5]).first()
    want = df.agg(F.expr("percentile(x, array(0.25, 0.5))")).first()[0]
    assert [got.q0, got.q1] == pytest.approx(want) and got.n == 8


def test_skewed_values_in_the_profile(spark):
    df = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id").cast("double")).alias("x"))
    got = profile.column_profile(df).first()
    expected = df.agg(F.expr("percentile(x, 0.5)"), F.count_distinct("x")).first()
    assert (got.p50, got.n_distinct) == tuple(expected)
    assert profile.top_values(profile.value_counts(df), 1).first().value == "7.0"
