import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from daymart.operators import quantiles, snapshots, tiers
from tests.conftest import day


def tier_list(spark, values):
    df = spark.createDataFrame([(f"c{i:02}", v) for i, v in enumerate(values)], "country string, gdp_ppp_per_capita double")
    return [r.tier_ord for r in tiers.tiers(df).orderBy("country").collect()]


@pytest.mark.parametrize(
    "values, expected",
    [
        ([1.0, 2.0, 3.0, 4.0, 5.0, 6.0], [0, 0, 1, 1, 2, 2]),
        ([1.0, 1.0, 1.0, 1.0, 2.0, 3.0], [0, 0, 0, 0, 1, 2]),
        ([2.0, 2.0, 2.0], [1, 1, 1]),
        ([1.0, None, 2.0, 3.0], [0, None, 1, 2]),
        ([None, None], [None, None]),
    ],
)
def test_tier_contract(spark, values, expected):
    assert tier_list(spark, values) == expected


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5).map(float)), min_size=1, max_size=40), st.sampled_from([(0.5,), (1 / 3, 2 / 3), (0.0, 1.0)]))
def test_quantiles_are_exact(spark, values, probabilities):
    known = [v for v in values if v is not None]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    rows = quantiles.exact_quantiles(df, "v", probabilities, ["g"]).collect()
    if not known:
        assert rows == []
        return
    got = [rows[0][f"q{i}"] for i in range(len(probabilities))]
    assert np.allclose(got, np.quantile(known, probabilities))


@pytest.mark.parametrize("groups", [[], ["g"]])
def test_quantiles_beyond_the_sketch(spark, groups):
    """Enough rows for narrow bands, a third of them one value."""
    df = spark.range(60_000).select(
        F.when(F.col("id") < 20_000, 0.5).otherwise(F.rand(7) * F.rand(8)).alias("v"), F.lit("x").alias("g")
    ).persist()
    values = np.array([r.v for r in df.collect()])
    probabilities = [0.01, 0.25, 1 / 3, 0.5, 2 / 3, 0.75, 0.999]
    row = quantiles.exact_quantiles(df, "v", probabilities, groups).first()
    assert np.allclose([row[f"q{i}"] for i in range(7)], np.quantile(values, probabilities), rtol=1e-12)
    assert row.n == 60_000


def test_roster_and_series(spark):
    mart = spark.createDataFrame(
        [("a", day("2024-01-01"), 1.0, 10.0), ("b", day("2024-01-01"), 2.0, None), ("c", day("2024-01-01"), 3.0, 30.0), ("d", day("2024-01-02"), None, 5.0), ("a", day("2024-01-02"), 1.0, 20.0)],
        "country string, d date, gdp_ppp_per_capita double, v double",
    )
    tiered = tiers.tiers(mart)
    roster = tiers.tier_roster(tiered).orderBy("tier_ord", "country").collect()
    assert [(r.gdp_tier, r.n_members, r.country) for r in roster] == [("Low GDP", 1, "a"), ("Mid GDP", 1, "b"), ("High GDP", 1, "c")]
    full = {(r.d.day, r.tier_ord): r.v for r in tiers.tier_series(mart, tiered, "v").collect()}
    assert full == {(1, 0): 10.0, (1, 1): None, (1, 2): 30.0, (2, 0): 20.0, (2, 1): None, (2, 2): None}
    assert tiers.tier_series(mart, tiered, "v", every_tier=False).count() == 3


def test_snapshot_and_yearly_snapshot_differ_on_a_null_last_day(spark):
    rows = [("a", day("2024-01-01"), 1.0, 5.0), ("a", day("2024-01-02"), 1.0, None), ("b", day("2024-01-01"), 2.0, 6.0)]
    df = spark.createDataFrame(rows, "country string, d date, g double, v double")
    assert [r.country for r in snapshots.latest_snapshot(df, ["g", "v"]).collect()] == ["b"]
    yearly = {r.country: (r.d.day, r.v) for r in snapshots.yearly_snapshot(df, ["g", "v"]).collect()}
    assert yearly == {"a": (1, 5.0), "b": (1, 6.0)}


def test_pivot_refuses_duplicates_and_undoes_unpivot(spark):
    wide = spark.createDataFrame([("a", day("2024-01-01"), 1.0, None), ("b", day("2024-01-02"), 2.0, 3.0)], "country string, date date, x double, y double")
    long = wide.unpivot(["country", "date"], ["x", "y"], "metric", "value")
    assert sorted(map(str, snapshots.pivot_metrics(long, ["x", "y"]).drop("year").collect())) == sorted(map(str, wide.collect()))
    with pytest.raises(Exception, match="more than one"):
        snapshots.pivot_metrics(long.unionByName(long), ["x", "y"]).collect()


def test_bubbles(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 4.0), ("a", 0.0, 9.0), ("b", 1.0, 0.0)], "country string, x double, y double")
    got = snapshots.bubble_points(df, "x", "y").orderBy("y").collect()
    assert [(r.country, r.bubble_size) for r in got] == [("a", 26.0), ("a", 46.0)]
    assert [r.bubble_size for r in snapshots.bubble_points(df, "x", "y", None).orderBy("y").collect()] == [6.0, 26.0, 46.0]


def test_melt(spark):
    wide = spark.createDataFrame([("a", 1.0, None), ("b", None, 2.0)], "country string, `2001` double, `2002` double")
    got = sorted(tuple(r) for r in snapshots.melt_years(wide, ["country"]).collect())
    assert got == [("a", 2001, 1.0), ("b", 2002, 2.0)]
    with pytest.raises(ValueError):
        snapshots.melt_years(wide.withColumnRenamed("2001", "x"), ["country"])


def test_selection_and_extract(spark):
    df = spark.createDataFrame([("a", day("2024-01-01"), 1.0), ("b", day("2024-01-01"), 2.0), ("c", day("2024-01-01"), 3.0)], "country string, d date, v double")
    chosen = spark.createDataFrame([("b",), ("c",), ("zz",)], "country string")
    assert sorted(r.country for r in snapshots.keep_selected(df, chosen).collect()) == ["b", "c"]
    assert [r.country for r in snapshots.keep_selected(df, chosen, max_entities=1).collect()] == ["b"]
    assert snapshots.entity_series(df, ["a"], "v").count() == 1
    assert snapshots.entity_series(df, ["a"], "absent").count() == 0
