import datetime

import pytest
from pyspark.sql import functions as F

from daymart.plans import enrichment_job
from daymart.sources import sinks, sql, tables
from daymart.operators import profile, snapshots
from tests.conftest import day


def test_yearly_csv(spark, tmp_path):
    path = tmp_path / "long.csv"
    path.write_text(" Sr. No , Country ,Year, GDP_PPP_Per_Capita \n1,Chad,2001,5.5\n2,Mali,n/a,3\n3,Togo,2002,\n4,Peru,2003.0,7\n")
    got = sorted(tuple(r) for r in tables.read_yearly_csv(spark, str(path)).collect())
    assert got == [("Chad", 2001, 5.5), ("Peru", 2003, 7.0)]
    with pytest.raises(Exception):
        tables.read_yearly_csv(spark, str(tmp_path / "absent.csv")).collect()


def test_wide_csv_melts(spark, tmp_path):
    path = tmp_path / "wide.csv"
    path.write_text("Sr.No,Country, 2001 ,2002\n1,Chad,1.5,\n2,Mali,,2\n")
    got = snapshots.melt_years(tables.read_wide_csv(spark, str(path)), ["country"])
    assert sorted(tuple(r) for r in got.collect()) == [("Chad", 2001, 1.5), ("Mali", 2002, 2.0)]


@pytest.fixture(scope="module")
def mart(spark):
    rows = [(c, day("2020-12-30") + datetime.timedelta(days=i), float(i), float(i) / 2) for c in ("a", "b", "c") for i in range(6)]
    return spark.createDataFrame(rows, "country string, d date, new_cases double, new_cases_per_100k double")


def test_a_large_year_is_written_by_several_tasks(spark, tmp_path):
    year = spark.range(4_000).selectExpr("concat('c', id % 40) country", "date_add(date'2020-01-01', int(id / 40)) d", "double(id) new_cases")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert sinks.write_mart(year, str(tmp_path / "mart")) == 4_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(list((tmp_path / "mart" / "year=2020").glob("*.parquet"))) > 4


def test_mart_round_trip_prunes(spark, mart, tmp_path):
    path = str(tmp_path / "mart")
    assert sinks.write_mart(mart, path) == 18
    read = tables.read_mart(spark, path, ["new_cases"], "2021-01-01", "2021-01-02", ["a"])
    assert read.count() == 2
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    assert "new_cases_per_100k" not in plan
    assert "EqualTo(country,a)" in plan or "In(country" in plan


def test_overwrite_csv_json_and_bucketed(spark, mart, tmp_path):
    path = str(tmp_path / "t")
    assert sinks.write_table(mart, path) == 18
    assert sinks.write_table(mart.limit(4), path) == 4
    sinks.write_csv(mart, str(tmp_path / "csv"), ["country", "d"])
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.count() == 18 and back.columns == mart.columns
    sinks.write_json(mart, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 18
    sinks.write_bucketed(mart, "mart_bucketed", 4)
    plan = spark.table("mart_bucketed").groupBy("country").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    spark.sql("DROP TABLE mart_bucketed")


def test_bound_sql(spark, mart):
    got = sql.run_sql(spark, "SELECT country, new_cases FROM {m} WHERE country = :c AND d >= :from", {"c": "a", "from": day("2021-01-03")}, m=mart)
    assert [tuple(r) for r in got.collect()] == [("a", 4.0), ("a", 5.0)]


def test_profile_edges(spark):
    df = spark.createDataFrame([(1.0, "x"), (float("inf"), None), (None, "x"), (-2.0, "y")], "n double, s string")
    clean = profile.infinities_to_null(df)
    got = {r.column_name: r for r in profile.column_profile(clean).collect()}
    assert (got["n"].n_rows, got["n"].n_null, got["n"].n_distinct, got["n"].n_negative, got["n"].p50) == (4, 2, 2, 1, -0.5)
    assert (got["s"].n_null, got["s"].n_distinct, got["s"].mean) == (1, 2, None)
    rough = {r.column_name: r.n_distinct for r in profile.column_profile(clean, exact_distinct=False).collect()}
    assert rough == {"n": 2, "s": 2}
    assert profile.duplicate_rows(df.unionByName(df)).first().n_duplicates == 4


def test_nightly_job(spark, mart, tmp_path):
    yearly = spark.createDataFrame([("a", 2020, 1.0), ("b", 2019, 2.0), ("b", 2021, 4.0)], "country string, year int, gdp_ppp_per_capita double")
    alias = spark.createDataFrame([("zz", "a")], "alias string, canonical string")
    out = str(tmp_path / "out")
    assert enrichment_job.run(spark, mart, yearly, alias, out, entities=["a", "c"]) == {"yearly": 3, "enriched": 18}
    read = lambda name: spark.read.option("header", True).csv(f"{out}/{name}")
    assert read("enriched_csv").count() == 18
    assert read("tiers_csv").count() == 3
    assert read("tier_roster").count() == 2
    assert read("series_new_cases_per_100k").select("country").distinct().count() == 2
    assert read("by_tier_new_cases_per_100k").count() == 18
    assert read("latest_new_cases_per_100k").count() == 2
    assert read("by_year_new_cases_per_100k").count() == 4
    assert read("profile").where(F.col("column_name") == "country").first().n_distinct == "3"
