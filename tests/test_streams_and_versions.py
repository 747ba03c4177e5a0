"""As-of by union, run summaries, span tags, header deltas and tables replaced by commit."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from daymart.operators import annotations, asof, patterns
from daymart.sources import comments, versions
from tests.conftest import SMALL, day
from tests.test_plans_at_scale import plan_of
from workload import queries


def rows_of(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(7)
    names = ["chad", "Chad", "deu", "fra", None]
    days = [(rng.choice(names), day("1990-01-01") + datetime.timedelta(days=rng.randrange(12_000)), i) for i in range(1500)]
    days += [("chad", day("2001-05-05"), -1)] * 2 + [("chad", None, -2), ("none", day("2001-01-01"), -3)]
    yearly = [(rng.choice(names), rng.choice([1985, 1993, 1994, 1996, 2003, 2015, 2030, None]), rng.choice([None, 1.0, 2.0, 3.5])) for _ in range(25)]
    return (
        spark.createDataFrame(days, "country string, d date, i int").repartition(4),
        spark.createDataFrame(yearly, "country string, year int, gdp_ppp_per_capita double"),
    )


@pytest.mark.parametrize("span_years", [1, 4, 100])
def test_asof_by_union_equals_the_join(sides, span_years):
    days, yearly = sides
    known = yearly.where("year is not null")
    assert rows_of(asof.asof_union(days, yearly, span_years=span_years)) == rows_of(asof.asof_join(days, known))
    assert asof.asof_union(days.limit(0), yearly).count() == 0
    assert asof.asof_union(days, yearly.limit(0)).where("gdp_ppp_per_capita is null").count() == days.count()


def test_asof_by_union_joins_nothing_and_spreads_an_entity(spark, sides):
    plan = plan_of(asof.asof_union(*sides))
    assert "Join" not in plan and "Cartesian" not in plan
    assert "hashpartitioning(_key" in plan and "_span" in plan[plan.index("Window") :]


@pytest.mark.parametrize("least", [1, 2, 4])
def test_stitched_summaries_equal_the_runs_of_all_rows(spark, least):
    """Runs over one or several whole months, months of one row, missing months, nulls, ties."""
    rng = random.Random(least)
    rows = []
    for name in "abcdef":
        value = 0.0
        for i in range(0, 300, rng.choice([1, 1, 9])):
            if rng.random() < 0.1:
                continue
            value = None if rng.random() < 0.03 else (value or 0.0) + (1.0 if rng.random() < (0.97 if name < "d" else 0.6) else -float(rng.randint(0, 3)))
            rows.append((name, day("2024-01-01") + datetime.timedelta(days=i), value))
    rows += [("z", day("2024-03-31"), 1.0), ("z", day("2024-04-01"), 2.0), ("y", day("2024-02-10"), 5.0)]
    df = spark.createDataFrame(rows, "country string, d date, v double").repartition(3)
    want = patterns.rising_runs(df, "v", least)
    summaries = patterns.run_summaries(df, "v")
    assert rows_of(patterns.stitched_runs(summaries, least).select(want.columns)) == rows_of(want)
    # Months summarised apart, in any order, add up.
    apart = [patterns.run_summaries(df.where(F.month("d") == m), "v") for m in (4, 1, 2, 3, 5, 6, 7, 8, 9, 10)]
    whole = apart[0]
    for part in apart[1:]:
        whole = whole.unionByName(part)
    assert rows_of(patterns.stitched_runs(whole, least).select(want.columns)) == rows_of(want)
    assert summaries.count() < df.count()


def test_spans_are_found_by_week(spark):
    rng = random.Random(5)
    spans = [(rng.choice("ab"), n, day("2024-01-01") + datetime.timedelta(days=(s := rng.randrange(200))), day("2024-01-01") + datetime.timedelta(days=s + rng.randrange(-1, 30))) for n in range(60)]
    days = [(c, day("2024-01-01") + datetime.timedelta(days=i)) for c in "abc" for i in range(240)]
    days += [days[3], ("a", None), (None, day("2024-01-05"))]
    left = spark.createDataFrame(days, "country string, d date")
    right = spark.createDataFrame(spans, "country string, n int, start_day date, end_day date")
    want = [(c, d, n, s, e) for c, d in days for k, n, s, e in spans if c == k and d and s <= d <= e]
    tagged = patterns.tag_spans(left, right)
    assert sorted(map(tuple, tagged.collect())) == sorted(want)
    every = patterns.tag_spans(left, right, keep_all=True)
    held = {(c, d) for c, d, *_ in want}
    assert every.count() == len(want) + sum((c, d) not in held for c, d in days)
    plan = plan_of(tagged)
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_pattern_request_finds_something(spark):
    assert queries.pattern_request(spark, SMALL).count() > 0


def test_batches_read_headers_only(spark, tmp_path, monkeypatch):
    alias = spark.createDataFrame([("deu", "Germany")], "alias string, canonical string")

    def batch(*rows):
        return spark.createDataFrame([(list(c), d, "M", "me", t) for c, d, t in rows], "countries array<string>, date string, metric string, user string, comment string")

    path = str(tmp_path / "log")
    monkeypatch.setattr(comments, "read_comments", lambda *_: pytest.fail("the log was read"))
    assert comments.append_comments(batch((["deu", "Chad"], "2021-01-01", "a")), alias, path) == {"matched": 0, "created": 2}
    assert comments.append_comments(batch((["Germany"], "2021-01-01", "b"), (["Germany"], "2021-01-02", "c"), (["Germany"], "2021-01-02", "d")), alias, path) == {"matched": 2, "created": 1}
    monkeypatch.undo()
    want = rows_of(annotations.annotation_docs(comments.read_comments(spark, path)))
    for change in (None, comments.compact_headers, comments.rebuild_headers):
        if change:
            change(spark, path)
        columns = ["country", "date", "metric", "created_at", "n_comments"]
        assert rows_of(comments.read_headers(spark, path).select(columns)) == want
    assert comments.append_comments(batch((["Chad"], "2021-01-01", "e")), alias, path) == {"matched": 1, "created": 0}
    assert len(list((tmp_path / "log_headers").iterdir())) == 2


@pytest.fixture
def mart(spark):
    return spark.range(40).select((F.col("id") % 4 + 2000).cast("int").alias("year"), F.col("id").alias("v"))


def broken(df):
    """The same rows, but a task fails once part of them is written."""
    fail = F.raise_error("lost").cast("bigint")
    return df.repartition(4).withColumn("v", F.when(F.col("v") == 17, fail).otherwise(F.col("v")))


def test_a_failed_write_leaves_the_table(spark, mart, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        versions.read_table(spark, path)
    assert versions.replace_table(mart.limit(30), path) == 30
    reader = versions.read_table(spark, path)
    with pytest.raises(Exception, match="lost"):
        versions.replace_table(broken(mart), path)
    assert versions.read_table(spark, path).count() == 30 == versions.table_rows(spark, path)
    assert versions.replace_table(mart, path) == 40
    assert versions.read_table(spark, path).count() == 40 and reader.count() == 30
    assert len(versions.expire_versions(spark, path)) == 2
    assert rows_of(versions.read_table(spark, path)) == rows_of(mart)


def test_partitions_are_replaced_and_others_kept(spark, mart, tmp_path):
    path = str(tmp_path / "t")
    assert versions.replace_table(mart, path, "year") == 40
    new = mart.where("year in (2001, 2003) and v < 20").union(spark.createDataFrame([(None, -1), (2010, -2)], mart.schema))
    assert versions.replace_partitions(new, path) == 12
    want = mart.where("year not in (2001, 2003)").unionByName(new)
    assert rows_of(versions.read_table(spark, path)) == rows_of(want) and versions.table_rows(spark, path) == 32
    with pytest.raises(Exception, match="lost"):
        versions.replace_partitions(broken(mart), path)
    assert rows_of(versions.read_table(spark, path)) == rows_of(want)
    assert versions.replace_partitions(mart.where("v < 0"), path) == 0
    assert versions.replace_partitions(spark.createDataFrame([(None, -7)], mart.schema), path) == 1
    assert versions.read_table(spark, path).where("year is null").first().v == -7
    plan = plan_of(versions.read_table(spark, path).where("year = 2002"))
    assert "PartitionFilters: [isnotnull(year" in plan
    versions.expire_versions(spark, path)
    assert versions.read_table(spark, path).count() == 32
    plain = str(tmp_path / "plain")
    versions.replace_table(mart, plain)
    with pytest.raises(ValueError, match="no partitions"):
        versions.replace_partitions(mart, plain)


def test_two_writers_cannot_take_one_version(spark, mart, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    versions.replace_table(mart, path)
    monkeypatch.setattr(versions, "_newest", lambda *_: (0, {"partition": None, "parts": {}}))
    with pytest.raises(RuntimeError, match="first"):
        versions.replace_table(mart.limit(1), path)
    monkeypatch.undo()
    assert versions.read_table(spark, path).count() == 40
