import datetime

import pytest
from pyspark.sql import functions as F

from daymart import schemas
from daymart.operators import annotations
from daymart.plans import comment_request
from daymart.sources import comments
from tests.conftest import day

START = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def alias(spark):
    return spark.createDataFrame([("deu", "Germany")], "alias string, canonical string")


def log_rows(spark, rows):
    return spark.createDataFrame(rows, schemas.COMMENT_LOG)


def requests(spark, rows):
    return spark.createDataFrame(rows, schemas.COMMENT_REQUEST)


@pytest.fixture(scope="module")
def busy_log(spark):
    """250 comments on one key, and 2 on another that share their time and text."""
    rows = [(f"{i:03}", "a", day("2024-01-01"), "M", f"u{i}", f"t{i}", START + datetime.timedelta(seconds=i)) for i in range(250)]
    rows += [("x1", "b", day("2024-01-02"), "M", "u", "same", START), ("x2", "b", day("2024-01-02"), "M", "u", "same", START)]
    return log_rows(spark, rows)


def test_documents_have_one_header_of_the_same_shape_at_any_size(spark, busy_log):
    docs = {r.country: r for r in annotations.annotation_docs(busy_log).collect()}
    assert docs["a"].created_at == START and docs["a"].n_comments == 250 and docs["b"].n_comments == 2
    assert annotations.comment_rows(busy_log).where("country = 'b'").select("text").collect() == [("same",), ("same",)]
    large = spark.range(30_000).selectExpr("string(id) comment_id", "'a' country", "date'2024-01-01' date", "'M' metric", "'u' user", "'t' text", "timestamp_ntz'2024-01-01 00:00:00' ts")
    header = annotations.annotation_docs(large).collect()
    assert len(header) == 1 and header[0].n_comments == 30_000 and annotations.comment_rows(large).count() == 30_000


def test_annotated_series_matches_exact_names(spark, busy_log):
    series = spark.createDataFrame([("a", day("2024-01-01"), "M", 1.0), ("A", day("2024-01-01"), "M", 1.0)], "country string, date date, metric string, value double")
    annotated = annotations.annotate_series(series, annotations.annotation_docs(busy_log))
    got = {r.country: r.annotation for r in annotated.collect()}
    assert got["A"] is None and got["a"].n_comments == 250 and annotated.columns == [*series.columns, "annotation"]
    assert annotations.comment_rows(busy_log, series).count() == 250


def test_range_read(busy_log):
    docs = annotations.annotation_docs(busy_log)
    assert annotations.read_annotations(docs, "a", "M", "2024-01-01", "2024-01-01").count() == 1
    assert annotations.read_annotations(docs, "a", "M", "2024-01-02", "2024-02-01").count() == 0
    assert annotations.read_annotations(busy_log, "a", "M", "2024-01-01", "2024-01-01").count() == 250


def test_latest_200_and_lines(spark, busy_log):
    latest = annotations.latest_comments(busy_log)
    rows = latest.where("country = 'a'").orderBy("position").collect()
    assert len(rows) == 200 and rows[0].text == "t249" and rows[-1].text == "t50"
    asked = spark.createDataFrame([("b", "M"), ("none", "M")], "country string, metric string")
    lines = [r.line for r in annotations.comment_lines(latest, asked).orderBy("country", "position").collect()]
    assert lines == ["2024-01-01 — u: same"] * 2 + ["No comments yet."]


def test_line_of_a_blank_user(spark):
    log = log_rows(spark, [("1", "a", day("2024-01-01"), "M", "", "  hi ", START)])
    asked = spark.createDataFrame([("a", "M")], "country string, metric string")
    assert annotations.comment_lines(annotations.latest_comments(log), asked).first().line == "2024-01-01 — —: hi"


def test_only_a_request_has_a_default_range(spark):
    log = log_rows(spark, [("1", "a", day("2019-12-31"), "M", "u", "t", START)])
    assert annotations.latest_comments(log).count() == 1
    assert comment_request.newest_comments(log).count() == 0
    assert comment_request.newest_comments(log, "2019-01-01").count() == 1
    asked = log.select("country", "metric")
    assert comment_request.printed_comments(log, asked, "2019-01-01").first().line == "2024-01-01 — u: t"


def test_requests_are_cleaned_and_spread(spark, alias):
    got = annotations.accepted_requests(
        requests(spark, [([" DEU ", "Chad"], "1999-01-01", "M", " me ", " hi "), (["Chad"], "2021-01-01", "M", " ", "x"), ([], "2021-01-01", "M", "me", "x"), (["Chad"], None, "M", "me", "y")]),
        alias,
    )
    assert sorted((r.country, r.date.isoformat(), r.user, r.text) for r in got.collect()) == [
        ("Chad", "2020-01-01", "me", "hi"),
        ("Chad", "2020-01-01", "me", "y"),
        ("Germany", "2020-01-01", "me", "hi"),
    ]


def test_append_counts_and_keeps_duplicates(spark, alias, tmp_path):
    path = str(tmp_path / "log")
    one = requests(spark, [(["deu"], "2021-01-01", "M", "me", "hi")])
    assert comments.append_comments(one, alias, path) == {"matched": 0, "created": 1}
    assert comments.append_comments(one, alias, path) == {"matched": 1, "created": 0}
    both = requests(spark, [(["deu", "Chad"], "2021-01-01", "M", "me", "hi"), (["Chad"], "2021-01-01", "M", "me", "again")])
    assert comments.append_comments(both, alias, path) == {"matched": 2, "created": 1}
    log = comments.read_comments(spark, path)
    assert log.count() == 5 and log.select("comment_id").distinct().count() == 5
