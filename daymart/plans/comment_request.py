"""Requests for comments, with the range that is meant when none is given."""

from __future__ import annotations

from pyspark.sql import DataFrame

from daymart.functions.fixed_values import COMMENTS_FROM, COMMENTS_TO
from daymart.operators.annotations import comment_lines, latest_comments


def newest_comments(log: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """The newest comments per entity and metric in a range."""
    return latest_comments(log, start or COMMENTS_FROM, end or COMMENTS_TO)


def printed_comments(log: DataFrame, requested: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Their printed lines for the requested (country, metric)."""
    return comment_lines(newest_comments(log, start, end), requested)
