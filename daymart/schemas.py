"""Table layouts."""

from __future__ import annotations

from pyspark.sql import types as T

from daymart.functions.fixed_values import METRIC_COLUMNS

MART = T.StructType(
    [T.StructField("country", T.StringType()), T.StructField("d", T.DateType())]
    + [T.StructField(name.lower(), T.DoubleType()) for name in METRIC_COLUMNS]
    + [T.StructField("population", T.DoubleType())]
)

YEARLY = T.StructType(
    [
        T.StructField("country", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("gdp_ppp_per_capita", T.DoubleType()),
    ]
)

ALIAS = T.StructType([T.StructField("alias", T.StringType()), T.StructField("canonical", T.StringType())])

# One row per comment, append only. comment_id is unique and gives ties a fixed order.
COMMENT_LOG = T.StructType(
    [
        T.StructField("comment_id", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("metric", T.StringType()),
        T.StructField("user", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
    ]
)

# What a batch adds to a document: its first time there and the number of its comments.
COMMENT_HEADERS = T.StructType(
    [
        T.StructField("country", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("metric", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("n_comments", T.LongType()),
    ]
)

# A comment as it is submitted: everything is text, and one comment may name several entities.
COMMENT_REQUEST = T.StructType(
    [
        T.StructField("countries", T.ArrayType(T.StringType())),
        T.StructField("date", T.StringType()),
        T.StructField("metric", T.StringType()),
        T.StructField("user", T.StringType()),
        T.StructField("comment", T.StringType()),
    ]
)
