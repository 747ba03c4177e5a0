"""Column profile of a table, over all of its rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daymart.functions.scalars import finite_or_null
from daymart.operators.fingerprints import distinct_rows, text_counts
from daymart.operators.frequent import ranked
from daymart.operators.gram import correlations
from daymart.operators.quantiles import from_order_key, keyed_quantiles, with_order_key
from daymart.session import stage

QUARTILES = (0.25, 0.5, 0.75)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def infinities_to_null(df: DataFrame) -> DataFrame:
    """Both infinities and NaN to null in every floating-point column."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, T.FractionalType)]
    return df.withColumns({c: finite_or_null(F.col(c)) for c in floats})


def _numbers(df: DataFrame) -> DataFrame | None:
    names = numeric_columns(df)
    if not names:
        return None
    return df.select(*[F.col(c).cast("double").alias(c) for c in names]).unpivot([], names, "column_name", "value")


def _texts(df: DataFrame, names: Sequence[str]) -> DataFrame | None:
    if not names:
        return None
    as_text = df.select(*[F.col(c).cast("string").alias(c) for c in names])
    return as_text.unpivot([], list(names), "column_name", "value")


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, value, n): how often each value of each column occurs, null included.

    Counting is map-side first, so a value held by a third of the rows is one row per task.
    """
    return _texts(df, columns or df.columns).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def top_values(counts: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent values of each column from all counts; ties go to the smaller value.

    Each task keeps its own k before the shuffle, so a column of unique values costs no more.
    ``frequent.frequent_values`` gives the same without counting every value.
    """
    return ranked(counts, k)


def _number_stats(df: DataFrame, exact_distinct: bool) -> DataFrame:
    """Counts, mean, deviation, range and quartiles of numeric columns, one row per column."""
    counts = with_order_key(_numbers(df), "value", "_key").select("column_name", "_key", F.lit(1).cast("long").alias("_n"))
    distinct = F.approx_count_distinct("_key")
    if exact_distinct:
        # Numbers by order key, null included: all that follows reads these counts alone.
        counts = stage(counts.groupBy("column_name", "_key").agg(F.count(F.lit(1)).alias("_n")))
        distinct = F.count("_key")
    known = counts.where(F.col("_key").isNotNull()).withColumn("_v", from_order_key(F.col("_key")))

    def total(condition):
        return F.coalesce(F.sum(F.when(condition, F.col("_n"))), F.lit(0))

    outline = stage(
        counts.withColumn("_v", from_order_key(F.col("_key")))
        .groupBy("column_name")
        .agg(
            F.sum("_n").alias("n_rows"),
            total(F.col("_key").isNull()).alias("n_null"),
            distinct.alias("n_distinct"),
            total(F.col("_v") == 0).alias("n_zero"),
            total(F.col("_v") < 0).alias("n_negative"),
            (F.sum(F.col("_v") * F.col("_n")) / F.nullif(total(F.col("_key").isNotNull()), F.lit(0))).alias("mean"),
        )
    )
    # Around the mean, so that a small spread of large numbers is not lost. A row per column.
    away = F.col("_v") - F.col("mean")
    spread = known.join(F.broadcast(outline.select("column_name", "mean")), "column_name").groupBy("column_name").agg(
        F.sqrt(F.sum(F.col("_n") * away * away) / F.nullif(F.sum("_n") - 1, F.lit(0))).alias("std")
    )
    keyed = known.select(F.struct("column_name").alias("_by"), "_key", "_n")
    quartiles = keyed_quantiles(keyed, QUARTILES, ["column_name"]).drop("n")
    quartiles = quartiles.withColumnsRenamed({"q0": "p25", "q1": "p50", "q2": "p75"})
    unknown = F.col("n_rows") == F.col("n_null")
    described = outline.join(F.broadcast(spread), "column_name", "left").join(F.broadcast(quartiles), "column_name", "left")
    # A column without a known number has no statistics.
    return described.withColumns({c: F.when(~unknown, F.col(c)) for c in ("n_zero", "n_negative")}).select(
        "column_name", F.lit("number").alias("kind"), "n_rows", "n_null", "n_distinct",
        "n_zero", "n_negative", "mean", "std", "min_value", "max_value", "p25", "p50", "p75",
    )


def column_profile(df: DataFrame, exact_distinct: bool = True) -> DataFrame:
    """One row per column: rows, nulls, distinct values, zeros, negatives, mean, deviation, range, quartiles.

    Columns are rows of grouped aggregations instead of hundreds of aggregates side by side: generated code
    stays small enough to be compiled, and everything combines map-side. Numbers are counted once by a 64-bit
    key, and all their statistics come from those stored counts, quartiles in four passes over them at most.
    Of other columns fingerprints are counted, and only repeated values are read a second time.
    ``exact_distinct=False`` counts distinct values by a sketch, stores nothing and reads the numbers again for
    each pass. An empty table has no rows.
    """
    numeric = numeric_columns(df)
    others = [c for c in df.columns if c not in numeric]
    parts = []
    if numeric:
        parts.append(_number_stats(df, exact_distinct))
    if others:
        texts = _texts(df, others)
        rough = texts.groupBy("column_name").agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count(F.when(F.col("value").isNull(), 1)).alias("n_null"),
            F.approx_count_distinct("value").alias("n_distinct"),
        )
        parts.append((text_counts(texts) if exact_distinct else rough).withColumn("kind", F.lit("other")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(left_column, right_column, correlation) for each pair of numeric columns, over rows knowing both.

    One pass; see ``gram``. NaN counts as unknown.
    """
    return correlations(df, list(columns or numeric_columns(df)))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows, distinct rows and surplus copies of the table, one row; see ``fingerprints``."""
    return distinct_rows(df)
