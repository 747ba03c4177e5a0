"""Distinct counts by fingerprints, made exact where fingerprints repeat.

Counting distinct rows or texts by grouping them shuffles them whole. Here a 128-bit fingerprint crosses the
shuffle in their place, at most once per task, so what is shuffled for a row does not grow with its width. A
fingerprint met once stands for one value. Only values whose fingerprint was met more often, copies and any
two values that happen to share one, are read again and compared by themselves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daymart.session import stage


def fingerprint(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Two 64-bit hashes of the columns, the second by another seed; nulls take part by their place."""
    parts = []
    for name in columns:
        column = F.col(f"`{name}`")
        # Adding zero makes both zeros one, as grouping does.
        parts.append(column + 0.0 if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)) else column)
    nulls = F.concat(*[F.when(F.col(f"`{name}`").isNull(), "1").otherwise("0") for name in columns])
    return [F.xxhash64(nulls, *parts), F.xxhash64(F.lit("second"), *parts, nulls)]


def repeated(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys..., _n``: a row for each combination of keys met more than once, beside one row whose first key
    is null and whose ``_n`` is the number of combinations met once. Stored, as it is read several times."""
    met = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    again = F.col("_n") > 1
    # Those met once come down to a row per task before they cross.
    kept = met.groupBy(*[F.when(again, F.col(k)).alias(k) for k in keys]).agg(F.sum("_n").alias("_n"))
    return stage(kept)


def distinct_rows(df: DataFrame) -> DataFrame:
    """``n_rows, n_distinct_rows, n_duplicates`` of the table, one row; exact."""
    names = df.columns
    marked = df.withColumns(dict(zip(("_f1", "_f2"), fingerprint(df, names), strict=True)))
    counted = repeated(marked.select("_f1", "_f2"), ["_f1", "_f2"])
    twice = counted.where(F.col("_f1").isNotNull()).select("_f1", "_f2")
    compared = marked.join(twice, ["_f1", "_f2"], "left_semi").groupBy(*[F.col(f"`{c}`") for c in names]).agg(F.lit(1).alias("_1"))
    alone = F.coalesce(F.sum(F.when(F.col("_f1").isNull(), F.col("_n"))), F.lit(0))
    totals = counted.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), alone.alias("_alone"))
    several = compared.agg(F.count(F.lit(1)).alias("_several"))
    # One row each.
    return totals.select(
        "n_rows", (F.col("_alone") + several.scalar()).alias("n_distinct_rows")
    ).withColumn("n_duplicates", F.col("n_rows") - F.col("n_distinct_rows"))


def text_counts(values: DataFrame) -> DataFrame:
    """``column_name, n_rows, n_null, n_distinct`` of rows ``column_name, value``; exact, shuffling no values
    but those whose fingerprint repeats."""
    marked = values.withColumns(dict(zip(("_f1", "_f2"), fingerprint(values, ["value"]), strict=True)))
    met = marked.groupBy("column_name", "_f1", "_f2").agg(
        F.count(F.lit(1)).alias("_n"), F.count("value").alias("_known")
    )
    again = (F.col("_n") > 1) & (F.col("_known") > 0)
    # What was met once, and the null, come down to a row per column and task before they cross.
    kept = stage(
        met.groupBy("column_name", F.when(again, F.col("_f1")).alias("_f1"), F.when(again, F.col("_f2")).alias("_f2")).agg(
            F.sum("_n").alias("_n"), F.sum("_known").alias("_known"), F.count(F.when((F.col("_n") == 1) & (F.col("_known") > 0), 1)).alias("_alone")
        )
    )
    twice = kept.where(F.col("_f1").isNotNull()).select("column_name", "_f1", "_f2")
    known = marked.where(F.col("value").isNotNull())
    compared = known.join(twice, ["column_name", "_f1", "_f2"], "left_semi").groupBy("column_name", "value").agg(F.lit(1).alias("_1"))
    several = compared.groupBy("column_name").agg(F.count(F.lit(1)).alias("_several"))
    totals = kept.groupBy("column_name").agg(
        F.sum("_n").alias("n_rows"), (F.sum("_n") - F.sum("_known")).alias("n_null"), F.sum("_alone").alias("_alone")
    )
    # A row for each column on either side.
    return totals.join(F.broadcast(several), "column_name", "left").select(
        "column_name", "n_rows", "n_null", (F.col("_alone") + F.coalesce("_several", F.lit(0))).alias("n_distinct")
    )
