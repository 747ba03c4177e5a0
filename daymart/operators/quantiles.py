"""Exact quantiles by radix selection, without gathering a column in one task.

``percentile`` keeps every distinct value of a group in one aggregation buffer. Here a double becomes a 64-bit
key of the same order, and the key of each wanted rank is found 16 bits at a time: counts by the first 16 bits,
map-side combined, tell which part holds the rank; the next pass counts by the next 16 bits within that part.
Four passes settle any values, however many magnitudes they span, and all columns and ranks share each pass.
A part that holds one value settles at once. No window ever sees more than PARTS rows of a group and part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daymart.session import stage

DIGIT_BITS = 16
PARTS = 1 << DIGIT_BITS
PASSES = 64 // DIGIT_BITS
#: Of a double: fraction bits, exponent bias, smallest normal and smallest positive number.
FRACTION_BITS, BIAS, NORMAL, TINY = 52, 1023, 2.0**-1022, 5e-324
INFINITE = 2047 << FRACTION_BITS


def with_order_key(df: DataFrame, value: str, key: str) -> DataFrame:
    """Add a long that orders as the double ``value`` does: its bits, negated below zero.

    Both zeros have key 0, NaN comes after infinity, null stays null. The exponent is estimated by a logarithm
    and corrected by exact powers of two, so the whole key is exact arithmetic in compiled expressions.
    """
    size = F.abs(F.col(value))
    finite = size < float("inf")
    guess = df.withColumn("_e", F.when(finite & (size >= NORMAL), F.greatest(F.floor(F.log2(size)), F.lit(1 - BIAS))).cast("int"))

    def power(exponent):
        return F.pow(F.lit(2.0), exponent.cast("double"))

    e = F.col("_e")
    corrected = guess.withColumn("_e", e + (size >= power(e + 1)).cast("int") - (size < power(e)).cast("int"))
    fraction = ((size / power(e) - 1) * 2.0**FRACTION_BITS).cast("long")
    bits = (
        F.when(e.isNotNull(), F.shiftleft((e + BIAS).cast("long"), FRACTION_BITS) + fraction)
        .when(finite, (size / TINY).cast("long"))
        .when(F.isnan(value), F.lit(INFINITE + 1))
        .when(size.isNotNull(), F.lit(INFINITE))
    )
    return corrected.withColumn(key, F.when(F.col(value) < 0, -bits).otherwise(bits)).drop("_e")


def from_order_key(key: Column) -> Column:
    """The double of an order key."""
    bits = F.abs(key)
    exponent = F.shiftright(bits, FRACTION_BITS)
    fraction = bits.bitwiseAND((1 << FRACTION_BITS) - 1).cast("double")
    size = (
        F.when(exponent == 0, fraction * TINY)
        .when(bits > INFINITE, float("nan"))
        .when(bits == INFINITE, float("inf"))
        .otherwise((fraction / 2.0**FRACTION_BITS + 1) * F.pow(F.lit(2.0), (exponent - BIAS).cast("double")))
    )
    return F.when(key < 0, -size).otherwise(size)


def exact_quantiles(
    df: DataFrame, value: str, probabilities: Sequence[float], groups: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """Linearly interpolated quantiles per group as q0, q1, ... with n, min_value and max_value.

    Nulls are left out and NaN counts as larger than any number; a null group is a group. With ``weight``
    a row stands for so many equal ones. Each of the passes, four at most, reads ``df`` once and only goes
    on with the parts still open; stage it first if it is costly to compute.
    """
    by = F.struct(*groups) if groups else F.struct(F.lit(0).alias("_all"))
    rows = df.where(F.col(value).isNotNull()).select(
        by.alias("_by"), F.col(value).cast("double").alias("_v"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("_n")
    )
    return keyed_quantiles(with_order_key(rows, "_v", "_key").drop("_v"), probabilities, groups)


def keyed_quantiles(rows: DataFrame, probabilities: Sequence[float], groups: Sequence[str]) -> DataFrame:
    """``exact_quantiles`` of rows ``_by, _key, _n``: a group, an order key and how often it occurs."""
    first = stage(_counted(rows, 1, "_by"))
    whole = first.groupBy("_by").agg(F.sum("_n").alias("n"), F.min("_least").alias("_min"), F.max("_most").alias("_max"))
    slots = []
    for p in probabilities:
        low = F.floor(F.lit(float(p)) * (F.col("n") - 1))
        slots += [low, F.least(low + 1, F.col("n") - 1)]
    ranks = F.explode(F.array(*[F.struct(F.lit(i).alias("slot"), r.alias("rank")) for i, r in enumerate(slots)]))
    wanted = stage(_settled_by(first, whole.select("_by", ranks.alias("w")).select("_by", "w.slot", "w.rank"), "_by"))
    for digit in range(2, PASSES + 1):
        if wanted.where("_least < _most").isEmpty():
            break
        wanted = stage(_narrowed(rows, wanted, digit))
    found = wanted.groupBy("_by").agg(
        *[F.max(F.when(F.col("slot") == i, from_order_key(F.col("_least")))).alias(f"_r{i}") for i in range(len(slots))]
    )
    return whole.join(found, "_by").select(
        *[F.col("_by")[c].alias(c) for c in groups],
        "n",
        from_order_key(F.col("_min")).alias("min_value"),
        from_order_key(F.col("_max")).alias("max_value"),
        *[
            (F.col(f"_r{2 * i}") + (F.col(f"_r{2 * i + 1}") - F.col(f"_r{2 * i}")) * (F.lit(float(p)) * (F.col("n") - 1) - slots[2 * i])).alias(f"q{i}")
            for i, p in enumerate(probabilities)
        ],
    )


def _part(digit: int, key: str = "_key") -> Column:
    """The key's first ``digit`` digits; of the same order, as the shift keeps the sign."""
    return F.shiftright(key, 64 - DIGIT_BITS * digit) if digit else F.lit(0).cast("long")


def _counted(rows: DataFrame, digit: int, *keys: str) -> DataFrame:
    """Rows by the parts of one more digit, with the smallest and the largest key in each."""
    return rows.groupBy(*keys, _part(digit).alias("_part")).agg(
        F.sum("_n").alias("_n"), F.min("_key").alias("_least"), F.max("_key").alias("_most")
    )


def _settled_by(counted: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """Wanted ranks with the keys between which the part holding them lies; ranks count from its start."""
    running = Window.partitionBy(*keys).orderBy("_part")
    placed = counted.withColumn("_until", F.sum("_n").over(running))
    inside = (F.col("rank") < F.col("_until")) & (F.col("rank") >= F.col("_until") - F.col("_n"))
    return (
        wanted.join(placed, list(keys))
        .where(inside)
        .select("_by", "slot", (F.col("rank") - (F.col("_until") - F.col("_n"))).alias("rank"), "_least", "_most")
    )


def _narrowed(rows: DataFrame, wanted: DataFrame, digit: int) -> DataFrame:
    """One more pass: the open parts of the digits so far, split by the next digit."""
    opened = wanted.where("_least < _most").select("_by", "slot", "rank", _part(digit - 1, "_least").alias("_outer"))
    inside = rows.withColumn("_outer", _part(digit - 1)).join(opened.select("_by", "_outer").distinct(), ["_by", "_outer"], "left_semi")
    narrowed = _settled_by(_counted(inside, digit, "_by", "_outer"), opened, "_by", "_outer")
    return wanted.where("_least = _most").unionByName(narrowed)
