"""The most frequent values of every column, without shuffling all distinct values.

Each task keeps a bounded number of counters per column (Misra and Gries, 1982): when there are too many, the
same amount is taken off all of them and the smallest go. What was taken off, summed over tasks, bounds by how
much any count is too low and how often a value without a counter can occur. If that is less than the
k-th largest count, the values that may be among the first k are counted exactly in a second pass. If not,
the pass is repeated with as many counters as that would take. Columns that no bounded number would serve,
such as keys whose values all occur about equally often, are counted in full.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daymart.session import stage

#: Counters of a column in a task, at first and at most.
COUNTERS, MOST_COUNTERS = 1024, 1 << 16
SKETCH = "column_name string, value string, low long, lost long"


def _sketched(texts: DataFrame, names: Sequence[str], counters: int) -> DataFrame:
    """A row for each counter of each task, and one with a null value for what its column lost there."""

    def reduced(held: dict[str, int]) -> tuple[dict[str, int], int]:
        cut = sorted(held.values(), reverse=True)[counters]
        return {v: n - cut for v, n in held.items() if n > cut}, cut

    def counting(batches):
        counts: list[dict[str, int]] = [{} for _ in names]
        lost = [0] * len(names)
        for batch in batches:
            for i, column in enumerate(batch.columns):
                held = counts[i]
                for value, n in zip(*(part.to_pylist() for part in pc.value_counts(column.drop_null()).flatten()), strict=True):
                    held[value] = held.get(value, 0) + n
                if len(held) > 2 * counters:
                    counts[i], cut = reduced(held)
                    lost[i] += cut
        for i, name in enumerate(names):
            if len(counts[i]) > counters:
                counts[i], cut = reduced(counts[i])
                lost[i] += cut
            held = counts[i]
            yield pa.record_batch(
                [
                    pa.array([name] * (len(held) + 1), pa.string()),
                    pa.array([*held, None], pa.string()),
                    pa.array([*held.values(), 0], pa.int64()),
                    pa.array([0] * len(held) + [lost[i]], pa.int64()),
                ],
                ["column_name", "value", "low", "lost"],
            )

    # Arrow needs names without dots.
    own = texts.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    return own.mapInArrow(counting, SKETCH)


def ranked(counts: DataFrame, k: int) -> DataFrame:
    """``column_name, value, n, position``: the first k values of each column by count, ties by value."""
    frequent = Window.partitionBy("column_name").orderBy(F.desc("n"), F.asc("value"))
    return counts.where(F.col("value").isNotNull()).withColumn("position", F.row_number().over(frequent)).where(F.col("position") <= k)


def _counted(texts: DataFrame, names: Sequence[str], only: DataFrame | None = None) -> DataFrame:
    long = texts.select(*[f"`{c}`" for c in names]).unpivot([], [f"`{c}`" for c in names], "column_name", "value")
    if only is not None:
        long = long.join(only, ["column_name", "value"], "left_semi")
    return long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def frequent_values(df: DataFrame, k: int = 10, columns: Sequence[str] | None = None, counters: int = COUNTERS) -> DataFrame:
    """``column_name, value, n, position``: the k most frequent values of each column, as text, exactly.

    Ties go to the smaller value; nulls are left out. Only k counts and one bound a column come to the driver.
    """
    names = list(columns or df.columns)
    texts = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in names])
    parts, waiting = [], {counters: names}
    while waiting:
        size = min(waiting)
        own = waiting.pop(size)
        sketch = _sketched(texts, own, size)
        low = stage(sketch.groupBy("column_name", "value").agg(F.sum("low").alias("n"), F.sum("lost").alias("lost")))
        lost = {r["column_name"]: r["lost"] for r in low.where(F.col("value").isNull()).collect()}
        top = {(r["column_name"], r["position"]): r["n"] for r in ranked(low, k).collect()}
        whole, apart, full = [], [], []
        for name in own:
            missing, reached = lost.get(name, 0), top.get((name, k), 0)
            if not missing:
                whole.append(name)
            elif reached > missing:
                apart.append((name, reached - missing))
            else:
                # Losses shrink in proportion to the counters.
                needed = 2 * size * missing / max(reached, 1)
                wanted = 1 << int(needed).bit_length()
                if wanted <= MOST_COUNTERS:
                    waiting.setdefault(wanted, []).append(name)
                else:
                    full.append(name)
        if whole:  # nothing was taken off: the counts are exact
            parts.append(low.where(F.col("column_name").isin(whole)).select("column_name", "value", "n"))
        if apart:
            least = F.lit(None).cast("long")
            for name, n in apart:
                least = F.when(F.col("column_name") == name, F.lit(n)).otherwise(least)
            candidates = stage(low.where(F.col("value").isNotNull() & (F.col("n") >= least)).select("column_name", "value"))
            parts.append(_counted(texts, [name for name, _ in apart], candidates))
        if full:
            parts.append(_counted(texts, full))
    return ranked(reduce(DataFrame.unionByName, parts), k)
