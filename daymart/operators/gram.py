"""One pass for all pairwise moments of a table's columns.

Each task folds its rows into a buffer of d x d numbers for d columns: for every ordered pair the rows that know
both, the mean and the squared deviations of the first over those rows, and their co-deviation. Buffers of
tasks are merged in Spark by a tree with the same update, so the work per row is one matrix product, rows
are neither copied nor shuffled, and what is left is one buffer whose size depends on the columns alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buffers merged side by side before the last merge.
BRANCHES = 8


@dataclass
class Moments:
    """``n``, ``mean``, ``square``, ``cross`` for every ordered pair (i, j): of column i over rows knowing i and j."""

    n: np.ndarray
    mean: np.ndarray
    square: np.ndarray
    cross: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> Moments:
        """Of rows by columns, NaN being unknown."""
        known = ~np.isnan(values)
        present = known.astype(float)
        # Around the columns' own means, so that large values with little spread lose nothing.
        about = np.divide(np.where(known, values, 0).sum(0), present.sum(0), out=np.zeros(values.shape[1]), where=known.any(0))
        centred = np.where(known, values - about, 0)
        n = present.T @ present
        total = centred.T @ present
        share = np.divide(total, n, out=np.zeros_like(n), where=n > 0)
        square = (centred**2).T @ present - total * share
        cross = centred.T @ centred - total * share.T
        return cls(n, about[:, None] * (n > 0) + share, square, cross)

    def merged(self, other: Moments) -> Moments:
        n = self.n + other.n
        weight = np.divide(other.n, n, out=np.zeros_like(n), where=n > 0)
        apart = np.where((self.n > 0) & (other.n > 0), other.mean - self.mean, 0)
        both = self.n * weight
        return Moments(
            n,
            np.where(self.n > 0, self.mean + apart * weight, other.mean),
            self.square + other.square + apart**2 * both,
            self.cross + other.cross + apart * apart.T * both,
        )

    def packed(self) -> bytes:
        return np.stack([self.n, self.mean, self.square, self.cross]).tobytes()

    @classmethod
    def unpacked(cls, raw: bytes, width: int) -> Moments:
        return cls(*np.frombuffer(raw, float).reshape(4, width, width))

    def correlation(self) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return self.cross / np.sqrt(self.square * self.square.T)


def moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``body binary``: the merged buffer of the columns, one row; none for an empty table.

    Nulls and NaN are unknown. Columns of any numeric type are read as doubles.
    """
    width = len(columns)

    def folded(parts: Iterable[Moments]):
        held = None
        for part in parts:
            held = part if held is None else held.merged(part)
        if held is not None:
            yield pa.record_batch([pa.array([held.packed()], pa.binary())], ["body"])

    def of_rows(batches):
        tables = (np.column_stack([c.fill_null(np.nan).to_numpy(zero_copy_only=False) for c in b.columns]) for b in batches if b.num_rows)
        yield from folded(map(Moments.of, tables))

    def of_buffers(batches):
        yield from folded(Moments.unpacked(raw, width) for b in batches for raw in b.column(0).to_pylist())

    rows = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    partial = rows.mapInArrow(of_rows, "body binary")
    return partial.repartition(BRANCHES).mapInArrow(of_buffers, "body binary").repartition(1).mapInArrow(of_buffers, "body binary")


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``left_column, right_column, correlation`` of each pair in the columns' order, over rows knowing both.

    Null without such rows, NaN where one of the two does not vary.
    """
    width, names = len(columns), list(columns)
    pairs = [(i, j) for i in range(width) for j in range(i + 1, width)]

    def shown(batches):
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                found = Moments.unpacked(raw, width)
                values = found.correlation()
                yield pa.record_batch(
                    [
                        pa.array([names[i] for i, _ in pairs], pa.string()),
                        pa.array([names[j] for _, j in pairs], pa.string()),
                        pa.array([float(values[i, j]) if found.n[i, j] else None for i, j in pairs], pa.float64()),
                    ],
                    ["left_column", "right_column", "correlation"],
                )

    return moments(df, names).mapInArrow(shown, "left_column string, right_column string, correlation double")


def principal_axes(df: DataFrame, columns: Sequence[str], count: int) -> tuple[np.ndarray, np.ndarray]:
    """Means of the columns and, a column each, the loadings of the first principal components.

    Only the buffer comes to the driver. The loading of largest size of each component is positive.
    """
    raw = moments(df, columns).first()
    if raw is None:
        return np.zeros(len(columns)), np.eye(len(columns))[:, :count]
    found = Moments.unpacked(bytes(raw["body"]), len(columns))
    _, vectors = np.linalg.eigh((found.cross + found.cross.T) / 2)
    axes = vectors[:, ::-1][:, :count]
    largest = np.abs(axes).argmax(0)
    return found.mean.diagonal(), axes * np.where(axes[largest, np.arange(axes.shape[1])] < 0, -1.0, 1.0)
