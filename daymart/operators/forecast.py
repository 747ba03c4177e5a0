"""Forecast of every daily series with an interval.

The fit follows the published recursions of Holt (1957), Winters (1960) and the damped trend of
Gardner and McKenzie (1985). A series is bounded by the calendar, so it is one row with two arrays. Each task
lays many series of like length into one matrix and runs the recursion of all of them, with all weights tried,
at once; the weights are then fitted by Levenberg-Marquardt steps, again all series of the matrix together.
"""

from __future__ import annotations

import copy
import itertools
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daymart.functions.fixed_values import FEW_RESIDUALS, FEWEST_POINTS, GDP_METRICS, HORIZON, INTERVAL_Z, SEASON_DAYS

#: Smoothing weights (level, trend, season, damping) from which the fit may start, and their bounds.
GRID = np.array(list(itertools.product((0.1, 0.3, 0.6, 0.9), (0.01, 0.1, 0.3), (0.01, 0.1, 0.3), (0.8, 0.9, 0.98))))
LOWEST = np.array([1e-4, 1e-4, 1e-4, 0.8])
HIGHEST = np.array([0.9999, 0.9999, 0.9999, 0.995])
#: Best points of the grid each series starts from, most steps, width of a numerical derivative.
STARTS, STEPS, WIDTH = 8, 40, 1e-6
#: Cells (series, weights, days) a recursion may hold, and rows in an Arrow batch that a task takes at once.
CELLS = 4_000_000
FITTED = (
    "country string, metric string, first int, n_days int, alpha double, beta double, gamma double, phi double,"
    " start_error double, squared_error double, spread double, ahead array<double>"
)


def _start(y: np.ndarray, season: int) -> tuple[float, float, np.ndarray]:
    """Level and trend from a line through the first ten deseasonalised points."""
    pattern = np.zeros(max(season, 1))
    if season:
        cycles = min(5, len(y) // season)
        head = y[: cycles * season]
        slope = (head[-season:].mean() - head[:season].mean()) / max((cycles - 1) * season, 1)
        flat = head - slope * np.arange(len(head))
        pattern = flat.reshape(cycles, season).mean(0)
        pattern = pattern - pattern.mean()
    n = min(10, len(y))
    t = np.arange(1, n + 1)
    flat = y[:n] - pattern[np.arange(n) % len(pattern)]
    trend = ((t - t.mean()) * (flat - flat.mean())).sum() / ((t - t.mean()) ** 2).sum()
    return flat.mean() - trend * t.mean(), trend, pattern


class Packed:
    """Daily series of like length, all seasonal or all not, as rows of one matrix padded at the end."""

    def __init__(self, series: Sequence[np.ndarray], season: int):
        self.lengths = np.array([len(y) for y in series])
        self.values = np.zeros((len(series), self.lengths.max()))
        for row, y in zip(self.values, series, strict=True):
            row[: len(y)] = y
        self.known = np.arange(self.values.shape[1]) < self.lengths[:, None]
        started = [_start(y, season) for y in series]
        self.level, self.trend = (np.array([s[i] for s in started]) for i in (0, 1))
        self.pattern = np.stack([s[2] for s in started])
        self.season = season

    def __len__(self) -> int:
        return len(self.values)

    def errors(self, weights: np.ndarray, horizon: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """One-step errors (series, weights, days), 0 where padded, and forecasts (series, weights, horizon)."""
        alpha, beta, gamma, phi = np.moveaxis(weights, -1, 0)
        level, trend = (np.broadcast_to(x[:, None], alpha.shape).copy() for x in (self.level, self.trend))
        pattern = np.repeat(self.pattern[:, None], alpha.shape[1], axis=1)
        period = pattern.shape[2]
        out = np.zeros((*alpha.shape, self.values.shape[1]))
        for t in range(self.values.shape[1]):
            value, going = self.values[:, t, None], self.known[:, t, None]
            s = pattern[:, :, t % period]
            base = level + phi * trend
            out[:, :, t] = np.where(going, value - base - s, 0)
            risen = alpha * (value - s) + (1 - alpha) * base
            trend = np.where(going, beta * (risen - level) + (1 - beta) * phi * trend, trend)
            if self.season:
                pattern[:, :, t % period] = np.where(going, gamma * (value - base) + (1 - gamma) * s, s)
            level = np.where(going, risen, level)
        damping = np.cumsum(phi[:, :, None] ** np.arange(1, horizon + 1), axis=2)
        turn = (self.lengths[:, None] + np.arange(horizon)) % period
        cycle = np.take_along_axis(pattern, np.broadcast_to(turn[:, None], (*alpha.shape, horizon)), axis=2)
        return out, level[:, :, None] + damping * trend[:, :, None] + cycle

    def fitted(self) -> tuple[np.ndarray, np.ndarray]:
        """Least-squares weights of each series, and the squared error of the best point of the grid.

        Steps start from several of the grid's best points, and the best end is kept. Only steps that lower the
        error are taken, so no series ends above its best point of the grid.
        """
        grid = GRID if self.season else GRID[GRID[:, 2] == GRID[0, 2]]
        first = (self.errors(np.broadcast_to(grid, (len(self), *grid.shape)))[0] ** 2).sum(2)
        order = first.argsort(1, kind="stable")[:, :STARTS]
        ends, costs = self._repeated(STARTS)._stepped(grid[order].reshape(-1, grid.shape[1]))
        best = costs.reshape(-1, STARTS).argmin(1)
        return ends.reshape(-1, STARTS, grid.shape[1])[np.arange(len(self)), best], first.min(1)

    def _repeated(self, times: int) -> Packed:
        """Every series so many times in a row."""
        out = copy.copy(self)
        for name in ("lengths", "values", "known", "level", "trend", "pattern"):
            setattr(out, name, np.repeat(getattr(self, name), times, axis=0))
        return out

    def _stepped(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Levenberg-Marquardt within the bounds, for all series at once: their weights and squared errors."""
        count = weights.shape[1]

        def measured(at):
            # The errors there and beside it in every direction, inwards where the bound is near.
            step = np.where(at + WIDTH > HIGHEST, -WIDTH, WIDTH)
            tried = np.concatenate([at[:, None], at[:, None] + step[:, :, None] * np.eye(count)], axis=1)
            errors = self.errors(tried)[0]
            slopes = (errors[:, 1:] - errors[:, :1]) / step[:, :, None]
            return (errors[:, 0] ** 2).sum(1), errors[:, 0], slopes

        cost, errors, slopes = measured(weights)
        damping = np.full(len(weights), 1e-2)
        for _ in range(STEPS):
            downhill = -np.einsum("sct,st->sc", slopes, errors)
            # A weight at its bound stays there while the error falls beyond it.
            held = ((weights <= LOWEST) & (downhill < 0)) | ((weights >= HIGHEST) & (downhill > 0))
            free = np.where(held[:, :, None], 0, slopes)
            square = np.einsum("sct,sdt->scd", free, free)
            size = np.einsum("scc->sc", square)
            ridge = damping[:, None] * np.maximum(size, 1e-12 * size.max(1, keepdims=True)) + np.where(size.max(1, keepdims=True) > 0, 0, 1) + held
            move = np.linalg.solve(square + ridge[:, :, None] * np.eye(count), np.where(held, 0, downhill)[:, :, None])[:, :, 0]
            tried = np.clip(weights + move, LOWEST, HIGHEST)
            new_cost, new_errors, new_slopes = measured(tried)
            better = new_cost < cost
            gained = np.where(better, (cost - new_cost) / np.maximum(cost, 1e-300), 0)
            weights = np.where(better[:, None], tried, weights)
            errors, slopes = np.where(better[:, None], new_errors, errors), np.where(better[:, None, None], new_slopes, slopes)
            cost = np.where(better, new_cost, cost)
            damping = np.clip(np.where(better, damping / 5, damping * 8), 1e-9, 1e9)
            if (better & (gained < 1e-7) | ~better & (damping >= 1e9)).all():
                break
        return weights, cost


def _daily(days: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A value for each day of the span, gaps filled along a line, none below 0."""
    return np.interp(np.arange(days[0], days[-1] + 1), days, values).clip(min=0)


def _rows_of(points: Sequence[tuple], horizon: int):
    """Fits of series ``(country, metric, days, values, weights or None)``, packed by length and season."""
    packed: dict[tuple, list] = {}
    for country, metric, days, values, weights in points:
        y = _daily(np.array(days), np.array(values, float))
        season = SEASON_DAYS if len(y) >= 2 * SEASON_DAYS else 0
        # Lengths of one matrix lie within a quarter of each other.
        packed.setdefault((season, int(np.log(len(y)) / np.log(1.25)), weights is None), []).append((country, metric, days[0], y, weights))
    for (season, _, free), own in packed.items():
        own.sort(key=lambda x: len(x[3]))
        height = max(1, CELLS // (len(GRID) * len(own[-1][3])))
        for start in range(0, len(own), height):
            part = own[start : start + height]
            series = Packed([y for *_, y, _ in part], season)
            weights, begun = series.fitted() if free else (np.array([w for *_, w in part], float), [None] * len(part))
            errors, ahead = series.errors(weights[:, None], horizon)
            for (country, metric, first, y, _), w, b, error, future in zip(part, weights, begun, errors[:, 0], ahead[:, 0], strict=True):
                error = error[: len(y)]
                spread = error.std(ddof=1) if len(y) > FEW_RESIDUALS else 0.0
                yield country, metric, first, len(y), *w.tolist(), b, float((error**2).sum()), float(spread), future.tolist()


def fit_series(series: DataFrame, horizon: int = HORIZON, weights: Sequence[str] | None = None) -> DataFrame:
    """``country, metric, first, n_days, alpha, beta, gamma, phi, start_error, squared_error, spread, ahead``, a row a series.

    ``series`` is (country, metric, date, value); null and NaN are no points, and series with fewer than ten
    points are left out. ``first`` is the first day as days since 1970, ``squared_error`` that of the
    one-step forecasts, ``start_error`` the smallest among the grid's (null with given weights), ``ahead`` the forecasts after the last day. ``weights`` names four columns (level,
    trend, season, damping) that give a series its weights instead of a fit.
    """
    known = series.where(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")))
    given = F.first(F.array(*[F.col(c).cast("double") for c in weights])) if weights else F.lit(None).cast("array<double>")
    points = F.sort_array(F.collect_list(F.struct(F.unix_date("date").alias("day"), F.col("value").cast("double").alias("value"))))
    # Fitting is heavy for its few bytes, and adaptive execution would put many series into one task
    # by their size. A fixed number of partitions keeps all cores busy; hashing still spreads any number.
    spark = series.sparkSession
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    packed = known.repartition(tasks, "country", "metric").groupBy("country", "metric").agg(points.alias("points"), given.alias("weights"))
    packed = packed.where(F.size("points") >= FEWEST_POINTS)
    names = [f.strip().split()[0] for f in FITTED.split(",")]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), *[pa.float64()] * 7, pa.list_(pa.float64())]

    def fitting(batches):
        for batch in batches:
            found = list(zip(*_rows_of(list(zip(*(c.to_pylist() for c in batch.columns), strict=True)), horizon), strict=True))
            if found:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(found, kinds, strict=True)], names)

    return packed.select("country", "metric", "points.day", "points.value", "weights").mapInArrow(fitting, FITTED)


def forecast_all(series: DataFrame, horizon: int = HORIZON, weights: Sequence[str] | None = None) -> DataFrame:
    """(country, metric, date, value, kind) for every series of (country, metric, date, value).

    Kinds are history, forecast, conf_low and conf_high. Series of metrics that cannot be forecast
    are left out. Series with fewer than ten points return their history only. See ``fit_series``.
    """
    own = series.where(~F.upper("metric").isin(*GDP_METRICS))
    fitted = fit_series(own, horizon, weights)
    last = F.col("first") + F.col("n_days") - 1
    days = fitted.select(
        "country", "metric", "spread", F.posexplode("ahead").alias("step", "value"), last.alias("last")
    ).withColumn("date", F.date_from_unix_date((F.col("last") + F.col("step") + 1).cast("int")))
    away = F.col("spread") * INTERVAL_Z

    def segment(value, kind: str):
        return F.struct(value.alias("value"), F.lit(kind).alias("kind"))

    segments = F.array(
        segment(F.col("value"), "forecast"),
        segment(F.greatest(F.col("value") - away, F.lit(0.0)), "conf_low"),
        segment(F.col("value") + away, "conf_high"),
    )
    history = own.select("country", "metric", "date", F.col("value").cast("double").alias("value"), F.lit("history").alias("kind"))
    return history.unionByName(days.select("country", "metric", "date", F.inline(segments)))
