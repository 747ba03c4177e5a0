"""Forecast request: gate, history, fit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from daymart.functions.fixed_values import GDP_METRICS, HORIZON, HORIZON_BOUNDS
from daymart.operators.forecast import forecast_all
from daymart.operators.series import valid_points
from daymart.plans.metric_series import metric_response, metric_series


def forecast_metric(
    mart: DataFrame,
    metric: str,
    horizon: int = HORIZON,
    start: str | None = None,
    end: str | None = None,
    entities: Sequence[str] | None = None,
) -> DataFrame:
    """History and forecast of one metric for all entities, or the chosen ones. Yearly metrics are an error."""
    if metric.upper() in GDP_METRICS:  # what the catalogue calls not forecastable
        raise ValueError(f"no forecast for {metric}")
    if not HORIZON_BOUNDS[0] <= horizon <= HORIZON_BOUNDS[1]:
        raise ValueError(f"horizon must lie in {HORIZON_BOUNDS[0]}..{HORIZON_BOUNDS[1]}, got {horizon}")
    history = metric_response(metric_series(mart, metric, start, end, entities))
    return forecast_all(valid_points(history), horizon)
