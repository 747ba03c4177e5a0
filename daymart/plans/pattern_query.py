"""Pattern request: range and entities first, then the matches, and the series they are drawn over."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from daymart.functions.fixed_values import RUN_LENGTH_BOUNDS, SPIKE_BOUNDS, SPIKES, STREAK_LENGTH, SURGE_LENGTH, SURGES
from daymart.operators.patterns import find_pattern, tag_runs, tag_spikes, with_headings
from daymart.plans.metric_series import in_range
from daymart.sources.sinks import write_csv


def check_bounds(pattern: str, min_len: int | None, multiplier: float | None) -> None:
    """What a request may ask for; the operators themselves take any length or multiplier."""
    number, bounds, what = (multiplier, SPIKE_BOUNDS, "multiplier") if pattern == SPIKES else (min_len, RUN_LENGTH_BOUNDS, "run length")
    if number is not None and not bounds[0] <= number <= bounds[1]:
        raise ValueError(f"{what} must lie in {bounds[0]}..{bounds[1]}, got {number}")


def pattern_matches(
    mart: DataFrame,
    pattern: str,
    start: str | None = None,
    end: str | None = None,
    entities: Sequence[str] | None = None,
    min_len: int | None = None,
    multiplier: float | None = None,
) -> DataFrame:
    """Matches of all entities, or of the ones named exactly.

    The range is cut before rows are compared, so the first row of the range has no predecessor.
    """
    check_bounds(pattern, min_len, multiplier)
    return find_pattern(in_range(mart, start, end, entities, exact_names=True), pattern, min_len, multiplier)


def pattern_overlay(
    mart: DataFrame,
    pattern: str,
    start: str | None = None,
    end: str | None = None,
    entities: Sequence[str] | None = None,
    min_len: int | None = None,
    multiplier: float | None = None,
) -> DataFrame:
    """The full series with each day's match beside it, from the same windows as the matches."""
    days = in_range(mart, start, end, entities, exact_names=True)
    check_bounds(pattern, min_len, multiplier)
    find_pattern(days, pattern, min_len, multiplier)  # checks the name
    if pattern == SPIKES:
        return tag_spikes(days, multiplier) if multiplier else tag_spikes(days)
    if pattern == SURGES:
        return tag_runs(days, "daily_vaccinations", min_len or SURGE_LENGTH)
    return tag_runs(days, "new_cases", min_len or STREAK_LENGTH)


def write_matches(matches: DataFrame, pattern: str, path: str) -> None:
    """The table under its display headings as CSV, in order of entity and day."""
    shown = with_headings(matches, pattern)
    write_csv(shown, path, shown.columns[:2])
