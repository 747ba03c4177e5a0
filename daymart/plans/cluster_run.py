"""Clustering request: window, series, report, features, labels, silhouette and view."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daymart.functions.fixed_values import FEW_WEEKS, WINDOW_DAYS, WINDOW_DAYS_BOUNDS
from daymart.functions.scalars import zero_if_null
from daymart.operators.clustering import cluster_count, kmeans_labels, principal_view, silhouette
from daymart.operators.features import standardize, weekly_features
from daymart.operators.series import daily_interpolated, look_back, series_report, series_stats, weekly_mean
from daymart.session import stage


@dataclass
class ClusterRun:
    """Results of one run. Without enough data ``labels`` is None and ``warnings`` says why.

    Labels, silhouette and view are computed when they are first asked for; a report costs no fit.
    """

    report: DataFrame
    features: DataFrame
    points: DataFrame | None = None
    clusters: int = 0
    warnings: list[str] = field(default_factory=list)

    @cached_property
    def labels(self) -> DataFrame | None:
        """The points that were clustered, with their cluster."""
        return None if self.points is None else stage(kmeans_labels(self.points, self.clusters))

    @cached_property
    def labelled(self) -> DataFrame | None:
        """Features as measured, with their cluster."""
        if self.labels is None:
            return None
        return self.features.join(self.labels.select("country", "cluster"), "country")

    @cached_property
    def silhouette(self) -> DataFrame | None:
        """Mean silhouette under squared distance, linear in the entities."""
        return None if self.labels is None else silhouette(self.labels)

    @cached_property
    def view(self) -> DataFrame | None:
        """Each entity's place in the plane of the first two principal components."""
        return None if self.labels is None else principal_view(self.labels)


def cluster_entities(
    mart: DataFrame,
    metric: str,
    end: str,
    window_days: int = WINDOW_DAYS,
    not_before: str | None = None,
    requested: DataFrame | None = None,
    scaled: bool = True,
) -> ClusterRun:
    """Cluster all requested entities (default: all in the mart) by their recent weekly behaviour."""
    if not WINDOW_DAYS_BOUNDS[0] <= window_days <= WINDOW_DAYS_BOUNDS[1]:
        raise ValueError(f"window must lie in {WINDOW_DAYS_BOUNDS[0]}..{WINDOW_DAYS_BOUNDS[1]} days, got {window_days}")
    value = metric.lower()
    days = look_back(mart.select("country", "d", value), end, window_days, not_before)
    if requested is not None:
        days = days.join(requested.select("country").distinct(), "country", "left_semi")
    daily = daily_interpolated(days.withColumn(value, zero_if_null(F.col(value))), value)
    # Staged because every model fit goes back to it.
    features = stage(weekly_features(weekly_mean(daily, value), value))
    names = requested if requested is not None else mart.select("country")
    described = features.select("country", F.lit(True).alias("_described"))
    stats = series_stats(daily, value).join(described, "country", "left")
    report = series_report(names, stats, has_features=F.coalesce("_described", F.lit(False)))
    n = features.count()
    if n == 0:
        return ClusterRun(report, features, warnings=[f"no usable series ({FEW_WEEKS}); widen window or selection"])
    if n < 2:
        return ClusterRun(report, features, warnings=["one usable series; select more entities"])
    points = standardize(features) if scaled else features
    return ClusterRun(report, features, points, cluster_count(n))
