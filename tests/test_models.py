import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from daymart.functions import fixed_values as fixed
from daymart.operators import clustering, forecast
from daymart.plans.cluster_run import cluster_entities
from daymart.plans.forecast_run import forecast_metric
from tests.conftest import day

COLUMNS = list(clustering.FEATURES)


def blobs(spark, per_blob=12, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for b in range(4):
        centre = np.eye(6)[b] * 20
        rows += [(f"{b}-{i}", *map(float, centre + rng.normal(0, 0.3, 6))) for i in range(per_blob)]
    rng.shuffle(rows)
    return spark.createDataFrame([tuple([r[0], *map(float, r[1:])]) for r in rows], "country string, " + ", ".join(f"{c} double" for c in COLUMNS))


@pytest.mark.parametrize("seed", [0, 5])
def test_separated_groups_are_found_whatever_the_order(spark, seed):
    found = clustering.kmeans_labels(blobs(spark, seed=seed), 4).select("country", "cluster").collect()
    groups = {}
    for r in found:
        groups.setdefault(r.cluster, set()).add(r.country[0])
    assert sorted(groups) == [0, 1, 2, 3] and all(len(g) == 1 for g in groups.values())


def test_silhouette_equals_brute_force(spark):
    points = blobs(spark, 6).withColumn("cluster", F.when(F.col("growth") > 5, 0).when(F.col("volatility") > 5, 1).otherwise(2))
    rows = points.collect()
    x = np.array([[r[c] for c in COLUMNS] for r in rows])
    labels = np.array([r.cluster for r in rows])
    distance = ((x[:, None] - x[None]) ** 2).sum(-1)
    want = {}
    for i, r in enumerate(rows):
        own = labels == labels[i]
        a = distance[i][own].sum() / (own.sum() - 1)
        b = min(distance[i][labels == l].mean() for l in set(labels) - {labels[i]})
        want[r.country] = (b - a) / max(a, b)
    got = {r.country: r.width for r in clustering.silhouette_widths(points).collect()}
    assert got.keys() == want.keys()
    assert all(got[c] == pytest.approx(want[c], abs=1e-9) for c in want)
    assert clustering.silhouette(points).first().silhouette == pytest.approx(np.mean(list(want.values())))


def test_silhouette_of_a_lone_point_is_zero(spark):
    points = blobs(spark, 3).withColumn("cluster", F.when(F.col("country") == "0-0", 0).otherwise(1))
    assert {r.country: r.width for r in clustering.silhouette_widths(points).collect()}["0-0"] == 0.0


def test_principal_view_keeps_distances_of_the_plane(spark):
    points = clustering.kmeans_labels(blobs(spark), 4)
    rows = clustering.principal_view(points).orderBy("country").collect()
    x = np.array([[r[c] for c in COLUMNS] for r in points.orderBy("country").collect()])
    x = x - x.mean(0)
    _, _, vt = np.linalg.svd(x, full_matrices=False)
    want = x @ vt[:2].T
    got = np.array([[r.pc1, r.pc2] for r in rows])
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-6)


@pytest.fixture(scope="module")
def week_mart(spark):
    def make(n):
        rng = np.random.default_rng(1)
        rows = [
            (f"e{i}", day("2024-01-01") + datetime.timedelta(days=t), float(rng.integers(1, 9) * (1 + i)))
            for i in range(n)
            for t in range(45)
        ]
        return spark.createDataFrame(rows, "country string, d date, new_cases double")

    return make


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_cluster_run_by_number_of_entities(week_mart, n):
    run = cluster_entities(week_mart(n), "NEW_CASES", "2024-02-14", 60)
    if n < 2:
        assert run.labelled is None and len(run.warnings) == 1
        assert run.features.count() == n
        return
    assert run.warnings == []
    assert run.labelled.count() == n and run.view.count() == n
    assert clustering.cluster_order(run.labelled).count() == n
    silhouette = run.silhouette.first().silhouette
    assert math.isnan(silhouette) if n == 2 else not math.isnan(silhouette)
    assert run.report.where("ok").count() == n


def series(spark, values, name="a", metric="NEW_CASES"):
    rows = [(name, metric, day("2024-01-01") + datetime.timedelta(days=i), v) for i, v in enumerate(values) if v != "skip"]
    return spark.createDataFrame(rows, "country string, metric string, date date, value double")


def kinds(df):
    return {r.kind: r["count"] for r in df.groupBy("kind").count().collect()}


def test_few_points_return_history_only(spark):
    assert kinds(forecast.forecast_all(series(spark, [1.0] * 9))) == {"history": 9}


@pytest.mark.parametrize("n", [10, 13, 14, 40])
def test_forecast_shape_and_interval(spark, n):
    rng = np.random.default_rng(n)
    got = forecast.forecast_all(series(spark, [float(x) for x in rng.integers(0, 50, n)]), 7)
    assert kinds(got) == {"history": n, "forecast": 7, "conf_low": 7, "conf_high": 7}
    wide = got.where("kind <> 'history'").groupBy("date").pivot("kind", ["forecast", "conf_low", "conf_high"]).sum("value").collect()
    assert min(r.date for r in wide) == day("2024-01-01") + datetime.timedelta(days=n)
    for r in wide:
        assert r.conf_low >= 0 and r.forecast <= r.conf_high
        assert r.conf_low <= r.forecast or r.forecast < 0


def test_zeros_stay_zero(spark):
    got = forecast.forecast_all(series(spark, [0.0] * 30)).where("kind <> 'history'").collect()
    assert max(abs(r.value) for r in got) < 1e-6


def test_weekly_cycle_is_repeated(spark):
    cycle = [10.0, 20.0, 30.0, 40.0, 30.0, 20.0, 5.0]
    got = forecast.forecast_all(series(spark, cycle * 6), 14).where("kind = 'forecast'").orderBy("date").collect()
    assert np.allclose([r.value for r in got], cycle * 2, atol=0.5)


def test_trend_keeps_its_direction(spark):
    got = forecast.forecast_all(series(spark, [float(i) for i in range(40)])).where("kind = 'forecast'").orderBy("date").collect()
    assert got[0].value > 38 and got[-1].value > got[0].value


def test_history_is_untouched_and_gaps_count_as_days(spark):
    values = [float(i) for i in range(12)]
    values[5] = "skip"
    got = forecast.forecast_all(series(spark, values), 7)
    assert kinds(got)["history"] == 11
    assert [r.value for r in got.where("kind = 'history'").orderBy("date").collect()] == [v for v in values if v != "skip"]


def test_gates(spark):
    assert forecast.forecast_all(series(spark, [1.0] * 20, metric=fixed.GDP_METRIC)).count() == 0
    with pytest.raises(ValueError):
        forecast_metric(spark.createDataFrame([], "country string, d date, new_cases double"), "new_cases", 91)


def test_request_gates_and_covers_every_entity(week_mart):
    got = forecast_metric(week_mart(2), "new_cases", 7)
    assert kinds(got) == {"history": 90, "forecast": 14, "conf_low": 14, "conf_high": 14}
    assert forecast_metric(week_mart(2), "new_cases", 7, entities=["E1"]).select("country").distinct().count() == 1
    with pytest.raises(ValueError):
        forecast_metric(week_mart(2), "gdp_ppp_per_capita")


def plain_errors(y, weights, season):
    """The recursion for one series and one row of weights, day by day."""
    alpha, beta, gamma, phi = weights
    level, trend, pattern = forecast._start(y, season)
    pattern, out = list(pattern), []
    for t, value in enumerate(y):
        s, base = pattern[t % len(pattern)], level + phi * trend
        out.append(value - base - s)
        risen = alpha * (value - s) + (1 - alpha) * base
        trend = beta * (risen - level) + (1 - beta) * phi * trend
        if season:
            pattern[t % len(pattern)] = gamma * (value - base) + (1 - gamma) * s
        level = risen
    return np.array(out)


def some_series():
    rng = np.random.default_rng(0)
    out = []
    for i in range(36):
        n = int(rng.choice([10, 13, 14, 15, 30, 61, 120]))
        t = np.arange(n)
        kinds = (rng.integers(0, 50, n), np.cumsum(rng.normal(0, 1, n)) + 50, 10 + 5 * np.sin(t * 2 * np.pi / 7) + rng.normal(0, 1, n), t * 2.0 + rng.normal(0, 3, n), np.zeros(n) + 5, np.exp(rng.normal(0, 2, n)))
        out.append(kinds[i % 6].astype(float).clip(0))
    return out


def test_fits_are_never_worse_than_the_grid():
    """Packed by length, all fitted together: each ends at or below its own best point of the grid, most far below it."""
    every = some_series()
    rows = forecast._rows_of([(str(i), "m", list(range(100, 100 + len(y))), y.tolist(), None) for i, y in enumerate(every)], 7)
    names = [f.strip().split()[0] for f in forecast.FITTED.split(",")]
    gained = 0
    for found in (dict(zip(names, r, strict=True)) for r in rows):
        y = every[int(found["country"])]
        season = 7 if len(y) >= 14 else 0
        weights = [found[c] for c in ("alpha", "beta", "gamma", "phi")]
        errors = plain_errors(y, weights, season)
        grid = min((plain_errors(y, w, season) ** 2).sum() for w in forecast.GRID)
        assert found["squared_error"] == pytest.approx((errors**2).sum()) and found["start_error"] == pytest.approx(grid)
        assert found["squared_error"] <= grid * (1 + 1e-9)
        assert found["spread"] == pytest.approx(errors.std(ddof=1)) and found["n_days"] == len(y)
        assert (np.array(weights) >= forecast.LOWEST).all() and (np.array(weights) <= forecast.HIGHEST).all()
        gained += found["squared_error"] < grid * 0.99
    assert gained > 18


def test_given_weights_are_used(spark):
    y = some_series()[6]
    points = series(spark, y.tolist()).withColumns({"a": F.lit(0.3), "b": F.lit(0.05), "c": F.lit(0.2), "p": F.lit(0.9)})
    found = forecast.fit_series(points, 7, ("a", "b", "c", "p")).first()
    assert found.squared_error == pytest.approx((plain_errors(y, (0.3, 0.05, 0.2, 0.9), 7 if len(y) >= 14 else 0) ** 2).sum()) and found.start_error is None


def test_kmeans_equals_a_plain_run(spark):
    """Same seeded starts, then Lloyd's rounds of each restart by itself."""
    rng = np.random.default_rng(3)
    table = rng.normal(0, 1, (150, 6)) + rng.integers(0, 3, (150, 1))
    names = [f"e{i}" for i in range(150)]
    rows = spark.createDataFrame([(n, *map(float, p)) for n, p in zip(names, table, strict=True)], "id string, " + ", ".join(f"c{i} double" for i in range(6))).repartition(5)
    ends = []
    for restart in range(6):
        centres = []
        for step in range(3):
            away = np.min([((table - c) ** 2).sum(1) for c in centres], axis=0) if centres else np.ones(150)
            race = [-math.log(clustering.chance(9, restart, step, n)) / a if a else math.inf for n, a in zip(names, away, strict=True)]
            centres.append(table[int(np.argmin(race))])
        centres = np.array(centres)
        for _ in range(300):
            nearest = ((table[:, None] - centres) ** 2).sum(2).argmin(1)
            moved = np.array([table[nearest == c].mean(0) if (nearest == c).any() else centres[c] for c in range(3)])
            shift, centres = ((moved - centres) ** 2).sum(), moved
            if shift <= clustering.TOLERANCE * table.var(0).mean():
                break
        ends.append((((table[:, None] - centres) ** 2).sum(2).min(1).sum(), sorted(centres.tolist())))
    want = min(ends, key=lambda x: x[0])[1]
    assert np.allclose(clustering.kmeans_centres(rows, 3, 6, 9), want)


def test_restarts_share_their_passes(spark, monkeypatch):
    """A pass serves all restarts, so more of them take no more seeding passes and only as many rounds as the slowest."""
    rows = blobs(spark).select(F.col("country").alias("id"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(COLUMNS)]).persist()
    passes = []
    inner = clustering._assigned
    monkeypatch.setattr(clustering, "_assigned", lambda *a: passes.append(len(a[1])) or inner(*a))
    rounds = {}
    for restarts in (1, 10):
        passes.clear()
        clustering.kmeans_centres(rows, 4, restarts)
        rounds[restarts] = len(passes)
    assert rounds[10] <= rounds[1] + 12 and passes[0] == 10 and passes == sorted(passes[:-1], reverse=True) + [10]
    rows.unpersist()


def test_fewer_points_than_clusters(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "id string, c0 double")
    assert clustering.kmeans_centres(rows, 3, 4).tolist() == [[1.0]] * 3


def test_a_report_costs_no_fit(week_mart, monkeypatch):
    def refuse(*_):
        raise AssertionError("fitted")

    monkeypatch.setattr(clustering, "kmeans_centres", refuse)
    run = cluster_entities(week_mart(5), "NEW_CASES", "2024-02-14", 60)
    assert run.report.count() == 5
    with pytest.raises(AssertionError, match="fitted"):
        run.labels


def test_series_without_features_are_named(spark):
    stats = spark.createDataFrame([("a", 30, 30, 5, True), ("b", 30, 30, 5, False)], "country string, len int, nnz int, weeks int, described boolean")
    stats = stats.withColumns({"first": F.lit(None).cast("date"), "last": F.lit(None).cast("date")})
    got = {r.country: (r.ok, r.reason) for r in run_report(stats)}
    assert got == {"a": (True, ""), "b": (False, fixed.NO_FEATURES)}


def run_report(stats):
    from daymart.operators.series import series_report

    return series_report(stats, stats, has_features=F.col("described")).collect()
