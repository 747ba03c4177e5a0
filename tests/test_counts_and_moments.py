"""Order keys, frequent values, fingerprints and pairwise moments against plain versions."""

import collections
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from daymart.operators import fingerprints, frequent, gram, profile, quantiles


def test_order_keys_are_the_bits_of_a_double(spark):
    rng = random.Random(1)
    values = [struct.unpack("<d", rng.getrandbits(64).to_bytes(8, "little"))[0] for _ in range(3000)]
    powers = [2.0**e for e in range(-1074, 1024)]
    values += powers + [-p for p in powers] + [math.nextafter(p, 0) for p in powers] + [math.nextafter(p, math.inf) for p in powers]
    values += [0.0, -0.0, math.inf, -math.inf, math.nan, 0.1, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in quantiles.with_order_key(df, "v", "k").withColumn("back", quantiles.from_order_key(F.col("k"))).collect():
        if r.v is None:
            assert r.k is None and r.back is None
        elif math.isnan(r.v):
            assert r.k == quantiles.INFINITE + 1 and math.isnan(r.back)
        else:
            bits = struct.unpack("<q", struct.pack("<d", abs(r.v)))[0]
            assert r.k == (-bits if r.v < 0 else bits) and r.back == r.v


def test_weighted_quantiles(spark):
    rng = random.Random(2)
    rows = [(rng.choice([-3.5, 0.0, 1e-9, 7.0, 1e12]), rng.randint(1, 5)) for _ in range(300)]
    got = quantiles.exact_quantiles(spark.createDataFrame(rows, "x double, w int"), "x", [0.2, 0.5, 0.77], weight="w").first()
    every = [x for x, w in rows for _ in range(w)]
    assert [got.q0, got.q1, got.q2] == pytest.approx(list(np.quantile(every, [0.2, 0.5, 0.77]))) and got.n == len(every)


def top(values, k):
    counts = collections.Counter(v for v in values if v is not None)
    return [(v, n) for v, n in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:k]]


@pytest.mark.parametrize("most", [1 << 16, 16])
def test_frequent_values_are_exact(spark, monkeypatch, most):
    """Few values, a heavy head on a long tail, all different, nulls only; with and without room for more counters."""
    monkeypatch.setattr(frequent, "MOST_COUNTERS", most)
    rng = random.Random(3)
    rows = []
    for i in range(6000):
        head = f"h{min(int(rng.expovariate(0.3)), 30)}" if rng.random() < 0.6 else f"t{rng.randrange(3000)}"
        rows.append((rng.choice(["a", "b", None]), head, i, None, rng.choice([0.5, -0.0, 2.0])))
    df = spark.createDataFrame(rows, "few string, heavy string, key long, nothing string, `n.x` double").repartition(4)
    got = collections.defaultdict(list)
    for r in frequent.frequent_values(df, 5, counters=8).orderBy("column_name", "position").collect():
        got[r.column_name].append((r.value, r.n))
    want = {c: top([None if r[i] is None else str(r[i]) for r in rows], 5) for i, c in enumerate(df.columns)}
    assert got == {c: v for c, v in want.items() if v}


def test_frequent_values_shuffle_no_more_for_more_distinct_values(spark, monkeypatch):
    """The head is found with the same counters, and only its values are counted, whatever the tail."""
    kept, joined = [], []
    inner, counted = frequent.stage, frequent._counted
    monkeypatch.setattr(frequent, "stage", lambda df: kept.append(inner(df)) or kept[-1])
    monkeypatch.setattr(frequent, "_counted", lambda *a: joined.append(len(a) == 3) or counted(*a))
    sizes = []
    for n in (20_000, 40_000):
        kept.clear()
        tail = F.concat(F.lit("t"), F.col("id")).alias("v")
        df = spark.range(0, n, 1, 4).select(F.when(F.col("id") % 2 == 0, F.concat(F.lit("h"), F.col("id") % 10)).otherwise(tail).alias("v"))
        got = frequent.frequent_values(df, 5, counters=256).collect()
        assert [(r.value, r.n) for r in sorted(got, key=lambda r: r.position)] == [(f"h{i}", n // 10) for i in (0, 2, 4, 6, 8)]
        sizes.append(sum(df.count() for df in kept))
    assert all(joined) and sizes[1] <= sizes[0] * 1.1


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, "", "a", "b" * 50]), rng.choice([None, 0.0, -0.0, 1.5, float("nan")]), rng.choice([None, 1, 2])) for _ in range(300)]
    rows += [(None, None, 5), (None, 5.0, None), ("x", None, None), ("solo", 9.0, 9)]
    return spark.createDataFrame(rows, "`a.b` string, f double, i int").repartition(3).persist()


@pytest.mark.parametrize("colliding", [False, True])
def test_fingerprints_are_exact_even_if_they_collide(mixed, monkeypatch, colliding):
    if colliding:
        monkeypatch.setattr(fingerprints, "fingerprint", lambda df, columns: [F.lit(7).cast("long"), F.length(F.coalesce(F.col(f"`{columns[0]}`"), F.lit("")))])
    want = mixed.distinct().count()
    got = profile.duplicate_rows(mixed).first()
    assert (got.n_rows, got.n_distinct_rows, got.n_duplicates) == (mixed.count(), want, mixed.count() - want)
    values = mixed.select(F.lit("c").alias("column_name"), F.col("`a.b`").alias("value"))
    found = fingerprints.text_counts(values).first()
    assert (found.n_rows, found.n_distinct) == (mixed.count(), mixed.select(F.count_distinct("`a.b`")).first()[0])
    assert found.n_null == mixed.where("`a.b` is null").count()
    assert profile.duplicate_rows(mixed.limit(0)).first().n_distinct_rows == 0


def test_rows_cross_as_fingerprints(spark, monkeypatch):
    """What the first shuffle carries does not depend on the width of a row."""
    plans = []
    inner = fingerprints.stage
    monkeypatch.setattr(fingerprints, "stage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or inner(df))
    wide = spark.range(100).select("id", *[F.concat(F.lit("wide"), F.col("id") + i).alias(f"wide{i}") for i in range(20)])
    assert profile.duplicate_rows(wide).first().n_duplicates == 0
    crossing = plans[0][: plans[0].rindex("Exchange")]
    assert "_f1" in crossing and "wide" not in crossing


def test_profile_reads_numbers_once(spark, monkeypatch):
    """All statistics of numbers come from one stored count; of extreme values too."""
    values = [1e-300, -1e300, 1e300, 2e-300, 0.0, 5.0, 5.0, None, 1e8, 1e8 + 1e-7]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "x double, i int")
    got = {r.column_name: r for r in profile.column_profile(df).collect()}
    known = [v for v in values if v is not None]
    assert (got["x"].n_rows, got["x"].n_null, got["x"].n_distinct, got["x"].n_zero, got["x"].n_negative) == (10, 1, 8, 1, 1)
    assert [got["x"].p25, got["x"].p50, got["x"].p75] == pytest.approx(list(np.quantile(known, [0.25, 0.5, 0.75])))
    assert (got["i"].mean, got["i"].std, got["i"].p50) == pytest.approx((4.5, np.std(range(10), ddof=1), 4.5))
    assert got["x"].min_value == -1e300 and got["x"].max_value == 1e300


def test_spread_of_large_numbers(spark):
    df = spark.range(1000).select((F.lit(1e9) + F.col("id") * 1e-6).alias("x"), (F.lit(1e9) - F.col("id") % 7).alias("y"))
    rows = np.array([tuple(r) for r in df.collect()])
    got = profile.column_profile(df).where("column_name = 'x'").first()
    assert got.std == pytest.approx(rows[:, 0].std(ddof=1), rel=1e-6)
    assert gram.correlations(df, ["x", "y"]).first().correlation == pytest.approx(np.corrcoef(rows.T)[0, 1], abs=1e-6)


def test_pairwise_moments_skip_what_a_pair_does_not_know(spark):
    rng = np.random.default_rng(5)
    table = rng.normal(100, 1, (400, 4)) @ rng.normal(0, 1, (4, 4))
    rows = [tuple(None if rng.random() < 0.2 else float(x) for x in row) for row in table] + [(None,) * 4]
    df = spark.createDataFrame(rows, "a double, `b.c` double, d double, e double").repartition(7).withColumn("one", F.lit(1)).withColumn("none", F.lit(None).cast("int"))
    names = df.columns
    got = {(r.left_column, r.right_column): r.correlation for r in profile.correlation_matrix(df).collect()}
    assert len(got) == 15
    for i in range(4):
        for j in range(i + 1, 4):
            both = np.array([(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None])
            assert got[names[i], names[j]] == pytest.approx(np.corrcoef(both.T)[0, 1])
    assert math.isnan(got["a", "one"]) and got["a", "none"] is None
    plan = profile.correlation_matrix(df)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "hashpartitioning" not in plan
    assert profile.correlation_matrix(df.limit(0)).count() == 0


def test_principal_axes(spark):
    rng = np.random.default_rng(6)
    table = rng.normal(0, 1, (300, 4)) * [5, 2, 1, 0.1] + 1e4
    df = spark.createDataFrame([tuple(map(float, r)) for r in table], "a double, b double, c double, d double").repartition(5)
    mean, axes = gram.principal_axes(df, df.columns, 2)
    _, _, want = np.linalg.svd(table - table.mean(0))
    assert np.allclose(mean, table.mean(0)) and np.allclose(np.abs(axes.T), np.abs(want[:2]), atol=1e-9)
    assert (axes[np.abs(axes).argmax(0), [0, 1]] > 0).all()
