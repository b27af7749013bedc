"""Quantiles by ranges, Poisson draws, statistics as arguments: against NumPy, exact draws and coverage."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetmill.operators import quantiles as q
from fleetmill.operators import resampling as rs
from fleetmill.plans.queries import QUERIES

DIR = "/root/testdata/sf0.001"
PROBS = {"lo": 0.0, "p10": 0.1, "mid": 0.5, "p75": 0.75, "hi": 1.0}


def rows(seed, n):
    r = np.random.default_rng(seed)
    key = np.where(r.random(n) < 0.4, "hot", r.choice(["a", "b", "c", None], n))
    x = np.where(r.random(n) < 0.1, None, np.where(r.random(n) < 0.3, 7.0, r.normal(0, 10, n).round(1)))
    return [(k, None if v is None else float(v), int(w)) for k, v, w in zip(key, x, r.integers(0, 4, n), strict=True)]


@pytest.mark.parametrize("weighted", [False, True])
def test_quantiles_match_numpy(spark, weighted):
    data = [*rows(1, 500), ("one", 3.5, 1), ("none", None, 2), ("zero", None, 0)]
    df = spark.createDataFrame(data, "side string, x double, w long")
    got = {r[0]: tuple(r[1:]) for r in q.quantiles(df, "x", PROBS, ["side"], "w" if weighted else None).collect()}
    for k in {d[0] for d in data}:
        v = [x for s, x, w in data if s == k and x is not None for _ in range(w if weighted else 1)]
        want = np.quantile(v, list(PROBS.values())) if v else [None] * len(PROBS)
        assert got[k] == (pytest.approx(want) if v else tuple(want)), k
    assert len(got) == len({d[0] for d in data})


def test_quantiles_without_keys_and_of_nothing(spark):
    df = spark.createDataFrame([(float(i % 10),) for i in range(101)], "x double")
    assert q.median(df, F.col("x") + 1).first().median == 1 + np.median([i % 10 for i in range(101)])
    assert [tuple(r) for r in q.median(df.limit(0), "x").collect()] == [(None,)]
    assert q.median(df.withColumn("k", F.lit(1)).limit(0), "x", "m", ["k"]).count() == 0


def test_quantiles_by_shuffled_join(spark, monkeypatch):
    monkeypatch.setattr(q, "WANTED_ROWS", 0)
    df = spark.createDataFrame([(i % 7, float(i * i % 31)) for i in range(400)], "k long, x double")
    got = {r.k: r.m for r in q.median(df, "x", "m", ["k"]).collect()}
    assert got == {k: np.median([i * i % 31 for i in range(400) if i % 7 == k]) for k in range(7)}


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", ["describe_columns", "dataset_profile", "shuffle_null", "sensor_class", "flip_agreement", "onset_quantiles", "sensor_onset", "direction_consistency", "cluster_life_compare"])
def test_no_buffer_of_all_values(spark, name):
    plan = QUERIES[name](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan.lower()


def test_poisson_counts():
    total = sum(math.exp(-1) / math.factorial(k) for k in range(len(rs.POISSON)))
    assert rs.POISSON[-1] == pytest.approx(total) and 1 - rs.POISSON[-1] < 2.0**-32
    assert rs.POISSON == sorted(rs.POISSON)


def test_poisson_weights_have_mean_and_variance_1(spark):
    w = rs.poisson(spark.range(4000).select(F.col("id").alias("unit")), 25).select("unit", "replicate", "w")
    n = 4000 * 25
    s, s2 = w.agg(F.sum("w"), F.sum(F.col("w") * F.col("w"))).first()
    assert abs(s / n - 1) < 0.015 and abs(s2 / n - (s / n) ** 2 - 1) < 0.03
    per = [r[0] for r in w.groupBy("replicate").agg(F.sum("w")).select("sum(w)").collect()]
    assert abs(np.std(per) / math.sqrt(4000) - 1) < 0.5  # replicates are drawn apart from each other
    assert "Exchange" not in w._jdf.queryExecution().executedPlan().toString()
    assert w.count() == w.dropDuplicates(["unit", "replicate"]).count()


def test_poisson_intervals_agree_with_exact_draws(spark):
    r = np.random.default_rng(3)
    values = spark.createDataFrame([(i, float(x)) for i, x in enumerate(r.gamma(2.0, 3.0, 400))], "unit long, x double")
    stats = {"mean": rs.mean, "cv": rs.cv, "median": 0.5}
    a = {x.stat: x for x in rs.bootstrap_ci(values, "x", 300, stats).collect()}
    b = {x.stat: x for x in rs.bootstrap_ci(values, "x", 300, stats, "p", "poisson").collect()}
    for s in stats:
        assert a[s].estimate == pytest.approx(b[s].estimate)
        assert b[s].ci_hi - b[s].ci_lo == pytest.approx(a[s].ci_hi - a[s].ci_lo, rel=0.25)
        assert abs(b[s].ci_lo - a[s].ci_lo) < 0.3 * (a[s].ci_hi - a[s].ci_lo)


def test_poisson_intervals_cover(spark):
    r = np.random.default_rng(11)
    data = [(g, g * 1000 + i, float(x)) for g in range(150) for i, x in enumerate(r.normal(5, 2, 50))]
    df = spark.createDataFrame(data, "g long, unit long, x double")
    reps = rs.poisson(df, 200).groupBy("g", "replicate").agg(rs.mean(F.col("x"), F.col("w")).alias("m"))
    ci = rs.interval(reps, ["g"], "m").collect()
    assert 0.88 <= sum(c.ci_lo <= 5 <= c.ci_hi for c in ci) / len(ci) <= 0.99


def test_a_statistic_that_the_library_does_not_know(spark):
    values = spark.createDataFrame([(i, float(1 + i % 9)) for i in range(200)], "unit long, x double")
    harmonic = lambda v, w: F.sum(w) / F.sum(w / v)
    got = {r.stat: r for r in rs.bootstrap_ci(values, "x", 60, {"harmonic": harmonic, "p90": 0.9}).collect()}
    assert got["harmonic"].estimate == pytest.approx(200 / sum(1 / (1 + i % 9) for i in range(200)))
    assert got["harmonic"].ci_lo < got["harmonic"].estimate < got["harmonic"].ci_hi
    assert got["p90"].estimate == np.quantile([1 + i % 9 for i in range(200)], 0.9)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_every_metric_has_an_interval_by_both_truths(spark):
    from fleetmill.operators import evaluation as e
    from fleetmill.sources import bindings as b

    got = {(r.truth, r.metric): r for r in QUERIES["bootstrap_metric_ci"](spark, DIR).collect()}
    names = {"rmse", "mae", "late_pct", "bias", "score_mean"} | {f"{m}_{n}" for m in ("rmse", "late_pct", "bias") for n, _, _ in b.BUCKETS}
    assert set(got) == {(t, n) for t in ("uncapped", "capped") for n in names}
    pts = b.points(spark, DIR)
    rows = {t: e.with_truth(pts, cap).toPandas() for t, cap in (("uncapped", None), ("capped", b.CAP))}
    for t, p in rows.items():
        urgent = p[(p.y >= 10) & (p.y < 20)]
        assert got[t, "mae"].estimate == pytest.approx((p.pred - p.y).abs().mean(), abs=1e-6)
        assert got[t, "late_pct_urgent"].estimate == pytest.approx(100 * (urgent.pred > urgent.y).mean(), abs=1e-6)
        assert (got[t, "late_pct_urgent"].n_points, got[t, "late_pct_urgent"].n_units) == (len(urgent), urgent.unit.nunique())
        assert (got[t, "mae"].n_points, got[t, "mae"].n_units) == (len(p), p.unit.nunique())
    assert all(r.ci_lo <= r.estimate <= r.ci_hi for (_, n), r in got.items() if n in ("rmse", "mae", "bias")) and all(0 < r.defined <= 1 for r in got.values())


def test_sums_by_counts_are_those_of_drawn_rows(spark):
    df = spark.createDataFrame([(i, i % 3, float(i % 7), None if i % 5 == 0 else float(i)) for i in range(300)], "unit long, g long, x double, y double").repartition(3)
    want = rs.poisson(df, 20).groupBy("g", "replicate").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("x")).alias("x"), F.sum(F.col("w") * F.col("y")).alias("y"))
    got = rs.poisson_sums(df, ["x", "y"], 20, ["g"]).groupBy("g", "replicate").agg(F.sum("w").alias("w"), F.sum("x").alias("x"), F.sum("y").alias("y"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
