"""Numeric tests of the fitted models and of the queries that SQL can't express, against NumPy on the smallest tables."""

import math
import os
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetmill.operators import models
from fleetmill.operators import resampling as rs
from fleetmill.plans import model_queries as mq
from fleetmill.plans.queries import QUERIES
from fleetmill.sources import bindings as b
from fleetmill.streaming import scoring

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def rows(spark):
    return mq.rows(spark, DIR).toPandas()


def rmse(pdf):
    return math.sqrt(((pdf["pred"] - pdf["rul"]) ** 2).mean())


@pytest.mark.parametrize("name", ["model_forest", "model_gbt"])
def test_trees_beat_the_mean(spark, rows, name):
    got = QUERIES[name](spark, DIR).toPandas()
    train, test = rows[rows.unit % 5 != 0], rows[rows.unit % 5 == 0]
    assert sorted(got["unit"].tolist()) == sorted(test["unit"].tolist())
    assert rmse(got) < math.sqrt(((test["rul"] - train["rul"].mean()) ** 2).mean())


def test_a_forest_of_many_rows_is_fitted_to_portions_of_equal_rows(spark, rows, monkeypatch):
    seen, fit = [], models.RandomForestRegressor.fit
    monkeypatch.setattr(models, "CELL_ROWS", 100)
    monkeypatch.setattr(models, "RANGES", 4)
    monkeypatch.setattr(models.RandomForestRegressor, "fit", lambda self, df: seen.append(df.agg(F.count("*"), F.sum("weight"), F.max("weight"), F.sum(F.col("weight") * F.col("rul"))).first()) or fit(self, df))
    got = QUERIES["model_forest"](spark, DIR).toPandas()
    train, test = rows[rows.unit % 5 != 0], rows[rows.unit % 5 == 0]
    n, weight, _, total = seen[0]
    assert n <= 100 + 4**3 < len(train) == weight and total == pytest.approx(train["rul"].sum())
    assert sorted(got["unit"].tolist()) == sorted(test["unit"].tolist())
    assert rmse(got) < math.sqrt(((test["rul"] - train["rul"].mean()) ** 2).mean())


def test_boosted_importances_add_up(spark):
    got = QUERIES["gbt_importances"](spark, DIR).collect()
    assert {r.feature for r in got} == set(mq.X) and sum(r.importance for r in got) == pytest.approx(1.0)
    assert [r.importance for r in got] == sorted((r.importance for r in got), reverse=True)


def test_refit_predicts_every_unit_within_the_budget(spark, rows):
    got = QUERIES["refit_all_units"](spark, DIR).collect()
    assert {r.unit for r in got} == set(rows["unit"]) and len({r.rounds for r in got}) == 1 and 1 <= got[0].rounds <= 500


def logistic(x, y, xt, c=1.0):
    """L2-penalised logistic regression by Newton's steps; features standardised by the training rows."""
    m, d = x.mean(0), x.std(0)
    d[d == 0] = 1
    z, w = np.column_stack([np.ones(len(x)), (x - m) / d]), np.zeros(x.shape[1] + 1)
    pen = np.diag([0.0] + [1 / c] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + pen, z.T @ (p - y) + pen @ w)
    return 1 / (1 + np.exp(-np.column_stack([np.ones(len(xt)), (xt - m) / d]) @ w))


def test_logistic_and_cross_fit_match_newton(spark):
    e = mq.early(spark, DIR).toPandas().sort_values("unit")
    train, test = e[e.unit % 5 != 0], e[e.unit % 5 == 0]
    got = QUERIES["model_logistic"](spark, DIR).toPandas().sort_values("unit")
    want = logistic(train[mq.EARLY].to_numpy(), train["y"].to_numpy(), test[mq.EARLY].to_numpy())
    assert got["unit"].tolist() == test["unit"].tolist() and np.allclose(got["p"], want, atol=1e-3)
    cross = QUERIES["cross_fit_probability"](spark, DIR).toPandas().set_index("unit")["p"]
    for k in range(3):
        a, o = train[train.fold != k], train[train.fold == k]
        if len(o):
            assert np.allclose(cross[o["unit"]], logistic(a[mq.EARLY].to_numpy(), a["y"].to_numpy(), o[mq.EARLY].to_numpy()), atol=1e-3)


def test_identifiability_is_the_auc_of_held_out_probabilities(spark):
    e = mq.early(spark, DIR).toPandas()
    p = {}
    for k in range(3):
        a, o = e[e.fold != k], e[e.fold == k]
        p.update(zip(o["unit"], logistic(a[mq.EARLY].to_numpy(), a["y"].to_numpy(), o[mq.EARLY].to_numpy())))
    pos, neg = ([p[u] for u, y in zip(e["unit"], e["y"]) if y == v] for v in (1, 0))
    auc = np.mean([(x > z) + (x == z) / 2 for x in pos for z in neg])
    assert QUERIES["identifiability"](spark, DIR).first().auc == pytest.approx(auc, abs=0.02)


def test_health_index_is_the_first_component_rising_to_failure(spark):
    got = {r.sensor: (r.loading, r.explained) for r in QUERIES["health_index_fit"](spark, DIR).collect()}
    from fleetmill.operators import features as f

    z = b.with_rul(f.zscore_masked(b.cycles(spark, DIR).withColumnRenamed("op1", "regime"), mq.X)).toPandas()
    names = [f"{c}_n" for c in mq.X]
    values, vecs = np.linalg.eigh(np.cov(z[names].to_numpy().T, bias=True))
    v = vecs[:, -1] * (-1 if np.corrcoef(z[names].to_numpy() @ vecs[:, -1], z["rul_true"])[0, 1] > 0 else 1)
    assert np.allclose([got[n][0] for n in names], v, atol=1e-6) and got[names[0]][1] == pytest.approx(values[-1] / values.sum())


def test_elbow_runs_from_total_to_no_inertia(spark):
    got = QUERIES["elbow_inertia"](spark, DIR).first()
    x = b.cycles(spark, DIR).select(*b.OPS).toPandas().to_numpy()
    x = (x - x.mean(0)) / x.std(0)
    assert got.k1 == pytest.approx((x**2).sum()) and got.k1 > got.k2 > got.k3 > got.k5 == pytest.approx(0, abs=1e-6)


def brute_gain(signs):
    """The best split of sign vectors into two groups, over all splits of the distinct ones."""
    kinds, n = np.unique(signs, axis=0, return_counts=True)
    total = (n[:, None] * (kinds - np.average(kinds, axis=0, weights=n)) ** 2).sum()
    best = total
    for side in product((0, 1), repeat=len(kinds)):
        side = np.array(side)
        if 0 < side.sum() < len(kinds):
            best = min(best, sum((n[side == s][:, None] * (kinds[side == s] - np.average(kinds[side == s], axis=0, weights=n[side == s])) ** 2).sum() for s in (0, 1)))
    return 1 - best / total


def test_split_gain_and_permutation_test(spark):
    signs = mq.sign_rows(spark, DIR).select("s2", "s4", "s8").toPandas().to_numpy()
    got = QUERIES["split_gain"](spark, DIR).first()
    assert got.units == len(signs) and got.gain <= brute_gain(signs) + 1e-9 and got.gain >= 0.9 * brute_gain(signs)
    p = QUERIES["permutation_test"](spark, DIR).first()
    assert p.gain == pytest.approx(got.gain) and 1 / 21 <= p.p <= 1


def test_permutation_keeps_each_sensors_signs(spark):
    """Opposite trends in two groups of units: no dealt replicate splits as well."""
    both = [([1.0, 1.0, 1.0], 30.0), ([-1.0, -1.0, -1.0], 30.0)]
    mixed = [([x, y, z], 7.5) for x, y, z in product((1.0, -1.0), repeat=3)]
    assert models.split_gain(both) == pytest.approx(1.0) and models.split_gain(mixed) < 0.5


def test_subpopulation_labels_put_the_larger_group_first(spark):
    n = QUERIES["subpopulation_labels"](spark, DIR).groupBy("cluster").count().orderBy("cluster").collect()
    assert [r["count"] for r in n] == sorted((r["count"] for r in n), reverse=True)


def test_component_intervals_hold_the_loading(spark):
    rows_ = QUERIES["pca_loading_ci"](spark, DIR).collect()
    assert {r.cluster for r in rows_} == {"all", "0", "1"} and all(r.ci_lo <= r.ci_hi and r.defined == 1 for r in rows_)
    c = b.cycles(spark, DIR).select(*mq.X).toPandas().to_numpy()
    v = np.linalg.eigh(np.cov(c.T, bias=True))[1][:, -1]
    v *= np.sign(v[np.argmax(np.abs(v))])
    for s, x in zip(mq.X, v, strict=True):
        r = next(r for r in rows_ if r.cluster == "all" and r.sensor == s)
        assert r.ci_lo - 0.02 <= x <= r.ci_hi + 0.02


def test_components_with_a_reversed_sign_are_told(spark):
    r = np.random.default_rng(1)
    t = r.normal(size=(40, 50))
    data = [(u, float(t[u, i] * 5), float((1 if u % 2 else -1) * t[u, i])) for u in range(40) for i in range(50)]
    per = models.moments(spark.createDataFrame(data, "unit long, p double, q double"), ["p", "q"], ["unit"]).withColumn("g", (F.col("unit") % 2).cast("string"))
    drawn = rs.draws(per.select("unit"), 10)
    ci = {(x.g, x.sensor): (x.ci_lo, x.ci_hi) for x in rs.interval(models.component_draws(per, drawn, ["p", "q"], ["g"]), ["g", "sensor"], "loading").collect()}
    assert ci["1", "q"][0] > 0 > ci["0", "q"][1]


def test_squared_silhouette_matches_brute_force(spark):
    r = np.random.default_rng(2)
    x, g = r.normal(size=(60, 2)) + np.repeat([[0, 0], [3, 1], [9, 9]], [25, 34, 1], axis=0), np.repeat([0, 1, 2], [25, 34, 1])
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    s = []
    for i in range(60):
        own = (g == g[i]) & (np.arange(60) != i)
        a, o = d[i, own].mean() if own.any() else None, min(d[i, g == k].mean() for k in set(g) - {g[i]})
        s.append(0.0 if a is None else (o - a) / max(a, o))
    df = spark.createDataFrame([(float(p), float(q), int(k)) for (p, q), k in zip(x, g)], "x double, y double, g int")
    assert models.silhouette_squared(df, ["x", "y"], "g").first().silhouette == pytest.approx(np.mean(s))


def streamed(spark, folder, batches, schema, build):
    for batch in batches:
        spark.createDataFrame(batch, schema).write.mode("append").parquet(f"{folder}/in")
        out = scoring.drained(build(spark.readStream.schema(schema).parquet(f"{folder}/in")), str(folder))
    return out


def test_stream_features_of_cycles_out_of_order_are_the_batch_features(spark, tmp_path):
    data = [(u, c, float(c * c % 17 + u)) for u in range(3) for c in range(1, 13)]
    batches = [[r for r in data if r[1] % 4 == 3], [r for r in data if r[1] % 4 in (0, 2)], [r for r in data if r[1] < 4], [r for r in data if r[1] % 4 == 1]]
    out = streamed(spark, tmp_path, batches, "unit long, cycle long, s double", lambda x: scoring.stream_features(x, "s", 5))
    got = sorted((r.unit, r.cycle, round(r.level, 9), round(r.slope, 9), r.n_cycles_used) for r in out.collect())
    whole = spark.createDataFrame([("d", *r) for r in data], "dataset string, unit long, cycle long, s double")
    want = sorted((r.unit, r.cycle, round(r.level, 9), round(r.slope if r.cycle > 1 else 0.0, 9), r.n_cycles_used) for r in scoring.batch_features(whole, "s", 5).collect())
    assert got == want


def test_idle_units_are_counted_out_and_forgotten(spark, tmp_path):
    """Unit 1 lacks a cycle for ever: once the watermark has passed it by, what waits is counted without it."""
    import datetime as dt

    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    batches = [[(1, 1, 1.0, at(0)), (1, 3, 3.0, at(1))], [(2, 1, 5.0, at(30))], [(2, 2, 6.0, at(60))], [(1, 4, 9.0, at(61))]]
    out = streamed(spark, tmp_path, batches, "unit long, cycle long, s double, ts timestamp", lambda x: scoring.stream_features(x.withWatermark("ts", "1 hour"), "s", 5, "ts", "2 hours"))
    got = sorted((r.unit, r.cycle, r.n_cycles_used) for r in out.collect())
    assert got[:2] == [(1, 1, 1), (1, 3, 2)] and (2, 1, 1) in got


def test_alerts_drop_late_rows(spark, tmp_path):
    import datetime as dt

    day = lambda d: dt.datetime(2024, 1, d, 12)
    batches = [[(day(1), "x"), (day(2), "x")], [(day(9), "y")], [(day(2), "late"), (day(9), "y")], [(day(20), "mark")]]
    out = streamed(spark, tmp_path, batches, "ts timestamp, bucket string", lambda x: scoring.bucket_alerts(x.withWatermark("ts", "2 days"), "ts", "1 day"))
    assert sorted((r.start.day, r.bucket, r.n) for r in out.collect()) == [(1, "x", 1), (2, "x", 1), (9, "y", 2)]


def test_no_registered_plan_sorts_all_rows_in_one_task(spark):
    """No query puts units or rows into a single partition to number or to sum them."""
    names = ["bootstrap_draws", "ks_two_sample", "roc_auc", "label_shuffle_control", "silhouette", "benchmark_view", "permutation_test", "paired_compare", "largest_remainder_alloc"]
    for name in names:
        plan = QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
        windows = [i for i, line in enumerate(plan.split("\n")) if "Window [" in line or "+- Window" in line]
        lines = plan.split("\n")
        assert not any("SinglePartition" in "".join(lines[i + 1 : i + 4]) for i in windows), name
        assert "Cartesian" not in plan, name
