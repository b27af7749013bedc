"""Boosting with patience, cross-validated candidates, saved pipelines, silhouettes, agreement over seeds."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from fleetmill.operators import models
from fleetmill.operators import resampling as rs
from fleetmill.operators import scoring_pipeline as pl

BUCKETS = [("low", 0, 10), ("high", 10, None)]


@pytest.fixture(scope="module")
def curve(spark):
    r = np.random.default_rng(2)
    x = r.uniform(-2, 2, (400, 2))
    y = np.sin(2 * x[:, 0]) + 0.4 * x[:, 1] + r.normal(0, 0.6, 400)
    return spark.createDataFrame([(float(a), float(b), float(c), i % 4) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "a double, b double, y double, fold int").coalesce(2).cache()


@pytest.mark.parametrize(("errors", "patience", "want"), [
    ([5.0, 4.0, 3.0, 3.5, 3.4], 2, (3, True)), ([5.0, 4.0, 3.0, 3.5], 2, (3, False)), ([5.0, 5.0, 5.0], 2, (1, True)), ([3.0], 1, (1, False)), ([3.0, 4.0, 2.0], 1, (1, True)),
])
def test_the_search_ends_when_patience_does(errors, patience, want):
    assert models.stopping_round(errors, patience) == want


def test_boosting_keeps_the_rounds_up_to_the_least_error(spark, curve):
    train, other = curve.where("fold <> 3"), curve.where("fold = 3")
    fit, errors = models.boosted_with_patience(train, other, ["a", "b"], "y", rounds=60, patience=8, first=6)
    best = fit.getNumTrees
    assert errors[best - 1] == min(errors[: best + 8]) and len(errors) >= best + 8
    held = models.vectors(other, ["a", "b"])
    assert fit.evaluateEachIteration(held, "squared")[-1] == pytest.approx(errors[best - 1])
    again = models.boosted(train, ["a", "b"], "y", best)
    a, b = ([r.prediction for r in m.transform(held).collect()] for m in (fit, again))
    assert a == pytest.approx(b)
    assert models.boosted_with_patience(train, other, ["a", "b"], "y", rounds=5, patience=50, first=64)[0].getNumTrees <= 5


def test_held_out_predictions_are_those_of_separate_fits(curve):
    rows = curve.withColumn("fold", F.col("fold") % 2)
    make = {"ridge": LinearRegression(labelCol="y", regParam=0.1), "plain": LinearRegression(labelCol="y")}
    model = models.cross_validated(rows, ["a", "b"], "y", make, 2)
    out = models.held_out(model, rows, list(make))
    assert out.count() == 2 * rows.count()
    for name, k in itertools.product(make, range(2)):
        alone = make[name].fit(models.vectors(rows.where(F.col("fold") != k), ["a", "b"])).transform(models.vectors(rows.where(F.col("fold") == k), ["a", "b"]))
        got = sorted(r.raw for r in out.where((F.col("candidate") == name) & (F.col("fold") == k)).collect())
        assert got == pytest.approx(sorted(r.prediction for r in alone.collect()))
    rmse = [math.sqrt(np.mean([(r.raw - r.y) ** 2 for r in out.where((F.col("candidate") == "ridge") & (F.col("fold") == k)).collect()])) for k in range(2)]
    assert model.avgMetrics[0] == pytest.approx(np.mean(rmse))


def batch(spark):
    rows = [("d", 1, c, float(c), 1.0) for c in range(1, 8)] + [("d", 2, 1, None, 1.0), ("d", 2, 2, 50.0, 9.0), ("d", 2, 3, float("nan"), 1.0), ("d", 3, 1, 2.0, -4.0)]
    return spark.createDataFrame(rows, "dataset string, unit long, cycle long, s double, t double")


def test_a_saved_pipeline_scores_and_rejects_with_reasons(spark, tmp_path):
    model = pl.pipeline("s", 3, ["s", "t"], ([0.0, 0.0], [20.0, 5.0]), 3, (30.0, -1.0, -2.0), 25.0)
    model.write().save(str(tmp_path / "p"))
    loaded = PipelineModel.load(str(tmp_path / "p"))
    assert [type(s).__name__ for s in loaded.stages] == ["Trailing", "Check", "Linear"]
    scores, rejects = pl.score(loaded, batch(spark), BUCKETS)
    assert scores.count() + rejects.count() == batch(spark).count()
    got = {(r.unit, r.cycle): (r.predicted_rul, r.rul_at_cap, r.bucket) for r in scores.collect()}
    assert got == {(1, c): (min(30 - (c - 1) - 2, 25.0), 30 - (c - 1) - 2 >= 25, "high") for c in range(3, 8)}
    assert {(r.unit, r.cycle): r.reject for r in rejects.collect()} == {
        (1, 1): pl.SHORT, (1, 2): pl.SHORT, (2, 1): pl.MISSING, (2, 2): f"{pl.OUTSIDE}: s, t", (2, 3): pl.MISSING, (3, 1): f"{pl.OUTSIDE}: t"}
    a, b = pl.score(loaded, batch(spark).limit(0), BUCKETS)
    assert a.count() == b.count() == 0


def test_envelope_has_a_margin(spark):
    df = spark.createDataFrame([(0.0, 1.0), (10.0, 3.0)], "s double, t double")
    assert pl.envelope(df, ["s", "t"], 0.1) == (pytest.approx([-1.0, 0.8]), pytest.approx([11.0, 3.2]))


@pytest.mark.parametrize("block", [1, 3, 10_000])
def test_silhouette_by_distances(spark, monkeypatch, block):
    monkeypatch.setattr(models, "BLOCK_ROWS", block)
    r = np.random.default_rng(5)
    x, g = r.normal(0, 1, (60, 2)), np.array([*r.integers(0, 3, 59), 7])
    df = spark.createDataFrame([(i, float(p), float(q), int(k)) for i, ((p, q), k) in enumerate(zip(x, g, strict=True))], "id long, x double, y double, g int")
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    s = []
    for i in range(0, 60, 10):
        own = (g == g[i]) & (np.arange(60) != i)
        b = min(dist[i, g == k].mean() for k in set(g) - {g[i]})
        a = dist[i, own].mean() if own.any() else None
        s.append(0.0 if a is None else (b - a) / max(a, b))
    got = models.silhouette(df, ["x", "y"], "g", "id", 10).first()
    assert got.n == 6 and got.silhouette == pytest.approx(np.mean(s))
    assert models.silhouette(df.limit(0), ["x", "y"], "g", "id").first().silhouette is None


def test_silhouette_by_keys(spark):
    df = spark.createDataFrame([(k, i, float(i % 2 * 10 + i), i % 2) for k in ("a", None) for i in range(8)], "k string, id long, x double, g int")
    got = {r.k: (r.n, r.silhouette) for r in models.silhouette(df, ["x"], "g", "id", 4, ["k"]).collect()}
    assert set(got) == {"a", None} and got["a"] == got[None] and got["a"][0] == 2


def test_rand_index_of_pairs_of_seeds(spark):
    r = np.random.default_rng(1)
    labels = r.integers(0, 3, (4, 40))
    labels[2] = (labels[1] + 1) % 3  # the same parts under other names
    df = spark.createDataFrame([(i, s, int(labels[s, i])) for s in range(4) for i in range(40)], "id long, seed int, label int")
    pairs = {(x.a, x.b): x.ari for x in rs.rand_index_pairs(df, "id", "seed", "label").collect()}
    assert set(pairs) == set(itertools.combinations(range(4), 2)) and pairs[1, 2] == pytest.approx(1.0)
    for a, b in pairs:
        one = df.where(F.col("seed") == a).select("id", F.col("label").alias("p")).join(df.where(F.col("seed") == b).select("id", F.col("label").alias("q")), "id")
        assert pairs[a, b] == pytest.approx(rs.rand_index(one, "p", "q").first().ari)


def test_trees_do_not_depend_on_a_switch_by_size(spark, curve, monkeypatch):
    """A table is fitted by ranges of its training rows' exact quantiles, whether it has more than CELL_ROWS rows or not."""
    few, found = curve.where("fold < 2"), []
    for rows in (100, 200_000):
        monkeypatch.setattr(models, "CELL_ROWS", rows)
        r = models.in_ranges(curve, ["a", "b"], few)
        found.append([[q[c] for q in r.orderBy("y").collect()] for c in ("a", "b")] + [[q.prediction for q in models.boosted(r, ["a", "b"], "y", 3).transform(models.vectors(r.orderBy("y"), ["a", "b"])).collect()]])
    assert found[0][:2] == found[1][:2] and found[0][2] == pytest.approx(found[1][2])
    x = np.array([q.a for q in few.collect()])
    edges = np.quantile(x, np.arange(1, models.RANGES) / models.RANGES)
    assert found[1][0] == [float(np.searchsorted(edges, q.a, "right")) for q in curve.orderBy("y").collect()]
