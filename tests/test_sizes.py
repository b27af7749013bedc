"""Steps whose memory or shuffles must not outgrow their input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetmill.functions.rng import uniform
from fleetmill.operators import models
from fleetmill.operators import resampling as rs
from fleetmill.plans import resampling_queries, signal_queries
from fleetmill.sources import bindings as b
from fleetmill.sources.shared import written


def events(spark, folder, units, each):
    rows = spark.range(units * each).select(F.col("id").alias("event_id"), (F.col("id") % units).alias("user_id"), F.timestamp_seconds(1_700_000_000 + F.col("id")).alias("ts"),
                                            F.element_at(F.array(*[F.lit(x) for x in ("click", "error", "view")]), (F.col("id") % 3 + 1).cast("int")).alias("event_type"),
                                            ((F.col("id") * 7919) % 10007 / 100).alias("value"), F.format_string('{"k": %d}', (F.col("id") * 31) % 100).alias("props"))
    rows.write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_tasks_of_rank_correlations_grow_with_the_rows(spark, tmp_path, monkeypatch):
    d = events(spark, tmp_path, 40, 30)
    monkeypatch.setattr(b.dealt, "__defaults__", (50,))
    r = signal_queries.rho(spark, d)
    plan = r._jdf.queryExecution().executedPlan().toString()  # not run yet
    assert r.rdd.getNumPartitions() == 24
    assert r.count() == 40 * len(b.SENSORS)
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan


@pytest.mark.parametrize("name", ["flip_share_by_cluster", "sign_vectors", "direction_consistency", "flip_table", "flip_agreement"])
def test_rank_correlations_that_are_read_again_are_made_once(spark, tmp_path, name):
    r = getattr(signal_queries, name)(spark, events(spark, tmp_path, 40, 30))
    assert "rank(" not in r._jdf.queryExecution().optimizedPlan().toString()
    assert r.count() > 0


def test_comparisons_write_unit_sums_and_no_candidates(spark, tmp_path, monkeypatch):
    d, names = events(spark, tmp_path, 40, 30), []

    def seen(df, name="table"):
        names.append((name, df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")))
        return written(df, name)

    monkeypatch.setattr(resampling_queries, "written", seen)
    assert resampling_queries.comparisons(spark, d).count() > 0
    assert "candidates" not in dict(names)
    assert dict(names)["sums"] == dict(names)["decision"] == 1  # that of the cycles


def test_poisson_counts_hash_once_a_draw_in_tasks_that_grow_with_the_units(spark, monkeypatch):
    monkeypatch.setattr(rs, "DRAWS", 50_000)
    units = written(spark.range(1200).coalesce(1).select(F.col("id").alias("unit")), "units")
    w = resampling_queries.counted(units)
    assert w._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1
    assert w.rdd.getNumPartitions() == 24
    plain = units.crossJoin(spark.range(1, resampling_queries.MANY + 1).withColumnRenamed("id", "replicate")).withColumn("w", rs.poisson_weight(uniform("poisson", F.col("replicate"), F.col("unit"))))
    sums = lambda df: sorted(tuple(r) for r in df.where("w > 0").groupBy("replicate").agg(F.count("*"), F.sum("w"), F.sum(F.col("w") * F.col("unit"))).collect())
    assert sums(w) == sums(plain)


def test_boosted_trees_of_many_rows_are_fitted_to_cells(spark, monkeypatch):
    r = np.random.default_rng(5)
    x = r.integers(0, 12, (3000, 2))
    y = np.sin(x[:, 0] / 2) + 0.1 * x[:, 1] + r.normal(0, 0.5, 3000)
    df = spark.createDataFrame([(float(a), float(b), float(c), i % 4 == 0) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "a double, b double, y double, held boolean").coalesce(2).cache()
    fit = lambda: models.boosted_with_patience(df.where("not held"), df.where("held"), ["a", "b"], "y", rounds=12, patience=12, first=12)
    by_rows, errors = fit()
    monkeypatch.setattr(models, "CELL_ROWS", 100)
    cells = models.gathered(df, ["a", "b"], "y")
    assert cells.count() == len({tuple(p) for p in x}) and cells.agg(F.sum("weight")).first()[0] == 3000
    by_cells, errors_by_cells = fit()
    assert errors_by_cells == pytest.approx(errors) and by_cells.getNumTrees == by_rows.getNumTrees
    a, b = ([q.prediction for q in m.transform(models.vectors(df, ["a", "b"])).collect()] for m in (by_rows, by_cells))
    assert a == pytest.approx(b)
    monkeypatch.setattr(models, "RANGES", 4)
    few = models.in_ranges(df, ["a", "b"], df)
    assert models.gathered(few, ["a", "b"], "y").count() == 16
    got = {(q.a, w.a) for q, w in zip(df.collect(), few.collect(), strict=True)}
    edges = np.quantile(x[:, 0], [0.25, 0.5, 0.75])
    assert got == {(float(v), float(np.searchsorted(edges, v, "right"))) for v in range(12)}


def test_silhouette_joins_no_pairs_and_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(models, "BLOCK_ROWS", 7)
    r = np.random.default_rng(3)
    rows = [(k, i, float(x), None if i == 4 else float(y), i % 3 if i % 50 else None) for k in ("a", "b") for i, (x, y) in enumerate(r.normal(size=(120, 2)))]
    df = spark.createDataFrame(rows, "k string, id long, x double, y double, g long")
    out = models.silhouette(df, ["x", "y"], "g", "id", every=4, keys=["k"])
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    want = {}
    for k in "ab":
        s = []
        for _, i, x, y, g in (q for q in rows if q[0] == k and q[1] % 4 == 0):
            d = {c: [None if y is None or q[3] is None else ((q[2] - x) ** 2 + (q[3] - y) ** 2) ** 0.5 for q in rows if q[0] == k and q[4] == c] for c in (0, 1, 2)}
            a = None if g is None or y is None else sum(v for v in d[g] if v is not None) / (len(d[g]) - 1)
            b = min((sum(v for v in d[c] if v is not None) / len(d[c]) for c in d if g is not None and c != g and y is not None), default=None)
            s.append(0.0 if a is None else (b - a) / max(a, b))
        want[k] = np.mean(s)
    assert {q.k: (q.silhouette, q.n) for q in out.collect()} == {k: (pytest.approx(v), 30) for k, v in want.items()}
