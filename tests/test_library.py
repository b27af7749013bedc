"""Golden values, refusals and invariants."""

import math

import pytest
from pyspark.sql import functions as F

from fleetmill.functions.columns import bucket
from fleetmill.functions.rng import uniform
from fleetmill.operators import evaluation as e
from fleetmill.operators import features as f
from fleetmill.operators import labels, models
from fleetmill.operators import resampling as rs
from fleetmill.operators import signal as s

BUCKETS = [("critical", 0.0, 15.0), ("urgent", 15.0, 50.0), ("healthy", 50.0, None)]


def cycles(spark, units, n, **columns):
    df = spark.range(units * n).select(F.lit("d").alias("dataset"), F.floor(F.col("id") / n).alias("unit"), (F.col("id") % n + 1).alias("cycle"))
    return df.withColumns({k: F.expr(v) for k, v in columns.items()})


def test_asymmetric_score(spark):
    df = spark.createDataFrame([(100.0, 110.0), (100.0, 90.0), (100.0, 100.0)], "y double, pred double")
    assert [r[0] for r in df.select(e.asymmetric(e.error())).collect()] == pytest.approx([1.718281828459045, 1.1581055339484458, 0.0])


def test_bucket_bounds_and_contiguity(spark):
    df = spark.createDataFrame([(0.0,), (14.999,), (15.0,), (50.0,), (None,)], "y double")
    assert [r[0] for r in df.select(bucket("y", BUCKETS)).collect()] == ["critical", "critical", "urgent", "healthy", None]
    with pytest.raises(ValueError):
        bucket("y", [("a", 0.0, 10.0), ("b", 11.0, None)])


def test_uniform_is_md5(spark):
    import hashlib

    v = int(hashlib.md5(b"42|s|1|2").hexdigest()[:8], 16) / 2**32
    assert spark.range(1).select(uniform("s", F.lit(1), F.lit(2))).first()[0] == v


def test_perfect_predictor_and_early_dip(spark):
    df = cycles(spark, 1, 50, rul_true="cast(50 - cycle as double)", pred="cast(50 - cycle as double)")
    leads = rs.triggers(df, [10.0, 30.0], ["unit"]).collect()
    assert {r.threshold: r.lead for r in leads} == {10.0: 10.0, 30.0: 30.0}
    dip = df.withColumn("pred", F.when(F.col("cycle") == 5, 0.0).otherwise(100.0))
    assert [r.lead for r in rs.triggers(dip, [10.0], ["unit"]).collect()] == [45.0]
    assert rs.triggers(df.withColumn("pred", F.lit(99.0)), [10.0], ["unit"]).first().lead is None


def curve(spark, wasted, caught):
    return spark.createDataFrame([("c", float(i), w, c) for i, (w, c) in enumerate(zip(wasted, caught))], "c string, threshold double, wasted double, caught double")


def test_caught_at_budget_golden(spark):
    at = lambda w, c, x: rs.caught_at_budget(curve(spark, w, c), [x], ["c"]).first().caught
    assert at([10.0, 30.0, 20.0, 40.0], [0.0, 50.0, 60.0, 100.0], 35.0) == pytest.approx(80.0)
    assert at([None, 10.0, 20.0, 30.0], [0.0, 0.0, 100.0, 100.0], 15.0) == pytest.approx(50.0)
    assert at([10.0, 20.0], [0.0, 100.0], 5.0) is None and at([10.0, 20.0], [0.0, 100.0], 25.0) is None


def test_units_are_resampled_not_rows(spark):
    rows = [(1, 0.0, 0.0)] * 1000 + [(2, 10.0, 0.0)]
    p = spark.createDataFrame(rows, "unit long, pred double, y double")
    sums = e.unit_sums(p, ["unit"], BUCKETS)
    drawn = rs.draws(p.select("unit").distinct(), 2000)
    reps = rs.replicate_metrics(sums, drawn, {"rmse": e.metrics(F.col("w"), BUCKETS)["rmse"]})
    zero = reps.agg(F.avg((F.col("rmse") == 0).cast("double"))).first()[0]
    assert abs(zero - 0.25) < 0.03
    assert drawn.groupBy("replicate").agg(F.sum("w").alias("w")).where("w <> 2").count() == 0


def test_folds_hold_each_unit_out_once_and_balance_labels(spark):
    lab = spark.range(50).select(F.col("id").alias("unit"), (F.col("id") < 20).cast("int").alias("subpop"))
    folds = labels.stratified_folds(lab, 3, 5)
    assert folds.groupBy("repeat", "unit").count().where("count <> 1").count() == 0
    n = folds.groupBy("repeat", "subpop", "fold").count()
    assert {r[0] for r in n.where("subpop = 1").select("count").collect()} == {4} and {r[0] for r in n.where("subpop = 0").select("count").collect()} == {6}


def test_windows_do_not_look_ahead(spark):
    df = cycles(spark, 3, 30, x="cast(cycle * 2 + unit as double)")
    a = f.rolling(df, ["x"], 5).where("cycle <= 15")
    b = f.rolling(df.withColumn("x", F.when(F.col("cycle") > 15, 1e9).otherwise(F.col("x"))), ["x"], 5).where("cycle <= 15")
    assert a.exceptAll(b).count() == 0
    assert {round(r[0], 9) for r in a.where("cycle > 1").select("x_slope").collect()} == {2.0}
    assert {r[0] for r in a.where("cycle = 1").select("x_slope").collect()} == {0.0}


def test_state_is_of_training_units_and_gaps_are_refused(spark):
    df = cycles(spark, 4, 40, regime="cast(cycle % 2 as int)", x="cast(cycle * (unit + 1) as double)")
    state = f.regime_norm(df.where("unit < 3"), ["x"])
    poisoned = f.regime_norm(df.withColumn("x", F.when(F.col("unit") == 3, 1e9).otherwise(F.col("x"))).where("unit < 3"), ["x"])
    assert state.exceptAll(poisoned).count() == 0
    with pytest.raises(Exception, match="no state for regime"):
        f.zscore(df.withColumn("regime", F.lit(9)), state, ["x"]).collect()
    with pytest.raises(Exception, match="can't be normalised"):
        f.refuse_degenerate(f.regime_norm(df.withColumn("x", F.lit(1.0)), ["x"])).collect()


def test_sequences_pad_with_the_first_row(spark):
    df = cycles(spark, 1, 2, x="cast(cycle as double)")
    r = f.sequences(df, ["x"], 5).where("cycle = 2").first()
    assert r["mask"] == [0, 0, 0, 1, 1] and [v[0] for v in r["seq"]] == [1.0, 1.0, 1.0, 1.0, 2.0]


def test_hinge_finds_the_bend(spark):
    df = cycles(spark, 2, 60, x="cast(if(cycle > 20 + unit * 10, (cycle - 20 - unit * 10) * 0.5, 0) as double)")
    got = {r.unit: (r.tau, round(r.b, 9), round(r.rss, 9)) for r in s.hinge(df, ["unit"], "x", 5).collect()}
    assert got == {0: (20, 0.5, 0.0), 1: (30, 0.5, 0.0)}


def test_constant_signals_have_no_correlation(spark):
    df = cycles(spark, 2, 10, sensor="'a'", x="cast(if(unit = 0, 1, cycle) as double)", ttf="cast(-cycle as double)")
    assert {r.unit: r.rho for r in s.spearman(df).collect()} == {0: None, 1: -1.0}


def test_ks_and_auc(spark):
    rows = [(float(i), 0) for i in range(10)] + [(float(i + 100), 1) for i in range(5)]
    df = spark.createDataFrame(rows, "x double, side int")
    assert rs.ks(df, "x", "side").first().ks == 1.0
    assert rs.ks(df.withColumn("x", F.lit(1.0)), "x", "side").first().ks == 0.0
    assert rs.roc_auc(df, "x", "side").first().auc == 1.0 and rs.roc_auc(df.withColumn("x", F.lit(0.0)), "x", "side").first().auc == 0.5
    assert rs.roc_auc(df.where("side = 1"), "x", "side").first().auc is None


def test_numbers_within_keys(spark):
    from fleetmill.operators.ordering import numbered_within

    df = spark.range(300).select("id", (F.col("id") % 4 == 0).alias("k")).repartition(5)
    rows = numbered_within(df, ["k"], [-F.col("id")]).collect()
    for k, n in ((True, 75), (False, 225)):
        mine = sorted((r for r in rows if r.k == k), key=lambda r: -r.id)
        assert [r.place for r in mine] == list(range(n)) and {r.size for r in mine} == {n}


def test_signed_rank_p(spark):
    """Exact p by enumeration of signs without ties, the normal approximation with ties, and no differences at all."""
    import itertools

    diffs = {"a": [1.0, -2.0, 3.0, 4.5, 6.0, -0.5, 7.0], "b": [5.0, 1.0, 2.0, 3.0, 4.0], "tied": [1.0, 1.0, -1.0, 2.0, 2.0, 3.0, 4.0, -5.0], "none": [0.0, 0.0]}
    rows = {r.k: r for r in rs.signed_rank(spark.createDataFrame([(k, x) for k, v in diffs.items() for x in v], "k string, d double"), "d", ["k"]).collect()}
    for k in ("a", "b"):
        n = len(diffs[k])
        sums = [min(s, n * (n + 1) // 2 - s) for signs in itertools.product((0, 1), repeat=n) for s in [sum(i + 1 for i, x in enumerate(signs) if x)]]
        assert rows[k].n == n and rows[k].p == pytest.approx(min(1.0, sum(s <= rows[k].w for s in sums) / 2**n))
    assert rows["tied"].p == pytest.approx(math.erfc(abs(rows["tied"].z) / math.sqrt(2)), abs=1e-6)
    assert (rows["none"].n, rows["none"].w, rows["none"].p) == (0, None, None)


def test_numbers_and_running_sums_over_ranges(spark):
    from fleetmill.operators.ordering import numbered, running

    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("x"), (F.col("id") % 3).alias("k")).repartition(7)
    assert sorted((r.x, r.place) for r in numbered(df, [-F.col("x")]).collect()) == [(i, 499 - i) for i in range(500)]
    assert numbered(df.limit(0), ["x"]).count() == 0
    rows = running(df, "x", ["x"], ["k"]).collect()
    for k in range(3):
        total = 0
        for r in sorted((r for r in rows if r.k == k), key=lambda r: r.x):
            total += r.x
            assert r.run_x == total and r.total_x == sum(q.x for q in rows if q.k == k)


def test_benchmark_view_reports_its_shortfall(spark):
    pts = cycles(spark, 1, 20, rul_true="cast(cycle - 1 as double)")
    target = spark.createDataFrame([(0, 0.5), (200, 0.5)], "bin long, share double")
    chosen, short = rs.benchmark_view(pts, target, 16, 10)
    assert chosen.count() == 8 and [(r.bin, r.shortfall) for r in short.collect()] == [(200, 8)]


def test_ridge_matches_normal_equations(spark):
    import numpy as np

    r = np.random.default_rng(1)
    x = r.normal(size=(200, 2)) * [1, 5] + [3, -2]
    y = x @ [2.0, -1.0] + 4 + r.normal(size=200) * 0.1
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, y double")
    w, i = models.ridge(df, ["a", "b"], "y", 1.0)
    z = (x - x.mean(0)) / x.std(0)
    beta = np.linalg.solve(z.T @ z + np.eye(2), z.T @ (y - y.mean())) / x.std(0)
    assert np.allclose(w, beta) and math.isclose(i, y.mean() - x.mean(0) @ beta, rel_tol=1e-9)


def test_opposite_trends_make_two_groups_larger_first(spark):
    df = cycles(spark, 12, 40, sensor="'s2'", x="cast(if(unit < 8, cycle, -cycle) as double)", ttf="cast(40 - cycle as double)")
    signs = s.signs(s.spearman(df)).withColumnRenamed("sign", "v")
    lab = models.relabel_by_size(models.kmeans(signs, ["v"], 2)[0].select("unit", "cluster"), "cluster")
    assert sorted((r.cluster, r["count"]) for r in lab.groupBy("cluster").count().collect()) == [(0, 8), (1, 4)]


def test_entry_imports_without_the_pipeline_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['fleetmill.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'fleet_status' in q and not any(n.startswith('op') and n[2].isdigit() for n in q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/", 2)[0])


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    from fleetmill.sources.shared import shared_dir

    no = SimpleNamespace(isDefined=lambda: False)
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(master="spark://x:1", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: no))))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(cluster)


def test_no_unpartitioned_window_over_rows(spark):
    df = cycles(spark, 3, 30, x="cast(cycle as double)")
    plan = f.rolling(df, ["x"], 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SinglePartition" not in plan


def test_unknown_datasets_and_missing_files_are_refused(spark, tmp_path):
    from fleetmill.sources import fleet_files

    rows = spark.createDataFrame([("a", 1, 1, 0.5), ("a", 1, 2, 0.7), ("b", 1, 1, 0.1)], "dataset string, unit long, cycle long, s2 double")
    for split in ("train", "test"):
        fleet_files.write_text(rows, str(tmp_path), split)
    read = lambda names, known=("a", "b", "c"): fleet_files.read_datasets(spark, str(tmp_path), list(names), ["s2"], list(known))
    assert {(r.dataset, r.split, r.cycle) for r in read("a").collect()} == {("a", s, c) for s in ("train", "test") for c in (1, 2)}
    assert read("ab").count() == 6 and read("aa").count() == 4
    with pytest.raises(ValueError, match="unknown datasets .*z"):
        read("az")
    with pytest.raises(FileNotFoundError, match="train_c.txt"):
        read("ac")
