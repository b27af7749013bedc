"""Metrics of predictions and the tables made of them."""

from __future__ import annotations


from pyspark.sql import functions as F

from fleetmill.functions.columns import bucket, r6
from fleetmill.operators import evaluation as e
from fleetmill.sources import bindings as b

from .registry import query

B = b.BUCKETS
BUCKET = "CASE WHEN y < 10 THEN 'critical' WHEN y < 20 THEN 'urgent' WHEN y < 40 THEN 'monitor' ELSE 'healthy' END"
P = f"p AS (SELECT *, {BUCKET} AS b, pred - y AS e FROM (SELECT *, rul_true AS y FROM points))"
BOTH = f"""p AS (SELECT *, {BUCKET} AS b, pred - y AS e FROM (SELECT * EXCLUDE (pred), pred, rul_true AS y, 'uncapped' AS truth FROM points
  UNION ALL SELECT * EXCLUDE (pred), least(pred, 40) AS pred, least(rul_true, 40) AS y, 'capped' AS truth FROM points))"""
SCORE = "CASE WHEN e < 0 THEN exp(-e / 13) - 1 ELSE exp(e / 10) - 1 END"
NAMES = [n for n, _, _ in B]


def uncapped(spark, d, which="A"):
    return e.with_truth(b.points(spark, d, which), None)


def both(spark, d):
    p = b.points(spark, d)
    return e.with_truth(p, None).withColumn("truth", F.lit("uncapped")).unionByName(e.with_truth(p, b.CAP).withColumn("truth", F.lit("capped")))


@query(f"""WITH {P} SELECT unit, count(*)::DOUBLE AS n, round(sum(e), 6) AS se, round(sum(e * e), 6) AS se2, round(sum(abs(e)), 6) AS sabs, sum((e > 0)::INT)::DOUBLE AS late, round(sum({SCORE}), 4) AS score,
  count(*) FILTER (b = 'urgent')::DOUBLE AS n_urgent, round(coalesce(sum(e * e) FILTER (b = 'monitor'), 0), 6) AS se2_monitor FROM p GROUP BY unit""")
def engine_aggregates(spark, d):
    s = e.unit_sums(uncapped(spark, d), ["unit"], B)
    return s.select("unit", "n", r6("se").alias("se"), r6("se2").alias("se2"), r6("sabs").alias("sabs"), "late", F.round("score", 4).alias("score"), "n_urgent", r6("se2_monitor").alias("se2_monitor"))


@query(f"WITH {P} SELECT subpop, round(sqrt(avg(e * e)), 6) AS rmse FROM p GROUP BY subpop")
def metric_rmse(spark, d):
    return uncapped(spark, d).groupBy("subpop").agg(r6(F.sqrt(F.avg(F.pow(e.error(), 2)))).alias("rmse"))


@query(f"WITH {P} SELECT subpop, round(avg(abs(e)), 6) AS mae FROM p GROUP BY subpop")
def metric_mae(spark, d):
    return uncapped(spark, d).groupBy("subpop").agg(r6(F.avg(F.abs(e.error()))).alias("mae"))


@query(f"WITH {P} SELECT unit, round(sum({SCORE}), 4) AS score FROM p GROUP BY unit")
def metric_asymmetric_score(spark, d):
    return uncapped(spark, d).groupBy("unit").agg(F.round(F.sum(e.asymmetric(e.error())), 4).alias("score"))


@query(f"WITH {P} SELECT subpop, {', '.join(f'''round(sqrt(avg(e * e) FILTER (b = '{n}')), 6) AS rmse_{n}''' for n in NAMES)} FROM p GROUP BY subpop")
def metric_bucket_rmse(spark, d):
    s = e.unit_sums(uncapped(spark, d), ["unit", "subpop"], B)
    m = e.metrics(F.lit(1.0), B)
    return s.groupBy("subpop").agg(*[r6(m[f"rmse_{n}"]).alias(f"rmse_{n}") for n in NAMES])


@query(f"WITH {P} SELECT repeat, round(100 * avg((e > 0)::INT), 6) AS late_pct FROM p GROUP BY repeat")
def metric_late_pct(spark, d):
    return uncapped(spark, d).groupBy("repeat").agg(r6(100 * F.avg((e.error() > 0).cast("double"))).alias("late_pct"))


@query(f"WITH {P} SELECT 'all' AS bucket, round(avg(e), 6) AS bias FROM p UNION ALL SELECT b, round(avg(e), 6) FROM p GROUP BY b")
def metric_signed_error(spark, d):
    p = uncapped(spark, d).withColumn("bucket", bucket("y", B))
    return p.rollup("bucket").agg(r6(F.avg(e.error())).alias("bias")).select(F.coalesce("bucket", F.lit("all")).alias("bucket"), "bias")


@query(f"WITH {P} SELECT b AS bucket, round(avg(e), 6) AS mean, round(stddev_pop(e), 6) AS std, count(*) AS n FROM p GROUP BY b")
def error_by_bucket(spark, d):
    return uncapped(spark, d).groupBy(bucket("y", B).alias("bucket")).agg(r6(F.avg(e.error())).alias("mean"), r6(F.stddev_pop(e.error())).alias("std"), F.count("*").alias("n"))


@query(f"WITH {P} SELECT round(avg(s), 6) AS score FROM (SELECT unit, avg({SCORE}) AS s FROM p GROUP BY unit)")
def metric_score_mean_per_engine(spark, d):
    return uncapped(spark, d).groupBy("unit").agg(F.avg(e.asymmetric(e.error())).alias("s")).agg(r6(F.avg("s")).alias("score"))


@query(f"""WITH {BOTH} SELECT round(sqrt(avg(e * e) FILTER (truth = 'uncapped')), 6) AS rmse_vs_uncapped, round(sqrt(avg(e * e) FILTER (truth = 'capped')), 6) AS rmse_vs_capped,
  round(avg(abs(e)) FILTER (truth = 'uncapped'), 6) AS mae_vs_uncapped, round(avg(abs(e)) FILTER (truth = 'capped'), 6) AS mae_vs_capped, round(sqrt(avg(e * e) FILTER (truth = 'capped')), 6) AS headline FROM p""")
def score_row(spark, d):
    s = e.unit_sums(both(spark, d), ["truth", "unit"], B)
    m = e.metrics(F.lit(1.0), B)
    row = s.groupBy().pivot("truth", ["uncapped", "capped"]).agg(r6(m["rmse"]).alias("rmse"), r6(m["mae"]).alias("mae"))
    names = {f"{t}_{k}": f"{k}_vs_{t}" for t in ("uncapped", "capped") for k in ("rmse", "mae")}
    return row.withColumnsRenamed(names).withColumn("headline", F.col("rmse_vs_capped"))


@query(f"""WITH {BOTH}, v AS (SELECT *, 'all' AS view FROM p UNION ALL SELECT *, 'deployment' FROM p WHERE cycle >= 10),
  s AS (SELECT view, truth, unit, any_value(subpop) AS subpop, sum({SCORE}) / count(*) AS sc FROM v GROUP BY ALL),
  g AS (SELECT view, truth, 'all' AS grp, * EXCLUDE (view, truth, subpop), subpop FROM v UNION ALL SELECT view, truth, 'subpop_' || subpop, * EXCLUDE (view, truth, subpop), subpop FROM v),
  a AS (SELECT view, truth, grp, count(DISTINCT unit) AS n_units, count(*) AS n_points, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae, 100 * avg((e > 0)::INT) AS late_pct, avg(e) AS bias,
    {', '.join(f"sqrt(avg(e * e) FILTER (b = '{n}')) AS rmse_{n}, avg(e) FILTER (b = '{n}') AS bias_{n}" for n in NAMES)} FROM g GROUP BY ALL)
  SELECT view, truth, grp, n_units, n_points, m.metric, round(m.v, 8) AS estimate FROM (SELECT *, unnest([{', '.join(f"{{'metric': '{x}', 'v': {x}}}" for x in ['rmse', 'mae', 'late_pct', 'bias', *[f'{k}_{n}' for n in NAMES for k in ('rmse', 'bias')]])}]) AS m FROM a)""")
def metric_table(spark, d):
    return e.metric_table(b.points(spark, d), B, b.CAP, b.MIN_HISTORY).where("metric <> 'score_mean'").withColumn("estimate", F.round("estimate", 8))


@query(f"WITH {P} SELECT repeat, fold, seed, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(e), 6) AS bias FROM p GROUP BY ALL")
def split_metrics(spark, d):
    s = e.unit_sums(uncapped(spark, d), ["repeat", "fold", "seed", "unit"], B)
    m = e.metrics(F.lit(1.0), B)
    return s.groupBy("repeat", "fold", "seed").agg(r6(m["rmse"]).alias("rmse"), r6(m["bias"]).alias("bias"))


@query("SELECT unit, round(sqrt(avg((pred_a - rul_true) ** 2)), 6) AS a, round(sqrt(avg((pred_b - rul_true) ** 2)), 6) AS b, round(sqrt(avg((pred_a - rul_true) ** 2)) - sqrt(avg((pred_b - rul_true) ** 2)), 6) AS diff FROM points2 GROUP BY unit")
def per_engine_metric(spark, d):
    rmse = lambda w: e.unit_sums(uncapped(spark, d, w), ["unit"], B).select("unit", F.sqrt(F.col("se2") / F.col("n")).alias(w.lower()))
    j = rmse("A").join(rmse("B"), "unit")
    return j.select("unit", r6("a").alias("a"), r6("b").alias("b"), r6(F.col("a") - F.col("b")).alias("diff"))


@query(f"WITH {BOTH} SELECT truth, b AS bucket, count(*) AS n, count(DISTINCT unit) AS n_units FROM p GROUP BY ALL")
def bucket_counts(spark, d):
    return both(spark, d).groupBy("truth", bucket("y", B).alias("bucket")).agg(F.count("*").alias("n"), F.countDistinct("unit").alias("n_units"))


@query("SELECT floor(rul_true / 10) * 10 AS bin, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM points GROUP BY 1")
def label_histogram(spark, d):
    return e.label_histogram(b.points(spark, d), 10).select(F.col("bin").cast("double").alias("bin"), F.round("share", 9).alias("share"))


@query("""WITH l AS (SELECT unit, max(cycle)::DOUBLE AS life FROM cycles GROUP BY unit), x AS (SELECT min(life) AS lo, max(life) AS hi FROM l)
  SELECT least(floor((life - lo) / (hi - lo) * 30), 29)::INT AS bin, count(*) AS n FROM l, x GROUP BY 1""")
def histogram_equal_width(spark, d):
    life = b.cycles(spark, d).groupBy("unit").agg(F.max("cycle").cast("double").alias("life"))
    return e.equal_width(life, "life", 30)


@query("""WITH g AS (SELECT sensor, op1, count(*) AS n, var_samp(x) AS v FROM long GROUP BY ALL), w AS (SELECT sensor, sum((n - 1) * v) / (sum(n) - count(*)) AS within FROM g GROUP BY sensor)
  SELECT sensor, round(within, 6) AS within, round(within / t, 6) AS share FROM w JOIN (SELECT sensor, var_samp(x) AS t FROM long GROUP BY sensor) USING (sensor)""")
def within_regime_variance(spark, d):
    v = e.within_variance(b.cycles(spark, d).withColumnRenamed("op1", "regime"), b.SENSORS)
    return v.select("sensor", r6("within").alias("within"), r6("share").alias("share"))


EFFECT = """WITH g AS (SELECT sensor, avg(x) FILTER (unit % 3 = 0) AS m1, avg(x) FILTER (unit % 3 <> 0) AS m0, var_samp(x) FILTER (unit % 3 = 0) AS v1, var_samp(x) FILTER (unit % 3 <> 0) AS v0,
  count(*) FILTER (unit % 3 = 0) AS n1, count(*) FILTER (unit % 3 <> 0) AS n0 FROM long GROUP BY sensor), f AS (SELECT sensor, abs(m1 - m0) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2)) AS effect FROM g)"""


def effects(spark, d):
    c = b.cycles(spark, d).withColumn("g", (F.col("unit") % 3 == 0).cast("int"))
    return e.split_effect(c, b.SENSORS, "g")


@query(f"{EFFECT} SELECT arg_max(sensor, effect) AS sensor, round(max(effect), 6) AS effect FROM f")
def forced_split_effect(spark, d):
    return effects(spark, d).agg(F.max_by("sensor", "effect").alias("sensor"), r6(F.max("effect")).alias("effect"))


@query(f"{EFFECT} SELECT sensor, round(effect, 6) AS effect FROM f ORDER BY effect DESC, sensor LIMIT 3")
def topk_effects(spark, d):
    return effects(spark, d).orderBy(F.desc("effect"), "sensor").limit(3).withColumn("effect", r6("effect"))


MODELS = """m AS (SELECT op1 AS dataset, 'A' AS model, sqrt(avg((pred_a - rul_true) ** 2)) AS v, fold FROM points2 JOIN (SELECT unit, cycle, op1 FROM cycles) USING (unit, cycle) GROUP BY ALL
  UNION ALL SELECT op1, 'B', sqrt(avg((pred_b - rul_true) ** 2)), fold FROM points2 JOIN (SELECT unit, cycle, op1 FROM cycles) USING (unit, cycle) GROUP BY ALL)"""


def models(spark, d):
    """(dataset, model, fold, v): RMSE of each model in each fold, regimes standing for datasets."""
    c = b.cycles(spark, d).select("unit", "cycle", F.col("op1").alias("ds"))
    rows = [b.points(spark, d, w).join(c, ["unit", "cycle"]).groupBy(F.col("ds").alias("dataset"), F.lit(w).alias("model"), "fold").agg(F.sqrt(F.avg(F.pow(F.col("pred") - F.col("rul_true"), 2))).alias("v")) for w in "AB"]
    return rows[0].unionByName(rows[1])


@query(f"""WITH {MODELS}, s AS (SELECT dataset, model, avg(v) AS v FROM m GROUP BY ALL), w AS (SELECT arg_min(model, v) AS model FROM s GROUP BY dataset)
  SELECT s.model, round(avg(v), 6) AS mean, (SELECT count(*) FROM w WHERE w.model = s.model) AS wins FROM s GROUP BY s.model""")
def best_per_dataset(spark, d):
    s = models(spark, d).groupBy("dataset", "model").agg(F.avg("v").alias("v"))
    wins = s.groupBy("dataset").agg(F.min_by("model", F.struct("v", "model")).alias("model")).groupBy("model").agg(F.count("*").alias("wins"))
    return s.groupBy("model").agg(r6(F.avg("v")).alias("mean")).join(wins, "model", "left").select("model", "mean", F.coalesce("wins", F.lit(0)).alias("wins"))


@query(f"WITH {MODELS} SELECT dataset, model, round_even(avg(v), 2) AS mean, round_even(stddev_samp(v), 2) AS std, round_even(min(v), 2) AS min, round_even(max(v), 2) AS max FROM m GROUP BY ALL")
def multiseed_summary(spark, d):
    r = lambda c: F.bround(c, 2)
    return models(spark, d).groupBy("dataset", "model").agg(r(F.avg("v")).alias("mean"), r(F.stddev_samp("v")).alias("std"), r(F.min("v")).alias("min"), r(F.max("v")).alias("max"))


@query(f"WITH {MODELS} SELECT dataset, round(avg(v) FILTER (model = 'A'), 6) AS a, round(avg(v) FILTER (model = 'B'), 6) AS b FROM m GROUP BY dataset")
def metric_pivot_wide(spark, d):
    return models(spark, d).groupBy("dataset").pivot("model", ["A", "B"]).agg(r6(F.avg("v"))).withColumnsRenamed({"A": "a", "B": "b"})


@query(f"""WITH {MODELS}, s AS (SELECT fold, dataset, min(v) FILTER (model = 'B') AS first, min(v) AS best FROM m GROUP BY ALL) SELECT dataset, round(max(first) FILTER (fold = 0), 6) AS first, round(min(best), 6) AS best,
  round(max(first) FILTER (fold = 0) - min(best), 6) AS gain FROM s GROUP BY dataset""")
def selection_progress(spark, d):
    s = models(spark, d).groupBy("fold", "dataset").agg(F.min(F.when(F.col("model") == "B", F.col("v"))).alias("first"), F.min("v").alias("best"))
    g = s.groupBy("dataset").agg(F.max(F.when(F.col("fold") == 0, F.col("first"))).alias("first"), F.min("best").alias("best"))
    return g.select("dataset", r6("first").alias("first"), r6("best").alias("best"), r6(F.col("first") - F.col("best")).alias("gain"))


@query("SELECT subpop, greatest(1, round_even(quantile_cont(n, 0.5), 0))::DOUBLE AS rounds FROM (SELECT unit, count(*) AS n FROM cycles GROUP BY unit) JOIN labels_ USING (unit) GROUP BY subpop")
def iteration_budget_median(spark, d):
    c = b.cycles(spark, d)
    n = c.groupBy("unit").agg(F.count("*").alias("n")).join(b.labels(c), "unit")
    return n.groupBy("subpop").agg(F.greatest(F.lit(1.0), F.bround(F.percentile("n", F.lit(0.5)))).alias("rounds"))


@query("SELECT subpop, count(*) AS n FROM labels_ GROUP BY subpop")
def subpop_sizes(spark, d):
    return b.labels(b.cycles(spark, d)).groupBy("subpop").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM (SELECT DISTINCT sign(corr(s2, cycle)), sign(corr(s4, cycle)), sign(corr(s8, cycle)) FROM cycles GROUP BY unit)")
def distinct_patterns(spark, d):
    from fleetmill.functions.columns import pearson

    s = [F.signum(pearson(F.col(c), F.col("cycle").cast("double"))).alias(c) for c in ("s2", "s4", "s8")]
    return b.cycles(spark, d).groupBy("unit").agg(*s).agg(F.countDistinct(F.struct("s2", "s4", "s8")).alias("n"))


@query("SELECT dataset, round(stddev_samp(life) / avg(life), 6) AS cv FROM (SELECT dataset, unit, max(cycle) AS life FROM cycles GROUP BY ALL) GROUP BY dataset")
def coefficient_of_variation(spark, d):
    life = b.cycles(spark, d).groupBy("dataset", "unit").agg(F.max("cycle").alias("life"))
    return life.groupBy("dataset").agg(r6(F.stddev_samp("life") / F.avg("life")).alias("cv"))


@query("SELECT unit, cycle, round(s2, 6) AS s2 FROM cycles ORDER BY unit, cycle")
def sort_unit_cycle(spark, d):
    return b.cycles(spark, d).select("unit", "cycle", r6("s2").alias("s2")).orderBy("unit", "cycle")


@query(f"WITH {MODELS}, s AS (SELECT dataset, model, fold, v FROM m) SELECT dataset, arg_min(fold, v) AS fold, round(min(v), 6) AS v FROM s GROUP BY dataset")
def pick_best(spark, d):
    return models(spark, d).groupBy("dataset").agg(F.min(F.struct("v", "fold", "model")).alias("x")).select("dataset", F.col("x.fold").alias("fold"), r6("x.v").alias("v"))


@query("SELECT repeat, 'A' AS model, count(*) AS n FROM points2 GROUP BY repeat UNION ALL SELECT repeat, 'B', count(*) FROM points2 WHERE cycle > 5 GROUP BY repeat")
def concat_frames(spark, d):
    p = b.points(spark, d, "A").withColumn("model", F.lit("A")).unionByName(b.points(spark, d, "B").where("cycle > 5").withColumn("model", F.lit("B")))
    return p.groupBy("repeat", "model").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT unit FROM cycles WHERE unit % 3 = 0 EXCEPT SELECT DISTINCT unit FROM cycles WHERE op1 = 10 AND cycle < 10")
def set_difference(spark, d):
    c = b.cycles(spark, d)
    return c.where("unit % 3 = 0").select("unit").subtract(c.where("op1 = 10 and cycle < 10").select("unit"))


@query("SELECT DISTINCT unit FROM cycles WHERE op1 = 0 AND cycle < 4 INTERSECT SELECT DISTINCT unit FROM cycles WHERE op1 = 10 AND cycle < 4")
def set_intersection(spark, d):
    c = b.cycles(spark, d).where("cycle < 4")
    return c.where("op1 = 0").select("unit").intersect(c.where("op1 = 10").select("unit"))


@query("SELECT repeat, fold, seed FROM points GROUP BY ALL")
def distinct_splits(spark, d):
    return b.points(spark, d).select("repeat", "fold", "seed").dropDuplicates()
