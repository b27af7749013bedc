"""Models, scoring and streams."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetmill.functions.columns import bucket, clip, r6, unpivot
from fleetmill.functions.rng import uniform
from fleetmill.operators import features as f
from fleetmill.operators import labels, models
from fleetmill.operators import resampling as rs
from fleetmill.operators import scoring_pipeline as pl
from fleetmill.operators import signal as s
from fleetmill.operators.ordering import numbered
from fleetmill.plans.flagship import fleet_status as _fleet_status
from fleetmill.sources import bindings as b
from fleetmill.sources.shared import new_folder, written
from fleetmill.streaming import scoring

from .registry import query, u

X = ["s2", "s4", "s7"]


def rows(spark, d):
    """Cycles with their life left and the unit's hashed fold."""
    c = labels.capped_rul(b.with_rul(b.cycles(spark, d)), [b.CAP])
    return c.withColumn("fold", F.floor(uniform("oof", F.col("unit")) * 3).cast("int"))


@query("""WITH z AS (SELECT *, (s2 - avg(s2) FILTER (unit % 5 <> 0) OVER w) / (stddev_samp(s2) FILTER (unit % 5 <> 0) OVER w) AS z2, (s7 - avg(s7) FILTER (unit % 5 <> 0) OVER w) / (stddev_samp(s7) FILTER (unit % 5 <> 0) OVER w) AS z7 FROM cycles WINDOW w AS (PARTITION BY op1)),
  m AS (SELECT unit, cycle, avg(z2) OVER r AS m2, avg(z7) OVER r AS m7, coalesce(regr_slope(z7, cycle) OVER r, 0) AS b7, max(cycle) OVER (PARTITION BY unit) AS l FROM z WINDOW r AS (PARTITION BY unit ORDER BY cycle ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
  p AS (SELECT *, least(greatest(66 - cycle + 5 * m2 - 20 * b7, 0), 40) AS p FROM m WHERE cycle = l)
  SELECT CASE WHEN p < 10 THEN 'critical' WHEN p < 20 THEN 'urgent' WHEN p < 40 THEN 'monitor' ELSE 'healthy' END AS bucket, count(*) AS n, round(avg(m7), 6) AS level FROM p GROUP BY 1""")
def fleet_status(spark, d):
    return _fleet_status(spark, d)


@query("SELECT CASE op1 WHEN 0 THEN 0 WHEN 10 THEN 1 WHEN 20 THEN 2 WHEN 25 THEN 3 ELSE 4 END AS cluster, count(*) AS n FROM cycles GROUP BY op1")
def kmeans_regimes(spark, d):
    c = b.cycles(spark, d).select(*b.OPS)
    c, _ = models.kmeans(models.standardised(c, c, b.OPS), b.OPS, 5, tuple(range(1, 11)))
    return c.groupBy("cluster").agg(F.count("*").alias("n"))


@query("SELECT row_number() OVER (ORDER BY n DESC, op1) - 1 AS label, n FROM (SELECT op1, count(*) AS n FROM cycles GROUP BY op1)")
def cluster_relabel_by_size(spark, d):
    c = b.cycles(spark, d).select(F.col("op1").alias("label"))
    return models.relabel_by_size(c, "label").groupBy(F.col("label").cast("long").alias("label")).agg(F.count("*").alias("n"))


def all_sign_rows(spark, d):
    """(unit, s2, s4, s8, whole): a sensor without correlation in some unit is 0 in all; a unit with a correlation of 0 has no vector."""
    rho = s.spearman(s.with_ttf(unpivot(b.cycles(spark, d), ["unit", "cycle"], ["s2", "s4", "s8"])))
    v = s.signs(rho).withColumn("x", F.when(F.col("problem").isin(s.NO_RHO, s.NO_RHO_ELSEWHERE), 0.0).otherwise(F.col("sign")))
    wide = v.groupBy("unit").agg(*[F.max(F.when(F.col("sensor") == c, F.col("x"))).alias(c) for c in ("s2", "s4", "s8")])
    return wide.withColumn("whole", F.col("s2").isNotNull() & F.col("s4").isNotNull() & F.col("s8").isNotNull())


def sign_rows(spark, d):
    return all_sign_rows(spark, d).where("whole").drop("whole")


@query()
def subpopulation_labels(spark, d):
    """(unit, cluster) of every unit; null where the unit has no sign vector."""
    v = written(all_sign_rows(spark, d), "signs")
    c, _ = models.kmeans(v.where("whole"), ["s2", "s4", "s8"], 2)
    return v.select("unit").join(models.relabel_by_size(c.select("unit", "cluster"), "cluster"), "unit", "left")


COV = ", ".join(f"round(covar_pop({p}, {q}), 6) AS {p}_{q}" for i, p in enumerate(X) for q in X[i:])


@query(f"SELECT {COV} FROM cycles")
def health_index_covariance(spark, d):
    return b.cycles(spark, d).agg(*[r6(F.covar_pop(p, q)).alias(f"{p}_{q}") for i, p in enumerate(X) for q in X[i:]])


@query()
def health_index_fit(spark, d):
    z = f.zscore_masked(b.cycles(spark, d).withColumnRenamed("op1", "regime"), X)
    names = [f"{c}_n" for c in X]
    v, share = models.first_component(models.moments(z, names).first().asDict(), names)
    hi = b.with_rul(z).withColumn("hi", models.linear(names, v, 0.0))
    # Oriented to rise towards failure.
    turn = F.when(F.corr("hi", "rul_true") > 0, -1.0).otherwise(1.0)
    one = hi.agg(turn.alias("turn"))
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("sensor"), (F.lit(float(x)) * F.col("turn")).alias("loading"), F.lit(share).alias("explained")) for n, x in zip(names, v, strict=True)])).alias("x")).select("x.*")


@query()
def pca_loading_ci(spark, d):
    """(cluster, sensor, ci_lo, ci_hi, defined, reversed): intervals over replicates of units, of all and of each cluster.

    reversed: the cluster's interval and that of all lie on opposite sides of 0.
    """
    c = b.cycles(spark, d)
    drawn = written(rs.draws(c.select("unit").distinct(), 40))
    per = models.moments(c, X, ["unit"]).join(b.labels(c), "unit")
    groups = per.withColumn("cluster", F.explode(F.array(F.lit("all"), F.col("subpop").cast("string")))).drop("subpop")
    reps = written(models.component_draws(groups, drawn, X, ["cluster"]))
    ci = rs.interval(reps, ["cluster", "sensor"], "loading")
    whole = ci.where("cluster = 'all'").select("sensor", F.col("ci_lo").alias("lo"), F.col("ci_hi").alias("hi"))
    return ci.join(F.broadcast(whole), "sensor").withColumn("reversed", ((F.col("ci_hi") < 0) & (F.col("lo") > 0)) | ((F.col("ci_lo") > 0) & (F.col("hi") < 0))).select("cluster", "sensor", "ci_lo", "ci_hi", "defined", "reversed")


def _hig(x: str) -> str:
    return f"""(SELECT unit, covar_pop(a, t) / nullif(stddev_pop(a) * stddev_pop(t), 0) AS rho FROM (SELECT unit, rank() OVER (PARTITION BY unit ORDER BY {x}) + (count(*) OVER (PARTITION BY unit, {x}) - 1) / 2 AS a, rank() OVER (PARTITION BY unit ORDER BY rul_true) AS t FROM h) GROUP BY unit)"""


@query(f"""WITH h AS (SELECT unit, rul_true, round(CASE WHEN unit % 3 = 0 THEN 0.8 * s7 + 0.2 * s2 ELSE 0.3 * s7 + 0.9 * s2 END, 9)::DOUBLE AS own, round(0.5 * s7 + 0.5 * s2, 9)::DOUBLE AS pooled FROM ruled)
  SELECT unit, round(abs(o.rho) - abs(p.rho), 6) AS gain FROM {_hig('own')} o JOIN {_hig('pooled')} p USING (unit)""")
def hi_group_gain(spark, d):
    own = F.when(F.col("unit") % 3 == 0, 0.8 * F.col("s7") + 0.2 * F.col("s2")).otherwise(0.3 * F.col("s7") + 0.9 * F.col("s2"))
    h = b.with_rul(b.cycles(spark, d)).select("unit", "rul_true", F.round(own, 9).alias("own"), F.round(0.5 * F.col("s7") + 0.5 * F.col("s2"), 9).alias("pooled"))
    a, p = s.spearman(h, "own", "rul_true", ["unit"]), s.spearman(h, "pooled", "rul_true", ["unit"]).withColumnRenamed("rho", "pooled")
    return a.join(p, "unit").select("unit", r6(F.abs("rho") - F.abs("pooled")).alias("gain"))


@query("SELECT unit, cycle, round((SELECT avg(least(rul_true, 40)) FROM ruled WHERE unit % 5 <> 0), 6) AS pred FROM cycles WHERE unit % 5 = 0")
def model_mean(spark, d):
    r = rows(spark, d)
    one = F.broadcast(r.where("unit % 5 <> 0").agg(F.avg("rul").alias("m")))  # a single row
    return r.where("unit % 5 = 0").join(one, F.lit(True)).select("unit", "cycle", r6(clip("m", b.CAP)).alias("pred"))


@query("""SELECT count(*) AS n, round(sum(s2), 3) AS s_s2, round(sum(s2 * s4), 2) AS q_s2_s4, round(sum(s7 * rul), 2) AS q_s7_rul FROM (SELECT *, least(rul_true, 40) AS rul FROM ruled WHERE unit % 5 <> 0)""")
def ridge_gram(spark, d):
    m = models.moments(rows(spark, d).where("unit % 5 <> 0"), [*X, "rul"])
    return m.select(F.col("n").cast("long").alias("n"), F.round("s_s2", 3).alias("s_s2"), F.round("q_s2_s4", 2).alias("q_s2_s4"), F.round("q_s7_rul", 2).alias("q_s7_rul"))


def solved(rows: str, alphas: str, key: str = "k") -> str:
    """SQL of ridge's weights w2, w4, w7 and intercept i by key and alpha, from the moments of rows (key, s2, s4, s7, rul): normal equations by Cramer's rule."""
    return f"""mo AS (SELECT {key}, count(*)::DOUBLE AS n, avg(s2) AS m2, avg(s4) AS m4, avg(s7) AS m7, avg(rul) AS my, stddev_pop(s2) AS d2, stddev_pop(s4) AS d4, stddev_pop(s7) AS d7, covar_pop(s2, s4) AS v24, covar_pop(s2, s7) AS v27, covar_pop(s4, s7) AS v47,
      covar_pop(s2, rul) AS y2, covar_pop(s4, rul) AS y4, covar_pop(s7, rul) AS y7 FROM {rows} GROUP BY {key}),
    ge AS (SELECT *, n + alpha AS a, n * v24 / (d2 * d4) AS b, n * v27 / (d2 * d7) AS c, n * v47 / (d4 * d7) AS e, n * y2 / d2 AS p, n * y4 / d4 AS q, n * y7 / d7 AS r FROM mo, ({alphas})),
    de AS (SELECT *, a * (a * a - e * e) - b * (b * a - e * c) + c * (b * e - a * c) AS det FROM ge),
    wt AS (SELECT {key}, alpha, (p * (a * a - e * e) - b * (q * a - e * r) + c * (q * e - a * r)) / det / d2 AS w2, (a * (q * a - e * r) - p * (b * a - e * c) + c * (b * r - q * c)) / det / d4 AS w4,
      (a * (a * r - q * e) - b * (b * r - q * c) + p * (b * e - a * c)) / det / d7 AS w7, my, m2, m4, m7 FROM de),
    we AS (SELECT *, my - w2 * m2 - w4 * m4 - w7 * m7 AS i FROM wt)"""


ROWS = f"rw AS (SELECT *, least(rul_true, 40) AS rul, floor({u('oof', 'unit')} * 3)::INT AS fold FROM ruled)"
OTHERS = "(SELECT k, s2, s4, s7, rul FROM rw JOIN (SELECT DISTINCT fold AS k FROM rw) ON fold <> k)"
RAW = "i + s2 * w2 + s4 * w4 + s7 * w7"


@query(f"WITH {ROWS}, {solved('(SELECT 0 AS k, * FROM rw WHERE unit % 5 <> 0)', 'SELECT 1.0::DOUBLE AS alpha')} SELECT unit, cycle, rul, round(least(greatest({RAW}, 0), 40), 6) AS pred FROM rw, we WHERE unit % 5 = 0")
def model_ridge(spark, d):
    r = rows(spark, d)
    w, i = models.ridge(r.where("unit % 5 <> 0"), X, "rul", 1.0)
    return r.where("unit % 5 = 0").select("unit", "cycle", "rul", r6(clip(models.linear(X, w, i), b.CAP)).alias("pred"))


def boosting_rows(spark, d):
    """Rows for trees, by ranges of the features of training units."""
    r = written(rows(spark, d).select("unit", "cycle", "rul", *X))
    return models.in_ranges(r, X, r.where("unit % 5 <> 0"))


@query()
def model_forest(spark, d):
    r = boosting_rows(spark, d)
    return models.forest(r.where("unit % 5 <> 0"), X, "rul").transform(models.vectors(r.where("unit % 5 = 0"), X)).select("unit", "cycle", "rul", F.col("prediction").alias("pred"))


def patient(spark, d, r, patience):
    """Boosted trees with up to 500 rounds, until `patience` of them bring no lower error on a fifth of the units."""
    train = r.where("unit % 5 <> 0")
    return models.boosted_with_patience(train.where("unit % 5 <> 1"), train.where("unit % 5 = 1"), X, "rul", 500, patience, 160 if patience > 20 else 64)


@query()
def model_gbt(spark, d):
    r = boosting_rows(spark, d)
    fit, _ = patient(spark, d, r, 50)
    return fit.transform(models.vectors(r.where("unit % 5 = 0"), X)).select("unit", "cycle", "rul", F.col("prediction").alias("pred"), F.lit(fit.getNumTrees).alias("rounds"))


@query()
def gbt_importances(spark, d):
    """(feature, importance) of the boosted trees, the largest first."""
    fit, _ = patient(spark, d, boosting_rows(spark, d), 5)
    return spark.createDataFrame([(c, float(v)) for c, v in zip(X, fit.featureImportances.toArray(), strict=True)], "feature string, importance double").orderBy(F.desc("importance"), "feature")


def early(spark, d):
    e = f.early_summary(b.cycles(spark, d), ["s2", "s8"], b.FIRST_N)
    return e.withColumns({"y": (F.col("unit") % 2 == 1).cast("int"), "fold": F.floor(uniform("cv", F.col("unit")) * 3).cast("int")})


EARLY = ["s2_mean", "s2_slope", "s8_slope"]


@query()
def model_logistic(spark, d):
    e = early(spark, d)
    return models.logistic_probability(e.where("unit % 5 <> 0"), e.where("unit % 5 = 0"), EARLY, "y").select("unit", "y", "p")


@query()
def cross_fit_probability(spark, d):
    e = written(early(spark, d))
    train = e.where("unit % 5 <> 0")
    inner = models.out_of_fold(train, 3, lambda a, o: models.logistic_probability(a, o, EARLY, "y"))
    return inner.unionByName(models.logistic_probability(train, e.where("unit % 5 = 0"), EARLY, "y")).select("unit", "fold", "p")


@query()
def identifiability(spark, d):
    e = written(early(spark, d))
    p = models.out_of_fold(e, 3, lambda a, o: models.logistic_probability(a, o, EARLY, "y"))
    return rs.roc_auc(p, "p", "y")


@query()
def identifiability_repeats(spark, d):
    """(repeat, fold, n, auc, auc_of_repeat, mean_auc): separability in three repeats of unit folds; each fold's model has its own scaling and weights."""
    e = written(early(spark, d))
    p = None
    for repeat in (1, 2, 3):
        dealt = e.withColumn("fold", F.floor(uniform(f"cv{repeat}", F.col("unit")) * 3).cast("int"))
        one = models.out_of_fold(dealt, 3, lambda a, o: models.logistic_probability(a, o, EARLY, "y")).select(F.lit(repeat).alias("repeat"), "fold", "unit", "y", "p")
        p = one if p is None else p.unionByName(one)
    p = written(p)
    by_fold, whole = rs.roc_auc(p, "p", "y", ["repeat", "fold"]), rs.roc_auc(p, "p", "y", ["repeat"]).withColumnRenamed("auc", "auc_of_repeat")
    mean = F.broadcast(whole.agg(F.avg("auc_of_repeat").alias("mean_auc")))  # a single row
    n = p.groupBy("repeat", "fold").agg(F.count("*").alias("n"))
    return n.join(by_fold, ["repeat", "fold"]).join(whole, "repeat").join(mean, F.lit(True)).select("repeat", "fold", "n", "auc", "auc_of_repeat", "mean_auc")


@query(f"""WITH {ROWS}, {solved(OTHERS, 'SELECT 1.0::DOUBLE AS alpha')} SELECT k AS fold, x.f AS feature, round(x.w, 6) AS weight FROM (SELECT k, unnest([{{'f': 's2', 'w': w2}}, {{'f': 's4', 'w': w4}}, {{'f': 's7', 'w': w7}}, {{'f': 'intercept', 'w': i}}]) AS x FROM we)""")
def fit_candidate(spark, d):
    """(fold, feature, weight): ridge fitted on the other folds' units, for each fold."""
    fits = models.ridge_by_fold(rows(spark, d), X, "rul", [1.0])
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(v).alias("weight")) for c, v in [*((c, f"w_{c}") for c in X), ("intercept", "intercept")]])
    return fits.select("fold", F.explode(pairs).alias("p")).select("fold", "p.feature", r6("p.weight").alias("weight"))


@query(f"""WITH {ROWS}, {solved(OTHERS, 'SELECT 1.0::DOUBLE AS alpha')} SELECT unit, cycle, fold, rul_true, 'ridge' AS model, round(least(greatest({RAW}, 0), 40), 6) AS pred FROM rw JOIN we ON fold = k
  UNION ALL SELECT unit, cycle, fold, rul_true, 'mean', round(my, 6) FROM rw JOIN we ON fold = k""")
def oof_predict(spark, d):
    """Held-out predictions of ridge and mean for every cycle."""
    r = written(rows(spark, d).select("unit", "cycle", "fold", "rul_true", "rul", *X))
    by_fold = r.groupBy("fold").agg(F.sum("rul").alias("s"), F.count("*").alias("n"))  # a row for each fold
    mean = by_fold.alias("a").join(F.broadcast(by_fold.alias("b")), F.col("a.fold") != F.col("b.fold")).groupBy(F.col("a.fold").alias("fold")).agg((F.sum("b.s") / F.sum("b.n")).alias("m"))
    both = models.predicted(r, models.ridge_by_fold(r, X, "rul", [1.0]), X).join(F.broadcast(mean), "fold")
    each = F.explode(F.array(F.struct(F.lit("ridge").alias("model"), clip("raw", b.CAP).alias("p")), F.struct(F.lit("mean").alias("model"), F.col("m").alias("p")))).alias("x")
    return both.select("unit", "cycle", "fold", "rul_true", each).select("unit", "cycle", "fold", "rul_true", "x.model", r6("x.p").alias("pred"))


@query("""SELECT model, dataset, round(sqrt(avg((p - rul) ** 2)), 6) AS rmse, round(avg(abs(p - rul)), 6) AS mae FROM (SELECT dataset, rul, x.m AS model, x.p AS p FROM (SELECT op1 AS dataset, rul, unnest([{'m': 'mean', 'p': (SELECT avg(least(rul_true, 40)) FROM ruled WHERE unit % 5 <> 0)}, {'m': 'line', 'p': least(greatest(66 - cycle, 0), 40)::DOUBLE}]) AS x
  FROM (SELECT *, least(rul_true, 40) AS rul FROM ruled WHERE unit % 5 = 0))) GROUP BY ALL""")
def candidate_scoreboard(spark, d):
    r = rows(spark, d)
    one = F.broadcast(r.where("unit % 5 <> 0").agg(F.avg("rul").alias("m")))  # a single row
    t = r.where("unit % 5 = 0").join(one, F.lit(True)).select(F.col("op1").alias("dataset"), "rul", F.explode(F.array(F.struct(F.lit("mean").alias("model"), F.col("m").alias("p")), F.struct(F.lit("line").alias("model"), clip(F.lit(66.0) - F.col("cycle"), b.CAP).alias("p")))).alias("x"))
    e = F.col("x.p") - F.col("rul")
    return t.groupBy(F.col("x.model").alias("model"), "dataset").agg(r6(F.sqrt(F.avg(e * e))).alias("rmse"), r6(F.avg(F.abs(e))).alias("mae"))


TRIALS = 30
ALPHAS = f"SELECT exp(ln(0.01) + {u('alpha', 'trial')} * (ln(1000.0) - ln(0.01)))::DOUBLE AS alpha FROM (SELECT unnest(range(1, {TRIALS + 1})) AS trial)"


@query(f"""WITH {ROWS}, ra AS (SELECT *, floor({u('again', 'unit')} * 3)::INT AS fold2 FROM rw), {solved(OTHERS, ALPHAS)}, e1 AS (SELECT alpha, sqrt(avg((least(greatest({RAW}, 0), 40) - rul) ** 2)) AS rmse FROM rw JOIN we ON fold = k GROUP BY alpha),
  {solved(OTHERS.replace('FROM rw JOIN', 'FROM ra JOIN').replace('fold AS k FROM rw', 'fold2 AS k FROM ra').replace('fold <> k', 'fold2 <> k'), ALPHAS).replace('mo AS', 'mo2 AS').replace('FROM mo,', 'FROM mo2,').replace('ge AS', 'ge2 AS').replace('FROM ge)', 'FROM ge2)').replace('de AS', 'de2 AS').replace('FROM de)', 'FROM de2)').replace('wt AS', 'wt2 AS').replace('FROM wt)', 'FROM wt2)').replace('we AS', 'we2 AS')},
  e2 AS (SELECT alpha, sqrt(avg((least(greatest({RAW}, 0), 40) - rul) ** 2)) AS rmse FROM ra JOIN we2 ON fold2 = k GROUP BY alpha), best AS (SELECT arg_min(alpha, rmse) AS alpha, min(rmse) AS rmse FROM e1)
  SELECT round(best.alpha, 6) AS alpha, round(best.rmse, 6) AS rmse, round(e2.rmse, 6) AS rmse_other_repeat, (SELECT count(*) FROM e2 o WHERE o.rmse < e2.rmse - 1e-9) AS better_elsewhere FROM best JOIN e2 ON e2.alpha = best.alpha""")
def hyperparameter_search(spark, d):
    """The ridge penalty of least held-out error among hashed log-uniform draws, and how it does in another repeat's folds."""
    r = written(rows(spark, d).withColumn("fold2", F.floor(uniform("again", F.col("unit")) * 3).cast("int")).select("unit", "cycle", "fold", "fold2", "rul", *X))
    lo, hi = F.log(F.lit(0.01)), F.log(F.lit(1000.0))
    drawn = spark.range(1, TRIALS + 1).select(F.exp(lo + uniform("alpha", F.col("id")) * (hi - lo)).alias("alpha"))
    alphas = [x.alpha for x in drawn.collect()]  # TRIALS numbers

    def errors(fold):
        fits = models.ridge_by_fold(r, X, "rul", alphas, fold)
        return models.predicted(r, fits, X, fold).groupBy("alpha").agg(F.sqrt(F.avg(F.pow(clip("raw", b.CAP) - F.col("rul"), 2))).alias("rmse"))

    best = errors("fold").agg(F.min_by("alpha", F.struct("rmse", "alpha")).alias("alpha"), F.min("rmse").alias("rmse"))
    other = written(errors("fold2").withColumnRenamed("rmse", "rmse2"))
    all_of = other.agg(F.collect_list("rmse2").alias("all"))  # TRIALS numbers
    found = best.join(other, "alpha").join(F.broadcast(all_of), F.lit(True))
    return found.select(r6("alpha").alias("alpha"), r6("rmse").alias("rmse"), r6("rmse2").alias("rmse_other_repeat"), F.size(F.filter("all", lambda x: x < F.col("rmse2") - 1e-9)).cast("long").alias("better_elsewhere"))


@query()
def refit_all_units(spark, d):
    """Boosted trees on all units with the budget of rounds that patience on validation units gave."""
    r = boosting_rows(spark, d)
    rounds = patient(spark, d, r, 5)[0].getNumTrees
    fit = models.boosted(r, X, "rul", rounds)
    last = r.groupBy("unit").agg(F.max_by(F.struct(*X), "cycle").alias("x")).select("unit", "x.*")
    return fit.transform(models.vectors(last, X)).select("unit", F.col("prediction").alias("pred"), F.lit(rounds).alias("rounds"))


#: Candidates of the cross-validation by name; two seeds of a forest are two candidates.
CANDIDATES = {
    "ridge": lambda: LinearRegression(labelCol="rul", regParam=0.1), "forest 1": lambda: RandomForestRegressor(labelCol="rul", numTrees=20, maxDepth=5, seed=1),
    "forest 2": lambda: RandomForestRegressor(labelCol="rul", numTrees=20, maxDepth=5, seed=2), "boosted": lambda: GBTRegressor(labelCol="rul", maxIter=10, maxDepth=3, seed=1),
}


def cross_validation(spark, d):
    r = written(rows(spark, d).select("unit", "cycle", "fold", "rul_true", "rul", *X))
    return models.cross_validated(r, X, "rul", {n: make() for n, make in CANDIDATES.items()}, 3), r


@query()
def oof_predict_candidates(spark, d):
    """Held-out predictions of every candidate for every cycle, in one table."""
    model, r = cross_validation(spark, d)
    return models.held_out(model, r, list(CANDIDATES)).select("unit", "cycle", "fold", "candidate", "rul_true", clip("raw", b.CAP).alias("pred"))


@query()
def candidate_table(spark, d):
    """(candidate, fold, rmse, mae, n) of held-out rows, and whether the candidate is the one of least mean error over folds."""
    model, r = cross_validation(spark, d)
    best = list(CANDIDATES)[min(range(len(CANDIDATES)), key=lambda k: model.avgMetrics[k])]
    e = F.col("raw") - F.col("rul")
    g = models.held_out(model, r, list(CANDIDATES)).groupBy("candidate", "fold").agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.count("*").alias("n"))
    return g.withColumn("best", F.col("candidate") == best)


@query("SELECT unit, max(cycle) AS cycle, round((SELECT avg(least(rul_true, 40)) FROM ruled WHERE unit % 5 <> 0), 6) AS pred FROM cycles WHERE unit % 5 = 0 GROUP BY unit")
def predict_last_cycle(spark, d):
    r = rows(spark, d)
    one = F.broadcast(r.where("unit % 5 <> 0").agg(F.avg("rul").alias("m")))  # a single row
    return labels.last_row(r.where("unit % 5 = 0").select("dataset", "unit", "cycle")).join(one, F.lit(True)).select("unit", "cycle", r6("m").alias("pred"))


def patterns(df):
    """Distinct sign vectors with their counts: eight at most for three sensors."""
    return [([r.s2, r.s4, r.s8], float(r.n)) for r in df.groupBy("s2", "s4", "s8").agg(F.count("*").alias("n")).orderBy("s2", "s4", "s8").collect()]


@query()
def split_gain(spark, d):
    signs = written(sign_rows(spark, d))
    return signs.agg(F.count("*").alias("units")).withColumn("gain", F.lit(models.split_gain(patterns(signs))))


@query()
def permutation_test(spark, d):
    """Gain of the split against gains with every sensor's signs dealt anew, in 20 replicates."""
    signs = written(sign_rows(spark, d))
    long = unpivot(signs, ["unit"], ["s2", "s4", "s8"]).withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(20))))
    # Places over all replicates and sensors: each of these has as many rows, so equal ranges of places.
    a = numbered(long.select("replicate", "sensor", "unit"), ["replicate", "sensor", "unit"], "i")
    h = uniform("perm", F.col("replicate"), F.col("sensor"), F.col("unit"))
    z = numbered(long.select("replicate", "sensor", "x", h.alias("h"), F.col("unit").alias("from")), ["replicate", "sensor", "h", "from"], "i").drop("h", "from")
    dealt = a.join(z, ["replicate", "sensor", "i"]).groupBy("replicate", "unit").pivot("sensor", ["s2", "s4", "s8"]).agg(F.first("x"))
    counts = dealt.groupBy("replicate", "s2", "s4", "s8").agg(F.count("*").cast("double").alias("n"))

    def of(pdf):
        return pdf.iloc[:1][["replicate"]].assign(gain=models.split_gain([(list(r), n) for r, n in zip(pdf[["s2", "s4", "s8"]].to_numpy(), pdf["n"], strict=True)]))

    null = counts.groupBy("replicate").applyInPandas(of, "replicate int, gain double")  # patterns of one replicate: eight rows at most
    seen = float(models.split_gain(patterns(signs)))
    return null.agg(F.max(F.lit(seen)).alias("gain"), ((1 + F.count_if(F.col("gain") >= seen)) / (1 + F.count("*"))).alias("p"))


@query("""WITH p AS (SELECT unit, cycle, s2 AS x, s8 AS y, unit % 3 AS g FROM cycles), q AS (SELECT * FROM p WHERE (unit * 1000 + cycle) % 50 = 0),
  d AS (SELECT q.unit, q.cycle, q.g, p.g AS c, sum(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2)) AS s, count(*) AS n FROM q, p GROUP BY ALL),
  e AS (SELECT unit, cycle, max(CASE WHEN g = c AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN g <> c THEN s / n END) AS b FROM d GROUP BY ALL)
  SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END), 6) AS silhouette, count(*) AS n FROM e""")
def silhouette(spark, d):
    """The mean silhouette, by Euclidean distances, of every fiftieth cycle among all."""
    p = b.cycles(spark, d).select((F.col("unit") * 1000 + F.col("cycle")).alias("id"), F.col("s2").alias("x"), F.col("s8").alias("y"), (F.col("unit") % 3).alias("g"))
    return models.silhouette(written(p), ["x", "y"], "g", "id").select(r6("silhouette").alias("silhouette"), "n")


SEEDED = f"l AS (SELECT unit, seed, floor((avg(s2) + 12 * {u('cluster', 'seed', 'unit')}) / 10)::INT AS label FROM cycles, (SELECT unnest([1, 2, 3, 4, 5]) AS seed) GROUP BY unit, seed)"


@query(f"""WITH {SEEDED}, t AS (SELECT x.seed AS a, y.seed AS b, x.label AS la, y.label AS lb, count(*)::DOUBLE AS n FROM l x JOIN l y ON x.unit = y.unit AND x.seed < y.seed GROUP BY ALL),
  i AS (SELECT a, b, sum(n * (n - 1) / 2) AS v FROM (SELECT a, b, la, sum(n) AS n FROM t GROUP BY ALL) GROUP BY ALL), j AS (SELECT a, b, sum(n * (n - 1) / 2) AS v FROM (SELECT a, b, lb, sum(n) AS n FROM t GROUP BY ALL) GROUP BY ALL),
  g AS (SELECT a, b, sum(n * (n - 1) / 2) AS ij, sum(n) AS n FROM t GROUP BY ALL), r AS (SELECT a, b, (ij - i.v * j.v / (n * (n - 1) / 2)) / nullif((i.v + j.v) / 2 - i.v * j.v / (n * (n - 1) / 2), 0) AS ari FROM g JOIN i USING (a, b) JOIN j USING (a, b))
  SELECT count(*) AS pairs, round(min(ari), 6) AS least, round(avg(ari), 6) AS mean, round(max(ari), 6) AS greatest FROM r""")
def rand_index_over_seeds(spark, d):
    """How far labels that depend on a seed agree: the least, mean and greatest adjusted Rand index of all pairs of five seeds."""
    per = b.cycles(spark, d).groupBy("unit").agg(F.avg("s2").alias("m")).withColumn("seed", F.explode(F.array(*[F.lit(k) for k in range(1, 6)])))
    labelled = per.select("unit", "seed", F.floor((F.col("m") + 12 * uniform("cluster", F.col("seed"), F.col("unit"))) / 10).cast("int").alias("label"))
    r = rs.rand_index_pairs(labelled, "unit", "seed", "label")
    return r.agg(F.count("*").alias("pairs"), r6(F.min("ari")).alias("least"), r6(F.avg("ari")).alias("mean"), r6(F.max("ari")).alias("greatest"))


@query("""WITH p AS (SELECT k, unit, avg(s2) AS x, avg(s8) AS y, unit % k AS g FROM cycles, (SELECT unnest([2, 3, 5]) AS k) GROUP BY ALL), c AS (SELECT k, g AS c, count(*) AS n, avg(x * x + y * y) AS q, avg(x) AS mx, avg(y) AS my FROM p GROUP BY ALL),
  d AS (SELECT p.k, unit, max(CASE WHEN g = c AND n > 1 THEN (x * x + y * y - 2 * (x * mx + y * my) + q) * n / (n - 1) END) AS a, min(CASE WHEN g <> c THEN x * x + y * y - 2 * (x * mx + y * my) + q END) AS b FROM p JOIN c ON p.k = c.k GROUP BY ALL)
  SELECT k, round(avg(CASE WHEN a IS NULL THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END), 6) AS silhouette FROM d GROUP BY k""")
def silhouette_squared(spark, d):
    """The mean silhouette of all units for several numbers of groups, by squared distances."""
    p = b.cycles(spark, d).groupBy("unit").agg(F.avg("s2").alias("x"), F.avg("s8").alias("y")).withColumn("k", F.explode(F.array(*[F.lit(k) for k in (2, 3, 5)]))).withColumn("g", F.col("unit") % F.col("k"))
    return models.silhouette_squared(p, ["x", "y"], "g", ["k"]).select("k", r6("silhouette").alias("silhouette"))


@query("SELECT op1 AS c1, op1 / 50 AS c2, CASE WHEN op1 = 25 THEN 60.0 ELSE 100.0 END::DOUBLE AS c3, count(*) AS n FROM cycles GROUP BY op1")
def regime_profile(spark, d):
    """Centres of the clusters of standardised settings, back on the settings' own scale, with their rows."""
    c = b.cycles(spark, d).select(*b.OPS)
    clustered, centres = models.kmeans(models.standardised(c, c, b.OPS), b.OPS, 5, tuple(range(1, 11)))
    scale = c.agg(*[f(o).alias(f"{n}_{o}") for o in b.OPS for n, f in (("m", F.avg), ("d", F.stddev_pop))]).first()  # a single row
    own = [(k, *(float(x) * (scale[f"d_{o}"] or 1.0) + scale[f"m_{o}"] for x, o in zip(p, b.OPS, strict=True))) for k, p in enumerate(centres)]
    known = F.broadcast(spark.createDataFrame(own, "cluster int, c1 double, c2 double, c3 double"))  # a row for each cluster
    n = clustered.groupBy("cluster").agg(F.count("*").alias("n"))
    return n.join(known, "cluster").select(r6("c1").alias("c1"), r6("c2").alias("c2"), r6("c3").alias("c3"), "n")


@query()
def elbow_inertia(spark, d):
    raw = b.cycles(spark, d).select("unit", *b.OPS)
    c = models.standardised(raw, raw, b.OPS)
    dist = lambda cs: F.least(*[sum(((F.col(o) - x) * (F.col(o) - x) for o, x in zip(b.OPS, p, strict=True)), F.lit(0.0)) for p in [*cs, cs[0]]])
    cols = {k: models.kmeans(c, b.OPS, k)[1] for k in (1, 2, 3, 5)}
    return c.agg(*[F.sum(dist(cs)).alias(f"k{k}") for k, cs in cols.items()])


WEIGHTS = (55.0, -0.4, -2.0)
FEATS = "ft AS (SELECT unit, cycle, avg(s7) OVER r AS level, coalesce(regr_slope(s7, cycle) OVER r, 0) AS slope, row_number() OVER (PARTITION BY unit ORDER BY cycle) AS n_cycles_used FROM cycles WINDOW r AS (PARTITION BY unit ORDER BY cycle ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)), sc AS (SELECT *, CASE WHEN n_cycles_used >= 10 THEN least(greatest(55 - 0.4 * level - 2 * CASE WHEN cycle = 1 THEN 0 ELSE slope END, 0), 40) END AS p FROM ft)"
BUCKET = "CASE WHEN p < 10 THEN 'critical' WHEN p < 20 THEN 'urgent' WHEN p < 40 THEN 'monitor' WHEN p >= 40 THEN 'healthy' END"


@query(f"WITH {FEATS} SELECT unit, cycle, n_cycles_used, round(p, 6) AS predicted_rul, p >= 40 AS rul_at_cap, {BUCKET} AS bucket, CASE WHEN p IS NULL THEN 'short history' END AS reject FROM sc")
def batch_score(spark, d):
    out = scoring.scored(scoring.batch_features(b.cycles(spark, d), "s7", b.WINDOW), WEIGHTS, b.CAP, b.MIN_HISTORY, b.BUCKETS)
    return out.select("unit", "cycle", "n_cycles_used", r6("predicted_rul").alias("predicted_rul"), "rul_at_cap", "bucket", "reject")


LIMITS = """lim AS (SELECT min(s2) - 0.0 AS a2, max(s2) AS z2, min(s4) AS a4, max(s4) AS z4, min(s8) AS a8, max(s8) AS z8 FROM cycles WHERE unit % 5 <> 0),
  bad AS (SELECT c.*, CASE WHEN (unit * 7 + cycle) % 97 = 0 THEN NULL WHEN (unit + cycle) % 89 = 0 THEN s2 + 1000 ELSE s2 END AS x2, CASE WHEN (unit + cycle) % 83 = 0 THEN -500.0 ELSE s4 END AS x4 FROM cycles c),
  ck AS (SELECT b.unit, b.cycle, ft.n_cycles_used, ft.level, ft.slope, CASE WHEN x2 IS NULL THEN 'missing value' WHEN concat_ws(', ', CASE WHEN x2 < a2 OR x2 > z2 THEN 's2' END, CASE WHEN x4 < a4 OR x4 > z4 THEN 's4' END, CASE WHEN s8 < a8 OR s8 > z8 THEN 's8' END) <> ''
    THEN 'outside the envelope: ' || concat_ws(', ', CASE WHEN x2 < a2 OR x2 > z2 THEN 's2' END, CASE WHEN x4 < a4 OR x4 > z4 THEN 's4' END, CASE WHEN s8 < a8 OR s8 > z8 THEN 's8' END) WHEN ft.n_cycles_used < 10 THEN 'short history' END AS reject
    FROM bad b JOIN ft USING (unit, cycle), lim)"""


def scored_batch(spark, d):
    """(scores, rejects) of cycles with some broken values, by a pipeline that was saved and loaded again."""
    c = b.cycles(spark, d)
    limits = pl.envelope(c.where("unit % 5 <> 0"), ["s2", "s4", "s8"])
    folder = new_folder(spark, "pipeline")
    pl.pipeline("s7", b.WINDOW, ["s2", "s4", "s8"], limits, b.MIN_HISTORY, WEIGHTS, b.CAP).write().save(folder)
    s2 = F.when((F.col("unit") * 7 + F.col("cycle")) % 97 == 0, F.lit(None)).when((F.col("unit") + F.col("cycle")) % 89 == 0, F.col("s2") + 1000).otherwise(F.col("s2"))
    broken = c.withColumns({"s2": s2, "s4": F.when((F.col("unit") + F.col("cycle")) % 83 == 0, -500.0).otherwise(F.col("s4"))})
    return pl.score(PipelineModel.load(folder), broken, b.BUCKETS)


@query(f"WITH {FEATS}, {LIMITS}, pr AS (SELECT *, least(greatest(55 - 0.4 * level - 2 * CASE WHEN cycle = 1 THEN 0 ELSE slope END, 0), 40) AS p FROM ck WHERE reject IS NULL) SELECT unit, cycle, n_cycles_used, round(p, 6) AS predicted_rul, p >= 40 AS rul_at_cap, {BUCKET} AS bucket FROM pr")
def pipeline_score(spark, d):
    out, _ = scored_batch(spark, d)
    return out.select("unit", "cycle", "n_cycles_used", r6("predicted_rul").alias("predicted_rul"), "rul_at_cap", "bucket")


@query(f"WITH {FEATS}, {LIMITS} SELECT unit, cycle, n_cycles_used, reject FROM ck WHERE reject IS NOT NULL")
def pipeline_rejects(spark, d):
    """The rows that aren't scored, with the reason."""
    return scored_batch(spark, d)[1].drop("dataset")


@query(f"WITH {FEATS} SELECT unit, cycle, n_cycles_used, round(p, 6) AS predicted_rul, {BUCKET} AS bucket FROM sc")
def stream_score(spark, d):
    """Cycles come in three runs, every third of a unit's in each, so that most wait in the state for those before them.

    A cycle is a minute of event time; a mark far behind all of them lets every unit's timer pass, which frees its state.
    """
    folder = new_folder(spark, "stream")
    time = F.timestamp_seconds(F.col("cycle") * 60)
    c = b.cycles(spark, d).select("unit", "cycle", "s7", time.alias("time"))
    for rows_now in (*(c.where(F.col("cycle") % 3 == part) for part in (0, 2, 1)), marked(c, "unit", "time")):
        rows_now.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(c.schema).parquet(f"{folder}/in").withWatermark("time", "10 days")
        feats = scoring.drained(scoring.stream_features(stream, "s7", b.WINDOW, "time"), folder)
    out = scoring.scored(feats.where("unit <> -1"), WEIGHTS, b.CAP, b.MIN_HISTORY, b.BUCKETS)
    return out.select("unit", "cycle", "n_cycles_used", r6("predicted_rul").alias("predicted_rul"), "bucket")


def marked(rows, key, time):
    """One row of key -1, 100 days behind the last of rows; nothing if there are none."""
    last = rows.agg((F.max(time) + F.expr("interval 100 days")).alias(time)).where(F.col(time).isNotNull())
    kinds = {f.name: f.dataType for f in rows.schema}
    other = [F.lit(-1).cast(kinds[c]).alias(c) if c == key else F.col(time) if c == time else F.lit(0).cast(kinds[c]).alias(c) for c in rows.columns]
    return last.select(*other)


#: Events of a group of units that share a stream's state.
GROUP_ROWS = 10_000
LATE = "FROM (SELECT ts, (SELECT max(ts) FROM events) AS last FROM events) WHERE ts < last - INTERVAL 6 DAY"


@query(f"SELECT user_id AS unit, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place, (SELECT count(*) {LATE}) AS late FROM events")
def stream_reorder(spark, d):
    """Events come up to four days late, in three runs, and are given out in order; a fourth run repeats old ones, all too late."""
    folder = new_folder(spark, "reorder")
    e = b.read(spark, d, "events").select(F.col("user_id").alias("unit"), "event_id", "ts")
    span = F.broadcast(e.agg(F.min("ts").alias("first"), F.max("ts").alias("last")))  # a single row
    days = lambda a, z: (F.unix_micros(z.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 86_400_000_000
    comes = days(F.col("first"), F.col("ts")) + 4 * uniform("delay", F.col("event_id"))
    run = F.least(F.floor(3 * comes / (days(F.col("first"), F.col("last")) + 4)), F.lit(2))
    timed = written(e.join(span, F.lit(True)).withColumn("run", run), "timed")
    groups = max(spark.sparkContext.defaultParallelism, -(-timed.count() // GROUP_ROWS))
    late = 0
    for rows_now in (*(timed.where(F.col("run") == k) for k in range(3)), timed.where("ts < last - interval 6 days"), marked(e, "unit", "ts")):
        rows_now.select("unit", "event_id", "ts").write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema("unit long, event_id long, ts timestamp").parquet(f"{folder}/in").withWatermark("ts", "5 days")
        late += scoring.drain(scoring.in_order(stream, "unit", "ts", "event_id", groups), folder)
    out = spark.read.parquet(f"{folder}/out").where("unit <> -1")
    return out.select("unit", "event_id", "place", F.lit(late).cast("long").alias("late"))


@query("SELECT unit, count(*) AS n, max(cycle) AS last FROM (SELECT DISTINCT unit, cycle FROM cycles) GROUP BY unit")
def stream_dedup_late(spark, d):
    """A second run brings repeated rows, and new ones that are older than the watermark: neither is taken."""
    folder = new_folder(spark, "dedup")
    e = b.read(spark, d, "events").select("event_id", "ts", "user_id")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    c = e.select(F.col("user_id").alias("unit"), F.row_number().over(order).cast("long").alias("cycle"), "ts")
    last = F.broadcast(e.agg(F.max("ts").alias("__last")))  # a single row
    late = c.join(last, F.lit(True)).where("ts < __last - interval 6 days").drop("__last").withColumn("cycle", F.col("cycle") + 1_000_000)
    for rows_now in (c.union(c.where("cycle % 3 = 0")), c.where("cycle % 2 = 0").union(late)):
        rows_now.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema("unit long, cycle long, ts timestamp").parquet(f"{folder}/in")
        out = scoring.drained(scoring.deduplicated(stream, "ts", ["unit", "cycle"], "5 days"), folder)
    return out.groupBy("unit").agg(F.count("*").alias("n"), F.max("cycle").alias("last"))


@query("""SELECT time_bucket(INTERVAL '1 day', ts) AS start, CASE WHEN value < 10 THEN 'critical' WHEN value < 20 THEN 'urgent' WHEN value < 40 THEN 'monitor' ELSE 'healthy' END AS bucket, count(*) AS n FROM events GROUP BY ALL""")
def stream_bucket_alert(spark, d):
    """Windows of a stream are given out as the watermark passes them; a mark behind all events lets the last ones pass."""
    folder = new_folder(spark, "alerts")
    e = b.read(spark, d, "events").select("ts", bucket("value", b.BUCKETS).alias("bucket"))
    e.union(e.agg((F.max("ts") + F.expr("interval 4 days")).alias("ts"), F.lit("mark").alias("bucket")).where("ts is not null")).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("ts timestamp, bucket string").parquet(f"{folder}/in").withWatermark("ts", "2 days")
    return scoring.drained(scoring.bucket_alerts(stream, "ts", "1 day"), folder).where("bucket <> 'mark'")


@query(f"""SELECT trial, round(exp(ln(0.01) + {u('rate', 'trial')} * (ln(0.3) - ln(0.01))), 9) AS rate, (floor({u('depth', 'trial')} * 6) + 3)::INT AS depth, ['mean', 'ridge', 'gbt'][(floor({u('kind', 'trial')} * 3) + 1)::INT] AS kind, n
  FROM (SELECT unit + 1 AS trial, count(*) AS n FROM cycles GROUP BY unit)""")
def random_candidates(spark, d):
    """A drawn candidate for each unit, with the cycles that it would be fitted on."""
    n = b.cycles(spark, d).groupBy((F.col("unit") + 1).alias("trial")).agg(F.count("*").alias("n"))
    return labels.random_candidates(n).select("trial", F.round("rate", 9).alias("rate"), "depth", "kind", "n")
