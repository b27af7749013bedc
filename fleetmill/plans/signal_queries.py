"""Statistics of signals within units."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetmill.functions.columns import pearson, r6, ratio, unpivot
from fleetmill.operators import evaluation as e
from fleetmill.operators import resampling as rs
from fleetmill.operators import signal as s
from fleetmill.operators.quantiles import median, quantiles
from fleetmill.sources import bindings as b
from fleetmill.sources.shared import written

from .registry import query, u
from .resampling_queries import CI, MANY, poisson_draws

LT = "lt AS (SELECT *, (max(cycle) OVER (PARTITION BY unit) - cycle)::DOUBLE AS ttf FROM long)"
RHO = f"""{LT}, rk AS (SELECT unit, sensor, op1, cycle, x, ttf, rank() OVER (PARTITION BY unit, sensor ORDER BY x) + (count(*) OVER (PARTITION BY unit, sensor, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY unit, sensor ORDER BY ttf)::DOUBLE AS ry FROM lt),
  rho AS (SELECT unit, sensor, covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) AS rho FROM rk GROUP BY ALL)"""


def long(spark, d, sensors=b.SENSORS, keys=("unit", "cycle")):
    # A row for each sensor, sorted again and again behind one exchange: tasks are small and as many as the rows ask for.
    return s.with_ttf(unpivot(b.cycles(spark, d, deal=True), list(keys), list(sensors)))


def rho(spark, d):
    return s.spearman(long(spark, d))


def rho_once(spark, d):
    """rho, written, for what reads it more than once: its rows are not multiplied and sorted for each."""
    return written(rho(spark, d), "rho")


@query("SELECT unit, round(covar_pop(s2, s7) / nullif(stddev_pop(s2) * stddev_pop(s7), 0), 6) AS r, NULL::DOUBLE AS constant FROM cycles GROUP BY unit")
def unit_pearson(spark, d):
    c = b.cycles(spark, d)
    return c.groupBy("unit").agg(r6(pearson(F.col("s2"), F.col("s7"))).alias("r"), pearson(F.col("s2"), F.lit(1.0)).alias("constant"))


@query(f"WITH {RHO} SELECT unit, sensor, round(rho, 6) AS rho FROM rho")
def unit_spearman(spark, d):
    return rho(spark, d).withColumn("rho", r6("rho"))


@query(f"""WITH {LT}, rk AS (SELECT unit, sensor, op1, rank() OVER (PARTITION BY unit, sensor, op1 ORDER BY x) + (count(*) OVER (PARTITION BY unit, sensor, op1, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY unit, sensor, op1 ORDER BY ttf) AS ry FROM lt)
  SELECT unit, op1, sensor, round(covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0), 6) + 0 AS rho FROM rk GROUP BY ALL""")
def regime_unit_spearman(spark, d):
    rows = long(spark, d, keys=("unit", "cycle", "op1"))
    return s.spearman(rows, keys=["unit", "op1", "sensor"]).withColumn("rho", r6("rho") + 0.0)  # no negative zero


NULLS = f"""{LT}, a AS (SELECT unit, sensor, x, row_number() OVER (PARTITION BY unit, sensor ORDER BY cycle) AS i FROM lt), bb AS (SELECT unit, sensor, ttf, row_number() OVER (PARTITION BY unit, sensor ORDER BY {u('null', 'unit', 'cycle')}, cycle) AS i FROM lt),
  nk AS (SELECT unit, sensor, rank() OVER (PARTITION BY unit, sensor ORDER BY x) + (count(*) OVER (PARTITION BY unit, sensor, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY unit, sensor ORDER BY ttf) AS ry FROM a JOIN bb USING (unit, sensor, i)),
  nul AS (SELECT unit, sensor, covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) AS rho FROM nk GROUP BY ALL)"""


@query(f"WITH {NULLS} SELECT sensor, round(quantile_cont(abs(rho), 0.5), 6) AS null_rho FROM nul GROUP BY sensor")
def shuffle_null(spark, d):
    return median(s.spearman(s.shuffled_ttf(long(spark, d))), F.abs("rho"), "m", ["sensor"]).select("sensor", r6("m").alias("null_rho"))


@query(f"""WITH {RHO}, {NULLS.replace(LT + ', ', '')}, m AS (SELECT sensor, quantile_cont(abs(rho), 0.5) AS m, greatest(avg((rho > 0)::INT), avg((rho < 0)::INT)) AS share FROM rho GROUP BY sensor), n AS (SELECT sensor, quantile_cont(abs(rho), 0.75) AS n FROM nul GROUP BY sensor)
  SELECT sensor, CASE WHEN m IS NULL THEN 'constant' WHEN m <= n THEN 'flat' WHEN share >= 0.9 THEN 'informative, consistent' ELSE 'informative, mixed' END AS class FROM m JOIN n USING (sensor)""")
def sensor_class(spark, d):
    r = rho_once(spark, d)
    m = median(r, F.abs("rho"), "m", ["sensor"]).join(s.consistency(r).drop("median"), "sensor", "left")
    n = quantiles(s.spearman(s.shuffled_ttf(long(spark, d))), F.abs("rho"), {"n": 0.75}, ["sensor"])
    c = F.when(F.col("m").isNull(), "constant").when(F.col("m") <= F.col("n"), "flat").when(F.col("share") >= 0.9, "informative, consistent").otherwise("informative, mixed")
    return m.join(n, "sensor").select("sensor", c.alias("class"))


@query(f"WITH {RHO} SELECT sensor, round(greatest(avg((rho > 0)::INT), avg((rho < 0)::INT)), 6) AS share, round(quantile_cont(rho, 0.5), 6) AS median FROM rho WHERE rho IS NOT NULL GROUP BY sensor")
def direction_consistency(spark, d):
    return s.consistency(rho_once(spark, d)).select("sensor", r6("share").alias("share"), r6("median").alias("median"))


def _rho_of(x: str, name: str) -> str:
    return f"""{name}k AS (SELECT unit, sensor, rank() OVER (PARTITION BY unit, sensor ORDER BY {x}) + (count(*) OVER (PARTITION BY unit, sensor, {x}) - 1) / 2 AS rx, rank() OVER (PARTITION BY unit, sensor ORDER BY ttf) AS ry FROM {name}0),
      {name} AS (SELECT unit, sensor, covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) AS rho FROM {name}k GROUP BY ALL)"""


def _gain(spark, d, rows):
    """(unit, gain): mean over sensors of |rho| of column y less that of x."""
    a, q = s.spearman(rows, "y").withColumnRenamed("rho", "ry"), s.spearman(rows, "x")
    return a.join(q, s.KEYS).groupBy("unit").agg(r6(F.avg(F.abs("ry") - F.abs("rho"))).alias("gain"))


@query(f"""WITH {LT}, y0 AS (SELECT *, round((x - avg(x) OVER (PARTITION BY sensor, op1)) / stddev_samp(x) OVER (PARTITION BY sensor, op1), 6) AS y FROM lt), x0 AS (SELECT * FROM lt), {_rho_of('y', 'y')}, {_rho_of('x', 'x')}
  SELECT unit, round(avg(abs(y.rho) - abs(x.rho)), 6) AS gain FROM y JOIN x USING (unit, sensor) GROUP BY unit""")
def norm_gain(spark, d):
    rows = long(spark, d, keys=("unit", "cycle", "op1"))
    g = F.broadcast(rows.groupBy("sensor", "op1").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("sd")))  # sensors times regimes
    return _gain(spark, d, rows.join(g, ["sensor", "op1"]).withColumn("y", r6((F.col("x") - F.col("m")) / F.col("sd"))))


@query(f"""WITH {LT}, y0 AS (SELECT *, round(avg(x) OVER (PARTITION BY unit, sensor ORDER BY cycle ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS y FROM lt), x0 AS (SELECT * FROM lt), {_rho_of('y', 'y')}, {_rho_of('x', 'x')}
  SELECT unit, round(avg(abs(y.rho) - abs(x.rho)), 6) AS gain FROM y JOIN x USING (unit, sensor) GROUP BY unit""")
def smoothing_gain(spark, d):
    w = Window.partitionBy("unit", "sensor").orderBy("cycle").rowsBetween(-4, 0)
    return _gain(spark, d, long(spark, d).withColumn("y", r6(F.avg("x").over(w))))


DIFF = "df AS (SELECT unit, sensor, cycle, x - lag(x) OVER (PARTITION BY unit, sensor ORDER BY cycle) AS d FROM long), dp AS (SELECT *, lag(d) OVER (PARTITION BY unit, sensor ORDER BY cycle) AS p FROM df WHERE d IS NOT NULL)"


@query(f"""WITH {DIFF} SELECT unit, sensor, round(stddev_samp(d) / sqrt(2), 6) AS sigma, round(covar_pop(d, p) / nullif((stddev_pop(d) FILTER (p IS NOT NULL)) * stddev_pop(p), 0), 6) AS ac1 FROM dp GROUP BY ALL""")
def diff_noise(spark, d):
    return s.diff_noise(long(spark, d)).select("unit", "sensor", r6("sigma").alias("sigma"), r6("ac1").alias("ac1"))


@query(f"""WITH {DIFF}, m AS (SELECT unit, sensor, d - avg(d) OVER (PARTITION BY unit, sensor) AS c FROM dp), k AS (SELECT unit, sensor, avg(c ** 3) / avg(c ** 2) ** 1.5 AS sk, avg(c ** 4) / avg(c ** 2) ** 2 - 3 AS ku FROM m GROUP BY ALL)
  SELECT unit, round(avg(sk), 6) AS skew, round(avg(ku), 6) AS kurt FROM k GROUP BY unit""")
def diff_shape(spark, d):
    return s.diff_shape(long(spark, d)).select("unit", r6("skew").alias("skew"), r6("kurt").alias("kurt"))


@query(f"""WITH {DIFF}, n AS (SELECT *, row_number() OVER (PARTITION BY unit, sensor ORDER BY cycle) AS i, count(*) OVER (PARTITION BY unit, sensor) AS m FROM dp), k AS (SELECT unit, sensor, stddev_samp(d) FILTER (i <= 30) AS early, stddev_samp(d) FILTER (i > m - 30) AS late FROM n GROUP BY ALL)
  SELECT unit, round(exp(avg(ln(late / early))), 6) AS growth FROM k GROUP BY unit""")
def noise_growth(spark, d):
    return s.noise_growth(long(spark, d), 30).select("unit", r6("growth").alias("growth"))


def _hinge(source: str, keys: str, y: str, least: int, name: str = "fit") -> str:
    """Brute force: every change point's fit by regression on its hinge."""
    j = " AND ".join(f"a.{k} = p.{k}" for k in keys.split(", "))
    a = ", ".join(f"a.{k}" for k in keys.split(", "))
    return f"""{name}s AS (SELECT {keys}, cycle, {y} AS v, row_number() OVER (PARTITION BY {keys} ORDER BY cycle) AS i, count(*) OVER (PARTITION BY {keys}) AS n, max(cycle) OVER (PARTITION BY {keys}) AS last FROM {source}),
      {name}t AS (SELECT {a}, p.cycle AS tau, p.i, p.n, p.last, regr_slope(a.v, greatest(a.cycle - p.cycle, 0)) AS b, regr_syy(a.v, greatest(a.cycle - p.cycle, 0)) - regr_sxy(a.v, greatest(a.cycle - p.cycle, 0)) ** 2 / regr_sxx(a.v, greatest(a.cycle - p.cycle, 0)) AS rss,
        regr_syy(a.v, a.cycle) - regr_sxy(a.v, a.cycle) ** 2 / regr_sxx(a.v, a.cycle) AS lin_rss FROM {name}s a JOIN {name}s p ON {j} WHERE p.i >= {least} AND p.i <= p.n - {least} GROUP BY {a}, p.cycle, p.i, p.n, p.last),
      {name} AS (SELECT {keys}, arg_min(struct_pack(tau := tau, b := b, at_start := i = {least}, rss := rss, lin_rss := lin_rss, n := n, last := last), struct_pack(r := round(rss, 9), t := tau)) AS f FROM {name}t GROUP BY {keys})"""


@query(f"WITH {_hinge('cycles', 'unit', 's7', 5)} SELECT unit, f.tau, round(f.b, 6) AS b, f.at_start, round(f.rss, 4) AS rss, round(f.lin_rss, 4) AS lin_rss, f.last - f.tau AS onset FROM fit")
def hinge_changepoint(spark, d):
    h = s.hinge(b.cycles(spark, d), ["unit"], "s7", 5)
    return h.select("unit", "tau", r6("b").alias("b"), "at_start", F.round("rss", 4).alias("rss"), F.round("lin_rss", 4).alias("lin_rss"), (F.col("last") - F.col("tau")).alias("onset"))


@query(f"""WITH {_hinge('cycles', 'unit', 's7', 5)}, o AS (SELECT f.last - f.tau AS onset, f.* FROM fit) SELECT quantile_cont(onset, 0.1) FILTER (b > 0) AS p10, quantile_cont(onset, 0.5) FILTER (b > 0) AS p50, quantile_cont(onset, 0.9) FILTER (b > 0) AS p90,
  round(avg((onset <= 40)::INT) FILTER (b > 0), 6) AS within_cap, count(*) FILTER (b <= 0) AS falling, count(*) FILTER (b > 0 AND at_start) AS at_start, round(quantile_cont(rss / lin_rss, 0.5) FILTER (b > 0), 6) AS rss_ratio FROM o""")
def onset_quantiles(spark, d):
    h = written(s.hinge(b.cycles(spark, d), ["unit"], "s7", 5).withColumn("onset", F.col("last") - F.col("tau")), "onsets")
    up = lambda c: F.when(F.col("b") > 0, c)
    one = h.agg(r6(F.avg(up((F.col("onset") <= 40).cast("double")))).alias("within_cap"), F.count_if(F.col("b") <= 0).alias("falling"), F.count_if((F.col("b") > 0) & F.col("at_start")).alias("at_start"))
    q = quantiles(h, up(F.col("onset")), {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    ratio = median(h, up(F.col("rss") / F.col("lin_rss")), "ratio").select(r6("ratio").alias("rss_ratio"))
    return q.join(F.broadcast(one), F.lit(True)).join(F.broadcast(ratio), F.lit(True))  # single rows


SENS = "ss AS (SELECT unit, sensor, cycle, x FROM long WHERE sensor IN ('s2', 's7', 's8'))"


def three(spark, d):
    return long(spark, d, ("s2", "s7", "s8"))


@query(f"""WITH {SENS}, {_hinge('ss', 'unit, sensor', 'x', 5)}, v AS (SELECT unit, sensor, count(DISTINCT x) > 1 AS varies FROM ss GROUP BY ALL)
  SELECT sensor, count(*) FILTER (varies) AS varying, count(*) FILTER (varies AND f.b > 0) AS rising, quantile_cont(f.last - f.tau, 0.5) FILTER (varies AND f.b > 0) AS onset FROM fit JOIN v USING (unit, sensor) GROUP BY sensor""")
def sensor_onset(spark, d):
    rows = three(spark, d)
    v = rows.groupBy(*s.KEYS).agg((F.min("x") != F.max("x")).alias("varies"))
    h = s.hinge(rows, s.KEYS, "x", 5).join(v, s.KEYS)
    ok = F.col("varies") & (F.col("b") > 0)
    h = written(h, "onsets")
    n = h.groupBy("sensor").agg(F.count_if("varies").alias("varying"), F.count_if(ok).alias("rising"))
    return n.join(median(h, F.when(ok, F.col("last") - F.col("tau")), "onset", ["sensor"]), "sensor")


@query(f"""WITH {SENS}, {_hinge('ss', 'unit, sensor', 'x', 5)}, {DIFF}, g AS (SELECT unit, sensor, stddev_samp(d) / sqrt(2) AS sigma FROM dp GROUP BY ALL), k AS (SELECT *, abs(f.b) AS ab, abs(f.b) * (f.last - f.tau) AS delta FROM fit JOIN g USING (unit, sensor) WHERE sigma > 0)
  SELECT unit, sensor, round(delta, 5) AS delta, round(delta / sigma, 5) AS snr, round(ab / (sigma * sqrt(12 / (20 * (20 ** 2 - 1)))), 5) AS t20 FROM k""")
def signal_to_noise(spark, d):
    rows = three(spark, d)
    h = s.hinge(rows, s.KEYS, "x", 5).join(s.diff_noise(rows), s.KEYS).where("sigma > 0")
    delta = F.abs("b") * (F.col("last") - F.col("tau"))
    r5 = lambda c: F.round(c, 5)
    return h.select("unit", "sensor", r5(delta).alias("delta"), r5(delta / F.col("sigma")).alias("snr"), r5(F.abs("b") / (F.col("sigma") * F.sqrt(F.lit(12 / (20 * (20**2 - 1)))))).alias("t20"))


@query(f"""WITH c3 AS (SELECT unit, cycle % 2 AS part, cycle, s7 FROM cycles), {_hinge('c3', 'unit, part', 's7', 5)}, r AS (SELECT c3.unit, c3.part, s7 - f.b * greatest(cycle - f.tau, 0) AS r, row_number() OVER (PARTITION BY c3.unit, c3.part ORDER BY cycle) AS i, f.n AS n FROM c3 JOIN fit ON c3.unit = fit.unit AND c3.part = fit.part),
  q AS (SELECT unit, part, stddev_samp(r) FILTER (i <= n // 3) AS a, stddev_samp(r) FILTER (i > n - n // 3) AS z FROM r GROUP BY ALL) SELECT unit, round(exp(avg(ln(z / a))), 5) AS ratio FROM q WHERE a > 0 AND z > 0 GROUP BY unit""")
def hinge_residual_ratio(spark, d):
    rows = b.cycles(spark, d).withColumn("part", F.col("cycle") % 2)
    g = s.residual_ratio(rows, ["unit", "part"], "s7", 5)
    return g.groupBy("unit").agg(F.round(F.exp(F.avg(F.ln("ratio"))), 5).alias("ratio")).where("ratio is not null")


@query("SELECT unit, cycle, round((s2 - s8 + s7) / 3, 6) AS oriented FROM cycles")
def oriented_mean_signal(spark, d):
    return b.cycles(spark, d).select("unit", "cycle", r6((F.col("s2") - F.col("s8") + F.col("s7")) / 3).alias("oriented"))


@query("""WITH k AS (SELECT unit, rank() OVER (PARTITION BY unit ORDER BY s2) + (count(*) OVER (PARTITION BY unit, s2) - 1) / 2 AS a, rank() OVER (PARTITION BY unit ORDER BY s9) + (count(*) OVER (PARTITION BY unit, s9) - 1) / 2 AS b FROM cycles)
  SELECT unit, round(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), 6) AS rho FROM k GROUP BY unit""")
def pair_redundancy(spark, d):
    return s.spearman(b.cycles(spark, d, deal=True), "s2", "s9", ["unit"]).withColumn("rho", r6("rho"))


@query(f"""WITH {RHO}, ok AS (SELECT sensor, bool_and(rho IS NOT NULL) AS ok FROM rho GROUP BY sensor),
  pr AS (SELECT unit, sensor, rho, CASE WHEN rho IS NULL THEN '{s.NO_RHO}' WHEN NOT ok THEN '{s.NO_RHO_ELSEWHERE}' WHEN abs(rho) < {s.ZERO!r} THEN '{s.RHO_0}' END AS problem FROM rho JOIN ok USING (sensor))
  SELECT unit, sensor, CASE WHEN problem IS NULL THEN sign(rho)::DOUBLE END AS sign, problem FROM pr""")
def sign_vectors(spark, d):
    return s.signs(rho_once(spark, d))


FLIP = f"{RHO}, mj AS (SELECT sensor, sign(quantile_cont(rho, 0.5)) AS m FROM rho GROUP BY sensor), fl AS (SELECT unit, sensor, sign(rho) <> m AS flip FROM rho JOIN mj USING (sensor) WHERE rho IS NOT NULL)"


@query(f"WITH {FLIP} SELECT unit, sensor, flip FROM fl")
def flip_table(spark, d):
    return s.flips(rho_once(spark, d))


@query(f"""WITH {FLIP}, g AS (SELECT x.sensor AS a, y.sensor AS b, avg((x.flip = y.flip)::INT) AS agree, avg(x.flip::INT) AS pa, avg(y.flip::INT) AS pb FROM fl x JOIN fl y ON x.unit = y.unit AND x.sensor < y.sensor GROUP BY ALL)
  SELECT a, b, round(agree, 6) AS agree, round(pa * pb + (1 - pa) * (1 - pb), 6) AS expected, round(agree - (pa * pb + (1 - pa) * (1 - pb)), 6) AS excess FROM g""")
def flip_agreement(spark, d):
    return s.flip_agreement(s.flips(rho_once(spark, d))).select("a", "b", r6("agree").alias("agree"), r6("expected").alias("expected"), r6("excess").alias("excess"))


@query(f"""WITH {FLIP}, {poisson_draws(MANY)}, fc AS (SELECT unit, subpop AS cluster, sensor, flip::INT AS f FROM fl JOIN labels_ USING (unit) WHERE flip IS NOT NULL), rp AS (SELECT replicate, cluster, sensor, sum(w * f) / sum(w) AS v FROM fc JOIN pd USING (unit) GROUP BY ALL),
  ci AS (SELECT cluster, sensor, {CI.format('v')} FROM rp GROUP BY ALL) SELECT cluster, sensor, round(avg(f), 6) AS share, any_value(ci_lo) AS ci_lo, any_value(ci_hi) AS ci_hi, any_value(ci_lo) > 0.5 AS flipped FROM fc LEFT JOIN ci USING (cluster, sensor) GROUP BY cluster, sensor""")
def flip_share_by_cluster(spark, d):
    """(cluster, sensor, share, ci_lo, ci_hi, flipped): the share of a cluster's units that are flipped, its interval over draws of these units, and whether that lies above a half."""
    f, label = s.flips(rho_once(spark, d)), b.labels(b.cycles(spark, d))
    one = lambda n: F.max(F.when(F.col("sensor") == n, F.col("flip").cast("double")))
    wide = f.groupBy("unit").agg(*[one(n).alias(n) for n in b.SENSORS]).join(label, "unit").withColumns({f"n_{n}": F.col(n).isNotNull().cast("double") for n in b.SENSORS})
    wide = written(wide, "flips")
    shares = lambda df, keys: e.long_metrics(df.groupBy(*keys).agg(*[ratio(F.sum(n), F.sum(f"n_{n}")).alias(n) for n in b.SENSORS]), keys, b.SENSORS)
    drawn = rs.poisson_sums(b.dealt(wide, "unit", rs.DRAWS // MANY), [c for c in wide.columns if c not in ("unit", "subpop")], MANY, ["subpop"])
    ci = rs.interval(shares(drawn, ["subpop", "replicate"]), ["subpop", "metric"], "estimate")
    rows = shares(wide, ["subpop"]).where("estimate is not null").join(ci, ["subpop", "metric"], "left")
    return rows.select(F.col("subpop").alias("cluster"), F.col("metric").alias("sensor"), r6("estimate").alias("share"), r6("ci_lo").alias("ci_lo"), r6("ci_hi").alias("ci_hi"), (r6("ci_lo") > 0.5).alias("flipped"))


@query("""WITH m AS (SELECT subpop, count(*) AS n, quantile_cont(life, 0.5) AS life FROM (SELECT unit, max(cycle) AS life FROM cycles GROUP BY unit) JOIN labels_ USING (unit) GROUP BY subpop)
  SELECT subpop AS cluster, n, life, life - (SELECT arg_max(life, n) FROM m) AS diff FROM m""")
def cluster_life_compare(spark, d):
    c = b.cycles(spark, d)
    lives = written(c.groupBy("unit").agg(F.max("cycle").alias("life")).join(b.labels(c), "unit"), "lives")
    m = written(lives.groupBy("subpop").agg(F.count("*").alias("n")).join(median(lives, "life", "life", ["subpop"]), "subpop"))
    big = m.agg(F.max_by("life", "n").alias("ref"))
    return m.join(F.broadcast(big), F.lit(True)).select(F.col("subpop").alias("cluster"), "n", "life", (F.col("life") - F.col("ref")).alias("diff"))  # a single row


@query("""WITH e AS (SELECT op1, list_distinct(list(unit)) AS s FROM cycles WHERE cycle <= 2 GROUP BY op1) SELECT a.op1 AS a, b.op1 AS b, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) AS jaccard FROM e a JOIN e b ON a.op1 < b.op1""")
def jaccard_sets(spark, d):
    # Sizes by counting, so a set is never gathered in one place.
    m = b.cycles(spark, d).where("cycle <= 2").select("op1", "unit").distinct()
    both = m.withColumnRenamed("op1", "a").join(m.withColumnRenamed("op1", "b"), "unit").where("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    n = m.groupBy("op1").agg(F.count("*").alias("n"))
    pairs = n.select(F.col("op1").alias("a"), F.col("n").alias("na")).join(n.select(F.col("op1").alias("b"), F.col("n").alias("nb")), F.col("a") < F.col("b"))  # regimes, a handful
    j = pairs.join(both, ["a", "b"], "left").withColumn("both", F.coalesce("both", F.lit(0)))
    return j.select("a", "b", r6(F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("jaccard"))


@query("SELECT DISTINCT op1 AS regime, s4 AS value, round(count(*) OVER (PARTITION BY op1 ORDER BY s4) / count(*) OVER (PARTITION BY op1), 6) AS share FROM cycles")
def ecdf(spark, d):
    e = s.ecdf(b.cycles(spark, d).withColumnRenamed("op1", "regime"), "s4", ["regime"])
    return e.select("regime", "value", r6("share").alias("share"))
