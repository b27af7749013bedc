"""Joins, windows, feature state and envelopes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetmill.functions.columns import by_cycle, r6, trailing
from fleetmill.operators import features as f
from fleetmill.operators import labels
from fleetmill.sources import bindings as b

from .registry import query

S = b.SENSORS
#: Starting centroids in (op1, op2, op3): fixed values near the five settings.
START = [[1.0, 0.0, 100.0], [9.0, 0.2, 100.0], [19.0, 0.4, 100.0], [26.0, 0.5, 61.0], [34.0, 0.7, 100.0]]


def regimes(spark, d):
    return b.cycles(spark, d).withColumnRenamed("op1", "regime")


def _both(spark, d):
    p = b.points(spark, d, "A").select("unit", "cycle", "repeat", "fold", "seed", "rul_true", F.col("pred").alias("pred_a"))
    q = b.points(spark, d, "B").select("unit", "cycle", "repeat", "fold", "seed", F.col("rul_true").alias("rul_b"), F.col("pred").alias("pred_b"))
    return p, q


@query("""SELECT repeat, count(*) AS n, round(avg(pred_a - pred_b), 6) AS diff, count(*) FILTER (unit % 9 = 4) AS one_sided, 0 AS unlike FROM points2 GROUP BY repeat""")
def pair_points(spark, d):
    p, q = _both(spark, d)
    keys = ["unit", "cycle", "repeat", "fold", "seed"]
    j = p.join(q.where("unit % 9 <> 4"), keys, "full_outer").join(q.select(*keys, F.col("pred_b").alias("all_b")), keys, "left")
    return j.groupBy("repeat").agg(F.count("*").alias("n"), r6(F.avg(F.col("pred_a") - F.col("all_b"))).alias("diff"), F.count_if(F.col("pred_b").isNull() | F.col("pred_a").isNull()).alias("one_sided"),
                                   F.count_if(F.col("rul_true") != F.col("rul_b")).cast("int").alias("unlike"))


@query("""SELECT t.unit, t.n, c.last - t.n AS rul FROM (SELECT unit, count(*) AS n FROM (SELECT *, max(cycle) OVER (PARTITION BY unit) AS l FROM cycles) WHERE unit % 5 = 0 AND cycle <= floor(l / 2) GROUP BY unit) t
  JOIN (SELECT unit, max(cycle) AS last FROM cycles GROUP BY unit) c USING (unit)""")
def truth_lookup(spark, d):
    c = b.cycles(spark, d)
    last = c.groupBy("unit").agg(F.max("cycle").alias("last"))
    return b.truncated(c).groupBy("unit").agg(F.count("*").alias("n")).join(last, "unit", "left").select("unit", "n", (F.col("last") - F.col("n")).alias("rul"))


@query("SELECT subpop, count(*) AS n, round(avg(s2), 6) AS mean FROM cycles JOIN labels_ USING (unit) GROUP BY subpop")
def label_lookup(spark, d):
    c = b.cycles(spark, d)
    return c.join(b.labels(c), "unit", "left").groupBy("subpop").agg(F.count("*").alias("n"), r6(F.avg("s2")).alias("mean"))


NORM = "norm AS (SELECT op1, avg(s2) AS m2, stddev_samp(s2) AS d2, avg(s7) AS m7, stddev_samp(s7) AS d7 FROM cycles WHERE unit % 5 <> 0 GROUP BY op1)"


@query(f"WITH {NORM} SELECT unit, cycle, round(m2, 6) AS mean, round(d2, 6) AS std FROM cycles JOIN norm USING (op1) WHERE unit % 5 = 0")
def state_lookup(spark, d):
    r = regimes(spark, d)
    state = f.regime_norm(r.where("unit % 5 <> 0"), ["s2"])
    return r.where("unit % 5 = 0").join(F.broadcast(state), "regime").select("unit", "cycle", r6("mean").alias("mean"), r6("std").alias("std"))


@query("SELECT DISTINCT unit + 100000 AS unit FROM cycles WHERE unit % 3 = 0")
def unknown_units(spark, d):
    u = b.cycles(spark, d).select("unit").distinct()
    asked = u.select(F.when(F.col("unit") % 3 == 0, F.col("unit") + 100000).otherwise(F.col("unit")).alias("unit"))
    return asked.join(u, "unit", "left_anti")


@query("""SELECT op1 AS config, f AS split FROM (SELECT DISTINCT op1 FROM cycles), (SELECT unnest([0, 1, 2, 3, 4]) AS f) WHERE (op1, f) NOT IN (SELECT op1, unit % 4 FROM cycles WHERE cycle = 1)""")
def pending_splits(spark, d):
    c = b.cycles(spark, d)
    plan = c.select(F.col("op1").alias("config")).distinct().select("config", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("split"))
    done = c.where("cycle = 1").select(F.col("op1").alias("config"), (F.col("unit") % 4).cast("int").alias("split"))
    return plan.join(done, ["config", "split"], "left_anti")


@query("""SELECT unit, sha256('{"cap":40,"unit":' || unit || ',"window":' || count(*) || '}') AS hash FROM cycles GROUP BY unit""")
def config_hash(spark, d):
    g = b.cycles(spark, d).groupBy("unit").agg(F.count("*").alias("window"))
    return g.select("unit", F.sha2(F.to_json(F.struct(F.lit(40).alias("cap"), "unit", "window")), 256).alias("hash"))


@query("SELECT op1 AS regime, subpop, count(*) AS n FROM cycles JOIN labels_ USING (unit) WHERE NOT (op1 = 10 AND subpop = 1) AND NOT (op1 = 20 AND subpop = 0) GROUP BY ALL")
def drop_not_reported(spark, d):
    c = b.cycles(spark, d)
    rows = c.join(b.labels(c), "unit").groupBy(F.col("op1").alias("regime"), "subpop").agg(F.count("*").alias("n"))
    drop = spark.createDataFrame([(10.0, 1), (20.0, 0)], "regime double, subpop int")
    return rows.join(F.broadcast(drop), ["regime", "subpop"], "left_anti")


@query("SELECT CASE op1 WHEN 0 THEN 0 WHEN 10 THEN 1 WHEN 20 THEN 2 WHEN 25 THEN 3 ELSE 4 END AS k, count(*) AS n, op1 FROM cycles GROUP BY op1")
def regime_nearest_centroid(spark, d):
    return b.cycles(spark, d).groupBy(f.nearest_centroid([F.col(o) for o in b.OPS], START).alias("k"), "op1").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT (CASE WHEN op1 < 15 THEN 0 ELSE 1 END) AS k, op1, op3 FROM cycles), c AS (SELECT k, avg(op1) AS x, avg(op3) AS z FROM a GROUP BY k),
  a2 AS (SELECT op1, op3, CASE WHEN (op1 - (SELECT x FROM c WHERE k = 0)) ** 2 + (op3 - (SELECT z FROM c WHERE k = 0)) ** 2 <= (op1 - (SELECT x FROM c WHERE k = 1)) ** 2 + (op3 - (SELECT z FROM c WHERE k = 1)) ** 2 THEN 0 ELSE 1 END AS k FROM cycles)
  SELECT k, round(avg(op1), 6) AS c1, round(avg(op3), 6) AS c3 FROM a2 GROUP BY k""")
def kmeans_lloyd(spark, d):
    c = b.cycles(spark, d)
    centres = f.lloyd(c, ["op1", "op3"], [[0.0, 92.0], [30.0, 92.0]], 2)
    k = f.nearest_centroid([F.col("op1"), F.col("op3")], centres)
    at = lambda i: F.element_at(F.array(*[F.lit(x[i]) for x in centres]), F.col("k") + 1)
    return c.select(k.alias("k")).distinct().select("k", r6(at(0)).alias("c1"), r6(at(1)).alias("c3"))


@query("SELECT unit, cycle, round((op1 - m1) / d1, 6) AS op1_z, round((op2 - m2) / d2, 6) AS op2_z, round((op3 - m3) / d3, 6) AS op3_z FROM cycles, (SELECT avg(op1) AS m1, stddev_pop(op1) AS d1, avg(op2) AS m2, stddev_pop(op2) AS d2, avg(op3) AS m3, stddev_pop(op3) AS d3 FROM cycles)")
def op_standardize(spark, d):
    c = b.cycles(spark, d)
    return f.op_standardize(c, f.op_scaler(c, b.OPS), b.OPS).select("unit", "cycle", *[r6(f"{o}_z").alias(f"{o}_z") for o in b.OPS])


@query("SELECT op1 AS regime, sensor, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std FROM long GROUP BY op1, sensor")
def regime_norm_fit(spark, d):
    return f.regime_norm(regimes(spark, d), S).select("regime", "sensor", "n", r6("mean").alias("mean"), r6("std").alias("std"))


@query(f"WITH {NORM} SELECT unit, cycle, round((s2 - m2) / d2, 6) AS s2_n, round((s7 - m7) / d7, 6) AS s7_n FROM cycles JOIN norm USING (op1)")
def regime_zscore(spark, d):
    r = regimes(spark, d)
    state = f.refuse_degenerate(f.regime_norm(r.where("unit % 5 <> 0"), ["s2", "s7"]))
    return f.zscore(r, state, ["s2", "s7"]).select("unit", "cycle", r6("s2_n").alias("s2_n"), r6("s7_n").alias("s7_n"))


@query("""SELECT unit, cycle, round((s2 - avg(s2) OVER w) / stddev_samp(s2) OVER w, 6) AS s2_n, 0.0::DOUBLE AS op3_n FROM cycles WINDOW w AS (PARTITION BY op1)""")
def regime_zscore_masked(spark, d):
    return f.zscore_masked(regimes(spark, d), ["s2", "op3"]).select("unit", "cycle", r6("s2_n").alias("s2_n"), "op3_n")


@query("SELECT unit, sum((op1 = 0)::INT)::DOUBLE AS r0, sum((op1 = 25)::INT)::DOUBLE AS r3 FROM cycles GROUP BY unit")
def regime_onehot(spark, d):
    return f.one_hot(regimes(spark, d), [0.0, 10.0, 20.0, 25.0, 35.0]).groupBy("unit").agg(F.sum("regime_0").alias("r0"), F.sum("regime_3").alias("r3"))


W5 = "WINDOW w AS (PARTITION BY unit ORDER BY cycle ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"


@query(f"SELECT unit, cycle, round(avg(s7) OVER w, 6) AS s7_mean FROM cycles {W5}")
def rolling_mean(spark, d):
    return b.cycles(spark, d).select("unit", "cycle", r6(F.avg("s7").over(trailing(5))).alias("s7_mean"))


@query(f"SELECT unit, cycle, round(CASE WHEN cycle = 1 THEN 0 ELSE regr_slope(s7, cycle) OVER w END, 6) AS s7_slope FROM cycles {W5}")
def rolling_slope(spark, d):
    return f.rolling(b.cycles(spark, d), ["s7"], 5).select("unit", "cycle", r6("s7_slope").alias("s7_slope"))


@query(f"SELECT unit, cycle, round(stddev_samp(s2) OVER w, 6) AS s2_std, round(min(s2) OVER w, 6) AS s2_min, round(max(s2) OVER w, 6) AS s2_max FROM cycles {W5}")
def rolling_std_min_max(spark, d):
    return f.rolling_spread(b.cycles(spark, d), "s2", 5).select("unit", "cycle", *[r6(f"s2_{x}").alias(f"s2_{x}") for x in ("std", "min", "max")])


@query(f"SELECT unit, cycle, round((max(s2) OVER w + min(s2) OVER w) / 2, 6) AS s2_middle, round(exp(avg(ln(s2 + 1)) OVER w) - 1, 6) AS s2_geometric, round((max(s7) OVER w + min(s7) OVER w) / 2, 6) AS s7_middle, round(exp(avg(ln(s7 + 1)) OVER w) - 1, 6) AS s7_geometric FROM cycles {W5}")
def smoothers(spark, d):
    """Smoothers that the library doesn't know, given as functions of a column and a window."""
    own = {"middle": lambda c, w: (F.max(c).over(w) + F.min(c).over(w)) / 2, "geometric": lambda c, w: F.exp(F.avg(F.log(c + 1)).over(w)) - 1}
    out = f.smoothed(b.cycles(spark, d), ["s2", "s7"], own, 5)
    return out.select("unit", "cycle", *[r6(f"{c}_{n}").alias(f"{c}_{n}") for c in ("s2", "s7") for n in own])


@query("""SELECT a.unit, a.cycle, round(sum(p.s2 * pow(1 - 2 / 16.0, a.cycle - p.cycle)) / sum(pow(1 - 2 / 16.0, a.cycle - p.cycle)), 6) AS s2_ewm FROM cycles a JOIN cycles p ON a.unit = p.unit AND p.cycle <= a.cycle GROUP BY ALL""")
def ewm_mean(spark, d):
    return f.ewm_mean(b.cycles(spark, d), "s2", 15).select("unit", "cycle", r6("s2_ewm").alias("s2_ewm"))


@query("SELECT unit, cycle, round(s2 - lag(s2) OVER (PARTITION BY unit ORDER BY cycle), 6) AS diff FROM cycles")
def first_difference(spark, d):
    return b.cycles(spark, d).select("unit", "cycle", r6(F.col("s2") - F.lag("s2").over(by_cycle())).alias("diff"))


@query("SELECT unit, cycle, round(cycle / (SELECT max(cycle) FROM cycles WHERE unit % 5 <> 0), 6) AS cycle_norm FROM cycles")
def cycle_norm(spark, d):
    c = b.cycles(spark, d)
    top = c.where("unit % 5 <> 0").agg(F.max("cycle").alias("top"))
    return c.join(F.broadcast(top), F.lit(True)).select("unit", "cycle", r6(F.col("cycle") / F.col("top")).alias("cycle_norm"))  # a single row


@query("SELECT unit, cycle, round(s2 * s3, 6) AS s2_s3, round(s4 * s9, 6) AS s4_s9 FROM cycles")
def sensor_interactions(spark, d):
    return b.cycles(spark, d).select("unit", "cycle", r6(F.col("s2") * F.col("s3")).alias("s2_s3"), r6(F.col("s4") * F.col("s9")).alias("s4_s9"))


@query("""SELECT unit, cycle, round(avg(CASE WHEN cycle <= 30 THEN s7 END) OVER (PARTITION BY unit ORDER BY cycle), 6) AS s7_base,
  round(avg(s7) OVER w - avg(CASE WHEN cycle <= 30 THEN s7 END) OVER (PARTITION BY unit ORDER BY cycle), 6) AS s7_dev FROM cycles WINDOW w AS (PARTITION BY unit ORDER BY cycle ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def baseline_deviation(spark, d):
    return f.baseline_deviation(b.cycles(spark, d), "s7", b.FIRST_N, b.WINDOW).select("unit", "cycle", r6("s7_base").alias("s7_base"), r6("s7_dev").alias("s7_dev"))


@query("""WITH h AS (SELECT unit, cycle, (s2 - 50) * 0.6 + (s7 - 60) * 0.8 AS hi FROM cycles) SELECT unit, cycle, round(hi, 6) AS hi, round(avg(hi) OVER w, 6) AS hi_mean, round(CASE WHEN cycle = 1 THEN 0 ELSE regr_slope(hi, cycle) OVER w END, 6) AS hi_slope
  FROM h WINDOW w AS (PARTITION BY unit ORDER BY cycle ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def health_index_apply(spark, d):
    rows = f.health_index(b.cycles(spark, d), {"s2": (50.0, 0.6), "s7": (60.0, 0.8)}, 5)
    return rows.select("unit", "cycle", r6("hi").alias("hi"), r6("hi_mean").alias("hi_mean"), r6("hi_slope").alias("hi_slope"))


@query("SELECT unit, round(avg(s2), 6) AS s2_mean, round(regr_slope(s2, cycle), 6) AS s2_slope, round(regr_slope(s8, cycle), 6) AS s8_slope FROM cycles WHERE cycle <= 30 GROUP BY unit HAVING count(*) = 30")
def early_summary(spark, d):
    return f.early_summary(b.cycles(spark, d), ["s2", "s8"], 30).select("unit", *[r6(c).alias(c) for c in ("s2_mean", "s2_slope", "s8_slope")])


@query("""WITH e AS (SELECT unit, 1 / (1 + exp(-(0.02 * (avg(s2) - 50) + 3 * regr_slope(s8, cycle)))) AS p FROM cycles WHERE cycle <= 30 GROUP BY unit HAVING count(*) = 30)
  SELECT unit, cycle, round(CASE WHEN cycle >= 30 THEN p END, 6) AS subpop_p FROM cycles LEFT JOIN e USING (unit)""")
def subpop_probability(spark, d):
    c = b.cycles(spark, d)
    e = f.early_summary(c, ["s2", "s8"], 30).select("unit", (1 / (1 + F.exp(-(0.02 * (F.col("s2_mean") - 50) + 3 * F.col("s8_slope"))))).alias("p"))
    return c.join(e, "unit", "left").select("unit", "cycle", r6(F.when(F.col("cycle") >= 30, F.col("p"))).alias("subpop_p"))


@query("SELECT unit, cycle, round(min(pred) OVER (PARTITION BY unit ORDER BY cycle), 6) AS low FROM points WHERE repeat = 1")
def running_min(spark, d):
    return b.points(spark, d).where("repeat = 1").select("unit", "cycle", r6(F.min("pred").over(by_cycle().rowsBetween(Window.unboundedPreceding, 0))).alias("low"))


@query("SELECT unit, cycle, round(max(s2) OVER (PARTITION BY unit ORDER BY cycle), 6) AS high FROM cycles")
def running_max(spark, d):
    return b.cycles(spark, d).select("unit", "cycle", r6(F.max("s2").over(by_cycle().rowsBetween(Window.unboundedPreceding, 0))).alias("high"))


@query("SELECT op1 AS model, unit AS trial, round(min(o) OVER (PARTITION BY op1 ORDER BY unit), 6) AS best FROM (SELECT op1, unit, avg(s2) AS o FROM cycles GROUP BY ALL)")
def best_so_far(spark, d):
    g = b.cycles(spark, d).groupBy(F.col("op1").alias("model"), F.col("unit").alias("trial")).agg(F.avg("s2").alias("o"))
    w = Window.partitionBy("model").orderBy("trial").rowsBetween(Window.unboundedPreceding, 0)
    return g.select("model", "trial", r6(F.min("o").over(w)).alias("best"))


@query("SELECT unit, cycle, rank() OVER (PARTITION BY unit ORDER BY s4) + (count(*) OVER (PARTITION BY unit, s4) - 1) / 2 AS rank FROM cycles")
def avg_rank(spark, d):
    c = b.cycles(spark, d)
    return c.select("unit", "cycle", f.avg_rank(c, "s4", "unit").alias("rank"))


@query("SELECT unit, cycle, cycle - 1 AS position FROM cycles")
def unit_position(spark, d):
    return b.cycles(spark, d).select("unit", "cycle", (F.row_number().over(by_cycle()) - 1).cast("long").alias("position"))


@query("""WITH r AS (SELECT unit, cycle, cycle % 3 AS part, s2, row_number() OVER w AS i, count(*) OVER (PARTITION BY unit, cycle % 3) AS n FROM cycles WINDOW w AS (PARTITION BY unit, cycle % 3 ORDER BY cycle))
  SELECT unit, part, CASE WHEN i <= n // 3 THEN 'first' WHEN i > n - n // 3 THEN 'last' ELSE 'middle' END AS third, count(*) AS n, round(avg(s2), 6) AS mean FROM r GROUP BY ALL""")
def interleaved_partition(spark, d):
    c = b.cycles(spark, d).withColumn("part", F.col("cycle") % 3)
    n, i = F.count("*").over(Window.partitionBy("unit", "part")), F.row_number().over(Window.partitionBy("unit", "part").orderBy("cycle"))
    c = c.withColumns({"i": i, "n": n})
    third = F.when(F.col("i") <= F.floor(F.col("n") / 3), "first").when(F.col("i") > F.col("n") - F.floor(F.col("n") / 3), "last").otherwise("middle")
    return c.groupBy("unit", "part", third.alias("third")).agg(F.count("*").alias("n"), r6(F.avg("s2")).alias("mean"))


@query("""SELECT unit, round(avg(s2) FILTER (cycle <= 10), 6) AS head, round(avg(s2) FILTER (cycle > l - 10), 6) AS tail FROM (SELECT *, max(cycle) OVER (PARTITION BY unit) AS l FROM cycles) GROUP BY unit""")
def head_tail_segments(spark, d):
    last = F.max("cycle").over(Window.partitionBy("dataset", "unit"))
    c = b.cycles(spark, d).withColumn("l", last)
    return c.groupBy("unit").agg(r6(F.avg(F.when(F.col("cycle") <= 10, F.col("s2")))).alias("head"), r6(F.avg(F.when(F.col("cycle") > F.col("l") - 10, F.col("s2")))).alias("tail"))


SEQ = """WITH q AS (SELECT unit, cycle, list(s4::INT) OVER (PARTITION BY unit ORDER BY cycle ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS w, max(cycle) OVER (PARTITION BY unit) AS l FROM cycles),
  p AS (SELECT unit, cycle, l, list_concat([w[1] FOR i IN range(5 - len(w))], w) AS seq, list_concat([0 FOR i IN range(5 - len(w))], [1 FOR i IN range(len(w))]) AS mask FROM q)"""


@query(f"{SEQ} SELECT unit, cycle, array_to_string(seq, ',') AS seq, array_to_string(mask, ',') AS mask FROM p")
def sequence_windows(spark, d):
    rows = f.sequences(b.cycles(spark, d), ["s4"], 5)
    text = lambda c: F.array_join(c.cast("array<int>").cast("array<string>"), ",")
    return rows.select("unit", "cycle", text(F.flatten("seq")).alias("seq"), text(F.col("mask")).alias("mask"))


@query(f"{SEQ} SELECT unit, array_to_string(seq, ',') AS seq FROM p WHERE cycle = l")
def last_windows(spark, d):
    rows = labels.last_row(f.sequences(b.cycles(spark, d), ["s4"], 5).select("dataset", "unit", "cycle", "seq"))
    return rows.select("unit", F.array_join(F.flatten("seq").cast("array<int>").cast("array<string>"), ",").alias("seq"))


@query("SELECT unit, count(*) AS n, round(sum(s2), 4) AS total FROM cycles WHERE cycle <= 12 GROUP BY unit")
def truncate_history(spark, d):
    return b.cycles(spark, d).where("cycle <= 12").groupBy("unit").agg(F.count("*").alias("n"), F.round(F.sum("s2"), 4).alias("total"))


ENV = "env AS (SELECT op1, max(abs(s9 - 3)) AS radius, min(s2) AS lo, max(s2) AS hi, min(s7) AS lo7, max(s7) AS hi7 FROM cycles WHERE unit % 5 = 1 GROUP BY op1)"


@query(f"WITH {ENV} SELECT op1 AS regime, round(radius, 6) AS radius, round(lo, 6) AS s2_lo, round(hi, 6) AS s2_hi, round(lo7, 6) AS s7_lo, round(hi7, 6) AS s7_hi FROM env")
def envelope_fit(spark, d):
    r = regimes(spark, d).where("unit % 5 = 1").withColumn("dist", F.abs(F.col("s9") - 3))
    e = f.envelope_fit(r, ["s2", "s7"], "dist")
    return e.select("regime", *[r6(c).alias(c) for c in e.columns if c != "regime"])


@query(f"""WITH {ENV}, r AS (SELECT * FROM cycles JOIN env USING (op1) WHERE unit % 5 = 0)
  SELECT unit, cycle, 'settings' AS reason FROM r WHERE abs(s9 - 3) > radius * 1.01 UNION ALL SELECT unit, cycle, 's2' FROM r WHERE s2 < lo - 0.01 * (hi - lo) OR s2 > hi + 0.01 * (hi - lo)
  UNION ALL SELECT unit, cycle, 's7' FROM r WHERE s7 < lo7 - 0.01 * (hi7 - lo7) OR s7 > hi7 + 0.01 * (hi7 - lo7)""")
def envelope_check(spark, d):
    r = regimes(spark, d).withColumn("dist", F.abs(F.col("s9") - 3))
    state = f.envelope_fit(r.where("unit % 5 = 1"), ["s2", "s7"], "dist")
    return f.envelope_check(r.where("unit % 5 = 0"), state, ["s2", "s7"], "dist", 0.01)
