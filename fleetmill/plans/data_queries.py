"""Scans, sinks, constraint checks, labels and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetmill.functions.columns import bucket, clip, r6
from fleetmill.operators import checks, labels
from fleetmill.operators.quantiles import median, quantiles
from fleetmill.sources import bindings as b
from fleetmill.sources import fleet_files as files
from fleetmill.sources.shared import new_folder, written

from .registry import query, u

S = b.SENSORS


def broken(spark, d):
    """The cycles with gaps, repeated rows and nulls."""
    c = b.cycles(spark, d)
    mark = F.col("unit") * 131 + F.col("cycle")
    return c.where(mark % 401 != 0).withColumn("s2", F.when(mark % 389 != 0, F.col("s2"))).union(c.where(mark % 397 == 0))


def _text(spark, d):
    """The cycles as headerless text files <split>_<dataset>.txt in the shared folder, and the truth of the test units."""
    folder = new_folder(spark, "text")
    c = b.cycles(spark, d).select("dataset", "unit", "cycle", *b.OPS, *S)
    files.write_text(c.where("unit % 5 <> 0"), folder, "train")
    files.write_text(b.truncated(c), folder, "test")
    return folder


@query("SELECT unit, cycle, round(op1, 6) AS op1, round(op2, 6) AS op2, round(op3, 6) AS op3, round(s2, 6) AS s2, round(s4, 6) AS s4 FROM cycles WHERE unit % 5 <> 0")
def scan_cycles_txt(spark, d):
    rows = files.read_text(spark, _text(spark, d), [*b.OPS, *S])
    return rows.where("split = 'train'").select("unit", "cycle", *[r6(c).alias(c) for c in ("op1", "op2", "op3", "s2", "s4")])


@query("""SELECT dataset, split, count(*) AS n_rows, count(DISTINCT unit) AS n_units FROM (
  SELECT dataset, unit, 'train' AS split FROM both_cycles WHERE unit % 5 <> 0 UNION ALL
  SELECT dataset, unit, 'test' FROM (SELECT *, max(cycle) OVER (PARTITION BY dataset, unit) AS l FROM both_cycles) WHERE unit % 5 = 0 AND cycle <= floor(l / 2)) GROUP BY ALL""")
def scan_multi_dataset(spark, d):
    folder = new_folder(spark, "text")
    c = b.all_cycles(spark, d)
    files.write_text(c.where("unit % 5 <> 0"), folder, "train")
    files.write_text(b.truncated(c), folder, "test")
    t = files.read_datasets(spark, folder, ["events", "lineitem"], ["s2", "s7"], ["events", "lineitem"])
    return t.groupBy("dataset", "split").agg(F.count("*").alias("n_rows"), F.countDistinct("unit").alias("n_units"))


@query("""SELECT row_number() OVER (ORDER BY unit) AS unit, rul FROM (SELECT unit, max(cycle) - floor(max(cycle) / 2)::BIGINT AS rul FROM cycles WHERE unit % 5 = 0 GROUP BY unit)""")
def scan_truth_by_line(spark, d):
    t = b.cycles(spark, d).where("unit % 5 = 0").groupBy("unit").agg((F.max("cycle") - F.floor(F.max("cycle") / 2)).alias("rul"))
    folder = new_folder(spark, "truth")
    # A number on each line, as such truth files are published; as many files as tasks, in the order of their names.
    t.repartitionByRange("unit").sortWithinPartitions("unit").select(F.col("rul").cast("string")).write.text(folder)
    return files.read_truth(spark, folder)


@query("SELECT dataset, count(*) AS n FROM cycles WHERE unit % 5 <> 0 GROUP BY dataset")
def scan_train_only(spark, d):
    folder = new_folder(spark, "split")
    c = b.cycles(spark, d)
    c.withColumn("split", F.when(F.col("unit") % 5 == 0, "test").otherwise("train")).write.partitionBy("split").parquet(folder)
    return spark.read.parquet(folder).where("split = 'train'").groupBy("dataset").agg(F.count("*").alias("n"))


@query("SELECT unit AS unit_id, cycle, round(op1, 6) AS op_setting_1, round(s2, 6) AS sensor_2 FROM cycles")
def rename_columns(spark, d):
    raw = b.cycles(spark, d).withColumnsRenamed(files.raw_names([*b.OPS, *S]))
    return raw.select("unit_id", "cycle", r6("op_setting_1").alias("op_setting_1"), r6("sensor_2").alias("sensor_2"))


@query("SELECT unnest(['op1', 'op2', 'op3', 's2', 's3', 's4', 's7', 's8', 's9']) AS feature, count(*) AS n FROM cycles")
def feature_columns(spark, d):
    c = b.with_rul(b.cycles(spark, d))
    return c.agg(F.count("*").alias("n")).select(F.explode(F.array(*map(F.lit, files.feature_columns(c)))).alias("feature"), "n")


@query("SELECT unit, cycle, repeat, round(pred, 6) AS pred FROM points")
def points_parquet(spark, d):
    folder = new_folder(spark, "points")
    files.write_points(b.points(spark, d, "A"), folder, "A")
    files.write_points(b.points(spark, d, "B"), folder, "B")
    return files.read_points(spark, folder, "A").select("unit", "cycle", "repeat", r6("pred").alias("pred"))


@query("SELECT cycle AS threshold, round(avg(pred_a), 6) AS a, round(avg(pred_b), 6) AS b FROM points2 GROUP BY cycle")
def csv_wide_export(spark, d):
    rows = [b.points(spark, d, m).groupBy(F.col("cycle").alias("threshold")).agg(F.avg("pred").alias("estimate")).withColumn("model", F.lit(m.lower())) for m in "AB"]
    folder = new_folder(spark, "csv")
    files.wide(rows[0].union(rows[1]), "threshold", "model", ["a", "b"]).write.csv(folder, header=True)
    return spark.read.schema("threshold long, a double, b double").csv(folder, header=True).select("threshold", r6("a").alias("a"), r6("b").alias("b"))


@query("SELECT repeat, fold, count(*) AS n, round(sum(pred), 4) AS total FROM points GROUP BY ALL")
def csv_points_source(spark, d):
    folder = new_folder(spark, "csv")
    b.points(spark, d).drop("dataset").write.csv(folder, header=True)
    return files.read_points_csv(spark, folder).groupBy("repeat", "fold").agg(F.count("*").alias("n"), F.round(F.sum("pred"), 4).alias("total"))


@query("""SELECT subpop AS stage, m.metric, round(m.estimate, 6) AS estimate, CASE WHEN m.hi < 0 THEN 'better' WHEN m.lo > 0 THEN 'worse' ELSE 'not different' END AS verdict FROM (
  SELECT subpop, unnest([{'metric': 'bias', 'estimate': avg(pred_a - rul_true), 'lo': min(pred_a - rul_true), 'hi': max(pred_a - rul_true)},
                         {'metric': 'diff', 'estimate': avg(pred_a - pred_b), 'lo': avg(pred_a - pred_b) - 0.1, 'hi': avg(pred_a - pred_b) + 0.1}]) AS m FROM points2 GROUP BY subpop)""")
def json_results_flatten(spark, d):
    a = b.points(spark, d, "A").join(b.points(spark, d, "B").select("unit", "cycle", "repeat", F.col("pred").alias("pb")), ["unit", "cycle", "repeat"])
    e, g = F.col("pred") - F.col("rul_true"), F.avg(F.col("pred") - F.col("pb"))
    m = lambda name, est, lo, hi: F.struct(F.lit(name).alias("metric"), est.alias("estimate"), F.struct(lo.alias("lo"), hi.alias("hi")).alias("ci"))
    docs = a.groupBy("subpop").agg(F.array(m("bias", F.avg(e), F.min(e), F.max(e)), m("diff", g, g - 0.1, g + 0.1)).alias("comparisons"))
    folder = new_folder(spark, "json")
    docs.select(F.col("subpop").alias("stage"), "comparisons").write.json(folder)
    return files.flatten_results(spark, folder).select("stage", "metric", r6("estimate").alias("estimate"), "verdict")


@query("SELECT op1 AS regime, 3 AS version, round(avg(s2), 6) AS mean, round(stddev_samp(s2), 6) AS std FROM cycles GROUP BY op1")
def state_tables_save_load(spark, d):
    state = b.cycles(spark, d).groupBy(F.col("op1").alias("regime")).agg(F.avg("s2").alias("mean"), F.stddev_samp("s2").alias("std"))
    folder = new_folder(spark, "state")
    files.save_state(state, folder, 3)
    return files.load_state(spark, folder, 3).select("regime", F.col("schema_version").alias("version"), r6("mean").alias("mean"), r6("std").alias("std"))


@query("SELECT dataset, op1 AS model, max(lpad(((unit * 7 + cycle) % 9973)::VARCHAR, 8, '0')) AS version FROM cycles GROUP BY ALL")
def latest_version(spark, d):
    versions = b.cycles(spark, d).select("dataset", F.col("op1").alias("model"), F.lpad(((F.col("unit") * 7 + F.col("cycle")) % 9973).cast("string"), 8, "0").alias("version"))
    return files.latest(versions, ["dataset", "model"])


@query("""SELECT 'not_null' AS rule, 's2' AS "column", count(*) AS n FROM broken WHERE s2 IS NULL HAVING count(*) > 0
  UNION ALL SELECT 'at_least_1', 'unit', count(*) FROM broken WHERE unit < 1 HAVING count(*) > 0""")
def check_schema(spark, d):
    return checks.schema(broken(spark, d), S)


@query("SELECT unit, cycle, count(*) AS n FROM broken GROUP BY ALL HAVING count(*) > 1")
def check_unique_key(spark, d):
    return checks.unique_key(broken(spark, d), ["unit", "cycle"])


@query("SELECT dataset, unit, min(cycle) AS first, max(cycle) AS last, count(*) AS n FROM broken GROUP BY ALL HAVING min(cycle) <> 1 OR max(cycle) <> count(*)")
def check_contiguous(spark, d):
    return checks.contiguous(broken(spark, d))


@query("""SELECT unit, CASE WHEN unit % 10 = 0 THEN 'negative' WHEN unit % 10 = 5 AND unit % 15 = 0 THEN 'not whole' END AS problem FROM (SELECT DISTINCT unit FROM cycles WHERE unit % 5 = 0 AND unit % 35 <> 0)
  WHERE unit % 10 = 0 OR unit % 15 = 0 UNION ALL SELECT DISTINCT unit, 'no truth' FROM cycles WHERE unit % 35 = 0 UNION ALL SELECT DISTINCT unit, 'no unit' FROM cycles WHERE unit % 55 = 1""")
def check_truth(spark, d):
    units = b.cycles(spark, d).select("unit").distinct()
    k = F.col("unit")
    truth = units.where(((k % 5 == 0) & (k % 35 != 0)) | (k % 55 == 1)).withColumn("rul", F.when(k % 10 == 0, -1.0).when(k % 15 == 0, 2.5).otherwise(7.0))
    return checks.truth(truth, units.where("unit % 5 = 0"))


@query("""SELECT 'events' AS dataset, 'rows' AS what, (SELECT count(*) FROM cycles) AS expected, (SELECT count(*) FROM broken) AS actual WHERE (SELECT count(*) FROM cycles) <> (SELECT count(*) FROM broken)
  UNION ALL SELECT 'events', 'max_unit', (SELECT count(DISTINCT unit) FROM cycles), (SELECT max(unit) FROM broken) WHERE (SELECT count(DISTINCT unit) FROM cycles) <> (SELECT max(unit) FROM broken)""")
def check_counts_vs_expected(spark, d):
    def counts(df, top):
        g = df.groupBy("dataset").agg(F.count("*").alias("rows"), F.countDistinct("unit").alias("units"), top.alias("max_unit"))
        return g.select("dataset", F.stack(F.lit(3), F.lit("rows"), "rows", F.lit("units"), "units", F.lit("max_unit"), "max_unit").alias("what", "n"))

    return checks.counts_vs_expected(counts(broken(spark, d), F.max("unit")), counts(b.cycles(spark, d), F.countDistinct("unit")))


@query("SELECT dataset, unit, min(cycle) AS first FROM cycles WHERE (unit % 4 <> 1 OR cycle > 3) GROUP BY ALL HAVING min(cycle) <> 1")
def check_history_start(spark, d):
    return checks.history_start(b.cycles(spark, d).where("unit % 4 <> 1 or cycle > 3"))


@query("""SELECT 's2' AS "column", count(*) AS n FROM broken WHERE s2 IS NULL HAVING count(*) > 0""")
def check_not_null_input(spark, d):
    return checks.nulls(broken(spark, d), [*b.OPS, *S])


@query("SELECT unit, cycle FROM broken WHERE s2 IS NULL OR s9 = 0")
def check_finite_residual(spark, d):
    e = F.when(F.col("s9") == 0, float("inf")).otherwise(F.col("s2") - F.col("s3"))
    return checks.not_finite(broken(spark, d), e, ["unit", "cycle"])


@query("SELECT 's2_mean' AS \"column\", count(*) AS n FROM (SELECT avg(s2) OVER (PARTITION BY unit ORDER BY cycle ROWS BETWEEN 0 PRECEDING AND CURRENT ROW) AS m FROM broken WHERE (unit * 131 + cycle) % 397 <> 0) WHERE m IS NULL HAVING count(*) > 0")
def check_no_nan_features(spark, d):
    from fleetmill.functions.columns import trailing

    rows = broken(spark, d).where((F.col("unit") * 131 + F.col("cycle")) % 397 != 0)
    return checks.nulls(rows.withColumn("s2_mean", F.avg("s2").over(trailing(1))), ["s2_mean", "s3"])


@query("""SELECT unit, cycle, CASE WHEN cycle % 50 = 1 THEN ['s3'] ELSE []::VARCHAR[] END AS missing, CASE WHEN cycle % 50 = 2 THEN ['s99'] ELSE []::VARCHAR[] END AS extra, cycle % 50 <> 3 AS finite FROM cycles WHERE cycle % 50 IN (1, 2, 3)""")
def check_request_keys(spark, d):
    c = F.col("cycle") % 50
    third = F.when(c == 1, "s1").otherwise("s3")
    sensors = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(s).alias("k"), F.col(s).alias("v")) for s in ("s2", "s4")], F.struct(third.alias("k"), F.when(c == 3, float("nan")).otherwise(F.col("s3")).alias("v")),
                                                   F.struct(F.when(c == 2, "s99").otherwise("s1").alias("k"), F.lit(0.0).alias("v"))), lambda x: x["k"] != "s1"))
    return checks.request_keys(b.cycles(spark, d).select("unit", "cycle", sensors.alias("sensors")), ["s2", "s3", "s4"]).drop("sensors")


@query("SELECT dataset, unit, count(*) AS n FROM cycles GROUP BY ALL HAVING count(*) < 60")
def check_min_history(spark, d):
    return checks.min_history(b.cycles(spark, d), 60)


@query("""SELECT r AS regime, s AS sensor, CASE WHEN r = 9 THEN 'extra' ELSE 'missing' END AS problem FROM (SELECT unnest([1, 9]) AS r, 's2' AS s) WHERE EXISTS (SELECT 1 FROM cycles)""")
def check_state_match(spark, d):
    code = F.when(F.col("op1") == 10, 9).when(F.col("op1") == 0, 0).when(F.col("op1") == 20, 2).when(F.col("op1") == 25, 3).otherwise(4)
    return checks.state_match(b.cycles(spark, d).select(code.alias("regime"), F.lit("s2").alias("sensor")), 5, ["s2"])


@query("SELECT unit, cycle, repeat, round(pred, 6) AS pa, CASE WHEN cycle % 40 = 1 THEN NULL ELSE round(pred + 1e-3, 6) END AS pb FROM points WHERE cycle % 40 IN (1, 2)")
def check_points_equal(spark, d):
    p = b.points(spark, d).select("unit", "cycle", "repeat", "pred")
    q = p.where("cycle % 40 <> 1").withColumn("pred", F.when(F.col("cycle") % 40 == 2, F.col("pred") + 1e-3).otherwise(F.col("pred") + 1e-12))
    return checks.points_equal(p, q, ["unit", "cycle", "repeat"]).withColumns({"pa": r6("pa"), "pb": r6("pb")})


@query("SELECT op1 AS regime, 'op3' AS sensor, count(*) AS n FROM cycles GROUP BY op1")
def check_constant_sensor(spark, d):
    return checks.constant_sensors(b.cycles(spark, d).withColumnRenamed("op1", "regime"), ["s2", "s4", "op3"])


@query("SELECT DISTINCT op1 AS regime FROM cycles WHERE unit % 5 = 0 AND op1 NOT IN (SELECT op1 FROM cycles WHERE unit % 5 <> 0 AND op1 <> 25)")
def check_unseen_regime(spark, d):
    c = b.cycles(spark, d).withColumnRenamed("op1", "regime")
    return checks.unseen_regimes(c.where("unit % 5 = 0"), c.where("unit % 5 <> 0 and regime <> 25"))


@query("""SELECT dataset, count(*) AS n_engines, sum(life)::BIGINT AS n_rows, min(life) AS life_min, quantile_cont(life, 0.25) AS q25, quantile_cont(life, 0.5) AS life_median, quantile_cont(life, 0.75) AS q75, max(life) AS life_max,
  count(*) FILTER (life < 60) AS n_short FROM (SELECT dataset, unit, max(cycle) AS life FROM cycles GROUP BY ALL) GROUP BY dataset""")
def dataset_profile(spark, d):
    life = written(b.cycles(spark, d).groupBy("dataset", "unit").agg(F.max("cycle").alias("life")), "lives")
    n = life.groupBy("dataset").agg(F.count("*").alias("n_engines"), F.sum("life").alias("n_rows"), F.min("life").alias("life_min"), F.max("life").alias("life_max"), F.count_if(F.col("life") < 60).alias("n_short"))
    return n.join(quantiles(life, "life", {"q25": 0.25, "life_median": 0.5, "q75": 0.75}, ["dataset"]), "dataset")


@query("""SELECT sensor, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS min, round(quantile_cont(x, 0.5), 6) AS median, round(max(x), 6) AS max FROM long GROUP BY sensor""")
def describe_columns(spark, d):
    from fleetmill.functions.columns import unpivot

    x = unpivot(b.cycles(spark, d), [], S)
    g = x.groupBy("sensor").agg(F.count("x").alias("n"), r6(F.avg("x")).alias("mean"), r6(F.stddev_samp("x")).alias("std"), r6(F.min("x")).alias("min"), r6(F.max("x")).alias("max"))
    return g.join(median(x, "x", "median", ["sensor"]), "sensor").withColumn("median", r6("median"))


@query("SELECT sensor, round(stddev_samp(x), 6) AS std FROM long GROUP BY sensor HAVING stddev_samp(x) < 25")
def low_variance_filter(spark, d):
    return checks.low_variance(b.cycles(spark, d), S, 25.0).select("sensor", r6("std").alias("std"))


@query("SELECT unit, cycle, rul_true FROM ruled")
def label_true_rul(spark, d):
    return labels.true_rul(b.cycles(spark, d)).select("unit", "cycle", "rul_true")


@query("SELECT unit, cycle, cap, least(rul_true, cap) AS rul FROM ruled, (SELECT unnest([20, 40, 60])::DOUBLE AS cap)")
def label_capped_rul(spark, d):
    return labels.capped_rul(labels.true_rul(b.cycles(spark, d)), [20, 40, 60]).select("unit", "cycle", "cap", "rul")


@query("SELECT CASE WHEN rul_true < 10 THEN 'critical' WHEN rul_true < 20 THEN 'urgent' WHEN rul_true < 40 THEN 'monitor' ELSE 'healthy' END AS bucket, count(*) AS n FROM ruled GROUP BY ALL")
def maintenance_bucket(spark, d):
    return labels.true_rul(b.cycles(spark, d)).groupBy(bucket("rul_true", b.BUCKETS).alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT unit, cycle, round(least(greatest(70 - 1.3 * cycle, 0), 40)::DOUBLE, 6) AS rul, 70 - 1.3 * cycle >= 40 AS rul_at_cap FROM cycles")
def clip_prediction(spark, d):
    raw = F.lit(70.0) - 1.3 * F.col("cycle")
    return b.cycles(spark, d).select("unit", "cycle", r6(clip(raw, 40)).alias("rul"), (clip(raw, 40) >= 40).alias("rul_at_cap"))


@query("SELECT unit, count(*) AS n FROM cycles WHERE unit % 7 = 3 GROUP BY unit")
def filter_units(spark, d):
    c = b.cycles(spark, d)
    return c.join(c.select("unit").distinct().where("unit % 7 = 3"), "unit", "left_semi").groupBy("unit").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, round(avg(pred), 6) AS pred FROM points WHERE cycle >= 10")
def deployment_view(spark, d):
    return b.points(spark, d).where(F.col("cycle") >= b.MIN_HISTORY).agg(F.count("*").alias("n"), r6(F.avg("pred")).alias("pred"))


@query("SELECT unit, cycle, round(s2, 6) AS s2 FROM cycles WHERE cycle <= 60 AND unit IN (SELECT unit FROM cycles GROUP BY unit HAVING count(*) >= 60)")
def first_n_cycles(spark, d):
    return labels.first_n(b.cycles(spark, d), 60).select("unit", "cycle", r6("s2").alias("s2"))


@query("SELECT unit, max(cycle) AS cycle, round(arg_max(s2, cycle), 6) AS s2, arg_max(op1, cycle) AS op1 FROM cycles GROUP BY unit")
def last_cycle_row(spark, d):
    return labels.last_row(b.cycles(spark, d)).select("unit", "cycle", r6("s2").alias("s2"), "op1")


@query("""WITH l AS (SELECT *, count(*) FILTER (rul_true < 20) OVER (PARTITION BY unit) AS low FROM ruled), r AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY cycle) AS place FROM l WHERE rul_true < 20 OR low = 0)
  SELECT unit, cycle FROM r WHERE (place - 1) % 4 = 0""")
def every_kth_instance(spark, d):
    return labels.every_kth(labels.true_rul(b.cycles(spark, d)), 20, 4).select("unit", "cycle")


@query("SELECT unit, CASE WHEN row_number() OVER (ORDER BY unit) <= floor(0.8 * count(*) OVER ()) THEN 'train' ELSE 'validation' END AS part FROM (SELECT DISTINCT unit FROM cycles)")
def split_first_frac(spark, d):
    return labels.split_first_frac(b.cycles(spark, d).select("dataset", "unit").distinct(), 0.8).select("unit", "part")


@query("SELECT unit, subpop FROM (SELECT *, row_number() OVER (PARTITION BY subpop ORDER BY unit) <= 5 AS f FROM labels_) ORDER BY NOT f, unit LIMIT 11")
def balanced_unit_sample(spark, d):
    return labels.balanced_sample(b.labels(b.cycles(spark, d)), 11)


FOLDS = f"""f AS (SELECT repeat, unit, subpop, ((row_number() OVER (PARTITION BY repeat, subpop ORDER BY {u('folds', 'repeat', 'unit')}, unit) - 1 + subpop) % 5)::INT AS fold FROM labels_, (SELECT unnest([1, 2])::INT AS repeat))"""


@query(f"WITH {FOLDS} SELECT repeat, unit, subpop, fold FROM f")
def stratified_group_folds(spark, d):
    return labels.stratified_folds(b.labels(b.cycles(spark, d)), 2, 5)


@query(f"""WITH {FOLDS}, r AS (SELECT f.repeat, h.fold, f.unit, f.subpop FROM f, (SELECT DISTINCT fold FROM f) h WHERE f.fold <> h.fold)
  SELECT repeat, fold, unit, CASE WHEN row_number() OVER (PARTITION BY repeat, fold, subpop ORDER BY {u('inner', 'repeat', 'fold', 'unit')}, unit) <= round_even(0.15 * count(*) OVER (PARTITION BY repeat, fold, subpop), 0) THEN 'val' ELSE 'train' END AS role FROM r""")
def inner_validation_split(spark, d):
    return labels.inner_validation(labels.stratified_folds(b.labels(b.cycles(spark, d)), 2, 5), 0.15)


@query(f"""WITH {FOLDS} SELECT h.repeat, h.fold, CASE WHEN h.fold = f.fold THEN 'test' ELSE 'train' END AS role, count(*) AS n, round(avg(s2), 6) AS mean FROM cycles c JOIN f USING (unit) JOIN (SELECT DISTINCT repeat, fold FROM f) h ON h.repeat = f.repeat GROUP BY ALL""")
def fold_expand(spark, d):
    c = b.cycles(spark, d)
    f = labels.stratified_folds(b.labels(c), 2, 5)
    held = f.select("repeat", F.col("fold").alias("own"), "unit").join(f.select("repeat", "fold").distinct(), "repeat")
    rows = c.join(held, "unit").withColumn("role", F.when(F.col("fold") == F.col("own"), "test").otherwise("train"))
    return rows.groupBy("repeat", "fold", "role").agg(F.count("*").alias("n"), r6(F.avg("s2")).alias("mean"))


@query("""SELECT cap, win, count(*) AS n, round(avg(least(rul_true, cap)), 6) AS rul FROM ruled, (SELECT unnest([20.0, 40.0])::DOUBLE AS cap), (SELECT unnest([5, 20]) AS win) WHERE cycle >= win GROUP BY ALL""")
def candidate_grid(spark, d):
    grid = labels.candidate_grid(spark, {"cap": [20.0, 40.0], "win": [5, 20]})
    rows = labels.true_rul(b.cycles(spark, d)).join(F.broadcast(grid), F.col("cycle") >= F.col("win"))  # the grid has four rows
    return rows.groupBy("cap", "win").agg(F.count("*").alias("n"), r6(F.avg(F.least("rul_true", "cap"))).alias("rul"))
