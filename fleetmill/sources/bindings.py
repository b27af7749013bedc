"""Fleet tables derived from the given tables: cycles of units from events, predictions, truth, labels, folds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetmill.functions.rng import uniform

SENSORS = ["s2", "s3", "s4", "s7", "s8", "s9"]
OPS = ["op1", "op2", "op3"]
#: Lives are short in these tables: cap, buckets, window and histories are scaled to them.
CAP, WINDOW, MIN_HISTORY, FIRST_N = 40, 5, 10, 30
BUCKETS = [("critical", 0.0, 10.0), ("urgent", 10.0, 20.0), ("monitor", 20.0, 40.0), ("healthy", 40.0, None)]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Events that a task takes where a unit's rows are then multiplied and sorted in the same stage.
TASK_ROWS = 50_000


def dealt(df: DataFrame, key: str, rows: int = TASK_ROWS) -> DataFrame:
    """df dealt by key to a number of tasks that grows with its rows; adaptive execution doesn't join these together again."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)), key)


def cycles(spark: SparkSession, sf_dir: str, deal: bool = False) -> DataFrame:
    """(dataset, unit, cycle, op1..op3, sensors): a user's events in order of time are a unit's cycles; deal: by `dealt`."""
    e = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value", F.get_json_object("props", "$.k").cast("double").alias("s4"))
    e = dealt(e, "user_id") if deal else e
    code = reduce(lambda c, x: c.when(F.col("event_type") == x[0], x[1]), [("error", 10.0), ("purchase", 20.0), ("signup", 25.0), ("view", 35.0)], F.when(F.col("event_type") == "click", 0.0))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.select(F.lit("events").alias("dataset"), F.col("user_id").alias("unit"), F.row_number().over(order).cast("long").alias("cycle"), code.alias("op1"), "value", "s4")
    odd = F.when(F.col("unit") % 2 == 1, 1.0).otherwise(-1.0)
    return e.select("dataset", "unit", "cycle", "op1", (F.col("op1") / 50).alias("op2"), F.when(F.col("op1") == 25.0, 60.0).otherwise(100.0).alias("op3"),
                    F.col("value").alias("s2"), F.log1p("value").alias("s3"), "s4", (F.col("value") + 0.5 * F.col("cycle")).alias("s7"),
                    (F.col("s4") - 0.3 * F.col("cycle") * odd).alias("s8"), (F.col("value") % 7).alias("s9"))


def long_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, unit, cycle, s2, s7): hundreds of cycles for each unit, a supplier's line items in a total order."""
    li = read(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    li = li.select(F.lit("lineitem").alias("dataset"), F.col("l_suppkey").cast("long").alias("unit"), F.row_number().over(order).cast("long").alias("cycle"), F.col("l_quantity").cast("double").alias("s2"))
    return li.withColumn("s7", F.col("s2") + 0.05 * F.col("cycle"))


def all_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, unit, cycle, s2, s7) of both fleets."""
    return cycles(spark, sf_dir).select("dataset", "unit", "cycle", "s2", "s7").unionByName(long_cycles(spark, sf_dir))


def with_rul(df: DataFrame) -> DataFrame:
    return df.withColumn("rul_true", (F.max("cycle").over(Window.partitionBy("dataset", "unit")) - F.col("cycle")).cast("double"))


def labels(df: DataFrame) -> DataFrame:
    """(unit, subpop) of every unit."""
    return df.select("unit").distinct().select("unit", (F.col("unit") % 3 == 0).cast("int").alias("subpop"))


def prediction(which: str) -> Column:
    c, s = F.col("cycle"), F.col("s2")
    raw = 66 - c + (s - 50) / 10 if which == "A" else 70 - 1.05 * c
    return F.least(F.greatest(raw, F.lit(0.0)), F.lit(125.0))


def points(spark: SparkSession, sf_dir: str, which: str = "A", repeats: int = 2, folds: int = 5) -> DataFrame:
    """(dataset, unit, cycle, repeat, fold, seed, rul_true, pred, subpop): a held-out prediction in each repeat."""
    df = with_rul(cycles(spark, sf_dir))
    rep = F.explode(F.array(*[F.lit(r) for r in range(1, repeats + 1)])).alias("repeat")
    rows = df.select("dataset", "unit", "cycle", "rul_true", prediction(which).alias("pred"), (F.col("unit") % 3 == 0).cast("int").alias("subpop"), rep)
    fold = F.floor(uniform("fold", F.col("repeat"), F.col("unit")) * folds).cast("int")
    return rows.select("dataset", "unit", "cycle", "repeat", fold.alias("fold"), F.lit(42).alias("seed"), "rul_true", "pred", "subpop")


def truncated(df: DataFrame) -> DataFrame:
    """Held-out units, the first half of their cycles only."""
    last = F.max("cycle").over(Window.partitionBy("dataset", "unit"))
    return df.where("unit % 5 = 0").withColumn("__last", last).where("cycle <= floor(__last / 2)").drop("__last")
