"""Labels, predicates and splits of units."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from fleetmill.functions.columns import UNIT
from fleetmill.functions.rng import uniform
from fleetmill.operators.ordering import numbered_within


def _all() -> WindowSpec:
    return Window.partitionBy(*UNIT)


def true_rul(df: DataFrame) -> DataFrame:
    """Cycles left to the unit's last one."""
    return df.withColumn("rul_true", (F.max("cycle").over(_all()) - F.col("cycle")).cast("double"))


def capped_rul(df: DataFrame, caps: list[float]) -> DataFrame:
    """A row for each cap of the grid."""
    return df.select("*", F.explode(F.array(*[F.lit(float(c)) for c in caps])).alias("cap")).withColumn("rul", F.least("rul_true", "cap"))


def first_n(df: DataFrame, n: int) -> DataFrame:
    """Cycles 1..n of the units that have them all."""
    head = df.where(F.col("cycle") <= n)
    return head.withColumn("__n", F.count("*").over(_all())).where(F.col("__n") == n).drop("__n")


def last_row(df: DataFrame) -> DataFrame:
    """The row of each unit's last cycle: an aggregate, which combines before the shuffle."""
    return df.groupBy(*UNIT).agg(F.max_by(F.struct(*[c for c in df.columns if c not in UNIT]), "cycle").alias("__r")).select(*UNIT, "__r.*")


def every_kth(df: DataFrame, cap: float, k: int) -> DataFrame:
    """Every k-th of a unit's rows below the cap; of all its rows if none is."""
    low = F.count_if(F.col("rul_true") < cap).over(_all())
    rows = df.withColumn("__low", low).where((F.col("rul_true") < cap) | (F.col("__low") == 0)).drop("__low")
    at = F.row_number().over(Window.partitionBy(*UNIT).orderBy("cycle"))
    return rows.withColumn("__at", at).where((F.col("__at") - 1) % k == 0).drop("__at")


def split_first_frac(units: DataFrame, frac: float) -> DataFrame:
    """(unit, part): the first floor(n * frac) units by id are for training."""
    placed = numbered_within(units.select("dataset", "unit"), ["dataset"], ["unit"])
    return placed.select("dataset", "unit", F.when(F.col("place") < F.floor(F.col("size") * frac), "train").otherwise("validation").alias("part"))


def balanced_sample(labels: DataFrame, n: int) -> DataFrame:
    """n units, as many of each label as n allows, least ids first; the rest filled with the least ids left."""
    k = labels.select("subpop").distinct().count()
    ranked = numbered_within(labels, ["subpop"], ["unit"]).withColumn("__p", F.when(F.col("place") < n // k, 0).otherwise(1))
    return ranked.orderBy("__p", "unit").limit(n).select("unit", "subpop")


def stratified_folds(labels: DataFrame, repeats: int, folds: int) -> DataFrame:
    """(repeat, unit, subpop, fold): in each repeat a unit is held out once, every label spread evenly over the folds."""
    rep = labels.select("unit", "subpop", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat"))
    h = uniform("folds", F.col("repeat"), F.col("unit"))
    placed = numbered_within(rep, ["repeat", "subpop"], [h, "unit"])
    return placed.select("repeat", "unit", "subpop", ((F.col("place") + F.col("subpop")) % folds).cast("int").alias("fold"))


def inner_validation(folds: DataFrame, frac: float) -> DataFrame:
    """(repeat, fold, unit, role): for each held-out fold, the others' units, a stratified share of them for validation."""
    n = folds.select("fold").distinct()
    rows = n.join(folds.select("repeat", "unit", "subpop", F.col("fold").alias("own")), F.col("fold") != F.col("own"))
    h = uniform("inner", F.col("repeat"), F.col("fold"), F.col("unit"))
    placed = numbered_within(rows, ["repeat", "fold", "subpop"], [h, "unit"])
    return placed.select("repeat", "fold", "unit", F.when(F.col("place") < F.bround(frac * F.col("size")), "val").otherwise("train").alias("role"))


def candidate_grid(spark, values: dict[str, list]) -> DataFrame:
    """All combinations of the parameters' values: a few rows, from the parameters alone."""
    out = spark.range(1).select()
    for name, options in values.items():
        out = out.select("*", F.explode(F.array(*map(F.lit, options))).alias(name))
    return out


def random_candidates(trials: DataFrame) -> DataFrame:
    """trials (with a column trial) and rate, depth, kind: hashed draws, log-uniform, integer and categorical."""
    lo, hi = F.lit(0.01), F.lit(0.3)
    rate = F.exp(F.log(lo) + uniform("rate", F.col("trial")) * (F.log(hi) - F.log(lo)))
    kind = F.element_at(F.array(F.lit("mean"), F.lit("ridge"), F.lit("gbt")), (F.floor(uniform("kind", F.col("trial")) * 3) + 1).cast("int"))
    return trials.withColumns({"rate": rate, "depth": (F.floor(uniform("depth", F.col("trial")) * 6) + 3).cast("int"), "kind": kind})
