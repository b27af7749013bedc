"""Metrics of predictions from per-unit sums, and tables over them.

Every metric is a ratio of sums, so points are first reduced to one row for each unit; groups, replicates and
comparisons then work on those rows alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetmill.functions.columns import bucket, ratio


def error() -> Column:
    """Prediction less truth."""
    return F.col("pred") - F.col("y")


def asymmetric(e: Column) -> Column:
    """The score of one error (prediction less truth): late predictions cost more than early ones."""
    return F.when(e < 0, F.expm1(-e / 13)).otherwise(F.expm1(e / 10))


def with_truth(points: DataFrame, cap: float | None) -> DataFrame:
    """y: the truth, capped if asked; the prediction is clipped likewise."""
    if cap is None:
        return points.withColumn("y", F.col("rul_true"))
    return points.withColumn("y", F.least("rul_true", F.lit(float(cap)))).withColumn("pred", F.least("pred", F.lit(float(cap))))


def unit_sums(points: DataFrame, keys: list[str], buckets: list[tuple[str, float, float | None]]) -> DataFrame:
    """One row for each key: n, se, se2, sabs, late, score, and n, se, se2, late of each bucket of the truth."""
    b, err = bucket("y", buckets), error()
    one = lambda c, v: F.sum(F.when(c, v).otherwise(0.0))
    aggs = [F.count("*").cast("double").alias("n"), F.sum(err).alias("se"), F.sum(err * err).alias("se2"), F.sum(F.abs(err)).alias("sabs"),
            F.sum((err > 0).cast("double")).alias("late"), F.sum(asymmetric(err)).alias("score")]
    for name, _, _ in buckets:
        here = b == name
        aggs += [one(here, F.lit(1.0)).alias(f"n_{name}"), one(here, err).alias(f"se_{name}"), one(here, err * err).alias(f"se2_{name}"), one(here, (err > 0).cast("double")).alias(f"late_{name}")]
    return points.groupBy(*keys).agg(*aggs)


def metrics(w: Column, buckets: list[tuple[str, float, float | None]], prefix: str = "") -> dict[str, Column]:
    """Metrics as aggregates over unit sums, each unit counting w times; null where nothing is to be averaged. prefix: of the sums' names."""
    c = lambda name: F.col(f"{prefix}{name}")
    s = lambda name: F.sum(w * c(name))
    out = {"rmse": F.sqrt(ratio(s("se2"), s("n"))), "mae": ratio(s("sabs"), s("n")), "late_pct": 100 * ratio(s("late"), s("n")), "bias": ratio(s("se"), s("n")),
           "score_mean": ratio(F.sum(w * c("score") / c("n")), F.sum(w))}
    for name, _, _ in buckets:
        n = s(f"n_{name}")
        out |= {f"rmse_{name}": F.sqrt(ratio(s(f"se2_{name}"), n)), f"bias_{name}": ratio(s(f"se_{name}"), n)}
    return out


def late_by_bucket(w: Column, buckets: list[tuple[str, float, float | None]], prefix: str = "") -> dict[str, Column]:
    """The share of late predictions in each bucket, as `metrics`."""
    s = lambda name: F.sum(w * F.col(f"{prefix}{name}"))
    return {f"late_pct_{name}": 100 * ratio(s(f"late_{name}"), s(f"n_{name}")) for name, _, _ in buckets}


def long_metrics(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """(keys, metric, estimate) from one column for each metric."""
    return df.select(*keys, F.stack(F.lit(len(names)), *[x for n in names for x in (F.lit(n), F.col(n))]).alias("metric", "estimate"))


def metric_table(points: DataFrame, buckets: list, cap: float, min_history: int) -> DataFrame:
    """(view, truth, grp, metric, estimate, n_units, n_points) for all cycles and those of deployment, both truths, all units and each label."""
    views = points.withColumn("view", F.explode(F.when(F.col("cycle") >= min_history, F.array(F.lit("all"), F.lit("deployment"))).otherwise(F.array(F.lit("all")))))
    both = with_truth(views, None).withColumn("truth", F.lit("uncapped")).unionByName(with_truth(views, cap).withColumn("truth", F.lit("capped")))
    sums = unit_sums(both, ["view", "truth", "subpop", "unit"], buckets)
    m = metrics(F.lit(1.0), buckets)
    grouped = sums.groupingSets([["view", "truth"], ["view", "truth", "subpop"]], "view", "truth", "subpop").agg(
        *[c.alias(k) for k, c in m.items()], F.count("*").alias("n_units"), F.sum("n").cast("long").alias("n_points"), F.grouping("subpop").alias("__all"))
    grp = F.when(F.col("__all") == 1, "all").otherwise(F.concat(F.lit("subpop_"), F.col("subpop").cast("string")))
    return long_metrics(grouped.withColumn("grp", grp), ["view", "truth", "grp", "n_units", "n_points"], list(m))


def label_histogram(points: DataFrame, width: float) -> DataFrame:
    """(bin, share) of the truth; totals come from the bins, not from the rows again."""
    g = points.groupBy((F.floor(F.col("rul_true") / width) * width).alias("bin")).agg(F.count("*").alias("n"))
    return g.join(F.broadcast(g.agg(F.sum("n").alias("total"))), F.lit(True)).select("bin", (F.col("n") / F.col("total")).alias("share"))  # a single row


def equal_width(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, n): bins of equal width from the least to the greatest value, which belongs to the last."""
    edge = F.broadcast(df.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi")))  # a single row
    at = F.least(F.floor((F.col(column) - F.col("__lo")) / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0)) * bins), F.lit(bins - 1))
    return df.join(edge, F.lit(True)).groupBy(F.coalesce(at, F.lit(0)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def within_variance(df: DataFrame, sensors: list[str], regime: str = "regime") -> DataFrame:
    """(sensor, within, share): pooled variance within regimes and its share of the total variance."""
    from fleetmill.functions.columns import unpivot

    long = unpivot(df, [regime], sensors)
    g = long.groupBy("sensor", regime).agg(F.count("x").alias("n"), F.var_samp("x").alias("v"), F.avg("x").alias("m"))
    total = F.sum("n")
    ss = F.sum((F.col("n") - 1) * F.col("v"))
    # The total's sum of squares is that within plus that of the regimes' means.
    between = F.sum(F.col("n") * F.col("m") * F.col("m")) - F.sum(F.col("n") * F.col("m")) * F.sum(F.col("n") * F.col("m")) / total
    return g.groupBy("sensor").agg((ss / (total - F.count("*"))).alias("within"), ((ss / (total - F.count("*"))) / ((ss + between) / (total - 1))).alias("share"))


def split_effect(df: DataFrame, sensors: list[str], group: str) -> DataFrame:
    """(sensor, effect): difference of two groups' means over their pooled deviation."""
    from fleetmill.functions.columns import unpivot

    g = unpivot(df, [group], sensors).groupBy("sensor")
    v = lambda f, x: f(F.when(F.col(group) == x, F.col("x")))
    n0, n1 = v(F.count, 0), v(F.count, 1)
    pooled = F.sqrt(((n0 - 1) * v(F.var_samp, 0) + (n1 - 1) * v(F.var_samp, 1)) / (n0 + n1 - 2))
    return g.agg(F.abs((v(F.avg, 1) - v(F.avg, 0)) / F.nullif(pooled, F.lit(0.0))).alias("effect"))
