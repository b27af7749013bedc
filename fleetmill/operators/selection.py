"""Rules over tables of comparisons (challenger, incumbent, metric, estimate, diff_ci_lo, diff_ci_hi)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def verdict() -> Column:
    return F.when(F.col("diff_ci_hi") < 0, "better").when(F.col("diff_ci_lo") > 0, "worse").otherwise("not different")


def pick_winner(comparisons: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, winner): the better challenger with the lowest estimate; the incumbent if none is better."""
    best = F.min(F.when(F.col("diff_ci_hi") < 0, F.struct("estimate", "challenger")))
    return comparisons.groupBy(*keys).agg(best.alias("b"), F.min("incumbent").alias("i")).select(*keys, F.coalesce("b.challenger", "i").alias("winner"))


def none_worse(comparisons: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, passes): worse on none of the metrics; budgets' curves count the other way round (more is better)."""
    bad = F.coalesce(F.when(F.col("metric").startswith("caught"), F.col("diff_ci_hi") < 0).otherwise(F.col("diff_ci_lo") > 0), F.lit(False))
    return comparisons.where(F.col("metric").isin(metrics) | F.col("metric").startswith("caught")).groupBy(*keys).agg((~F.bool_or(bad)).alias("passes"))


def decision_better(comparisons: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, better): caught more at one budget or more, less at none."""
    return comparisons.where("metric like 'caught%'").groupBy(*keys).agg(
        (F.coalesce(F.bool_or(F.col("diff_ci_lo") > 0), F.lit(False)) & ~F.coalesce(F.bool_or(F.col("diff_ci_hi") < 0), F.lit(False))).alias("better"))


def loo_dropped(comparisons: DataFrame, keys: list[str], cap: str, metrics: list[str]) -> DataFrame:
    """(keys, challenger): adopted changes that aren't better than leaving them out; that of the cap also where none_worse fails."""
    passes = none_worse(comparisons, [*keys, "challenger"], metrics)
    rows = comparisons.where("metric = 'rmse'").join(passes, [*keys, "challenger"])
    return rows.where(~((verdict() == "better") & ((F.col("challenger") != cap) | F.col("passes")))).select(*keys, "challenger")


def block_screen(comparisons: DataFrame, exclusive: list[str]) -> DataFrame:
    """(adopted): blocks better than the base alone; of the exclusive ones only that with the lowest estimate. One row."""
    ok = comparisons.where("diff_ci_hi < 0").select("challenger", "estimate")
    one = ok.where(F.col("challenger").isin(exclusive)).agg(F.min_by("challenger", F.struct("estimate", "challenger")).alias("challenger"))
    rest = ok.where(~F.col("challenger").isin(exclusive)).select("challenger")
    return rest.union(one.where("challenger is not null")).agg(F.array_join(F.array_sort(F.collect_list("challenger")), "+").alias("adopted"))


def final_outcome(rmse: Column, decision: Column) -> Column:
    return F.when(rmse.isNull() | decision.isNull(), "pending").when((rmse == "better") & (decision != "worse"), "winner").otherwise("locked")


def identifiability_gate(auc: DataFrame, gate: float, strong: float) -> DataFrame:
    """(group, opens): AUC at least the gate, its lower bound at least strong, and the control's interval holds 0.5."""
    return auc.select("group", ((F.col("auc") >= gate) & (F.col("ci_lo") >= strong) & (F.col("control_lo") <= 0.5) & (F.col("control_hi") >= 0.5)).alias("opens"))
