"""Resampling of units: draws, intervals, paired comparison, decision curves, tests. Rows are never resampled, units are."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from fleetmill.functions.columns import ratio
from fleetmill.functions.rng import uniform
from fleetmill.operators.ordering import numbered, running
from fleetmill.operators.quantiles import quantiles
from fleetmill.sources.shared import written


def draws(units: DataFrame, replicates: int, stream: str = "boot", key: str = "unit") -> DataFrame:
    """(replicate, unit, w): how often each unit is drawn in each replicate; as many draws as units.

    units: one row for each unit. Draw i of a replicate takes the unit at a hashed place in the order of ids.
    """
    place = written(numbered(units.select(key), [key]), "places")  # ids only, one row for each unit
    n = F.broadcast(place.agg(F.count("*").alias("n")))  # a single row
    drawn = place.join(n, F.lit(True)).select(F.col("place").alias("i"), "n", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    drawn = drawn.select("replicate", F.floor(uniform(stream, F.col("replicate"), F.col("i")) * F.col("n")).cast("long").alias("place"))
    return drawn.groupBy("replicate", "place").agg(F.count("*").alias("w")).join(place, "place").select("replicate", key, "w")


def _counts() -> list[float]:
    """The distribution function of a Poisson count of mean 1, up to where the rest is less than the random numbers' step."""
    p, out = math.exp(-1), []
    while not out or 1 - out[-1] >= 2.0**-32:
        out.append((out[-1] if out else 0.0) + p)
        p /= len(out)
    return out


#: Hashes of a task where rows are dealt before they are drawn.
DRAWS = 2_000_000


#: P(count <= k) for k = 0, 1, ...
POISSON = _counts()


def poisson_weight(u: Column) -> Column:
    """How often a unit counts, from a uniform number."""
    return reduce(lambda a, c: a + (u >= c).cast("int"), POISSON, F.lit(0))


def poisson(df: DataFrame, replicates: int, stream: str = "poisson", key: str = "unit") -> DataFrame:
    """df's rows once for each replicate that they count in, with replicate and w: a Poisson count of mean 1, from a hash of replicate and key.

    Units are drawn independently of each other, so no order, count or shuffle is needed; the number of units drawn
    varies from replicate to replicate. Where df has several rows for a unit, they share its count. A row's work is that
    of `replicates` hashes: few rows in one file are to be dealt to tasks before (`DRAWS`).
    """
    # A filter on columns would be pushed below them, and hash once for each of the counts that it compares with.
    one = lambda r: F.struct(r.alias("replicate"), F.transform(F.array(uniform(stream, r, F.col(key))), poisson_weight)[0].alias("w"))
    drawn = F.filter(F.transform(F.sequence(F.lit(1), F.lit(replicates)), one), lambda x: x["w"] > 0)
    return df.withColumn("__drawn", F.explode(drawn)).select(*df.columns, "__drawn.replicate", "__drawn.w")


def poisson_sums(df: DataFrame, sums: list[str], replicates: int, keys: list[str] | None = None, stream: str = "poisson", key: str = "unit") -> DataFrame:
    """(keys, replicate, w, sums): of each task, the sums of df's columns by the counts of `poisson`, and of the counts; to be added up by replicate.

    For many columns: a row's counts meet its columns in a product of matrices instead of a row for each replicate. A null
    adds nothing.
    """
    keys = keys or []
    one = lambda r: F.transform(F.array(uniform(stream, r, F.col(key))), poisson_weight)[0].cast("byte")
    rows = df.select(*keys, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in sums], F.transform(F.sequence(F.lit(1), F.lit(replicates)), one).alias("__w"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for whole in batches:
            for b in (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000)):
                w = b.column("__w").flatten().to_numpy().reshape(-1, replicates).astype(float)
                x = np.column_stack([np.ones(len(w)), *(b.column(c).to_numpy() for c in sums)])
                group = np.array(list(zip(*(b.column(k).to_pylist() for k in keys), strict=True)), dtype=object).reshape(len(w), -1) if keys else np.empty((len(w), 0), dtype=object)
                for k in {tuple(g) for g in group}:
                    mine = np.array([tuple(g) == k for g in group])
                    total[k] = total.get(k, 0.0) + w[mine].T @ x[mine]
        for k, s in total.items():
            cells = [pa.array([v] * replicates, c.type) for v, c in zip(k, kinds, strict=False)]
            yield pa.record_batch([*cells, pa.array(np.arange(1, replicates + 1), pa.int32()), *(pa.array(c) for c in s.T)], schema=kinds)

    out = StructType([*(df.schema[k] for k in keys), StructField("replicate", IntegerType()), *(StructField(c, DoubleType()) for c in ["w", *sums])])
    kinds = to_arrow_schema(out)
    return rows.mapInArrow(of, out)


def interval(df: DataFrame, keys: list[str], value: str, level: float = 0.95) -> DataFrame:
    """(keys, ci_lo, ci_hi, defined): percentile interval over replicates; nulls are left out, defined is the share of others.

    A group's buffer holds a number for each replicate, whatever the number of units.
    """
    a = (1 - level) / 2
    return df.groupBy(*keys).agg(F.percentile(value, F.lit(a)).alias("ci_lo"), F.percentile(value, F.lit(1 - a)).alias("ci_hi"), F.avg(F.col(value).isNotNull().cast("double")).alias("defined"))


#: A statistic as an aggregate of values that count w times.
Statistic = Callable[[Column, Column], Column]


def mean(v: Column, w: Column) -> Column:
    return F.sum(v * w) / F.sum(w)


def share(v: Column, w: Column) -> Column:
    """Share of values above 0."""
    return F.sum((v > 0).cast("double") * w) / F.sum(w)


def cv(v: Column, w: Column) -> Column:
    """Deviation over mean."""
    m = mean(v, w)
    return F.sqrt((F.sum(v * v * w) - F.sum(w) * m * m) / (F.sum(w) - 1)) / m


def bootstrap_ci(values: DataFrame, value: str, replicates: int, stats: dict[str, Statistic | float], stream: str = "boot", method: str = "exact") -> DataFrame:
    """(stat, estimate, ci_lo, ci_hi) of one value for each unit.

    stats: by name an aggregate of (value, weight), or a number from 0 to 1 for that quantile, which is found by ranges.
    method: "exact" or "poisson" draws.
    """
    from fleetmill.operators.evaluation import long_metrics

    rows = values.select("unit", value)
    drawn = written(poisson(rows, replicates, stream) if method == "poisson" else draws(rows, replicates, stream).join(rows, "unit"), "drawn")

    def measured(df: DataFrame, keys: list[str]) -> DataFrame:
        plain = {n: s for n, s in stats.items() if callable(s)}
        parts = [df.groupBy(*keys).agg(*[s(F.col(value), F.col("w")).alias(n) for n, s in plain.items()])] if plain else []
        parts += [quantiles(df, value, {n: s}, keys, "w") for n, s in stats.items() if not callable(s)]
        both = reduce(lambda a, x: a.join(x, keys or F.lit(True)), parts)  # a row for each replicate
        return long_metrics(both, keys, list(stats))

    ci = interval(measured(drawn, ["replicate"]), ["metric"], "estimate")
    est = measured(rows.withColumn("w", F.lit(1)), [])
    return est.join(ci, "metric").select(F.col("metric").alias("stat"), "estimate", "ci_lo", "ci_hi")


def replicate_metrics(sums: DataFrame, drawn: DataFrame, m: dict[str, Column], keys: list[str] | None = None) -> DataFrame:
    """A row of metrics for each replicate (and key): draws join unit sums, never points."""
    return sums.join(drawn, "unit").groupBy(*(keys or []), "replicate").agg(*[c.alias(k) for k, c in m.items()])


def triggers(points: DataFrame, thresholds: list[float], keys: list[str]) -> DataFrame:
    """(keys, threshold, lead): life left when a trajectory first predicts the threshold or less; null if it never does."""
    grid = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    hit = F.col("pred") <= F.col("threshold")
    return points.select(*keys, "cycle", "rul_true", "pred", grid).groupBy(*keys, "threshold").agg(F.min_by("rul_true", F.when(hit, F.col("cycle"))).alias("lead"), F.count_if(hit).alias("hits")).select(
        *keys, "threshold", F.when(F.col("hits") > 0, F.col("lead")).alias("lead"))


def decision_sums(leads: DataFrame, least: float, keys: list[str] | None = None) -> DataFrame:
    """(keys, unit, threshold, n, failed, removed, wasted, caught) over a unit's trajectories."""
    l = F.col("lead")  # noqa: E741
    return leads.groupBy(*(keys or []), "unit", "threshold").agg(
        F.count("*").cast("double").alias("n"), F.sum(F.coalesce(l <= 0, F.lit(True)).cast("double")).alias("failed"), F.sum(F.coalesce(l > 0, F.lit(False)).cast("double")).alias("removed"),
        F.sum(F.coalesce(F.when(l > 0, l), F.lit(0.0))).alias("wasted"), F.sum(F.coalesce(l >= least, F.lit(False)).cast("double")).alias("caught"))


def decision_metrics(w: Column) -> dict[str, Column]:
    s = lambda c: F.sum(w * F.col(c))
    return {"caught": 100 * ratio(s("caught"), s("n")), "failed": 100 * ratio(s("failed"), s("n")), "wasted": ratio(s("wasted"), s("removed"))}


def caught_at_budget(curve: DataFrame, budgets: list[float], keys: list[str]) -> DataFrame:
    """(keys, budget, caught): where the running maximum of wasted life reaches a budget, by linear interpolation.

    Points without wasted life are left out; a budget outside of the curve gives null; on a plateau that equals the
    budget its last point counts.
    """
    order = Window.partitionBy(*keys).orderBy("threshold")
    run = F.max("wasted").over(order.rowsBetween(Window.unboundedPreceding, 0))
    c = curve.where("wasted is not null and caught is not null").withColumn("run", run)
    c = c.withColumns({"next_run": F.lead("run").over(order), "next_caught": F.lead("caught").over(order)})
    c = c.select("*", F.explode(F.array(*[F.lit(float(x)) for x in budgets])).alias("budget"))
    at = c.where("run <= budget").groupBy(*keys, "budget").agg(F.max_by(F.struct("run", "caught", "next_run", "next_caught"), "threshold").alias("p"))
    p = F.col("p")
    between = p["caught"] + (p["next_caught"] - p["caught"]) * (F.col("budget") - p["run"]) / F.nullif(p["next_run"] - p["run"], F.lit(0.0))
    found = at.select(*keys, "budget", F.when(p["run"] == F.col("budget"), p["caught"]).otherwise(between).alias("caught"))
    return c.select(*keys, "budget").distinct().join(found, [*keys, "budget"], "left")


def _normal_tail(z: Column) -> Column:
    """The standard normal distribution's weight beyond |z| on one side, by a rational approximation (error under 1e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    series = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    return series * F.exp(-x * x) / 2


def _exact_p(w: Column, n: Column) -> Column:
    """Two-sided p of the statistic without ties: sums of all subsets of the ranks 1 to n are counted."""
    most = n * (n + 1) / 2
    start = F.transform(F.sequence(F.lit(0), most.cast("int")), lambda s: F.when(s == 0, 1.0).otherwise(0.0))
    ways = F.aggregate(F.sequence(F.lit(1), n.cast("int")), start, lambda have, r: F.transform(have, lambda x, s: x + F.when(s >= r, F.get(have, s - r)).otherwise(0.0)))
    below = F.aggregate(F.slice(ways, 1, F.floor(w).cast("int") + 1), F.lit(0.0), lambda t, x: t + x)
    return F.least(F.lit(1.0), 2 * below / F.pow(F.lit(2.0), n))


def signed_rank(diffs: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """(keys, n, w, z, p): Wilcoxon's signed ranks of the differences of a few splits, without zeros, average ranks for ties.

    p is exact for up to 50 differences without ties, else by the normal approximation with tie correction; where no
    split differs n is 0 and w, z and p are null.
    """
    d = diffs.where(F.col(value) != 0).withColumn("__a", F.abs(value))
    group = Window.partitionBy(*keys)
    t = F.count("*").over(Window.partitionBy(*keys, "__a"))
    d = d.withColumn("r", F.rank().over(group.orderBy("__a")) + (t - 1) / 2).withColumn("t", t)
    g = d.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.when(F.col(value) > 0, F.col("r")).otherwise(0.0)).alias("up"), F.sum(F.when(F.col(value) < 0, F.col("r")).otherwise(0.0)).alias("down"),
                             F.sum(F.col("t") * F.col("t") - 1).alias("ties"))
    n, w = F.col("n"), F.least("up", "down")
    z = (w - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    g = g.select(*keys, "n", w.alias("w"), z.alias("z"), "ties")
    p = F.when((F.col("n") <= 50) & (F.col("ties") == 0), _exact_p(F.col("w"), F.col("n"))).otherwise(F.least(F.lit(1.0), 2 * _normal_tail(F.col("z"))))
    found = g.select(*keys, "n", "w", "z", p.alias("p"))
    return diffs.select(*keys).distinct().join(found, keys, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def ks(df: DataFrame, value: str, side: str, weight: Column | None = None, keys: list[str] | None = None) -> DataFrame:
    """(keys, ks): greatest distance of two distribution functions; side: 0 or 1. Values are counted before they are ordered."""
    keys = keys or []
    w = weight if weight is not None else F.lit(1)
    n = lambda x: F.sum(F.when(F.col(side) == x, w).otherwise(0))
    g = running(df.groupBy(*keys, value).agg(n(0).alias("a"), n(1).alias("b")), value, ["a", "b"], keys)
    share = lambda c: F.col(f"run_{c}") / F.nullif(F.col(f"total_{c}"), F.lit(0.0))
    return g.select(*keys, F.abs(share("a") - share("b")).alias("gap")).groupBy(*keys).agg(F.max("gap").alias("ks"))


def largest_remainder(shares: DataFrame, total: int) -> DataFrame:
    """(bin, want): whole numbers that add up to total; the largest remainders, then the least bins, get one more."""
    s = shares.withColumn("exact", F.col("share") * total).withColumn("want", F.floor("exact"))
    # A row for each bin: they are sorted as one array.
    place = F.array_sort(F.collect_list(F.struct((F.col("want") - F.col("exact")).alias("less"), "bin", "want")))
    one = s.agg(place.alias("b"), (F.lit(total) - F.sum("want")).alias("short")).select("short", F.posexplode("b").alias("place", "x"))
    return one.select("x.bin", (F.col("x.want") + (F.col("place") < F.col("short")).cast("int")).alias("want"))


#: Slots that the points of a bin fall into by their hash.
SLOTS = 4096


def benchmark_view(points: DataFrame, target: DataFrame, total: int, width: float) -> tuple[DataFrame, DataFrame]:
    """(chosen points, (bin, shortfall)): per bin of the truth as many points as wanted, without replacement, by hashed order."""
    want = largest_remainder(target, total)
    b = (F.floor(F.col("rul_true") / width) * width).alias("bin")
    h = uniform("bench", F.col("unit"), F.col("cycle"))
    rows = points.withColumn("bin", b).withColumn("__h", h)
    # A bin's points fall into slots by their hash; only slots up to the one that fills the bin are ranked.
    slots = rows.groupBy("bin", F.floor(F.col("__h") * SLOTS).alias("__slot")).agg(F.count("*").alias("n"))
    filled = slots.withColumn("before", F.sum("n").over(Window.partitionBy("bin").orderBy("__slot").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))  # SLOTS rows
    last = filled.join(F.broadcast(want), "bin").where("before < want").groupBy("bin").agg(F.max("__slot").alias("__last"), F.first("want").alias("want"))  # a row for each bin
    few = rows.join(F.broadcast(last), "bin").where(F.floor(F.col("__h") * SLOTS) <= F.col("__last"))
    place = F.row_number().over(Window.partitionBy("bin").orderBy("__h", "unit", "cycle"))
    have = slots.groupBy("bin").agg(F.sum("n").alias("have"))
    short = want.join(have, "bin", "left").select("bin", F.greatest(F.col("want") - F.coalesce("have", F.lit(0)), F.lit(0)).alias("shortfall")).where("shortfall > 0")
    return few.withColumn("__p", place).where("__p <= want").drop("__p", "__h", "__last", "want"), short


def roc_auc(df: DataFrame, score: str, label: str, keys: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """(keys, auc) by ranks over distinct scores, so that weighted units and ties count as they should; null if one class lacks."""
    keys = keys or []
    w = F.col(weight) if weight else F.lit(1)
    g = df.groupBy(*keys, score).agg(F.sum(F.when(F.col(label) == 1, w).otherwise(0)).alias("__p"), F.sum(F.when(F.col(label) == 0, w).otherwise(0)).alias("__q"))
    g = running(g, score, ["__q"], keys).withColumn("__wins", F.col("__p") * (F.col("run___q") - F.col("__q") / 2))
    return g.groupBy(*keys).agg((F.sum("__wins") / F.nullif(F.sum("__p") * F.sum("__q"), F.lit(0))).alias("auc"))


def rand_index(df: DataFrame, a: str, b: str) -> DataFrame:
    """(ari): adjusted Rand index of two labelings, from their contingency table."""
    pairs = lambda c: F.sum(c * (c - 1) / 2)
    t = df.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    ij = t.agg(pairs(F.col("n")).alias("ij"), F.sum("n").alias("total"))
    i = t.groupBy(a).agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias("i"))
    j = t.groupBy(b).agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias("j"))
    one = ij.join(F.broadcast(i), F.lit(True)).join(F.broadcast(j), F.lit(True))  # single rows
    expected = F.col("i") * F.col("j") / (F.col("total") * (F.col("total") - 1) / 2)
    return one.select(((F.col("ij") - expected) / F.nullif((F.col("i") + F.col("j")) / 2 - expected, F.lit(0.0))).alias("ari"))


def rand_index_pairs(df: DataFrame, row_id: str, seed: str, label: str) -> DataFrame:
    """(a, b, ari) for all pairs of seeds a < b: how far the labels of their clusterings agree.

    df: a row for each id and seed. Each id's labels meet once, as one array; what is shuffled further are contingency
    counts, a row for each pair of seeds and of labels.
    """
    s = df.groupBy(row_id).agg(F.collect_list(F.struct(F.col(seed).alias("s"), F.col(label).alias("l"))).alias("x"))  # as many as there are seeds
    both = F.transform("x", lambda p: F.transform(F.filter("x", lambda q: q["s"] > p["s"]), lambda q: F.struct(p["s"].alias("a"), q["s"].alias("b"), p["l"].alias("la"), q["l"].alias("lb"))))
    t = s.select(F.explode(F.flatten(both)).alias("p")).select("p.*").groupBy("a", "b", "la", "lb").agg(F.count("*").cast("double").alias("n"))
    pairs = lambda c: F.sum(c * (c - 1) / 2)
    ij = t.groupBy("a", "b").agg(pairs(F.col("n")).alias("ij"), F.sum("n").alias("total"))
    side = lambda c: t.groupBy("a", "b", c).agg(F.sum("n").alias("n")).groupBy("a", "b").agg(pairs(F.col("n")).alias(f"in_{c}"))
    g = ij.join(side("la"), ["a", "b"]).join(side("lb"), ["a", "b"])
    expected = F.col("in_la") * F.col("in_lb") / (F.col("total") * (F.col("total") - 1) / 2)
    return g.select("a", "b", ((F.col("ij") - expected) / F.nullif((F.col("in_la") + F.col("in_lb")) / 2 - expected, F.lit(0.0))).alias("ari"))
