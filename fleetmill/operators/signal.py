"""Statistics of signals within units: rank correlation, change points, noise, sign patterns. One row for each unit and sensor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetmill.functions.columns import pearson, ratio
from fleetmill.functions.rng import uniform
from fleetmill.operators.quantiles import median

KEYS = ["unit", "sensor"]


def with_ttf(long: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """ttf: cycles left. long: (unit, cycle, sensor, x)."""
    return long.withColumn("ttf", (F.max("cycle").over(Window.partitionBy("unit")) - F.col("cycle")).cast("double"))


def rank(value: str, *within: str) -> Column:
    """Average rank within a group; windows share the group's distribution."""
    group = Window.partitionBy(*within)
    return (F.rank().over(group.orderBy(value)) + (F.count("*").over(Window.partitionBy(*within, value)) - 1) / 2).cast("double")


def spearman(long: DataFrame, x: str = "x", y: str = "ttf", keys: list[str] | None = None) -> DataFrame:
    """(keys, rho): Spearman's correlation of x and y; null if a side is constant."""
    keys = keys or KEYS
    ranked = long.withColumns({"__rx": rank(x, *keys), "__ry": rank(y, *keys)})
    return ranked.groupBy(*keys).agg(pearson(F.col("__rx"), F.col("__ry")).alias("rho"))


def shuffled_ttf(long: DataFrame) -> DataFrame:
    """long with ttf dealt anew within each unit, the same for all of its sensors, by hashed order."""
    by = Window.partitionBy("unit", "sensor")
    a = long.withColumn("__i", F.row_number().over(by.orderBy("cycle")))
    h = uniform("null", F.col("unit"), F.col("cycle"))
    b = long.select("unit", "sensor", "ttf", F.row_number().over(by.orderBy(h, "cycle")).alias("__i"))
    return a.drop("ttf").join(b, ["unit", "sensor", "__i"]).drop("__i")


def consistency(rho: DataFrame) -> DataFrame:
    """(sensor, share, median): share of units with the majority's sign; units without rho are left out."""
    known = rho.where("rho is not null")
    r = known.groupBy("sensor").agg(F.avg((F.col("rho") > 0).cast("double")).alias("up"), F.avg((F.col("rho") < 0).cast("double")).alias("down"))
    return r.join(median(known, "rho", "median", ["sensor"]), "sensor").select("sensor", F.greatest("up", "down").alias("share"), "median")


def diff_noise(long: DataFrame) -> DataFrame:
    """(unit, sensor, sigma, ac1): deviation of first differences over sqrt(2), and their correlation one step apart."""
    w = Window.partitionBy(*KEYS).orderBy("cycle")
    d = long.withColumn("d", F.col("x") - F.lag("x").over(w)).where("d is not null").withColumn("p", F.lag("d").over(w))
    both = lambda c: F.when(F.col("p").isNotNull(), F.col(c))
    return d.groupBy(*KEYS).agg((F.stddev_samp("d") / F.sqrt(F.lit(2.0))).alias("sigma"), pearson(both("d"), both("p")).alias("ac1"))


def diff_shape(long: DataFrame) -> DataFrame:
    """(unit, skew, kurt): population skewness and excess kurtosis of the differences, averaged over sensors."""
    w = Window.partitionBy(*KEYS).orderBy("cycle")
    d = long.withColumn("d", F.col("x") - F.lag("x").over(w)).where("d is not null")
    per = d.groupBy(*KEYS).agg(F.skewness("d").alias("s"), F.kurtosis("d").alias("k"))
    return per.groupBy("unit").agg(F.avg("s").alias("skew"), F.avg("k").alias("kurt"))


def noise_growth(long: DataFrame, n: int) -> DataFrame:
    """(unit, growth): geometric mean over sensors of the differences' deviation in the last n over that in the first n."""
    w = Window.partitionBy(*KEYS).orderBy("cycle")
    d = long.withColumn("d", F.col("x") - F.lag("x").over(w)).where("d is not null")
    d = d.withColumns({"i": F.row_number().over(w), "m": F.count("*").over(Window.partitionBy(*KEYS))})
    dev = lambda c: F.stddev_samp(F.when(c, F.col("d")))
    per = d.groupBy(*KEYS).agg(dev(F.col("i") <= n).alias("early"), dev(F.col("i") > F.col("m") - n).alias("late"))
    return per.groupBy("unit").agg(F.exp(F.avg(F.ln(F.col("late") / F.nullif(F.col("early"), F.lit(0.0))))).alias("growth"))


def hinge(df: DataFrame, keys: list[str], y: str, least: int) -> DataFrame:
    """(keys, tau, b, at_start, rss, lin_rss, n, last, mean_y): the best flat-then-linear fit of each series.

    All change points with `least` points or more on each side are tried; sums over the points behind a change point are
    totals less running sums, so a series takes time in proportion to its length. Of equal fits the earliest is taken.
    """
    group = Window.partitionBy(*keys)
    run = group.orderBy("cycle").rowsBetween(Window.unboundedPreceding, 0)
    t, v = F.col("__t"), F.col("__y")
    # Times and values are taken from their means, which keeps the sums small.
    rows = df.select(*keys, "cycle", F.col(y).alias("__v")).withColumns({"__m": F.avg("__v").over(group), "__c": F.avg("cycle").over(group), "__n": F.count("*").over(group)})
    rows = rows.withColumns({"__t": F.col("cycle") - F.col("__c"), "__y": F.col("__v") - F.col("__m")})
    sums = {"s0": F.lit(1.0), "s1": t, "s2": t * t, "sy": v, "sty": t * v}
    rows = rows.withColumns({f"__{k}": F.sum(c).over(group) - F.sum(c).over(run) for k, c in sums.items()} | {
        "__yy": F.sum(v * v).over(group), "__txy": F.sum(t * v).over(group), "__txx": F.sum(t * t).over(group), "__i": F.row_number().over(group.orderBy("cycle"))})
    hs = F.col("__s1") - t * F.col("__s0")
    sxx = F.col("__s2") - 2 * t * F.col("__s1") + t * t * F.col("__s0") - hs * hs / F.col("__n")
    sxy = F.col("__sty") - t * F.col("__sy")
    tried = rows.where((F.col("__i") >= least) & (F.col("__i") <= F.col("__n") - least)).withColumns({"__sxx": sxx, "__sxy": sxy})
    b = ratio(F.col("__sxy"), F.col("__sxx"))
    tried = tried.select(*keys, F.col("cycle").alias("tau"), b.alias("b"), (F.col("__i") == least).alias("at_start"), (F.col("__yy") - F.coalesce(b * F.col("__sxy"), F.lit(0.0))).alias("rss"),
                         (F.col("__yy") - F.col("__txy") * F.coalesce(ratio(F.col("__txy"), F.col("__txx")), F.lit(0.0))).alias("lin_rss"), F.col("__n").alias("n"), F.col("__m").alias("mean_y"))
    best = tried.groupBy(*keys).agg(F.min_by(F.struct("tau", "b", "at_start", "rss", "lin_rss", "n", "mean_y"), F.struct(F.round("rss", 9), "tau")).alias("f"))
    last = df.groupBy(*keys).agg(F.max("cycle").alias("last"))
    return best.select(*keys, "f.*").join(last, keys)


def residual_ratio(df: DataFrame, keys: list[str], y: str, least: int) -> DataFrame:
    """(keys, ratio): deviation of the hinge's residuals in the last third over that in the first; null if either is 0."""
    fit = hinge(df, keys, y, least)
    group = Window.partitionBy(*keys)
    rows = df.select(*keys, "cycle", F.col(y).alias("__v")).join(fit.select(*keys, "tau", "b", "n"), keys)
    rows = rows.withColumns({"r": F.col("__v") - F.col("b") * F.greatest(F.col("cycle") - F.col("tau"), F.lit(0)), "i": F.row_number().over(group.orderBy("cycle"))})
    third = F.floor(F.col("n") / 3)
    dev = lambda c: F.stddev_samp(F.when(c, F.col("r")))
    g = rows.groupBy(*keys).agg(dev(F.col("i") <= third).alias("first"), dev(F.col("i") > F.col("n") - third).alias("last"))
    return g.select(*keys, F.when((F.col("first") > 0) & (F.col("last") > 0), F.col("last") / F.col("first")).alias("ratio"))


#: Correlations of ranks under this are 0 but for rounding: others are 3 / n ** 3 at least.
ZERO = 1e-12

#: Why a sign is undefined: in the unit itself, in another unit (the sensor can't be used in any), or as the correlation is 0.
NO_RHO, NO_RHO_ELSEWHERE, RHO_0 = "no correlation", "no correlation in another unit", "correlation of 0"


def signs(rho: DataFrame) -> DataFrame:
    """(unit, sensor, sign, problem): every row of rho; where a sign is undefined it is null, and problem says why."""
    whole = rho.groupBy("sensor").agg(F.bool_and(F.col("rho").isNotNull()).alias("__ok"))
    problem = F.when(F.col("rho").isNull(), NO_RHO).when(~F.col("__ok"), NO_RHO_ELSEWHERE).when(F.abs("rho") < ZERO, RHO_0)
    rows = rho.join(F.broadcast(whole), "sensor").withColumn("problem", problem)  # a row for each sensor
    return rows.select("unit", "sensor", F.when(F.col("problem").isNull(), F.signum("rho")).alias("sign"), "problem")


def flips(rho: DataFrame) -> DataFrame:
    """(unit, sensor, flip): the unit's sign differs from that of the sensor's median."""
    major = median(rho, "rho", "m", ["sensor"]).select("sensor", F.signum("m").alias("major"))
    return rho.where("rho is not null").join(F.broadcast(major), "sensor").select("unit", "sensor", (F.signum("rho") != F.col("major")).alias("flip"))


def flip_agreement(flip: DataFrame) -> DataFrame:
    """(a, b, agree, expected, excess) for pairs of sensors over units."""
    x = flip.select("unit", F.col("sensor").alias("a"), F.col("flip").cast("double").alias("fa"))
    y = flip.select("unit", F.col("sensor").alias("b"), F.col("flip").cast("double").alias("fb"))
    g = x.join(y, "unit").where("a < b").groupBy("a", "b").agg(F.avg((F.col("fa") == F.col("fb")).cast("double")).alias("agree"), F.avg("fa").alias("pa"), F.avg("fb").alias("pb"))
    expected = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return g.select("a", "b", "agree", expected.alias("expected"), (F.col("agree") - expected).alias("excess"))


def ecdf(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """(keys, value, share): counted by value before it is cumulated."""
    g = df.groupBy(*keys, F.col(column).alias("value")).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return g.select(*keys, "value", (F.sum("n").over(order) / F.sum("n").over(Window.partitionBy(*keys))).alias("share"))
