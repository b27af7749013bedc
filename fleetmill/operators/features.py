"""Features of cycles: regimes, within-regime scores, causal windows, envelopes; state is kept in small tables.

Every function that fits returns a state table; the one that applies takes it, so held-out units meet training state.
Windows look back only, within one unit.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from fleetmill.functions.columns import UNIT, by_cycle, trailing, unpivot


def op_scaler(df: DataFrame, ops: list[str]) -> DataFrame:
    """(op, mean, std): population deviation; a constant setting is divided by 1."""
    wide = df.agg(*[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c) for c in ops])
    rows = unpivot(wide, [], ops, "op", "s")
    return rows.select("op", "s.mean", F.when(F.col("s.std") == 0, 1.0).otherwise(F.col("s.std")).alias("std"))


def _one_row(state: DataFrame, key: str, values: list[str], names: list[str]) -> DataFrame:
    """A state table of one row for each key, as a single row of <key>_<value> columns."""
    return state.agg(*[F.max(F.when(F.col(key) == n, F.col(v))).alias(f"__{n}_{v}") for n in names for v in values])


def op_standardize(df: DataFrame, scaler: DataFrame, ops: list[str]) -> DataFrame:
    one = F.broadcast(_one_row(scaler, "op", ["mean", "std"], ops))  # a single row
    rows = df.join(one, F.lit(True))
    return rows.withColumns({f"{c}_z": (F.col(c) - F.col(f"__{c}_mean")) / F.col(f"__{c}_std") for c in ops}).drop(*one.columns)


def nearest_centroid(point: list[Column], centroids: list[list[float]]) -> Column:
    """The number of the nearest of a few centroids; of equally near ones the first."""
    dist = [reduce(lambda a, b: a + b, [(p - F.lit(x)) * (p - F.lit(x)) for p, x in zip(point, c, strict=True)]) for c in centroids]
    least = F.least(*dist) if len(dist) > 1 else dist[0]
    return reduce(lambda acc, i: F.when(dist[i] == least, i).otherwise(acc), range(len(dist) - 1, -1, -1), F.lit(None).cast("int"))


def lloyd(df: DataFrame, ops: list[str], start: list[list[float]], rounds: int) -> list[list[float]]:
    """Centroids after a fixed number of rounds from a fixed start; a centroid without rows stays. Only centroids reach the driver."""
    centres = [list(map(float, c)) for c in start]
    for _ in range(rounds):
        rows = df.withColumn("__k", nearest_centroid([F.col(c) for c in ops], centres)).groupBy("__k").agg(*[F.avg(c).alias(c) for c in ops]).collect()
        for r in rows:
            centres[r["__k"]] = [r[c] for c in ops]
    return centres


def regime_norm(df: DataFrame, sensors: list[str], regime: str = "regime") -> DataFrame:
    """(regime, sensor, mean, std, n): sample deviation."""
    g = df.groupBy(regime).agg(F.count("*").alias("n"), *[F.struct(F.avg(s).alias("mean"), F.stddev_samp(s).alias("std")).alias(s) for s in sensors])
    return unpivot(g, [regime, "n"], sensors, value="m").select(regime, "sensor", "m.mean", "m.std", "n")


def refuse_degenerate(state: DataFrame) -> DataFrame:
    """The state; reading a row of a constant sensor or a regime of fewer than two rows is an error."""
    bad = (F.col("n") < 2) | F.col("std").isNull() | (F.col("std") == 0)
    return state.withColumn("std", F.when(~bad, F.col("std")).otherwise(F.raise_error(F.format_string("sensor %s can't be normalised in regime %s", "sensor", F.col("regime").cast("string"))).cast("double")))


def zscore(df: DataFrame, state: DataFrame, sensors: list[str], regime: str = "regime") -> DataFrame:
    """<s>_n for each sensor by the state of the row's regime; a regime without state is an error."""
    wide = state.groupBy(regime).pivot("sensor", sensors).agg(F.first("mean").alias("mean"), F.first("std").alias("std"))
    wide = wide.withColumn("__known", F.lit(True))
    rows = df.join(F.broadcast(wide), regime, "left")  # one row for each of a few regimes
    fail = F.raise_error(F.concat(F.lit("no state for regime "), F.col(regime).cast("string"))).cast("double")
    score = lambda s: F.when(F.col("__known"), (F.col(s) - F.col(f"{s}_mean")) / F.col(f"{s}_std")).otherwise(fail)
    return rows.withColumns({f"{s}_n": score(s) for s in sensors}).drop("__known", *[f"{s}_{v}" for s in sensors for v in ("mean", "std")])


def zscore_masked(df: DataFrame, sensors: list[str], regime: str = "regime") -> DataFrame:
    """Scores by the rows' own regime; 0 where a sensor has one value in it. Statistics are aggregated, then joined."""
    g = df.groupBy(regime).agg(*[F.struct(F.avg(s).alias("m"), F.stddev_samp(s).alias("d"), (F.min(s) == F.max(s)).alias("one")).alias(f"__{s}") for s in sensors])
    rows = df.join(F.broadcast(g), regime)  # one row for each of a few regimes
    return rows.withColumns({f"{s}_n": F.when(F.col(f"__{s}.one"), 0.0).otherwise((F.col(s) - F.col(f"__{s}.m")) / F.nullif(F.col(f"__{s}.d"), F.lit(0.0))) for s in sensors}).drop(*[f"__{s}" for s in sensors])


def one_hot(df: DataFrame, regimes: list, regime: str = "regime") -> DataFrame:
    return df.withColumns({f"regime_{i}": (F.col(regime) == r).cast("double") for i, r in enumerate(regimes)})


def rolling(df: DataFrame, columns: list[str], window: int) -> DataFrame:
    """<c>_mean and <c>_slope over the last `window` cycles, fewer at the start; the slope of a single cycle is 0."""
    w = trailing(window)
    slope = lambda c: F.coalesce(F.regr_slope(F.col(c), F.col("cycle")).over(w), F.lit(0.0))
    return df.withColumns({f"{c}_mean": F.avg(c).over(w) for c in columns} | {f"{c}_slope": slope(c) for c in columns})


#: A smoother: a column over a window of a unit's cycles.
Smoother = Callable[[Column, WindowSpec], Column]


def smoothed(df: DataFrame, columns: list[str], smoothers: dict[str, Smoother], window: int) -> DataFrame:
    """df with <column>_<name> for every column and smoother, over the same trailing window, so in one pass of its sorted rows.

    A smoother gets the column and the window of the last `window` cycles; of it, it may use the partition and order only.
    """
    w = trailing(window)
    return df.withColumns({f"{c}_{name}": fn(F.col(c), w) for c in columns for name, fn in smoothers.items()})


def rolling_spread(df: DataFrame, column: str, window: int) -> DataFrame:
    w = trailing(window)
    return df.withColumns({f"{column}_std": F.stddev_samp(column).over(w), f"{column}_min": F.min(column).over(w), f"{column}_max": F.max(column).over(w)})


def ewm_mean(df: DataFrame, column: str, span: float, rows: int = 200) -> DataFrame:
    """The adjusted exponentially weighted mean; older than `rows` cycles weighs under 1e-11 for spans to 15."""
    keep = 1 - 2 / (span + 1)
    w = trailing(rows)
    back = F.collect_list(F.col(column)).over(w)
    weighted = lambda v: F.aggregate(v, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("n")), lambda a, x: F.struct((a["s"] * keep + x).alias("s"), (a["n"] * keep + 1).alias("n")))
    done = df.withColumn("__b", back).withColumn("__e", weighted(F.col("__b")))
    return done.withColumn(f"{column}_ewm", F.col("__e.s") / F.col("__e.n")).drop("__b", "__e")


def baseline_deviation(df: DataFrame, column: str, first: int, window: int) -> DataFrame:
    """<c>_base: mean of the cycles 1..min(t, first); <c>_dev: trailing mean less the base."""
    so_far = by_cycle().rowsBetween(Window.unboundedPreceding, 0)
    base = F.avg(F.when(F.col("cycle") <= first, F.col(column))).over(so_far)
    return df.withColumn(f"{column}_base", base).withColumn(f"{column}_dev", F.avg(column).over(trailing(window)) - F.col(f"{column}_base"))


def health_index(df: DataFrame, component: dict[str, tuple[float, float]], window: int) -> DataFrame:
    """hi = sum of (z - mean) * loading over the sensors, with its trailing mean and slope."""
    hi = reduce(lambda a, b: a + b, [(F.col(s) - m) * load for s, (m, load) in component.items()])
    return rolling(df.withColumn("hi", hi), ["hi"], window)


def early_summary(df: DataFrame, sensors: list[str], n: int) -> DataFrame:
    """Mean and slope of each sensor over cycles 1..n, a row for each unit that has them all."""
    from fleetmill.operators.labels import first_n

    return first_n(df, n).groupBy(*UNIT).agg(*[x for s in sensors for x in (F.avg(s).alias(f"{s}_mean"), F.regr_slope(F.col(s), F.col("cycle")).alias(f"{s}_slope"))])


def avg_rank(df: DataFrame, column: str, *within: str) -> Column:
    """The rank of a value among its group's, ties sharing the average."""
    group = Window.partitionBy(*within)
    return F.rank().over(group.orderBy(column)) + (F.count("*").over(Window.partitionBy(*within, column)) - 1) / 2


def sequences(df: DataFrame, columns: list[str], length: int) -> DataFrame:
    """seq: the last `length` rows of columns, padded in front with the first of them; mask: 1 for a row, 0 for padding."""
    w = trailing(length)
    rows = df.withColumn("__w", F.collect_list(F.array(*[F.col(c).cast("float") for c in columns])).over(w))
    lack = F.lit(length) - F.size("__w")
    return rows.withColumn("seq", F.concat(F.array_repeat(F.get("__w", 0), lack), "__w")).withColumn(
        "mask", F.concat(F.array_repeat(F.lit(0), lack), F.array_repeat(F.lit(1), F.size("__w")))).drop("__w")


def envelope_fit(df: DataFrame, sensors: list[str], distance: str, regime: str = "regime") -> DataFrame:
    """(regime, radius, <s>_lo, <s>_hi): how far training rows went."""
    return df.groupBy(regime).agg(F.max(distance).alias("radius"), *[x for s in sensors for x in (F.min(s).alias(f"{s}_lo"), F.max(s).alias(f"{s}_hi"))])


def envelope_check(df: DataFrame, state: DataFrame, sensors: list[str], distance: str, margin: float, regime: str = "regime") -> DataFrame:
    """(unit, cycle, reason): a row for each way in which a row leaves the envelope; its edge is inside."""
    rows = df.join(F.broadcast(state), regime, "left")  # one row for each of a few regimes
    room = lambda s: margin * (F.col(f"{s}_hi") - F.col(f"{s}_lo"))
    reasons = [F.when(F.col("radius").isNull(), "unseen regime"), F.when(F.col(distance) > F.col("radius") * (1 + margin), "settings")]
    reasons += [F.when((F.col(s) < F.col(f"{s}_lo") - room(s)) | (F.col(s) > F.col(f"{s}_hi") + room(s)), s) for s in sensors]
    return rows.select("unit", "cycle", F.explode(F.filter(F.array(*reasons), lambda r: r.isNotNull())).alias("reason"))
