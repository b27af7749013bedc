"""Column expressions: buckets, clips, guarded ratios, unpivoting, trailing windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

UNIT = ("dataset", "unit")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def r6(x: Column | str) -> Column:
    return F.round(col(x), 6)


def bucket(value: Column | str, buckets: list[tuple[str, float, float | None]]) -> Column:
    """The name of the bucket [low, high) of a value; buckets must be contiguous from 0 to no end."""
    edges = [lo for _, lo, _ in buckets] + [buckets[-1][2]]
    if edges[0] != 0 or edges[-1] is not None or any(hi != nxt for (_, _, hi), nxt in zip(buckets[:-1], edges[1:-1], strict=True)):
        raise ValueError("buckets must be contiguous from 0 to no end")
    v, out = col(value), F.lit(None).cast("string")
    for name, lo, hi in buckets[::-1]:
        out = F.when(v.isNotNull(), name) if hi is None else F.when((v >= lo) & (v < hi), name).otherwise(out)
    return out


def clip(value: Column | str, cap: float) -> Column:
    return F.least(F.greatest(col(value), F.lit(0.0)), F.lit(float(cap)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null if b is 0."""
    return a / F.nullif(b, F.lit(0.0))


def unpivot(df: DataFrame, keys: list[str], values: list[str], name: str = "sensor", value: str = "x") -> DataFrame:
    return df.select(*keys, F.stack(F.lit(len(values)), *[x for v in values for x in (F.lit(v), F.col(v))]).alias(name, value))


def by_cycle(*more: str) -> WindowSpec:
    return Window.partitionBy(*UNIT, *more).orderBy("cycle")


def trailing(n: int, *more: str) -> WindowSpec:
    return by_cycle(*more).rowsBetween(-(n - 1), 0)


def pearson(x: Column, y: Column) -> Column:
    """Correlation as an aggregate; null if either side is constant."""
    return ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def _let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with value worked out once."""
    return F.transform(F.array(value), of)[0]


def fused(a: Column | float, b: Column | float, c: Column | float) -> Column | float:
    """a * b + c from the exact product, as a fused multiply-add gives it; for numbers, and for columns that are no long expressions."""
    halves = lambda x: (x * 134217729.0 - (x * 134217729.0 - x), x - (x * 134217729.0 - (x * 134217729.0 - x)))
    (ah, al), (bh, bl), p = halves(a), halves(b), a * b
    s = p + c
    z = s - p
    return s + ((p - (s - z)) + (c - z) + (((ah * bh - p) + ah * bl + al * bh) + al * bl))


def slope(y: Column | str, x: Column | str, w: WindowSpec) -> Column:
    """The slope of y over x in a window's rows, in their order: regr_slope with products that are added before they are rounded.

    DuckDB's build has these fused. The last digits decide the bucket of a prediction that lies on an edge.
    """
    points = F.filter(F.collect_list(F.struct(col(x).cast("double").alias("x"), col(y).cast("double").alias("y"))).over(w), lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    state = lambda **cells: F.struct(*[(F.lit(v) if isinstance(v, float) else v).alias(k) for k, v in cells.items()])

    def add(s: Column, p: Column) -> Column:
        moved = lambda q: state(n=q["n"], dx=q["dx"], mx=s["mx"] + q["dx"] / q["n"], my=s["my"] + q["dy"] / q["n"])
        left = lambda q: state(n=q["n"], mx=q["mx"], my=q["my"], dx=q["dx"], r=p["y"] - q["my"], sq=s["sq"] + q["dx"] * (p["x"] - q["mx"]))
        after = lambda q: state(n=q["n"], mx=q["mx"], my=q["my"], co=fused(q["dx"], q["r"], s["co"]), sq=q["sq"])
        return _let(state(n=s["n"] + 1.0, dx=p["x"] - s["mx"], dy=p["y"] - s["my"]), lambda q: _let(moved(q), lambda v: _let(left(v), after)))

    return F.aggregate(points, state(n=0.0, mx=0.0, my=0.0, co=0.0, sq=0.0), add, lambda s: F.when(s["sq"] != 0, (s["co"] / s["n"]) / (s["sq"] / s["n"])))
