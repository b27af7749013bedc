"""Connected components of a table of links, by hooking to the least neighbour and halving the paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for every node of a link, the least node that links reach.

    Each round hooks every root to its least neighbour, follows the hooks to their ends and draws the links
    between what is left; every table goes through the shared folder. Self-links, repeated links and either
    direction are allowed; no links give no rows.
    """
    def drawn(x: str, y: str) -> list:
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    left = written(links.where(F.col(a) != F.col(b)).select(*drawn(a, b)).distinct())
    label = None
    while not left.isEmpty():
        both = left.select(F.col("a").alias("x"), F.col("b").alias("y")).union(left.select(F.col("b"), F.col("a")))
        hook = written(both.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("p")))
        while True:
            up = hook.select(F.col("x").alias("p"), F.col("p").alias("pp"))
            step = written(hook.join(up, "p").select("x", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")))
            hook = step.select("x", "p")
            if step.where("moved").isEmpty():
                break
        if label is None:
            label = hook
        else:
            label = written(label.join(hook.select(F.col("x").alias("p"), F.col("p").alias("pp")), "p", "left").select("x", F.coalesce("pp", "p").alias("p")))
        at_a = hook.select(F.col("x").alias("a"), F.col("p").alias("pa"))
        at_b = hook.select(F.col("x").alias("b"), F.col("p").alias("pb"))
        left = written(left.join(at_a, "a").join(at_b, "b").where("pa <> pb").select(*drawn("pa", "pb")).distinct())
    if label is None:
        label = left.select(F.col("a").alias("x"), F.col("b").alias("p"))
    return label.select(F.col("x").alias("node"), F.col("p").alias("component"))
