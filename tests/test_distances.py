"""Sums of distances by boxes: against all pairs, with rows far out, doubled, unknown and without end."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetmill.operators import distances as ds
from fleetmill.operators import models


def pairs(rows, q, c):
    """(sum of distances to the rows of label c, number of these); None if no distance is known."""
    mine = [r for r in rows if r[2] == c]
    d = [np.hypot(q[0] - r[0], q[1] - r[1]) for r in mine if r[0] is not None and r[1] is not None] if None not in q[:2] else []
    return (float(np.sum(d)) if d else None, len(mine))


@pytest.mark.parametrize("odd", [[], [(1e9, 3.0, 0), (1e9, 3.0, 1), (2.0, None, 1), (None, None, 2), (5.0, 5.0, 3)]])
def test_sums_by_boxes_are_those_of_all_pairs(spark, odd):
    r = np.random.default_rng(4)
    x = np.column_stack([r.exponential(40, 3000).round(2), r.normal(0, 30, 3000).round(1)])
    rows = [*odd, *((float(a), float(b), int(g)) for (a, b), g in zip(x, r.integers(0, 3, 3000), strict=True)), *[(7.0, 7.0, 1)] * 40]
    df = spark.createDataFrame([(i, *q) for i, q in enumerate(rows)], "id long, x double, y double, g int").repartition(4)
    got = ds.distance_sums(df, ["x", "y"], "g", F.col("id") % 50 < 5, [], 20).collect()
    seen = {}
    for q in got:
        seen.setdefault((q.x, q.y, q.g), q["__asked"])
        want, n = pairs(rows, (q.x, q.y), q["__c"])
        assert q["__n"] == n and (q["__s"] is None if want is None else q["__s"] == pytest.approx(want, rel=1e-11))
    assert sum(seen.values()) == sum(i % 50 < 5 for i in range(len(rows)))
    assert len(got) == len(seen) * len({g for _, _, g in rows})


def test_rows_without_end_are_compared_one_by_one(spark):
    rows = [(float(i % 37), float(i % 41), i % 2) for i in range(1000)]
    df = spark.createDataFrame([(i, *q) for i, q in enumerate([*rows, (float("inf"), 1.0, 1)])], "id long, x double, y double, g int")
    got = ds.distance_sums(df, ["x", "y"], "g", F.col("id") == 500, [], 10).collect()
    assert {q["__c"]: q["__s"] for q in got} == {0: pytest.approx(pairs(rows, rows[500], 0)[0]), 1: float("inf")}


def test_distances_that_are_worked_out_grow_slower_than_pairs():
    """Near rows and nodes that each row meets: of four times the rows some twice as many, and each of the rows is in one of the boxes."""
    met = []
    for n in (40_000, 160_000):
        x = np.random.default_rng(1).normal(size=(n, 2))
        b = ds._grown(x, 4 * n**0.5)
        box = b.of(x)
        size = np.bincount(box, minlength=len(b.dim))
        b.lo, b.hi = (np.full((len(b.dim), 2), v) for v in (np.inf, -np.inf))
        np.minimum.at(b.lo, box, x), np.maximum.at(b.hi, box, x)
        for c in reversed(np.nonzero(b.dim >= 0)[0]):
            b.lo[c], b.hi[c], size[c] = b.lo[b.kids[c]].min(0), b.hi[b.kids[c]].max(0), size[b.kids[c]].sum()
        b.weights = np.zeros(1)
        split = {c: b.split(c) for c in np.nonzero(b.dim < 0)[0]}
        assert all(size[near].sum() + size[apart].sum() == n for near, apart in split.values())
        met.append(np.mean([size[near].sum() + len(apart) * ds.NODES**2 for near, apart in (split[c] for c in box[::100])]))
    assert met[1] < 0.4 * 160_000 and met[1] < 2.5 * met[0]


def test_silhouette_is_that_of_pairs_beyond_one_box(spark, monkeypatch):
    monkeypatch.setattr(models, "BLOCK_ROWS", 30)
    r = np.random.default_rng(9)
    rows = [(i, float(a), float(b), int(g)) for i, ((a, b), g) in enumerate(zip(r.normal(size=(2000, 2)) + np.repeat([[0, 0], [4, 1]], 1000, axis=0), np.repeat([0, 1], 1000), strict=True))]
    got = models.silhouette(spark.createDataFrame(rows, "id long, x double, y double, g int"), ["x", "y"], "g", "id").first()
    x, g = np.array([q[1:3] for q in rows]), np.array([q[3] for q in rows])
    s = []
    for i in range(0, 2000, 50):
        d = np.hypot(*(x - x[i]).T)
        a, o = d[g == g[i]].sum() / 999, d[g != g[i]].mean()
        s.append((o - a) / max(a, o))
    assert got.n == 40 and got.silhouette == pytest.approx(np.mean(s), rel=1e-10)
