"""Sums of Euclidean distances from asked rows to all rows, by label, without comparing each with each.

Rows are dealt to boxes. A row's distances to the rows of its own box and of those nearby are added up one by one; a box
that lies apart stands for its rows by weights on a grid of Chebyshev nodes, which give the same sums but for about 1e-12
of a distance, less than what adding up as many doubles in another order changes. Every row is in its box's weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from numpy.polynomial.chebyshev import chebvander
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from fleetmill.sources.shared import written

#: Nodes of a box for each column; how far apart boxes are for them, in halves of the longest side: errors fall as 4.2 ** -NODES.
NODES, APART = 16, 2.0

#: Columns up to which boxes have nodes; with more, all distances are added up one by one.
COLUMNS = 2

#: Rows by which borders of boxes are placed, about. They decide the time that sums take and not the sums.
BORDER_ROWS = 100_000

#: Distances that are worked out at once, as many as fit a core's cache.
PAIRS = 1 << 16

_AT = np.cos((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES))
_BASE = chebvander(_AT, NODES - 1).T * np.r_[1.0, np.full(NODES - 1, 2.0)][:, None] / NODES


@dataclass
class Boxes:
    """The boxes of a key's rows: each is cut in two (kids) where column `dim` reaches `at`, or is not (dim < 0)."""

    dim: np.ndarray
    at: np.ndarray
    kids: np.ndarray
    labels: dict = field(default_factory=dict)  # by label: its place, number of rows and of those with all columns
    lo: np.ndarray | None = None
    hi: np.ndarray | None = None
    weights: np.ndarray | None = None  # by box, label and node

    def of(self, x: np.ndarray) -> np.ndarray:
        """The box of each row."""
        box = np.zeros(len(x), dtype=np.int32)
        while len(i := np.nonzero(self.dim[box] >= 0)[0]):
            c = box[i]
            box[i] = self.kids[c, (x[i, self.dim[c]] >= self.at[c]).astype(int)]
        return box

    def split(self, a: int) -> tuple[list[int], list[int]]:
        """(boxes near box a, whose rows are met one by one, and boxes apart, by their nodes); together they hold all rows."""
        near, apart, todo = [], [], [0]
        while todo:
            c = todo.pop()
            gap = np.sqrt((np.maximum(np.maximum(self.lo[c] - self.hi[a], self.lo[a] - self.hi[c]), 0.0) ** 2).sum())
            if self.weights is not None and 0 < gap < np.inf and gap >= APART * (self.hi[c] - self.lo[c]).max() / 2:
                apart.append(c)
            elif self.dim[c] >= 0:
                todo.extend(self.kids[c].tolist())
            else:
                near.append(c)
        return near, apart

    def nodes(self, c: int) -> list[np.ndarray]:
        """The nodes of a box, by column."""
        return [(a + b) / 2 + (b - a) / 2 * _AT for a, b in zip(self.lo[c], self.hi[c], strict=True)]


def _grown(rows: np.ndarray, most: float) -> Boxes:
    dim, at, kids = [], [], []

    def grow(x: np.ndarray) -> int:
        i = len(dim)
        dim.append(-1), at.append(0.0), kids.append((-1, -1))
        spread = np.ptp(x, axis=0) if len(x) > most and len(x) > 1 else np.zeros(1)
        if spread.max() > 0:
            d = int(spread.argmax())
            cut = max(np.median(x[:, d]), np.nextafter(x[:, d].min(), np.inf))
            left = x[:, d] < cut
            dim[i], at[i] = d, float(cut)
            kids[i] = (grow(x[left]), grow(x[~left]))
        return i

    grow(rows)
    return Boxes(np.array(dim), np.array(at), np.array(kids))


def _shares(x: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """(rows, nodes): how values in [lo, hi] are shared out to the nodes."""
    half = (hi - lo) / 2
    return chebvander((x - (lo + half)) / half if half > 0 else np.zeros(len(x)), NODES - 1) @ _BASE


def _dealt(shares: list[np.ndarray], w: np.ndarray) -> np.ndarray:
    """Weights of the nodes of all columns, in the order of `_grid`."""
    return shares[0].T @ w if len(shares) == 1 else (shares[0].T @ (w[:, None] * shares[1])).ravel()


def _grid(nodes: list[np.ndarray]) -> np.ndarray:
    return np.stack(np.meshgrid(*nodes, indexing="ij"), -1).reshape(-1, len(nodes))


def _points(t: pa.Table | pa.RecordBatch, columns: list[str]) -> np.ndarray:
    return np.column_stack([t.column(c).cast(pa.float64()).to_numpy(**({} if isinstance(t, pa.Table) else {"zero_copy_only": False})) for c in columns])


def _summed(q: np.ndarray, x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of each row of q, its distances to x's rows times w, added up."""
    out, sides, step = np.zeros((len(q), *w.shape[1:])), np.ascontiguousarray(x.T), max(1, PAIRS // max(len(x), 1))
    for i in range(0, len(q), step):
        square = 0.0
        for p, s in zip(q[i : i + step].T, sides, strict=True):
            d = np.subtract.outer(p, s)
            d *= d
            square += d
        out[i : i + step] = np.sqrt(square, out=square) @ w
    return out


def _keys(t: pa.Table | pa.RecordBatch, keys: list[str]) -> list[tuple]:
    return list(zip(*(t.column(k).to_pylist() for k in keys), strict=True)) if keys else [()] * t.num_rows


def _weights(boxes: dict[tuple, Boxes], rows: DataFrame, columns: list[str], label: str, keys: list[str], tasks: int) -> None:
    """Every box's sides and its nodes' weights: those of uncut boxes from their rows, within tasks, the others' from these."""
    sides = rows.where("__box >= 0").groupBy(*keys, "__box").agg(*[f(c) for c in columns for f in (F.min, F.max)]).collect()  # a row for each box
    for b in boxes.values():
        b.lo, b.hi = np.full((len(b.dim), len(columns)), np.inf), np.full((len(b.dim), len(columns)), -np.inf)
    for r in sides:
        b, at = boxes[tuple(r[: len(keys)])], len(keys)
        b.lo[r[at]], b.hi[r[at]] = r[at + 1 :: 2], r[at + 2 :: 2]
    for b in boxes.values():
        for c in reversed(np.nonzero(b.dim >= 0)[0]):
            b.lo[c], b.hi[c] = b.lo[b.kids[c]].min(0), b.hi[b.kids[c]].max(0)
    if len(columns) > COLUMNS or max(len(b.dim) for b in boxes.values()) == 1:
        return
    known = rows.sparkSession.sparkContext.broadcast(boxes)

    def of(key: tuple, t: pa.Table) -> pa.Table:
        *k, c = (x.as_py() for x in key)
        b, x, w = known.value[tuple(k)], _points(t, columns), t.column("__w").to_numpy().astype(float)
        place, out = np.array([b.labels[v][0] for v in t.column(label).to_pylist()]), []
        for p in range(len(b.labels)):
            mine = place == p
            out.append(_dealt([_shares(x[mine, j], b.lo[c, j], b.hi[c, j]) for j in range(len(columns))], w[mine]))
        return pa.table({**{n: pa.array([v], t.schema.field(n).type) for n, v in zip(keys, k, strict=True)}, "__box": pa.array([c], pa.int32()), "__weights": pa.array([np.concatenate(out)], pa.list_(pa.float64()))})

    kinds = "".join(f"{k} {rows.schema[k].dataType.simpleString()}, " for k in keys)
    finite = reduce(lambda a, c: a & (F.abs(c) < float("inf")), columns, F.lit(True))
    of_rows = rows.where(F.col("__box") >= 0).where(finite).repartition(tasks, *keys, "__box").groupBy(*keys, "__box").applyInArrow(of, f"{kinds}__box int, __weights array<double>")
    for b in boxes.values():
        b.weights = np.zeros((len(b.dim), len(b.labels), NODES ** len(columns)))
    for r in of_rows.toArrow().to_pylist():  # a row for each box, of NODES ** COLUMNS numbers for each label at most
        b = boxes[tuple(r[k] for k in keys)]
        b.weights[r["__box"]] = np.array(r["__weights"]).reshape(len(b.labels), -1)
    for b in boxes.values():
        for c in reversed(np.nonzero(b.dim >= 0)[0]):
            for kid in b.kids[c]:
                if np.isfinite(b.hi[c] - b.lo[c]).all():
                    one = [_shares(n, lo, hi) for n, lo, hi in zip(b.nodes(kid), b.lo[c], b.hi[c], strict=True)]
                    each = b.weights[kid].reshape(len(b.labels), *[NODES] * len(columns))
                    b.weights[c] += np.array([s.T @ w if len(one) == 1 else (s.T @ w @ one[1]).ravel() for w in each for s in one[:1]])


def distance_sums(df: DataFrame, columns: list[str], label: str, asked: Column, keys: list[str], box_rows: int) -> DataFrame:
    """(keys, columns, label, __asked, __c, __s, __n): of the asked rows, the sums of distances to their key's rows by label __c, and numbers of these.

    Equal rows are one, with their number (__asked: of those asked for). A box has about `box_rows` rows at most, of many
    rows four times their root: what every task and the driver hold (the boxes' weights) and a box's rows grow as that root,
    time as the rows' power of 1.5 at most. A sum is null where no distance is known.
    """
    spark, all_of = df.sparkSession, [*keys, label, *columns]
    known = reduce(lambda a, c: a & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")), columns, F.lit(True))
    rows = written(df.groupBy(*all_of).agg(F.count("*").alias("__w"), F.count_if(asked).alias("__asked")), "points")
    totals = rows.groupBy(*keys, label).agg(F.count_if(known).alias("points"), F.sum("__w").alias("n"), F.sum(F.when(known, F.col("__w")).otherwise(0)).alias("known")).collect()  # a row for each label
    n = sum(r.points for r in totals)
    share, most = max(1, n // BORDER_ROWS), max(box_rows, 4 * n**0.5)
    finite = reduce(lambda a, c: a & (F.abs(c) < float("inf")), columns, known)
    few = rows.where(finite & (F.pmod(F.xxhash64(*columns), F.lit(share)) == 0)).select(*keys, *columns).toArrow()
    borders = {}
    for k, x in zip(_keys(few, keys), _points(few, columns), strict=True):
        borders.setdefault(k, []).append(x)
    boxes = {k: _grown(np.array(borders.get(k) or np.zeros((0, len(columns)))), most / share) for k in {tuple(r[: len(keys)]) for r in totals}}
    for r in totals:
        b = boxes[tuple(r[: len(keys)])]
        b.labels[r[len(keys)]] = (len(b.labels), r.n, r.known)
    if not boxes:
        boxes[()] = _grown(np.zeros((0, len(columns))), most)
    placed = spark.sparkContext.broadcast({k: Boxes(b.dim, b.at, b.kids) for k, b in boxes.items()})

    def boxed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, box = _points(b, columns), np.full(b.num_rows, -1, dtype=np.int32)
            at: dict[tuple, list[int]] = {}
            for i, k in enumerate(_keys(b, keys)):
                at.setdefault(k, []).append(i)
            for k, i in at.items():
                mine = np.array(i)[~np.isnan(x[i]).any(1)]
                box[mine] = placed.value[k].of(x[mine])
            yield from pa.Table.from_batches([b]).append_column("__box", pa.array(box)).to_batches()

    rows = written(rows.mapInArrow(boxed, StructType([*rows.schema.fields, StructField("__box", IntegerType())])), "boxed")
    tasks = max(spark.sparkContext.defaultParallelism, sum(len(b.dim) for b in boxes.values()) // 16)
    _weights(boxes, rows, columns, label, keys, tasks)
    held = spark.sparkContext.broadcast(boxes)

    def to_boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near: dict[tuple, list[int]] = {}
        for b in batches:
            at, box, home = [], [], b.column("__box").to_pylist()
            for i, (k, c) in enumerate(zip(_keys(b, keys), home, strict=True)):
                if (k, c) not in near:
                    near[k, c] = [c, *(x for x in held.value[k].split(c)[0] if x != c)] if c >= 0 else [c]
                at += [i] * len(near[k, c])
                box += near[k, c]
            t = pa.Table.from_batches([b]).take(pa.array(at, pa.int64()))
            yield from t.rename_columns(["__home" if x == "__box" else x for x in t.column_names]).append_column("__box", pa.array(box, pa.int32())).to_batches()

    def sums(key: tuple, t: pa.Table, q: pa.Table) -> pa.Table:
        *k, box = (x.as_py() for x in key)
        b, at = held.value[tuple(k)], _points(q, columns) if q.num_rows else np.zeros((0, len(columns)))
        mine = q.column("__home").to_numpy() == box if q.num_rows else np.zeros(0, bool)
        values, x = t.column(label).to_pylist() if q.num_rows else [], _points(t, columns)
        w, labels = t.column("__w").to_numpy().astype(float), np.array([b.labels[v][0] for v in values], dtype=int)
        far = np.zeros((len(at), len(b.labels)))
        if box >= 0 and mine.any() and (apart := b.split(box)[1]):
            weights = np.concatenate([b.weights[c].T for c in apart])
            far[mine] = _summed(at[mine], np.concatenate([_grid(b.nodes(c)) for c in apart]), weights)
        out = []
        for v, (p, n_all, n_known) in b.labels.items():
            here = labels == p
            asks = np.ones(len(at), bool) if box >= 0 and here.any() else mine
            if asks.any():
                s = far[asks, p] + (_summed(at[asks], x[here], w[here]) if box >= 0 else np.nan)
                part = q.filter(pa.array(asks)).select([*all_of, "__asked"]).append_column("__c", pa.array([v] * int(asks.sum()), q.schema.field(label).type))
                out.append(part.append_column("__s", pa.array(s, mask=np.isnan(s) | (n_known == 0))).append_column("__n", pa.array(np.where(mine[asks], n_all, 0))))
        return pa.concat_tables(out) if out else pa.Table.from_pylist([], schema=nothing)

    asks = rows.where("__asked > 0").select(*all_of, "__asked", "__box")
    exploded = asks.mapInArrow(to_boxes, StructType([*(f if f.name != "__box" else StructField("__home", IntegerType()) for f in asks.schema.fields), StructField("__box", IntegerType())]))
    out_of = StructType([*(rows.schema[c] for c in [*all_of, "__asked"]), StructField("__c", rows.schema[label].dataType), StructField("__s", DoubleType()), StructField("__n", LongType())])
    nothing = to_arrow_schema(out_of)
    by_rows, by_asked = (d.repartition(tasks, *keys, "__box").groupBy(*keys, "__box") for d in (rows, exploded))
    parts = by_rows.cogroup(by_asked).applyInArrow(sums, out_of)
    return parts.groupBy(*all_of, "__asked", "__c").agg(F.sum("__s").alias("__s"), F.sum("__n").alias("__n"))
