"""Batch and streaming scoring of units' cycles: per-unit state, one scored row for each new cycle."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from fleetmill.functions.columns import bucket, by_cycle, clip, fused, slope, trailing

SCORED = "unit long, cycle long, level double, slope double, n_cycles_used int"


#: A row's time as a number: pandas shows times in the session's zone, timers and watermarks are in UTC.
CLOCK = "__clock"

#: The number of a row's group of keys.
GROUP = "__group"


def _ms(span: str) -> int:
    return pd.Timedelta(span) // pd.Timedelta(milliseconds=1)


def level_and_slope(held: list) -> tuple[float, float]:
    """Mean and slope of (cycle, value) pairs, by the running sums of avg and `slope` in their order.

    Their last digits decide the bucket of a prediction that lies on an edge, so they must be those of a batch.
    """
    n = total = mc = mx = co = sq = 0.0
    for c, x in held:
        n, total, dc, dx = n + 1, total + x, c - mc, x - mx
        mc, mx, sq = mc + dc / n, mx + dx / n, sq + dc * (c - (mc + dc / n))
        co = fused(dc, x - mx, co)
    return total / n, (co / n) / (sq / n) if sq else 0.0


class TrailingFeatures(StatefulProcessor):
    """A unit's last cycles in two lists: those counted, as far as windows reach back, and those that wait for earlier ones."""

    def __init__(self, sensor: str, window: int, timed: bool, idle: int):
        self.sensor, self.window, self.timed, self.idle = sensor, window, timed, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        cells = "cycle long, value double"
        self.held = handle.getListState("held", cells)
        self.waiting = handle.getListState("waiting", cells)
        self.seen = handle.getValueState("seen", "n int")

    def _count(self, unit: int, held: list, waiting: dict, gaps: bool) -> pd.DataFrame:
        """Takes from the waiting cycles those whose turn it is, or all of them, and writes the state."""
        seen = self.seen.get()[0] if self.seen.exists() else 0
        out = []
        for c in sorted(waiting):
            if not gaps and c != (held[-1][0] if held else 0) + 1:
                break
            held = [*held, (c, waiting.pop(c))][-self.window :]
            seen += 1
            out.append((unit, c, *level_and_slope(held), seen))
        if held:
            self.held.put(held)
            self.seen.update((seen,))
        if waiting:
            self.waiting.put(sorted(waiting.items()))
        else:
            self.waiting.clear()
        return pd.DataFrame(out, columns=["unit", "cycle", "level", "slope", "n_cycles_used"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, waiting = list(self.held.get()), dict(self.waiting.get())
        last = held[-1][0] if held else 0
        until = 0
        for frame in rows:
            waiting.update((int(c), float(x)) for c, x in zip(frame["cycle"], frame[self.sensor], strict=True) if c > last)
            if self.timed:
                until = max(until, int(frame.iloc[:, -1].max()) + self.idle)  # the clock; computed columns come without their names
        if self.timed:
            old = list(self.handle.listTimers())
            if not old or until > max(old):
                for t in old:
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(until)
        yield self._count(int(key[0]), held, waiting, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = self._count(int(key[0]), list(self.held.get()), dict(self.waiting.get()), True)
        for state in (self.held, self.waiting, self.seen):
            state.clear()
        yield out

    def close(self) -> None:
        pass


class InOrder(StatefulProcessor):
    """Rows of a key, or of a group of keys, held until the watermark passes their time, then given out in order. One timer: the earliest row's."""

    def __init__(self, key: str, order: str, names: list[str], kept: StructType):
        self.key, self.order, self.names, self.kept = key, order, names, kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.kept)
        self.given = handle.getListState("given", StructType([self.kept[self.key]]).add("n", "long"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = []
        for frame in rows:
            frame = frame.set_axis(self.names, axis=1)  # computed columns come without their names
            first.append(int(frame[CLOCK].min()) // 1000)
            self.held.appendList(list(frame[self.kept.names].astype(object).itertuples(index=False, name=None)))
        timers = list(self.handle.listTimers())
        if not timers or min(first) < min(timers):
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(min(first))
        yield pd.DataFrame({c: [] for c in [*self.kept.names, "place"]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark, own, clock, order = timerValues.getCurrentWatermarkInMs(), *(self.kept.names.index(c) for c in (self.key, CLOCK, self.order))
        rows = sorted(self.held.get(), key=lambda r: (r[clock], r[order]))
        n, places = dict(self.given.get()), []
        ready = [r for r in rows if r[clock] // 1000 <= mark]
        rest = rows[len(ready) :]
        for r in ready:
            n[r[own]] = n.get(r[own], 0) + 1
            places.append(n[r[own]])
        self.given.put(list(n.items()))
        if rest:
            self.held.put(rest)
            self.handle.registerTimer(rest[0][clock] // 1000)  # the timer that has expired goes by itself
        else:
            self.held.clear()
        yield pd.DataFrame(ready, columns=self.kept.names).assign(place=places)

    def close(self) -> None:
        pass


def batch_features(df: DataFrame, sensor: str, window: int) -> DataFrame:
    """(unit, cycle, level, slope, n_cycles_used) of every cycle: trailing mean and slope."""
    w = trailing(window)
    return df.select("unit", "cycle", F.avg(sensor).over(w).alias("level"), F.coalesce(slope(sensor, "cycle", w), F.lit(0.0)).alias("slope"),
                     F.row_number().over(by_cycle()).alias("n_cycles_used"))


def scored(features: DataFrame, weights: tuple[float, float, float], cap: float, least: int, buckets: list) -> DataFrame:
    """Predictions of a linear model, clipped, with bucket and flag; histories under the least length are rejected with a reason."""
    b, wl, ws = weights
    pred = clip(F.lit(b) + wl * F.col("level") + ws * F.col("slope"), cap)
    short = F.col("n_cycles_used") < least
    out = features.withColumn("predicted_rul", F.when(~short, pred)).withColumn("reject", F.when(short, "short history"))
    return out.withColumn("rul_at_cap", F.col("predicted_rul") >= cap).withColumn("bucket", bucket("predicted_rul", buckets))


def stream_features(cycles: DataFrame, sensor: str, window: int, time: str | None = None, idle: str = "1 hour") -> DataFrame:
    """The same features from a stream of cycles (unit, cycle, sensor): a unit's state is its last `window` cycles.

    A unit's cycles count from 1 without gaps; one that comes before those that precede it waits in the state for them,
    in whichever batch they come, and one that was counted already is dropped. With time (a watermarked column), a unit
    whose watermark passes its last row by `idle` has its waiting cycles counted without those that lack, and is forgotten.
    """
    mode = "EventTime" if time else "None"
    rows = cycles.select("unit", "cycle", sensor, *([time, F.unix_millis(time).alias(CLOCK)] if time else []))
    return rows.groupBy("unit").transformWithStateInPandas(TrailingFeatures(sensor, window, bool(time), _ms(idle)), SCORED, "Append", mode)


def in_order(rows: DataFrame, key: str, time: str, order: str, groups: int | None = None) -> DataFrame:
    """rows (a stream with a watermark on time) with their place among those of their key, from 1, by time and `order`.

    A row is held until the watermark passes its time; then nothing earlier can come any more. Rows that come later than
    that are dropped by the watermark and counted by it (see `drain`). Repeated rows keep their number.
    groups: a state for each of so many groups of keys, the same in all runs, instead of one for each key: a call for each
    of many small keys takes far longer than its rows.
    """
    kept = StructType([rows.schema[key], *(f for f in rows.schema if f.name not in (key, time))]).add(CLOCK, "long")
    out = StructType([*kept]).add("place", "long")
    clocked = rows.withColumn(CLOCK, F.unix_micros(time))
    clocked = clocked.withColumn(GROUP, F.pmod(F.xxhash64(key), F.lit(groups))) if groups else clocked
    held = clocked.groupBy(GROUP if groups else key).transformWithStateInPandas(InOrder(key, order, clocked.columns, kept), out, "Append", "EventTime")
    return held.select(*[F.timestamp_micros(CLOCK).alias(c) if c == time else F.col(c) for c in rows.columns], "place")


def deduplicated(events: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    """A stream without repeated keys; rows later than the watermark are dropped, state older than it is freed."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def bucket_alerts(scores: DataFrame, time: str, every: str) -> DataFrame:
    """(start, bucket, n): the fleet's counts by bucket in tumbling windows; works on a batch or a watermarked stream."""
    return scores.groupBy(F.window(time, every).alias("w"), "bucket").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "bucket", "n")


def drain(stream: DataFrame, folder: str, mode: str = "append") -> int:
    """Runs a stream over what is there now into Parquet below folder; gives the number of rows that came too late for its watermark."""
    conf, provider = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(provider)
    conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # a query keeps what it is started with
    try:
        q = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start(f"{folder}/out")
    finally:
        conf.set(provider, before)
    q.awaitTermination()
    return sum(o.numRowsDroppedByWatermark for p in q.recentProgress for o in p.stateOperators)


def drained(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now, and reads what came out so far."""
    drain(stream, folder, mode)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
