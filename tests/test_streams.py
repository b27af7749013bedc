"""Streams with state: timers free it, rows wait for the watermark, late ones are counted."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from fleetmill.streaming import scoring

SCHEMA = "unit long, cycle long, s double, ts timestamp"


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def run(spark, folder, batches, build):
    late = 0
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = build(spark.readStream.schema(SCHEMA).parquet(f"{folder}/in").withWatermark("ts", "30 minutes"))
        late += scoring.drain(stream, str(folder))
    return spark.read.schema(stream.schema).parquet(f"{folder}/out"), late


def state(spark, folder, name):
    return spark.read.format("statestore").option("path", f"{folder}/state").option("stateVarName", name).load()


def test_groups_of_units_share_a_state_and_keep_their_own_places(spark, tmp_path):
    r = random.Random(3)
    rows = [(u, c, float(c), at(10 * c + u % 7)) for u in range(40) for c in range(1, 10)]
    batches = [[x for x in rows if k * 40 < (x[3] - at(0)).seconds / 60 <= k * 40 + 40] for k in range(3)]
    for b in batches:
        r.shuffle(b)
    held = []

    def build(s):
        if held or (tmp_path / "state").exists():
            held.append({x.key.asDict()["__group"] for x in state(spark, tmp_path, "held").select("key").collect()})
        return scoring.in_order(s, "unit", "ts", "cycle", groups=3)

    out, late = run(spark, tmp_path, [*batches, [(0, 99, 0.0, at(5))], [(99, 1, 0.0, at(5000))]], build)
    assert late == 1 and held[0] == {0, 1, 2}
    assert sorted((x.unit, x.place, x.cycle, x.ts, x.s) for x in out.where("unit <> 99").collect()) == [(u, c, c, t, x) for u, c, x, t in sorted(rows)]


def test_rows_come_out_in_order_and_late_ones_are_counted(spark, tmp_path):
    r = random.Random(1)
    rows = [(u, c, float(c), at(10 * c)) for u in (1, 2) for c in range(1, 13)]
    rows.append((1, 99, 0.5, at(50)))  # a tie in time goes by cycle
    batches = [[x for x in rows if k * 40 < (x[3] - at(0)).seconds / 60 <= k * 40 + 40] for k in range(3)]
    batches[0].append(batches[1].pop(0))  # comes before its time
    batches[1].append(batches[0].pop(3))  # comes after younger ones, within the watermark
    for b in batches:
        r.shuffle(b)
    batches += [[(1, 500, 0.0, at(5)), (2, 501, 0.0, at(6))], [(9, 1, 0.0, at(5000))]]
    out, late = run(spark, tmp_path, batches, lambda s: scoring.in_order(s, "unit", "ts", "cycle"))
    got = sorted((x.unit, x.place, x.cycle, x.ts, x.s) for x in out.where("unit <> 9").collect())
    want = []
    for u in (1, 2):
        mine = sorted((x for x in rows if x[0] == u), key=lambda x: (x[3], x[1]))
        want += [(u, k + 1, x[1], x[3], x[2]) for k, x in enumerate(mine)]
    assert got == want and late == 2
    assert [x.key.unit for x in state(spark, tmp_path, "held").select("key").distinct().collect()] == [9]


def test_timers_free_a_units_state(spark, tmp_path):
    rows = [(u, c, float(c), at(c)) for u in (1, 2, 3) for c in range(1, 9)]
    batches = [[x for x in rows if x[1] % 3 == k] for k in (0, 2, 1)]
    build = lambda s: scoring.stream_features(s, "s", 4, "ts", "1 hour")
    out, _ = run(spark, tmp_path, batches, build)
    assert {x.key.unit for x in state(spark, tmp_path, "held").select("key").collect()} == {1, 2, 3}
    whole = spark.createDataFrame([("d", *x[:3]) for x in rows], "dataset string, unit long, cycle long, s double")
    want = {(r.unit, r.cycle): (r.level, r.slope, r.n_cycles_used) for r in scoring.batch_features(whole, "s", 4).collect()}
    got = {(r.unit, r.cycle): (r.level, r.slope, r.n_cycles_used) for r in out.collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want if k[1] > 1)
    run(spark, tmp_path, [[(-1, 1, 0.0, at(9000))]], build)
    for name in ("held", "waiting", "seen"):
        assert {x.key.unit for x in state(spark, tmp_path, name).select("key").collect()} <= {-1}, name


def test_drain_leaves_the_session_as_it_was(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    run(spark, tmp_path, [[(1, 1, 1.0, at(0))]], lambda s: s.select("unit", F.col("cycle").alias("c")))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_stream_features_are_those_of_a_batch_to_the_last_digit(spark, tmp_path):
    r = random.Random(2)
    rows = [(u, c, round(r.random() * 200, 2) + 0.5 * c, at(c)) for u in range(1, 30) for c in range(1, 25)]
    rows += [(30, c, x, at(c)) for c, x in zip(range(1, 14), [1.5] * 8 + [30.15, 30.63, 14.89, 31.65, 79.73], strict=True)]  # predicted 20 exactly
    out, _ = run(spark, tmp_path, [rows], lambda s: scoring.stream_features(s, "s", 5, "ts"))
    whole = spark.createDataFrame([("d", *x[:3]) for x in rows], "dataset string, unit long, cycle long, s double")
    want = {(x.unit, x.cycle): (x.level, x.slope) for x in scoring.batch_features(whole, "s", 5).collect()}
    assert {(x.unit, x.cycle): (x.level, x.slope) for x in out.collect()} == want


def test_slopes_round_products_once(spark):
    r = random.Random(4)
    rows = [("d", u, c, None if (u, c) == (3, 5) else round(r.random() * 200, 2) + 0.5 * c) for u in range(1, 40) for c in range(1, 25)]
    got = {(x.unit, x.cycle): x.slope for x in scoring.batch_features(spark.createDataFrame(rows, "dataset string, unit long, cycle long, s double"), "s", 5).collect()}
    for _, u, c, _ in rows:
        n = mc = mx = co = sq = 0.0
        for _, _, k, x in (q for q in rows if q[1] == u and c - 5 < q[2] <= c and q[3] is not None):
            n, dc, dx = n + 1, k - mc, x - mx
            mc, mx = mc + dc / n, mx + dx / n
            co, sq = math.fma(dc, x - mx, co), sq + dc * (k - mc)
        assert got[u, c] == ((co / n) / (sq / n) if sq else 0.0), (u, c)
