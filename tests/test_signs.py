"""Signs that are undefined are told, with their reason, and not left out; shares of flipped signs have intervals."""

import os

import pytest
from pyspark.sql import functions as F

from fleetmill.operators import signal as s
from fleetmill.plans import model_queries, signal_queries
from fleetmill.plans.queries import QUERIES

DIR = "/root/testdata/sf0.001"


def cycles(values):
    return [(u, n, i, float(x), float(len(xs) - 1 - i)) for u, by in values.items() for n, xs in by.items() for i, x in enumerate(xs)]


VALUES = {1: {"a": [1, 2, 3, 4], "b": [4, 3, 2, 1], "c": [1, 2, 3, 4]}, 2: {"a": [1, 2, 2, 1], "b": [1, 2, 3, 5], "c": [7, 7, 7, 7]}}
WANT = {(1, "a"): (-1.0, None), (1, "b"): (1.0, None), (1, "c"): (None, s.NO_RHO_ELSEWHERE), (2, "a"): (None, s.RHO_0), (2, "b"): (-1.0, None), (2, "c"): (None, s.NO_RHO)}


def test_undefined_signs_are_told_and_kept(spark):
    df = spark.createDataFrame(cycles(VALUES), "unit long, sensor string, cycle long, x double, ttf double")
    assert {(r.unit, r.sensor): (r.sign, r.problem) for r in s.signs(s.spearman(df)).collect()} == WANT


def test_the_query_keeps_a_unit_with_a_correlation_of_0(spark, monkeypatch):
    rho = spark.createDataFrame([(1, "a", 0.5), (2, "a", 1e-17), (3, "a", -0.5)], "unit long, sensor string, rho double")
    monkeypatch.setattr(signal_queries, "rho_once", lambda spark, d: rho)
    assert {r.unit: (r.sign, r.problem) for r in signal_queries.sign_vectors(spark, "").collect()} == {1: (1.0, None), 2: (None, s.RHO_0), 3: (-1.0, None)}


def test_a_unit_without_a_vector_has_no_cluster(spark, monkeypatch):
    rho = [(u, c, 0.0 if (u, c) == (3, "s4") else (0.5 if u % 2 else -0.5)) for u in range(8) for c in ("s2", "s4", "s8")]
    monkeypatch.setattr(s, "spearman", lambda long: spark.createDataFrame(rho, "unit long, sensor string, rho double"))
    monkeypatch.setattr(model_queries.b, "cycles", lambda spark, d: spark.range(1).select(F.lit(1).alias("unit"), F.lit(1).alias("cycle"), *[F.lit(1.0).alias(c) for c in ("s2", "s4", "s8")]))
    got = {r.unit: r.cluster for r in model_queries.subpopulation_labels(spark, "").collect()}
    assert set(got) == set(range(8)) and got[3] is None and {got[u] for u in (0, 2, 4, 6)} == {0} and {got[u] for u in (1, 5, 7)} == {1}


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_flip_shares_have_intervals_over_a_clusters_units(spark):
    rows = QUERIES["flip_share_by_cluster"](spark, DIR).collect()
    assert rows and all(0 <= r.ci_lo <= r.share <= r.ci_hi <= 1 and r.flipped == (r.ci_lo > 0.5) for r in rows)
    assert any(r.ci_lo < r.ci_hi for r in rows)
