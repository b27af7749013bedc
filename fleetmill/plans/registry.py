"""Registered queries and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Views that oracles start from; each may use those above it.
VIEWS = {
    "cycles": """SELECT dataset, unit, cycle, op1, op1 / 50 AS op2, CASE WHEN op1 = 25 THEN 60.0 ELSE 100.0 END::DOUBLE AS op3, value AS s2, ln(1 + value) AS s3, s4,
      value + 0.5 * cycle AS s7, s4 - 0.3::DOUBLE * cycle * (CASE WHEN unit % 2 = 1 THEN 1 ELSE -1 END) AS s8, value % 7 AS s9
      FROM (SELECT 'events' AS dataset, user_id AS unit, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS cycle, value, (props->>'$.k')::DOUBLE AS s4,
            (CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 10 WHEN 'purchase' THEN 20 WHEN 'signup' THEN 25 ELSE 35 END)::DOUBLE AS op1 FROM events)""",
    "long_cycles": """SELECT *, s2 + 0.05 * cycle AS s7 FROM (SELECT 'lineitem' AS dataset, l_suppkey::BIGINT AS unit, row_number() OVER (PARTITION BY l_suppkey ORDER BY
      l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_discount, l_tax) AS cycle, l_quantity::DOUBLE AS s2 FROM lineitem)""",
    "both_cycles": "SELECT dataset, unit, cycle, s2, s7 FROM cycles UNION ALL SELECT dataset, unit, cycle, s2, s7 FROM long_cycles",
    "ruled": "SELECT *, (max(cycle) OVER (PARTITION BY unit) - cycle)::DOUBLE AS rul_true FROM cycles",
    "points2": """SELECT dataset, unit, cycle, repeat, floor(('0x' || substr(md5('42|fold|' || repeat || '|' || unit), 1, 8))::BIGINT / 4294967296.0 * 5)::INT AS fold, 42 AS seed, rul_true,
      least(greatest(66 - cycle + (s2 - 50) / 10, 0), 125) AS pred_a, least(greatest(70 - 1.05::DOUBLE * cycle, 0), 125)::DOUBLE AS pred_b, (unit % 3 = 0)::INT AS subpop
      FROM ruled, (SELECT unnest([1, 2])::INT AS repeat)""",
    "points": "SELECT * EXCLUDE (pred_a, pred_b), pred_a AS pred FROM points2",
    "broken": """SELECT * REPLACE (CASE WHEN (unit * 131 + cycle) % 389 = 0 THEN NULL ELSE s2 END AS s2) FROM cycles WHERE (unit * 131 + cycle) % 401 <> 0
      UNION ALL SELECT * FROM cycles WHERE (unit * 131 + cycle) % 397 = 0""",
    "labels_": "SELECT unit, (unit % 3 = 0)::INT AS subpop FROM (SELECT DISTINCT unit FROM cycles)",
    "long": """UNPIVOT (SELECT dataset, unit, cycle, op1, s2, s3, s4, s7, s8, s9 FROM cycles) ON s2, s3, s4, s7, s8, s9 INTO NAME sensor VALUE x""",
}


def u(stream: str, *counters: str) -> str:
    """The counter-based random number in DuckDB SQL."""
    key = " || '|' || ".join([f"'42|{stream}'", *counters])
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT / 4294967296.0)"


def oracle(sql: str) -> str:
    """sql behind the views that it names, directly or through other views."""
    used, text = [], sql
    for name, view in reversed(VIEWS.items()):
        if any(f"{w} {name}{e}" in f" {text} " for w in ("FROM", "JOIN", ",") for e in (" ", ",", ")", "\n", ";")):
            used.insert(0, f"{name} AS ({view})")
            text += f" {view} "
    recursive = "RECURSIVE " if "RECURSIVE" in sql else ""
    body = sql.replace("WITH RECURSIVE ", "WITH ", 1)
    if not used:
        return sql
    return f"WITH {recursive}{', '.join(used)}" + (f", {body.strip()[5:]}" if body.strip().startswith("WITH ") else f" {body}")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = oracle(sql)
        return f

    return add
