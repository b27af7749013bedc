"""Every registered query of the library against its DuckDB SQL, on the smallest tables; those without SQL give rows."""

import math
import os

import duckdb
import pytest

from fleetmill.plans.oracles import ORACLES
from fleetmill.plans.queries import QUERIES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{DIR}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(([plain(x) for x in r] for r in df.select(*columns).collect()), key=repr)
    if name not in ORACLES:
        assert columns
        return
    rel = tables.execute(ORACLES[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == columns
    want = sorted(([plain(r[names.index(c)]) for c in columns] for r in rel.fetchall()), key=repr)
    assert got == want
