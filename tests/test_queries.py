"""Every graph query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from pairstrand.plans.catalog import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
#: Held against plain Python in test_walks.
WALKS = {"beam_walk", "greedy_walk", "find_paths"}


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 6) + 0.0 if isinstance(v, int | float) and not isinstance(v, bool) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in DATA.iterdir():
        c.sql(f"CREATE VIEW {p.stem} AS FROM '{p}/*.parquet'" if p.is_dir() else f"CREATE VIEW {p.stem} AS FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WALKS))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    got = rows(df.columns, df.collect())
    if name not in ORACLES:
        assert got
        return
    want = duck.execute(ORACLES[name])
    names = [x[0] for x in want.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows(names, want.fetchall())
