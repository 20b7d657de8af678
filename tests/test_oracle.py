"""Every registered flow query against DuckDB on the same files."""

import datetime
import math
import os
from decimal import Decimal

import duckdb
import pytest

from sluice import queries as Q

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in sorted(os.listdir(SF)):
        name = f.removesuffix(".parquet")
        con.execute(f"create view {name} as select * from read_parquet('{SF}/{f}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v if math.isinf(v) else round(v, 6) + 0.0
    if isinstance(v, Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


ORACLES = Q.oracle_sql()


@pytest.mark.parametrize("name", list(Q.queries()))
def test_query(spark, duck, name):
    got = Q.queries()[name](spark, SF)
    if name not in ORACLES:
        assert len(got.collect()) > 0
        return
    want = duck.sql(ORACLES[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    rows = sorted((str([plain(r[c]) for c in names]) for r in got.collect()))
    columns = want.columns
    expected = sorted(str([plain(r[columns.index(c)]) for c in names]) for r in want.fetchall())
    assert rows == expected
