"""Every query against its SQL on the smallest tables: the same columns and the same rows."""

import datetime as dt
import math
import os
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from verbatlas.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    """A value as both engines mean it."""
    if isinstance(v, (Decimal, float)):
        return "nan" if math.isnan(v) else f"{float(v):.6f}"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in values)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sql, name):
    df = catalog.QUERIES[name](spark, SF)
    found = df.collect()
    if name not in catalog.ORACLE_SQL:
        assert df.columns and len(set(df.columns)) == len(df.columns)
        return
    wanted = sql.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in wanted.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, found) == rows(names, wanted.fetchall())


def test_names_agree():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)
