"""Every registered query runs, and those with SQL give the rows that DuckDB gives."""

import datetime
import decimal
import math
import os

import pytest

import __spark_entry__
from sparkloom import plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _cell(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, datetime.datetime) and not (x.hour or x.minute or x.second):
        return x.date()
    return x


def _rows(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_matches_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, SF)
    want = duck.execute(plans.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    a, b = _rows(got.columns, got.collect()), _rows(names, want.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for p, q in zip(x, y):
            assert p == q or (isinstance(p, (int, float)) and isinstance(q, (int, float)) and math.isclose(p, q, rel_tol=1e-9, abs_tol=2e-6)), (x, y)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_runs(spark, name):
    rows = plans.QUERIES[name](spark, SF).collect()
    assert rows


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["l_returnflag", "l_linestatus", "n", "net", "gap", "gap_log"]
    assert set(plans.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
