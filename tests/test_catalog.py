import decimal
import math
import os

import duckdb
import pytest
from lodestone.plans import catalog

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SMALL):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SMALL}/{f}'")
    return c


def cell(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return str([cell(x) for x in v]) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_same_rows_as_the_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted((tuple(cell(r[c]) for c in columns) for r in df.collect()), key=str)
    if name not in catalog.ORACLE_SQL:
        assert got
        return
    cursor = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(cell(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=str)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalog.QUERIES) <= set(entry.queries())


def test_filters_reach_the_scan(spark):
    plan = catalog.QUERIES["date_filter"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_extendedprice:double,l_shipdate:timestamp_ntz>" in plan
    assert "Python" not in catalog.QUERIES["bm25_top"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
