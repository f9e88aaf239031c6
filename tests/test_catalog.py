"""Every registered query of the engine against its DuckDB SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from quillet.plans import catalog, papers

QUERIES, ORACLE = {**catalog.QUERIES, **papers.QUERIES}, {**catalog.ORACLE, **papers.ORACLE}
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    return v.isoformat()[:19] if hasattr(v, "isoformat") else "~" if v is None else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(columns).collect())
    rel = duck.sql(ORACLE[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


def test_hot_paths_stay_in_the_jvm(spark):
    for name, f in QUERIES.items():
        if name in papers.GRAMMAR:
            continue
        plan = f(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan, name


def test_columns_and_filters_reach_the_scan(spark):
    plan = catalog.QUERIES["event_tail"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(event_id,1500)" in plan and "ReadSchema: struct<event_id:bigint,event_type:string>" in plan
