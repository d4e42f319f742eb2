"""Every query equals its SQL."""

import duckdb
import pytest

from folioflow.plans.catalog import QUERIES
from folioflow.plans.page_queries import ORACLES


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    value = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else int(v) if isinstance(v, int) and not isinstance(v, bool) else v
    return sorted(names), sorted(repr([value(r[k]) if not isinstance(r[k], int) or isinstance(r[k], bool) else float(r[k]) for k in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    want = duck.sql(ORACLES[name])
    assert normal(df.collect(), df.columns) == normal(want.fetchall(), want.columns)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_filters_and_columns_reach_the_scan(spark, small):
    plan = QUERIES["pending_pages"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan
    plan = QUERIES["text_quality_by_lang"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<text:string,lang:string>" in plan and "Python" not in plan
