import os

import pytest

import __spark_entry__ as entry
from lodeglass.plans import catalogue, general_problems


@pytest.fixture(scope="module")
def duck(data):
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(data):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{data}/{name}')")
    return con


def text(v):
    return f"{v:.6f}" if isinstance(v, float) else str(v)


QUERIES = catalogue.queries() | general_problems.queries()
SQL = catalogue.oracle_sql() | general_problems.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    rows = [tuple(text(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    if name not in SQL:
        return
    found = duck.execute(SQL[name])
    columns = [d[0] for d in found.description]
    order = [columns.index(c) for c in sorted(columns)]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(rows) == sorted(tuple(text(r[k]) for k in order) for r in found.fetchall())


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_read_what_they_need(spark, data):
    p = plan(catalogue.privacy_files(spark, data))
    assert "ReadSchema: struct<path:string,content:string>" in p and "PushedFilters: [IsNotNull(path)]" in p
    assert "ReadSchema: struct<kind:string,text:string>" in plan(catalogue.token_estimates(spark, data)).replace("text:string,kind:string", "kind:string,text:string")
    assert "ArrowEvalPython" not in plan(catalogue.symbol_search(spark, data)) and "CartesianProduct" not in plan(catalogue.symbol_search(spark, data))
    assert plan(catalogue.symbol_scores(spark, data)).count("Exchange") == 1  # repeated symbols are told apart once
