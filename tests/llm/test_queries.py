import pytest

from lodeglass.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_runs(spark, data, name):
    df = Q.queries()[name](spark, data)
    rows = df.collect()
    assert (rows or name.startswith("p7_")) and len({tuple(map(str, r)) for r in rows}) == len(rows) or name in ("p2_masked", "p9_passages"), name


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_agrees_with_sql(spark, name):
    import os

    import duckdb

    root = "/root/testdata/sf0.01"
    if not os.path.isdir(root):
        pytest.skip("no test data")
    con = duckdb.connect()
    for table in ("file_content", "symbols"):
        con.execute(f"create view {table} as select * from read_parquet('{root}/{table}.parquet')")
    df = Q.queries()[name](spark, root)
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(f"select {', '.join(df.columns)} from ({Q.oracle_sql()[name]})").fetchall()) != []


def test_columns(spark, data):
    want = {"p1_found": ["file_id"], "p2_found": ["file_id", "line_no"], "p4_found": ["file_id"], "p5_found": ["symbol_id"], "p7_found": ["item_kind", "item_key"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "pii_kind", "line_no"]}
    for name, columns in want.items():
        assert Q.queries()[name](spark, data).columns == columns
