import pytest

from tarazu.llm import queries

COLUMNS = {
    "p2_found": [("row_id_a", "bigint"), ("row_id_b", "bigint")], "p4_found": [("row_id", "bigint"), ("lang", "string")], "p5_found": [("row_id", "bigint"), ("id", "int")], "p6_found": [("row_id", "bigint"), ("defect", "string")],
    "p7_ids": [("doc_id", "bigint"), ("ids", "array<int>")], "p9_found": [("doc_id", "bigint")],
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_runs_with_its_columns(spark, data, name):
    df = queries.queries()[name](spark, data)
    if name in COLUMNS:
        assert df.dtypes == COLUMNS[name]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, data, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("train", "prompts"):
        c.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    cur = c.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    mine = [tuple(r[n] for n in names) for r in queries.queries()[name](spark, data).collect()]
    assert sorted(mine, key=repr) == sorted(cur.fetchall(), key=repr)
