import pytest

import __spark_entry__ as entry


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    from tarazu.plans import catalogue

    assert set(catalogue.oracle_sql()) == set(catalogue.queries())


def test_queries_match_their_sql(spark, data):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for name in ("train", "documents", "prompts", "eval_results", "verdicts", "progress", "topics", "events"):
        c.execute(f"create view {name} as select * from '{data}/{name}.parquet'")
    from tarazu.plans import catalogue, stored

    own = catalogue.oracle_sql()
    known = catalogue.queries() | catalogue.whole() | stored.queries()
    key = lambda r: tuple(map(repr, r))
    for name, sql in (own | stored.whole_sql(own) | stored.oracle_sql(own["clean_totals"])).items():
        df = known[name](spark, data)
        cur = c.execute(sql)
        names = [d[0] for d in cur.description]
        assert sorted(names) == sorted(df.columns), name
        mine = [tuple(round(r[n], 5) if isinstance(r[n], float) else r[n] for n in names) for r in df.collect()]
        theirs = [tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in cur.fetchall()]
        assert sorted(mine, key=key) == sorted(theirs, key=key), name
