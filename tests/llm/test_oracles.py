import duckdb
import pytest

from boxpace.llm.catalog import LLM_ORACLES, LLM_QUERIES

SF = "/root/testdata/sf0.001"


def test_names():
    assert sorted(int(q[2:].split("_")[0]) for q in LLM_QUERIES) == list(range(1, 14))
    assert set(LLM_ORACLES) <= set(LLM_QUERIES)


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(LLM_ORACLES[name])
    names = [d[0] for d in cur.description]
    want = [dict(zip(names, r)) for r in cur.fetchall()]
    got = LLM_QUERIES[name](spark, SF).toArrow()
    assert set(got.column_names) == set(names)
    rows = lambda t: sorted((tuple(r[c] for c in sorted(names)) for r in t), key=repr)
    assert rows(got.to_pylist()) == rows(want)
