import duckdb
import pytest

from factloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rows = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.SQL[name])
    at = [[c[0] for c in cur.description].index(c) for c in rows.columns]
    assert sorted(map(str, map(tuple, rows.collect()))) == sorted(str(tuple(r[i] for i in at)) for r in cur.fetchall())


def test_there_is_a_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
