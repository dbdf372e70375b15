"""Every query that has SQL, against DuckDB over the same tables."""

import decimal

import duckdb
import pytest

from factloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.6g}"
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_sql_agrees(spark, duck, name):
    rows = catalog.QUERIES[name](spark, SF)
    cur = duck.execute(catalog.SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(rows.columns)
    at = [names.index(c) for c in rows.columns]
    want = sorted(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
    assert sorted(tuple(plain(v) for v in r) for r in rows.collect()) == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_others_give_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_importance_is_of_all_facts(spark):
    from factloom.operators import graph
    from factloom.plans.views import facts

    f = facts(spark, SF)
    got = {r.block_id: r.importance for r in catalog.QUERIES["fact_importance"](spark, SF).collect()}
    assert set(got) == {r.block_id for r in f.select("block_id").collect()}
    # paths that start at suppliers pass through their nations
    whole = {r.block_id: r.centrality for r in graph.betweenness(f, graph.link(f)).collect()}
    base = {r.block_id: 2 * {"VERIFIED": 4, "LIKELY_TRUE": 3, "POSSIBLY_TRUE": 2}.get(r.reliability_rating, 1) + 0.5 * r.usage_count for r in f.collect()}
    assert all(abs(got[k] - base[k] - 30 * whole[k]) < 1e-5 for k in got) and sum(whole.values()) > 0


def test_entities_of_all_facts_equal_brute_force(spark):
    import re

    from factloom.operators import similarity
    from factloom.plans.views import facts

    f = facts(spark, SF).limit(0)
    names = ["Acme Corp", "Acme Corporation", "acme", "a", "The Acme", "Bolt-On", "bolt on Ltd", "x y z w v u t", "t u v w x y z s", "z y x w v u t", "New York City", "york", "Customer#1", "Customer#12", "&", "É a"]
    rows = spark.createDataFrame([(f"f{i}", n, "is", n) for i, n in enumerate(names)], "fact_id string, subject string, predicate string, object string")
    got = {r.entity: r.canonical for r in similarity.resolve_entities(f.unionByName(rows, allowMissingColumns=True))[0].collect()}
    plain = lambda s: re.sub(r"[\W_]", "", s.lower())
    words = lambda s: {*s.lower().split()}
    firsts = lambda s: {plain(w)[0] for w in words(s) if plain(w)}
    like = lambda a, b: firsts(a) & firsts(b) and (plain(a) in plain(b) or plain(b) in plain(a) or len(words(a) & words(b)) >= 0.85 * len(words(a) | words(b)))
    seeds, want = [], {}
    for n in sorted(names, key=lambda n: (-len(n), n)):
        first = next((s for s in seeds if like(s, n)), None)
        if first is None:
            seeds.append(n)
        else:
            want[n] = first
    assert got == want
    # customers are not left out
    assert catalog.QUERIES["entity_resolution"](spark, SF).where("predicate = 'in_segment'").count() > 100
