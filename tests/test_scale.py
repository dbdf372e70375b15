"""What must not grow faster than the input: rows that steps write and meet, beside right results."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from factloom.operators import analysis, embed, evaluation, extract, graph, models, similarity, vectors
from factloom.sources import ingest


def most_rows(spark, run):
    """The most rows that one step gave while ``run`` ran."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty(30_000)
    began = store.executionsCount()
    run()
    bus.waitUntilEmpty(30_000)
    done, most = store.executionsList(began, 10_000), 0
    for e in (done.apply(i) for i in range(done.size())):
        values, kinds = store.executionMetrics(e.executionId()), e.metrics()
        for m in (kinds.apply(i) for i in range(kinds.size())):
            if m.name() == "number of output rows" and (v := values.get(m.accumulatorId())).isDefined():
                most = max(most, int(v.get().split()[-1].replace(",", "")))
    return most


@pytest.fixture
def staged(monkeypatch):
    """Rows of each table that the similarity joins write, by its name."""
    rows, stage = {}, similarity.stage_table

    def spy(df, name, *more):
        out = stage(df, name, *more)
        rows[name] = out[0].count()
        return out

    monkeypatch.setattr(similarity, "stage_table", spy)
    return rows


def few_words(n, seed=7):
    r = random.Random(seed)
    return [(i, " ".join(r.choice(x) for x in (["red", "old", "large"], ["ring", "bolt", "pipe"], ["large", "small"], [f"brand{k}" for k in range(6)], [str(k) for k in range(9)]))) for i in range(n)]


def test_cosines_compare_equal_texts_once(spark, staged):
    rows = [(i, f"old pump valve {i % 4} of brand{i % 4}") for i in range(400)]
    got = {(r.a, r.b) for r in similarity.cosine_pairs(spark.createDataFrame(rows, "id long, text string"), 0.9).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(range(400), 2) if a % 4 == b % 4}
    assert staged["counts"] == 4 * 5


@pytest.mark.parametrize("threshold", [0.6, 0.8, 1.0])
def test_short_texts_meet_under_several_words(spark, threshold):
    rows = few_words(300)
    df = spark.createDataFrame(rows, "id long, text string")
    words = {i: set(t.split()) for i, t in rows}
    like = lambda a, b: len(words[a] & words[b]) / len(words[a] | words[b])
    got = {(r.a, r.b) for r in similarity.jaccard_pairs(df, threshold).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(range(300), 2) if like(a, b) >= threshold - 1e-12}

    def cosine(a, b):
        x, y = (dict(rows)[i].split() for i in (a, b))
        dot = lambda p, q: sum(p.count(w) * q.count(w) for w in set(p))
        return dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5

    got = {(r.a, r.b) for r in similarity.cosine_pairs(df, threshold).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(range(300), 2) if cosine(a, b) >= threshold - 1e-12}


def test_few_pairs_of_short_texts_are_compared(spark):
    from pyspark.sql import functions as F

    sets = sorted({tuple(sorted(set(t.split()))) for _, t in few_words(2000)})
    df = spark.createDataFrame([(i, list(w), [1] * len(w)) for i, w in enumerate(sets)], "id long, w array<string>, one array<long>")
    met = similarity.few_pairs(df.select("id", similarity.few_keys("w", "one", F.size("w") * 0.2 + 1e-9).alias("keys"))).count()
    alike = sum(len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b)) for a, b in itertools.combinations(sets, 2))
    rare = sum(bool({x for x in a if x.isdigit()} & set(b)) for a, b in itertools.combinations(sets, 2))
    assert alike <= met < rare / 2


def test_paths_flow_back_along_the_links_that_were_taken(spark):
    links = [(f"s{i}", "hub") for i in range(300)] + [("hub", "end"), ("end", "last")]
    nodes = spark.createDataFrame([(x,) for x in [*(a for a, _ in links), "last", *(f"alone{i}" for i in range(500))]], "block_id string")
    edges, got = spark.createDataFrame(links, "src string, dst string"), {}
    most = most_rows(spark, lambda: got.update({r.block_id: r.centrality for r in graph.betweenness(nodes, edges).collect()}))
    n = 300 + 3 + 500
    assert len(got) == n and {k: round(v * (n - 1) * (n - 2)) for k, v in got.items() if v} == {"hub": 600, "end": 301}
    assert most < 3 * n  # not 300 sources for each of 300 links into the hub


def test_vectors_are_sent_to_few_blocks(spark, monkeypatch):
    x = np.random.default_rng(5).normal(size=(400, 8))
    df = spark.createDataFrame([(str(i), row) for i, row in enumerate(x.tolist())], "id string, embedding array<double>")
    u, got = x / np.linalg.norm(x, axis=1, keepdims=True), []
    monkeypatch.setattr(embed, "CELL_ROWS", 4)
    monkeypatch.setattr(embed, "BUNCH_ROWS", 8)
    most = most_rows(spark, lambda: got.extend(tuple(r) for r in embed.near_pairs(df, 0.4).collect()))
    assert sorted(got) == sorted(tuple(sorted((str(i), str(j)))) for i, j in itertools.combinations(range(400), 2) if u[i] @ u[j] >= 0.4)
    assert most < 400 * 30  # not to each of 100 cells


def test_entities_end_with_a_semicolon(spark):
    pages = {"a &lt;b&gt; &amp;lt; &#39;&#x41;&eacute;&nosuch; &copy;": "a <b> &lt; 'A\xe9&nosuch; \xa9", "token = &quot": "token = &quot", "?a=1&copy=2&amp=3&#39": "?a=1&copy=2&=3&#39"}
    rows = spark.createDataFrame([(k,) for k in pages], "html string").select("html", ingest.html_to_text("html").alias("text")).collect()
    assert {r.html: r.text for r in rows} == pages


def test_words_of_a_fact_are_counted_once(spark):
    rows = spark.createDataFrame([(1, "Old pump, old valve of iron"), (2, "old old pump"), (3, ""), (4, None), (5, "the of"), (6, "brand new")], "fact_id long, fact_statement string")
    got = [(r.fact_id, round(r.similarity, 9)) for r in analysis.similar_facts(rows, 1, 0.0).collect()]
    assert got == [(2, round(0.405 * 5 / (7 * 5) ** 0.5, 9)), (3, 0.0), (4, 0.0), (5, 0.0), (6, 0.0)]
    assert analysis.similar_facts(rows, 99, 0.0).count() == 0
    assert {r.similarity for r in analysis.similar_facts(rows, 5, 0.0).collect()} == {0.0}
    plan = analysis.similar_facts(rows, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("regexp_replace") <= 12  # in the filter and in what is returned


def test_hash_embeddings_are_made_where_their_rows_are(spark):
    rows = spark.createDataFrame([(i, f"word{i} other{i % 3} word{i}" if i else "") for i in range(30)], "fact_id long, text string")
    out = vectors.hash_embedding(rows, "fact_id", "text", 16)
    assert {r.fact_id: [round(x, 9) for x in r.embedding] for r in out.collect()} == {i: [round(x, 9) for x in embed.hashed(f"word{i} other{i % 3} word{i}", 16)] for i in range(1, 30)}
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_greedy_matches_need_no_python(spark):
    r = random.Random(3)
    kind = "item string, subject string, predicate string, object string"
    words = ["ann", "ann lee", "lee", "bob"]
    rows = lambda n: [(f"i{r.randrange(6)}", r.choice(words), r.choice(["met", "met_by"]), r.choice(words)) for _ in range(n)]
    found, gold = rows(40), [*rows(30), (None, "ann", "met", "bob")]
    holds = lambda a, b: a in b or b in a
    tp = 0
    for item in {g[0] for g in gold}:
        free = sorted(g for g in gold if g[0] == item)
        for p in sorted(f for f in found if f[0] == item):
            hit = next((g for g in free if holds(p[1], g[1]) and holds(p[3], g[3])), None)
            if hit:
                free.remove(hit)
                tp += 1
    out = evaluation.evaluate(spark.createDataFrame(found, kind), spark.createDataFrame(gold, kind))
    row = out.first()
    assert (row.tp, row.fp, row.fn) == (tp, 40 - tp, 31 - tp) and tp < 30
    assert "Pandas" not in out._jdf.queryExecution().executedPlan().toString()


def test_few_rows_of_a_batch_are_python_objects(monkeypatch):
    sizes = []

    def run(rows):
        sizes.append(len(rows))
        return pa.array([len(t or "") for t in rows])

    texts = ["a" * (i % 7) if i % 5 else None for i in range(1000)]
    assert extract.in_slices(pa.array(texts), run).to_pylist() == [len(t or "") for t in texts] and max(sizes) <= extract.SLICE
    assert extract.in_slices(pa.array([], pa.string()), run).to_pylist() == []
    assert extract.triples([[], [("a", "b", "c", "d", "e", "f")], []]).to_pylist() == [[], [dict(zip("subject subject_type predicate object object_type text".split(), "abcdef"))], []]
    assert extract.triples([[], []]).to_pylist() == [[], []]


def test_extractors_read_arrow_batches(spark):
    docs = spark.createDataFrame([(i, f"Marie Curie found Radium. She was a chemist. Text {i}.") for i in range(200)] + [(200, None), (201, "")], "doc_id long, text string")
    for name, resolve in (("svo", False), ("svo", True), ("pattern", False)):
        out = extract.extract_facts(docs, extractor=name, resolve=resolve)
        assert "(200)" not in out._jdf.queryExecution().executedPlan().toString()  # 200: by pandas.Series
        got = {}
        for r in out.collect():
            got.setdefault(int(r.source_id), []).append((r.ordinal, r.subject, r.predicate, r.object))
        assert sorted(got) == list(range(200)) and len({tuple(sorted(v)[:1]) for v in got.values()}) == 1
        assert (0, "Marie Curie", "found" if name == "svo" else "discovered", "Radium") in got[7]
    assert all("Marie Curie" == s for r in range(3) for _, s, p, _ in got[r] if p == "discovered")


def test_agreement_gathers_claims_before_it_sums_them(spark):
    rows = [(f"s{i % 40}", "p", "O ", f"m{m}") for i in range(40) for m in range(i % 4)] + [("S1", "P", "o", None), ("none", "p", "o", None)]
    claims = spark.createDataFrame([*rows, *rows], "subject string, predicate string, object string, model string")
    agreed = similarity.agree_exact(claims)
    plan = agreed._jdf.queryExecution().executedPlan().toString()
    before = plan[plan.index("Exchange") :]
    assert plan.count("Exchange") == 1 and "Aggregate" not in before  # nothing is sorted for sums on the way
    got = {r.subject: (r.agreement, r.source_models, r.reliability_rating, r.weighted_rating) for r in agreed.collect()}
    tiers = ["UNVERIFIED", "POSSIBLY_TRUE", "LIKELY_TRUE", "VERIFIED"]
    want = {f"s{i}": (i % 4, ",".join(f"m{m}" for m in range(i % 4)), tiers[i % 4], tiers[i % 4]) for i in range(40) if i % 4}
    assert got == want | {"none": (0, "", "UNVERIFIED", "UNVERIFIED")}
    row = models.manifest(agreed, "x", 2, claims).first()
    assert (row.models, row.facts, row.verified, row.likely_true, row.possibly_true, row.input_facts) == ("m0,m1,m2", 20, 10, 10, 0, 2 * len(rows))
    empty = models.manifest(agreed.where("false"), "x").first()
    assert (empty.models, empty.facts, empty.verified, empty.input_facts) == ("", 0, 0, 0)


def test_a_manifest_reads_facts_once(spark, monkeypatch):
    made, stage = [], models.stage_table
    monkeypatch.setattr(models, "stage_table", lambda df, name, *more: made.append(name) or stage(df, name, *more))
    agreed = spark.createDataFrame([("a", 2, "m0,m1", "LIKELY_TRUE")] * 50, "subject string, agreement long, source_models string, reliability_rating string")
    plan = models.manifest(agreed)._jdf.queryExecution().executedPlan().toString()
    assert made == ["manifest"] and "ExistingRDD" not in plan


def test_missing_links_split_words_once_a_fact(spark, monkeypatch):
    plans, stage = [], analysis.stage_table
    monkeypatch.setattr(analysis, "stage_table", lambda df, name, *more: plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or stage(df, name, *more))
    rows = spark.createDataFrame([(i, t, "x", "s") for i, t in few_words(120)], "fact_id long, fact_statement string, category string, source_id string")
    edges = spark.createDataFrame([(1, 2)], "src long, dst long")
    got = {(r.a, r.b): round(r.similarity, 9) for r in analysis.missing_links(rows, edges).collect()}
    words = {i: set(t.split()) for i, t in few_words(120)}
    like = {(a, b): 0.4 * len(words[a] & words[b]) / len(words[a] | words[b]) + 0.3 for a, b in itertools.combinations(range(120), 2) if (a, b) != (1, 2)}
    assert got == {k: round(v, 9) for k, v in like.items() if v >= 0.6 - 1e-9} and got
    assert "regexp_replace" not in dict(plans)["missing-links"]
