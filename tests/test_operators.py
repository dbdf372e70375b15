import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import chain, evaluation, extract, graph, similarity, vectors
from factloom.operators import facts as O
from factloom.sources import ingest


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(expr.alias("x")).first()[0]


def jac(a, b):
    x, y = (set(t.lower().split()) for t in (a, b))
    return len(x & y) / len(x | y) if x and y else 0.0


@pytest.mark.parametrize(
    "sentence,triples",
    [
        ("Robert Putnam wrote Bowling Alone.", [("Robert Putnam", "wrote", "Bowling Alone")]),
        ("Ada Byron was President of North County College.", [("Ada Byron", "president_of", "North County College")]),
        ("Notes With Honors was published in 1843.", [("Notes With Honors", "published", "1843")]),
        ("Civic engagement is a value choice.", [("Civic engagement", "is_a", "value choice")]),
        ("Deborah DeGrate and Chris Engle graduated with civic honors.", [("Deborah DeGrate", "graduated", "civic honors"), ("Chris Engle", "graduated", "civic honors")]),
        ("Marie Curie was born in Warsaw.", [("Marie Curie", "born_in", "Warsaw")]),
        ("Key Components:", []),
        ("nothing here is capital", []),
    ],
)
def test_sentences_to_triples(sentence, triples):
    assert list(extract.sentence_facts(sentence)) == triples


def test_extraction_of_documents(spark):
    docs = spark.createDataFrame([(1, "Dr. Raymond Davis provided advice and guidance. Marie Curie was born in Warsaw. She discovered radium."), (2, None), (3, "")], "doc_id long, text string")
    plain = extract.extract_facts(docs).collect()
    assert [(r.subject, r.predicate, r.object) for r in plain][0] == ("Dr. Raymond Davis", "provided", "advice and guidance")
    solved = {(r.subject, r.predicate, r.object): r for r in extract.extract_facts(docs, resolve=True).collect()}
    row = solved["Marie Curie", "discovered", "radium"]
    assert row.fact_statement == "Marie Curie discovered radium." and row.question == "What did Marie Curie discover?" and row.answer == "radium"
    with pytest.raises(ValueError):
        extract.get_extractor("none")
    with pytest.raises(ImportError):
        extract.get_extractor("spacy")


def test_gold_set(spark):
    gold = [("a", "Robert Putnam", "wrote", "Bowling Alone"), ("b", "Marie Curie", "born_in", "Warsaw"), ("c", "Ada Byron", "developed", "program")]
    found = [("a", "Robert Putnam", "wrote", "Bowling Alone"), ("b", "Marie Curie", "was", "born"), ("c", "Ada Byron", "developed", "a civic honors program")]
    kind = "item string, subject string, predicate string, object string"
    row = evaluation.evaluate(spark.createDataFrame(found, kind), spark.createDataFrame(gold, kind)).first()
    assert (row.tp, row.fp, row.fn, row.precision, row.recall, row.f1) == (2, 1, 1, 0.6667, 0.6667, 0.6667)
    # one gold triple is found by one prediction alone, the first in order
    twice = evaluation.evaluate(spark.createDataFrame([("a", "Robert Putnam", "wrote", "Bowling Alone"), ("a", "Putnam", "wrote", "Bowling"), ("a", "Putnam", "", "")], kind), spark.createDataFrame([*gold[:1], ("a", "", "wrote", "")], kind)).first()
    assert (twice.tp, twice.fp, twice.fn) == (1, 2, 1)
    none = evaluation.evaluate(spark.createDataFrame([], kind), spark.createDataFrame([], kind)).first()
    assert (none.precision, none.recall) == (1.0, 1.0)


def test_shard_evaluation_and_gates(spark):
    triple = "subject string, object string"
    gold = spark.createDataFrame([("Mitochondria", "ATP"), ("Nucleus", "DNA"), ("Ribosomes", "protein")], triple)
    bad = spark.createDataFrame([("Mitochondria", "photosynthesis")], triple)
    shard = spark.createDataFrame([("Mitochondria", "ATP", "VERIFIED"), ("mitochondria", "photosynthesis", "LIKELY_TRUE"), ("Nucleus", "DNA", "VERIFIED")], triple + ", reliability_rating string")
    row = evaluation.evaluate_shard(shard, gold, bad).first().asDict()
    assert row == {"n": 3, "precision": 0.6667, "verified_precision": 1.0, "hallucination": 0.3333, "coverage": 0.6667}
    assert evaluation.check_gates(row) == ["precision 0.6667 is below 0.8", "hallucination 0.3333 is above 0.1"]


def test_quality_gates(spark):
    cases = {"The": False, "However": False, "Being": False, "Developing": False, "x": False, "robert": False, "Robert Putnam": True, "Marie": True, "": False}
    for s, ok in cases.items():
        assert one(spark, T.is_acceptable("s", "o"), s=s, o="thing") is ok, s
    assert not one(spark, T.is_acceptable("s", "o"), s="Marie", o="x" * 81)
    assert not one(spark, T.is_acceptable("s", "o", F.lit("CONCEPT")), s="Marie", o="x")
    assert one(spark, T.is_acceptable("s", "o", F.lit("CONCEPT")), s="Marie Curie", o="x")
    assert one(spark, F.round(T.quality("s", "o", F.lit("ENTITY")), 6), s="Marie", o="x" * 40) == 0.9


def test_scalars(spark):
    assert one(spark, T.norm("x"), x="  A B\n c ") == "a b c"
    assert one(spark, T.model_statement("s", "p", "o", "q"), s="Mitochondria", p="produce", o="ATP", q="oxidative phosphorylation") == "Mitochondria produce ATP (oxidative phosphorylation)."
    assert one(spark, T.model_statement("s", "p", "o", "q"), s="water", p="is_a", o="", q=None) == "Water is a."
    assert one(spark, T.verbalize("s", "p", "o"), s="Marie Curie", p="born_in", o="Warsaw") == "Marie Curie was born in Warsaw."
    assert one(spark, T.question("s", "p"), s="X", p="parent_of") == "Who is X a parent of?"
    assert one(spark, T.question("s", "p"), s="X", p="is_a") == "What is X?"
    assert one(spark, T.question("s", "p"), s="X", p="moves_to") == "What does X moves to?"
    assert one(spark, T.question("s", "p"), s="X", p="") == "What is related to X?"
    assert one(spark, T.confidence_quality("c"), c="0.95") == 29.5 and one(spark, T.confidence_quality("c"), c="odd") == 20.0
    assert one(spark, T.safe_name("x"), x="a/b c:é") == "a_b_c_é"
    assert one(spark, T.expand_query("x", 2), x="graph of things") == "graph of things chart network"
    assert one(spark, T.degenerate("s", "o", "d"), s="Chemistry", o="chemistry is", d="x") and one(spark, T.degenerate("s", "o", "d"), s="X", o="y", d="x")
    for m, w in [("x", 1.0), ("llama3-8b", 1.5), ("whatever", 1.0), ("GPT-4", 3.0), ("qwen2.5-0.5b", 0.5)]:
        assert one(spark, T.model_weight("m"), m=m) == w
    assert one(spark, T.critique("s", "p", "o", "t"), s="It", p="is", o="x", t="It is x.").confidence_score == 0.95
    assert one(spark, T.critique("s", "p", "o", "t"), s="A", p="is", o="is", t="A is is.").is_factual is False
    assert one(spark, T.sentences("x"), x="Dr. A. went. Home\nnow!") == ["Dr. A.", "went.", "Home", "now!"]


def test_records(spark):
    row = spark.createDataFrame([("What?", "That.", "Sky", "", "It's \"so\" é.")], "question string, answer string, subject string, category string, fact_statement string")
    got = row.select(*[extract.record(f).alias(f) for f in ("chat", "instruction", "alpaca", "sharegpt", "plain", "text")]).first()
    assert json.loads(got.chat) == {"messages": [dict(role=r, content=c) for r, c in (("user", "What?"), ("assistant", "That."))]}
    assert json.loads(got.alpaca) == {"instruction": "State a verified fact about Sky.", "input": "", "output": "It's \"so\" é."}
    assert json.loads(got.sharegpt)["conversations"][1] == {"from": "gpt", "value": "It's \"so\" é."} and got.text == "- It's \"so\" é."
    bare = row.select(F.lit(None).cast("string").alias("question"), F.lit(None).cast("string").alias("answer"), "subject", "category", "fact_statement").select(extract.record("instruction")).first()[0]
    assert json.loads(bare)["instruction"] == "Tell me a fact about General."


def test_probes(spark):
    prompts = spark.createDataFrame([("biochemistry", "p1", "list"), ("biochemistry", "p2", "list")], "domain string, prompt string, prompt_type string")

    def backend(prompt):
        if prompt == "p2":
            raise RuntimeError("down")
        said = [("Mitochondria", "produce", "ATP", 0.95), ("Biochemistry", "is", "x", None), ("", "is", "x", None)]
        return {"facts": [dict(zip(("subject", "predicate", "object", "confidence"), s)) for s in said]}

    out = extract.probe(prompts, backend, "m1")
    assert out.count() == 2
    rows = extract.probe_facts(out).collect()
    assert len(rows) == 1 and rows[0].fact_statement == "Mitochondria produce ATP." and rows[0].quality_score == 29.5 and rows[0].category == "Biochemistry"


def test_sources(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Title\n\nSome **bold** [link](http://x).\n- item\n")
    (tmp_path / "b.html").write_text("<html><head><script>var p='<p>';</script></head><body><h1>Head</h1><p>One &amp; two</p><p>Three</p></body></html>")
    body = json.dumps(json.dumps({"post": {"body_html": "<p>Inner text</p>", "x": [{"body_html": "s"}]}}))
    (tmp_path / "c.htm").write_text(f"<body>outer</body><script>window._preloads = JSON.parse({body})</script>")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.txt").write_text("plain")
    (tmp_path / "e.bin").write_text("no")
    got = {r.source_id: r.text for r in ingest.load_folder(spark, str(tmp_path)).collect()}
    assert got == {"a": "Title\n\nSome bold link.\nitem", "b": "Head\nOne & two\nThree", "c": "Inner text", "d": "plain"}
    (tmp_path / "f.json").write_text(json.dumps({"f1": {"fact_statement": "S.", "tags": "a, b", "reliability_rating": "verified"}, "f2": {"reliability_rating": "odd"}}))
    rows = {r.fact_id: r for r in ingest.load_facts_json(spark, str(tmp_path / "f.json")).collect()}
    assert rows["f1"].tags == ["a", "b"] and rows["f1"].reliability_rating == "VERIFIED" and rows["f2"].reliability_rating == "UNVERIFIED"
    (tmp_path / "g.csv").write_text("id,rating,t\n1,LIKELY_TRUE,x\n2,bad,y\n")
    assert {r.fact_id: r.reliability_rating for r in ingest.load_facts_csv(spark, str(tmp_path / "g.csv"), "id", "rating").collect()} == {"1": "LIKELY_TRUE", "2": "UNVERIFIED"}


def test_changes(spark):
    facts = spark.createDataFrame([("a", "VERIFIED", 1, 42.0), ("b", "UNVERIFIED", 0, 10.0)], "fact_id string, reliability_rating string, usage_count int, quality_score double")
    got = {r.fact_id: r for r in O.update(facts, spark.createDataFrame([("b", "LIKELY_TRUE", 3)], "fact_id string, reliability_rating string, usage_count int")).collect()}
    assert got["b"].quality_score == 36.0 and got["a"].quality_score == 42.0
    with pytest.raises(ValueError):
        O.update(facts, spark.createDataFrame([("a", 1)], "fact_id string, odd int"))
    assert [r.fact_id for r in O.delete(facts, facts.where("fact_id = 'a'")).collect()] == ["b"]
    good, bad = O.validate(facts.unionByName(spark.createDataFrame([("", "VERIFIED", 0, 0.0), ("c", "ODD", 0, 0.0), (None, "VERIFIED", 0, 0.0)], facts.schema)))
    assert good.count() == 2 and bad.count() == 3
    nodes = spark.createDataFrame([("1", "old")], "block_id string, fact_statement string")
    new = spark.createDataFrame([("1", "new"), ("2", "x")], nodes.schema)
    assert sorted(r.fact_statement for r in O.ingest(nodes, new).collect()) == ["new", "x"]
    assert sorted(r.fact_statement for r in O.ingest(nodes, new, upsert=False).collect()) == ["old", "x"]


def test_lifecycle(spark):
    kind = "fact_id string, source string, subject string, predicate string, object string, fact_statement string, reliability_rating string"
    rows = [("1", "a.txt", "Water", "boils", "100C", "Water boils at 100C.", "LIKELY_TRUE"), ("2", "b.txt", "Water", "boils", "100C", "water  boils at 100C.", "LIKELY_TRUE"), ("3", "a.txt", "Paris", "located_in", "France", "x", "VERIFIED"), ("4", "b.txt", "Paris", "located_in", "Texas", "x", "VERIFIED")]
    df = spark.createDataFrame(rows, kind)
    got = O.promote(df).collect()
    assert [(r.sources, r.current, r.proposed) for r in got] == [(2, "LIKELY_TRUE", "VERIFIED")]
    c = O.contradictions(df).collect()
    assert [(r.subject, r.objects) for r in c] == [("Paris", "france<-a.txt; texas<-b.txt")]


def test_sft_lines(spark):
    turn = lambda r, c: {"role": r, "content": c}
    good = {"messages": [turn("user", "q"), turn("assistant", "a")], "metadata": {"reliability": "VERIFIED"}}
    lines = [json.dumps(good), json.dumps(dict(messages=[])), json.dumps(good | {"metadata": {"reliability": "POSSIBLY_TRUE"}}), "not json at all", json.dumps({"messages": [turn("user", ""), turn("assistant", "a")]}), json.dumps({"messages": [turn("system", "s"), turn("user", "q"), turn("assistant", "a")]}), "  "]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert [r.problem is None for r in O.prepare_sft(df).collect()].count(True) == 2 and O.prepare_sft(df).count() == 6
    assert O.prepare_sft(df, "LIKELY_TRUE").where("problem IS NULL").count() == 1


def test_budget_skips_and_goes_on(spark):
    r = random.Random(1)
    rows = [(g, i, "x" * r.randrange(0, 120)) for g in range(5) for i in range(30)]
    got = defaultdict(list)
    for row in O.budget(spark.createDataFrame(rows, "g int, i int, record string"), 60, ["i"], ["g"]).orderBy("g", "position").collect():
        got[row.g].append(row.record)
    for g in range(5):
        used, want = 0, []
        for _, _, text in [x for x in rows if x[0] == g]:
            cost = max(1, len(text) // 4)
            if used + cost <= 60:
                used += cost
                want.append(text)
        assert got[g] == want


def test_split_is_exact(spark):
    df = spark.range(1003).select(F.col("id").cast("string").alias("k"))
    parts = {r.part: r["count"] for r in O.split(df, 0.8, F.col("k")).groupBy("part").count().collect()}
    assert parts == {"train": 802, "val": 201}


def test_jaccard_pairs_equal_brute_force(spark):
    r = random.Random(2)
    texts = [" ".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(0, 9))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for t in (0.3, 0.5, 0.8, 1.0):
        got = {(x.a, x.b) for x in similarity.jaccard_pairs(df, t).collect()}
        assert got == {(i, j) for i in range(150) for j in range(i + 1, 150) if jac(texts[i], texts[j]) >= t}


def test_greedy_seeds_equal_a_scan(spark):
    for seed in range(4):
        r = random.Random(seed)
        n = 60
        edges = {(i, j) for i in range(n) for j in range(i + 1, n) if r.random() < 0.06}
        rank = list(range(n))
        r.shuffle(rank)
        want, kept = {}, []
        for i in sorted(range(n), key=rank.__getitem__):
            lead = next((k for k in kept if (min(i, k), max(i, k)) in edges), None)
            want[i] = i if lead is None else lead
            if lead is None:
                kept.append(i)
        got = similarity.greedy_seeds(spark.createDataFrame(list(enumerate(rank)), "id long, rank long"), spark.createDataFrame(sorted(edges), "a long, b long"))
        assert {x.id: x.seed for x in got.collect()} == want


def test_clusters_and_agreement(spark):
    rows = [(0, "A", "is", "B", "A is B now and here.", "m1", 1.0), (1, "a", "is", "b", "Other words entirely.", "m2", 2.0), (2, "X", "is", "Y", "A is B now and here", "m2", 3.0), (3, "X", "is", "Z", "A is B now and here.", "m2", 1.0), (4, "Q", "is", "R", "Q is R.", "m1", 1.0)]
    df = spark.createDataFrame(rows, "pos long, subject string, predicate string, object string, fact_statement string, model string, quality_score double")
    c = similarity.cluster(df, 0.6)
    seeds = {r.pos: r.seed for r in c.collect()}
    want, reps = {}, []
    for pos, s, p, o, stmt, *_ in rows:
        like = next((k for k, spo, t in reps if spo == (s.lower(), p, o.lower()) or t == stmt.lower() or jac(t, stmt) >= 0.6), None)
        want[pos] = pos if like is None else like
        if like is None:
            reps.append((pos, (s.lower(), p, o.lower()), stmt.lower()))
    assert seeds == want
    got = {r.seed: (r.agreement, r.members, r.reliability_rating, r.fact_statement) for r in similarity.agree(df, c).collect()}
    assert got[0][:3] == (2, 4, "LIKELY_TRUE") and got[0][3] == "A is B now and here" and got[4][2] == "POSSIBLY_TRUE"
    assert {r.reliability_rating for r in similarity.agree(df, c, weighted=True).collect()} == {"LIKELY_TRUE", "POSSIBLY_TRUE"}


def test_entities(spark):
    kind = "subject string, predicate string, object string, fact_statement string, reliability_rating string, agreement int"
    rows = [("Adenosine Triphosphate (ATP)", "fuels", "CellularProcess", "Adenosine Triphosphate (ATP) fuels CellularProcess.", "VERIFIED", 3), ("ATP", "fuels", "CellularProcess", "ATP fuels CellularProcess.", "LIKELY_TRUE", 2), ("Glucose / D-Glucose (Sugar)", "is a type of", "Sugar", "s", "VERIFIED", 1)]
    df = spark.createDataFrame(rows, kind)
    names, merged = similarity.resolve_entities(df, limit_to=["ATP"])
    assert [tuple(r) for r in names.collect()] == [("ATP", "Adenosine Triphosphate (ATP)")]
    assert merged.count() == 2 and merged.where("agreement = 3").first().subject == "Adenosine Triphosphate (ATP)"
    assert similarity.resolve_entities(df)[0].count() == 2


def digraph(spark, seed, n=24, p=0.09):
    r = random.Random(seed)
    edges = [(f"n{i:02d}", f"n{j:02d}") for i in range(n) for j in range(n) if i != j and r.random() < p]
    nodes = [f"n{i:02d}" for i in range(n)]
    return nodes, edges, spark.createDataFrame([(x,) for x in nodes], "block_id string"), spark.createDataFrame(edges, "src string, dst string")


def test_pagerank(spark):
    nodes, edges, nf, ef = digraph(spark, 1, p=0.05)
    out = defaultdict(list)
    for a, b in edges:
        out[a].append(b)
    rank = {x: 1 / len(nodes) for x in nodes}
    for _ in range(200):
        loose = sum(rank[x] for x in nodes if not out[x]) / len(nodes)
        nxt = {x: 0.15 / len(nodes) + 0.85 * loose for x in nodes}
        for a in nodes:
            for b in out[a]:
                nxt[b] += 0.85 * rank[a] / len(out[a])
        rank = nxt
    got = {r.block_id: r["rank"] for r in graph.pagerank(nf, ef).collect()}
    assert set(got) == set(nodes) and all(abs(got[x] - rank[x]) < 1e-4 for x in nodes) and abs(sum(got.values()) - 1) < 1e-9


def test_betweenness(spark):
    nodes, edges, nf, ef = digraph(spark, 2, 14, 0.15)
    out = defaultdict(list)
    for a, b in edges:
        out[a].append(b)
    total = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        dist, paths, order = {s: 0}, defaultdict(float, {s: 1.0}), [s]
        for v in order:
            for w in out[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
        flow = defaultdict(float)
        for w in reversed(order):
            for v in order:
                if w in out[v] and dist[w] == dist[v] + 1:
                    flow[v] += paths[v] / paths[w] * (1 + flow[w])
            if w != s:
                total[w] += flow[w]
    got = {r.block_id: r.centrality for r in graph.betweenness(nf, ef).collect()}
    assert all(abs(got[x] - total[x] / (13 * 12)) < 1e-9 for x in nodes)


def test_components_and_hops(spark):
    nodes, edges, nf, ef = digraph(spark, 3, 40, 0.015)
    group = {x: x for x in nodes}
    for _ in nodes:
        for a, b in edges:
            group[a] = group[b] = min(group[a], group[b])
    assert {r.block_id: r.component for r in graph.components(nf, ef).collect()} == group
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b), near[b].add(a)
    seen, front = {"n00": 0}, {"n00"}
    for h in (1, 2, 3):
        front = {y for x in front for y in near[x]} - set(seen) - {"n05"}
        seen.update(dict.fromkeys(front, h))
    blocked = nf.where("block_id = 'n05'")
    assert {r.block_id: r.hop for r in graph.hops(nf.where("block_id = 'n00'"), ef, 3, blocked).collect()} == seen
    assert graph.graph_stats(nf, ef).first().components == len(set(group.values()))


def graph_facts(spark, rows):
    kind = "subject string, predicate string, object string, fact_statement string, reliability_rating string, agreement int, quality_score double"
    df = spark.createDataFrame([(*r, f"{r[0]} {r[1]} {r[2]}.", *x) for *r, x in rows], kind)
    return df.withColumn("block_id", T.block_id("subject", "predicate", "object"))


def test_reasoning(spark):
    v = ("VERIFIED", 1, 10.0)
    f = graph_facts(spark, [("Mitochondria", "produce", "ATP", v), ("ATP", "is", "energy", v), ("A", "is", "B", v), ("B", "is", "C", v), ("Mitochondria", "do not produce", "ATP", ("POSSIBLY_TRUE", 1, 2.0))])
    e = graph.link(f)
    assert sorted(r.predicate for r in e.collect()) == ["do not produce_is", "is_is", "produce_is"]
    assert [(r.subject, r.predicate, r.object) for r in graph.transitive(f, e).collect()] == [("A", "is", "C")]
    assert graph.contradictions(f).count() == 1 and graph.conflict_pairs(f).count() == 1
    assert [(r.predicate, r.reliability_rating) for r in graph.reconcile(f).where("demoted").collect()] == [("do not produce", "UNVERIFIED")]
    assert graph.chain_instructions(f, e).count() == 9 and graph.contradiction_instructions(f).count() == 1
    assert graph.graph_sql(spark, f, e, "SELECT count(*) AS n FROM Fact").first().n == 5
    spark.sql("CREATE OR REPLACE TEMP VIEW one AS SELECT 1 AS a")
    for bad in ("DROP TABLE Fact", "SELECT 1; SELECT 2", "insert into Fact values (1)", "WITH x AS (SELECT 1 AS a) INSERT INTO one SELECT a FROM x", "SELECT java_method('java.lang.System', 'exit', '1')", "SET a=b", "nonsense", "MATCH (f:Fact) SET f.subject = 'x' RETURN f", "MATCH (f:Fact DELETE f"):
        with pytest.raises(ValueError):
            graph.graph_sql(spark, f, e, bad)


def test_limits_and_patterns(spark):
    v = ("VERIFIED", 1, 10.0)
    f = graph_facts(spark, [("ATP", "is", "energy", v), ("energy", "is", "work", v), ("it's", "is", "ATP", ("LIKELY_TRUE", 1, 2.0))])
    e = graph.link(f)
    ask = lambda q, n=100: graph.graph_sql(spark, f, e, q, n).collect()
    assert len(ask("SELECT * FROM Fact", 2)) == 2 and len(ask("SELECT * FROM Fact LIMIT 3", 2)) == 3
    assert len(ask("SELECT * FROM (SELECT * FROM Fact LIMIT 3) t", 1)) == 1
    assert len(ask("WITH x AS (SELECT * FROM Fact) SELECT * FROM x", 1)) == 1
    assert ask("MATCH (f:Fact) RETURN count(f) AS n")[0].n == 3
    assert [r.s for r in ask("MATCH (f:Fact) WHERE toLower(f.object) CONTAINS 'at' OR f.subject IN ['energy'] RETURN f.subject AS s ORDER BY s LIMIT 5")] == ["energy", "it's"]
    assert [tuple(r) for r in ask("MATCH (a:Fact)-[r:RELATED]->(b:Fact) WHERE a.subject = 'ATP' RETURN a.subject, b.object")] == [("ATP", "work")]
    assert ask("MATCH (a:Fact)<-[:RELATED]-(b:Fact {subject: 'ATP'}) RETURN a.object AS o")[0].o == "work"
    assert sorted(r.s for r in ask("MATCH (a:Fact {subject: 'ATP'})-[r]-(b) RETURN b.subject AS s")) == ["energy", "it's"]
    assert [r.s for r in ask("MATCH (a:Fact), (b:Fact) WHERE a.object = b.subject AND a.subject STARTS WITH \"it's\" RETURN b.subject AS s")] == ["ATP"]
    assert ask("MATCH (f:Fact) WHERE f.subject = 'it\\'s' RETURN f")[0].object == "ATP"
    assert [r[0] for r in ask("MATCH (a)-[:RELATED]->(b)-[:RELATED]->(c) RETURN c.object")] == ["work"]
    for bad in ("MATCH (f:Person) RETURN f", "MATCH (f:Fact)", "MATCH (a)-[:KNOWS]->(b) RETURN a", "MATCH (a)<-[r]->(b) RETURN a", "MATCH f RETURN f"):
        with pytest.raises(ValueError):
            ask(bad)


def test_ontology(spark):
    v = ("VERIFIED", 1, 10.0)
    f = graph_facts(spark, [("ATP", "is a", "ChemicalCompound", v), ("Glucose", "is a type of", "ChemicalCompound", v), ("Mitochondria", "produces", "ATP", v), ("Respiration", "occurs in", "Cytoplasm", v)])
    assert [tuple(r) for r in graph.taxonomy(f).collect()] == [("ChemicalCompound", "ATP|Glucose")]
    types = graph.semantic_types(f)
    got = {r.concept: r.type for r in types.collect()}
    assert (got["Mitochondria"], got["Respiration"], got["Cytoplasm"]) == ("ENTITY", "PROCESS", "LOCATION")
    assert ("ENTITY", "produces", "CONCEPT") in {tuple(r) for r in graph.relation_schema(f, types).collect()}


def test_retrieval(spark):
    v = ("VERIFIED", 1, 10.0)
    f = graph_facts(spark, [("Mitochondria", "produce", "ATP", v), ("ATP", "fuels", "cells", v), ("cells", "form", "tissue", v), ("Nucleus", "stores", "DNA", v), ("tissue", "is", "odd", ("UNVERIFIED", 1, 1.0))])
    e = graph.link(f)
    assert [r.subject for r in graph.seeds(f, "Where is Mitochondria").collect()] == ["Mitochondria"]
    assert graph.seeds(f, "", 2).count() == 2 and graph.seeds(f, "zebra").count() == 0
    found = graph.retrieve(f, e, "Mitochondria", top_k=3)
    assert {r.subject for r in found.collect()} == {"Mitochondria", "ATP", "cells"}
    assert graph.context(found).first().context.startswith("### Verified Knowledge Graph Facts:\n- **Mitochondria**")
    assert graph.context(found.limit(0)).first().context.startswith("No relevant")


def test_vectors(spark):
    df = spark.createDataFrame([("v1", [1.0, 0.0]), ("v2", [0.0, 1.0]), ("v3", [0.707, 0.707]), ("z", [0.0, 0.0])], "vec_id string, embedding array<double>")
    assert [(r.vec_id, r.similarity) for r in vectors.nearest_to(df, [1.0, 0.0], 1).collect()] == [("v1", 1.0)]
    assert [r.vec_id for r in vectors.nearest_to(df, [0.0, 1.0], 2).collect()] == ["v2", "v3"]
    assert [r.similarity for r in vectors.nearest_to(df, [0.0, 0.0], 2).collect()] == [0.0, 0.0]
    assert [r.vec_id for r in vectors.similar_to(df, "v1", 1).collect()] == ["v3"]
    new = spark.createDataFrame([("v1", [5.0, 5.0]), ("w", [1.0, 1.0])], df.schema)
    assert vectors.upsert(df, new).count() == 5 and vectors.remove(df, new).count() == 3
    h = vectors.hash_embedding(spark.createDataFrame([(1, "a b a"), (2, "b a a")], "k int, t string"), "k", "t", 16).collect()
    assert h[0].embedding == h[1].embedding and abs(sum(x * x for x in h[0].embedding) - 1) < 1e-9


def test_chain(spark):
    tx = spark.createDataFrame([(i % 2, i, f"t{i}") for i in range(47)], "ledger int, i int, body string")
    blocks = chain.build(tx, "ledger", ["i"], "body").persist()
    assert blocks.count() == 6 and all(r.hash.startswith("00") for r in blocks.collect())
    assert chain.verify(blocks).where("NOT linked OR NOT intact").count() == 0
    bent = blocks.withColumn("transactions", F.when(F.col("index") == 2, F.array(F.lit("forged"))).otherwise(F.col("transactions")))
    assert chain.verify(bent).where("NOT intact").count() == 2
    gone = chain.verify(blocks.where("NOT (ledger = '0' AND index = 2)")).where("NOT linked").collect()
    assert [(r.ledger, r["index"]) for r in gone] == [("0", 3)]
    changes = spark.createDataFrame([("a", 1, "x", None), ("a", 2, None, 5), ("b", 1, "y", 1)], "id string, t int, p string, q int")
    assert {r.id: (r.p, r.q) for r in chain.replay(changes, "id", ["t"], ["p", "q"]).collect()} == {"a": ("x", 5), "b": ("y", 1)}


def test_tf_and_attributes(spark):
    assert one(spark, F.round(similarity.tf_similarity("a", "b"), 6), a="The cat, the cat!", b="cat") == 0.405
    assert one(spark, similarity.tf_similarity("a", "b"), a="the of", b="cat") == 0.0
    kind = "struct<fact_statement: string, category: string, tags: array<string>, source_id: string, author_creator: string>"
    df = spark.createDataFrame([(("a b", "c", ["t"], "s", None), ("a d", "c", ["t", "u"], "x", None))], f"a {kind}, b {kind}")
    assert abs(df.select(similarity.attribute_similarity("a", "b")).first()[0] - (0.4 / 3 + 0.2 + 0.1)) < 1e-9
