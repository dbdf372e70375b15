import pytest
from pyspark.sql import functions as F

from factloom.operators import chain, extract, graph, models
from factloom.plans import tools
from factloom.sources import sinks
from tests.test_operators import graph_facts


def test_entities_and_patterns(spark):
    assert [(t, k) for _, _, t, k in extract.entities("Jane Doe works for Apple Inc near Salt Lake City since 4 Jan 2001, says NASA in Hawaii.")] == [
        ("Jane Doe", "PERSON"), ("Apple Inc", "ORGANIZATION"), ("Salt Lake City", "LOCATION"), ("4 Jan 2001", "DATE"), ("NASA", "ORGANIZATION"), ("Hawaii", "ENTITY"),
    ]
    docs = spark.createDataFrame([(1, "Marie Curie discovered radium! it rains. Jane Doe works for Apple Inc."), (2, None)], "doc_id long, text string")
    got = extract.extract_facts(docs, extractor="pattern").withColumns({"c": extract.category(), "t": extract.tags()}).collect()
    assert [(r.subject, r.predicate, r.object, r.c) for r in got] == [("Marie Curie", "discovered", "radium", "General"), ("Jane Doe", "works_for", "Apple Inc", "Employment")]
    assert got[1].t == ["person", "organization", "works_for"]
    both = models.consensus(docs, ["svo", "pattern"]).where("subject = 'marie curie'").first()
    assert (both.agreement, both.source_models, both.reliability_rating) == (2, "pattern,svo", "LIKELY_TRUE")


def test_prompts(spark):
    rows = models.prompts(spark, "biology", ["Cell", "Gene"], 40).collect()
    assert len(rows) == 40 and {r.prompt_type for r in rows} == {"entity", "relation", "concept", "list"} and rows == models.prompts(spark, "biology", ["Cell", "Gene"], 40).collect()
    assert all("{" not in r.prompt and ("Cell" in r.prompt or "Gene" in r.prompt) for r in rows)
    assert all("Cell" in r.prompt and "Gene" in r.prompt for r in rows if r.prompt_type == "relation")
    assert "negative" in {r.prompt_type for r in models.prompts(spark, "b", ["X"], 60, negative=True).collect()}
    assert {r.prompt for r in models.prompts(spark, "b", [], 3).collect()} == {models.BARE.format(domain="b")}
    for bad in (lambda: models.render("odd"), lambda: models.render("relation", a="x", domain="y")):
        with pytest.raises(ValueError):
            bad()


def test_grid_resumes_and_isolates_errors(spark):
    def prober(model, domain):
        if model == "bad":
            raise RuntimeError("down")
        return 3

    done = spark.createDataFrame([("a", "x")], "model string, domain string")
    got = {(r.model, r.domain): (r.facts, r.status) for r in models.run_grid(spark, ["a", "bad"], ["x", "y"], done, prober, 2).collect()}
    assert got == {("a", "x"): (0, "skipped"), ("a", "y"): (3, "ok"), ("bad", "x"): (0, "error: down"), ("bad", "y"): (0, "error: down")}
    assert [r.model for r in models.language_models(spark.createDataFrame([("m-Embed",), ("m",)], "model string")).collect()] == ["m"]


def test_crawl(spark):
    said = {"Cells": ("Cells contain Mitochondria. Cells need Energy.", -0.1), "Mitochondria": ("Mitochondria produce ATP.", 0.0), "Energy": ("Energy is Odd.", -9.0), "ATP": ("ATP fuels Muscles.", -0.2)}
    rows = models.crawl(spark, "Cells", lambda p: said.get(p.split("'")[1], ("", 0.0)), depth=2).collect()
    assert {(r.subject, r.predicate, r.object, r.depth) for r in rows} == {("Cells", "contain", "Mitochondria", 0), ("Cells", "need", "Energy", 0), ("Mitochondria", "produce", "ATP", 1), ("ATP", "fuels", "Muscles", 2)}


def test_selection(spark):
    kind = "pos long, model string, subject string, predicate string, object string, fact_statement string, quality_score double"
    rows = [(1, "a", "X", "is", "Y", "X is Y.", 1.0), (2, "b", "X", "is", "Y", "X is Y.", 2.0), (3, "c", "x", "is", "y", "x is y.", 1.0), (4, "a", "P", "is", "Q", "P is Q.", 1.0)]
    df = spark.createDataFrame(rows, kind)
    got = models.select(df).collect()
    assert [(r.fact_statement, r.agreement, r.reliability_rating, r.quality_score) for r in got] == [("X is Y.", 3, "VERIFIED", 43.0), ("P is Q.", 1, "POSSIBLY_TRUE", 21.0)]
    assert models.select(df, min_agreement=2).count() == 1 and models.select(df, min_reliability="VERIFIED").count() == 1 and models.select(df, top_k=1).count() == 1
    assert models.report(models.statement_tier(df)).first().asDict() == {"clusters": 2, "verified": 1, "likely": 0, "possibly": 1}
    judged = models.critic(df.withColumn("reliability_rating", F.lit("VERIFIED")), lambda s: "P" not in s).where("NOT factual").collect()
    assert [(r.subject, r.reliability_rating, r.quality_score) for r in judged] == [("P", "UNVERIFIED", 0.0)]


def test_drops_are_written_once(spark, tmp_path):
    facts = spark.createDataFrame([("a.txt", "S1.", "VERIFIED", 9.0), ("a.txt", "S2.", "VERIFIED", 9.0), ("b.txt", "S3.", "VERIFIED", 9.0)], "source string, fact_statement string, reliability_rating string, quality_score double")
    path = f"file://{tmp_path}/store"
    assert sinks.read_drops(spark, path).count() == 0
    assert sinks.write_drops(facts, path, "2026-02-03T00:00:00Z").count() == 2
    assert sinks.write_drops(facts.unionByName(spark.createDataFrame([("c.txt", "S4.", "VERIFIED", 1.0)], facts.schema)), path, "2026-03-03T00:00:00Z").count() == 1
    got = sinks.read_drops(spark, path).collect()
    assert sorted(r.fact_statement for r in got) == ["S1.", "S2.", "S3.", "S4."] and len({r.drop_id for r in got}) == 3
    full = facts.withColumns({"fact_id": F.col("fact_statement"), "subject": F.lit("S"), "category": F.lit("c"), "question": F.lit(None).cast("string"), "answer": F.lit(None).cast("string")})
    assert sinks.write_training(full, f"file://{tmp_path}/out", "chat") == 3
    with pytest.raises(ValueError):
        sinks.write_training(full, f"file://{tmp_path}/out", "odd")


def test_graph_files_chains_and_tools(spark, tmp_path):
    v = ("VERIFIED", 1, 10.0)
    f = graph_facts(spark, [("ATP", "is a", "Compound", v), ("Cell", "makes", "ATP", v)])
    e = graph.link(f)
    for kind in ("graphml", "gexf"):
        text = sinks.graph_xml(f, e, kind)
        assert text.count("<node ") == 2 and text.count("<edge ") == 1
    blocks = chain.build(spark.createDataFrame([(0, i, f"t{i}") for i in range(25)], "l int, i int, body string"), "l", ["i"], "body", zeros=1)
    sinks.write_chain(blocks, f"file://{tmp_path}/chain")
    assert sinks.read_chain(spark, f"file://{tmp_path}/chain").count() == 3
    sinks.write_chain(blocks.withColumn("nonce", F.col("nonce") + 1), f"file://{tmp_path}/bent")
    with pytest.raises(ValueError):
        sinks.read_chain(spark, f"file://{tmp_path}/bent")
    t = tools.GraphTools(f, e)
    assert [x["name"] for x in tools.list_tools()] == list(tools.TOOLS)
    assert tools.handle_tool_call(t, "graph_find_by_subject", {"subject": "atp"})["result"][0]["object"] == "Compound"
    assert tools.handle_tool_call(t, "graph_query", {"query": "SELECT count(*) AS n FROM RELATED"}) == {"ok": True, "result": [{"n": 1}]}
    assert len(tools.handle_tool_call(t, "graph_find_by_reliability", {"reliability": "VERIFIED"})["result"]) == 2
    assert tools.handle_tool_call(t, "graph_distill_ontology", None)["result"]["taxonomy"] == [{"parent": "Compound", "children": "ATP"}]
    assert not tools.handle_tool_call(t, "odd", {})["ok"] and not tools.handle_tool_call(t, "graph_query", {})["ok"] and not tools.handle_tool_call(t, "graph_query", {"query": "DROP TABLE x"})["ok"]
