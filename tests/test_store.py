import hashlib
import json

import pytest
from pyspark.sql import functions as F

from factloom.operators import chain, evaluation, models, sharding
from factloom.operators import facts as O
from factloom.sources import ingest, sinks
from factloom.streaming import events

FACT = "fact_id string, fact_statement string, category string, reliability_rating string, usage_count int"


def rows(spark, n, start=0):
    return spark.createDataFrame([(f"f{i:04d}", f"statement {i}", "A" if i % 2 else "B", "VERIFIED", i) for i in range(start, start + n)], FACT)


def test_gold_files_and_report(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"items": [{"text": "a b", "facts": [{"subject": "a", "predicate": "p", "object": "b"}]}, {"text": "c"}]}))
    (tmp_path / "l.json").write_text(json.dumps([{"text": "a b", "facts": []}]))
    (tmp_path / "f.json").write_text(json.dumps({"facts": [{"subject": "a", "predicate": "p", "object": "b"}], "negative": [{"subject": "x", "object": "y"}]}))
    texts, gold = evaluation.load_gold_items(spark, str(tmp_path / "g.json"))
    assert [tuple(r) for r in texts.orderBy("item").collect()] == [(0, "a b"), (1, "c")] and [tuple(r) for r in gold.collect()] == [(0, 0, "a", "p", "b")]
    assert evaluation.load_gold_items(spark, str(tmp_path / "l.json"))[0].count() == 1
    good, bad = evaluation.load_gold_facts(spark, str(tmp_path / "f.json"))
    assert good.first().object == "b" and bad.first().subject == "x"
    text = evaluation.render_report("Title", {"n": 3, "precision": 0.5}, ["precision 0.5 is below 0.8"])
    assert "precision" in text and "failed" in text and "0.5000" in text


def test_blocks_of_a_shard(spark):
    kind = "subject string, predicate string, object string"
    gold = spark.createDataFrame([("Mitochondria", "p", "ATP"), ("Nucleus", "p", "DNA")], kind)
    shard = spark.createDataFrame([("Mitochondria", "p", "ATP", "VERIFIED", 3), ("the mitochondria", "p", "ATP energy", "LIKELY_TRUE", 2), ("x", "p", "y", "LIKELY_TRUE", 2)], kind + ", reliability_rating string, agreement int")
    got = {(r.scope, r.key): (r.n, r.tp, r.fp, r.fn, r.precision, r.recall) for r in evaluation.shard_blocks(shard, gold, gold.limit(0)).collect()}
    assert got["overall", "all"] == (3, 2, 1, 1, 0.6667, 0.6667) and got["tier", "LIKELY_TRUE"] == (2, 1, 1, 1, 0.5, 0.5) and got["agreement", "3"][:2] == (1, 1)
    same = {"mitochondria p atp": [1.0, 0.0], "nucleus p dna": [0.0, 1.0], "the mitochondria p atp energy": [0.9, 0.1], "x p y": [-1.0, 0.0]}
    row = evaluation.evaluate_shard(shard, gold, gold.limit(0), same.__getitem__).first()
    assert (row.n, row.precision, row.coverage) == (3, 0.6667, 0.5)


def test_shards(spark, tmp_path):
    first = sharding.place(rows(spark, 25), capacity=10)
    sizes = {r.shard_id: (r.facts, r.full) for r in sharding.statistics(first, 10).collect()}
    assert sizes == {"shard_0001": (10, True), "shard_0002": (10, True), "shard_0003": (5, False)}
    more = sharding.place(rows(spark, 12, 20), first, 10).collect()
    where = {r.fact_id: r.shard_id for r in first.collect()}
    assert all(r.shard_id == where[r.fact_id] for r in more if r.fact_id in where) and len(more) == 12
    new = [r.shard_id for r in more if r.fact_id not in where]
    assert new.count("shard_0003") == 5 and new.count("shard_0004") == 2
    ids = [r[0] for r in rows(spark, 5).select(sharding.md5_mod("fact_id", 7)).collect()]
    assert ids == [int(hashlib.md5(f"f{i:04d}".encode()).hexdigest(), 16) % 7 for i in range(5)]
    path = f"file://{tmp_path}/s"
    sharding.write_store(first, path)
    assert sharding.get_fact(spark, path, "f0007").first().fact_statement == "statement 7"
    with pytest.raises(ValueError):
        sharding.get_fact(spark, path, "none")
    plan = sharding.read_store(spark, path, ["shard_0002"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "shard_0002" in plan
    assert sharding.find(sharding.read_store(spark, path), category="A", usage_count=3).count() == 1
    changed = sharding.upsert(first, spark.createDataFrame([("f0001", "new")], "fact_id string, category string"))
    assert changed.where("category = 'new'").count() == 1
    with pytest.raises(ValueError):
        sharding.upsert(first, spark.createDataFrame([("f0001", "x")], "fact_id string, odd string"))
    left = sharding.remove(first, rows(spark, 15))
    assert {r.shard_id: r.facts for r in sharding.statistics(sharding.optimize(left, 10), 10).collect()} == {"shard_0001": 10}


def test_ledger_of_facts(spark):
    at = lambda n: f"2024-01-0{n}"
    moves = [(1, "add_fact", "a", {"category": "x", "n": "1"}), (2, "update_fact", "a", {"n": "2"}), (3, "add_fact", "b", {"category": "y"}), (4, "update_fact", "a", {"category": "z"})]
    df = spark.createDataFrame([("l", n, at(n), k, i, d) for n, k, i, d in moves], "ledger string, n int, at string, kind string, id string, data map<string, string>")
    lines = None
    for kind in ("add_fact", "update_fact"):
        part = df.where(F.col("kind") == kind).select("ledger", "n", chain.transaction(kind, "at", "id", "data").alias("body"))
        lines = part if lines is None else lines.unionByName(part)
    blocks = chain.build(lines, "ledger", ["n"], "body", size=2, zeros=1, genesis=True)
    assert [(r["index"], len(r.transactions)) for r in blocks.orderBy("index").collect()] == [(0, 0), (1, 2), (2, 2)]
    assert chain.verify(blocks).where("linked AND intact").count() == 3
    pending = spark.createDataFrame([("l", 0, json.dumps({"type": "update_fact", "timestamp": at(9), "fact_id": "b", "data": {"category": "w"}}))], "ledger string, position int, transaction string")
    said = chain.fact_transactions(blocks, pending)
    assert [r.timestamp for r in chain.fact_history(said, "a").collect()] == [at(1), at(2), at(4)]
    real = spark.createDataFrame([("a", "z", "2"), ("b", "y", None), ("c", "q", None)], "fact_id string, category string, n string")
    got = {r.fact_id: r for r in chain.verify_facts(real, said).collect()}
    assert got["a"].verified and got["a"].transactions == 3 and (got["a"].first_recorded, got["a"].last_updated) == (at(1), at(4))
    assert not got["b"].verified and got["b"].mismatches == ["category"] and not got["c"].verified and got["c"].transactions == 0
    assert {tuple(r) for r in chain.rebuild(said, ["category", "n"]).collect()} == {("a", "z", "2"), ("b", "w", None)}


def test_fact_changes(spark, tmp_path):
    base = O.add(rows(spark, 0).withColumn("quality_score", F.lit(0.0)), rows(spark, 3))
    assert {r.fact_id: r.quality_score for r in base.collect()} == {"f0000": 40.0, "f0001": 42.0, "f0002": 44.0}
    for bad in (rows(spark, 1), rows(spark, 1, 9).withColumn("reliability_rating", F.lit("odd")), rows(spark, 2, 9).withColumn("fact_id", F.lit("z"))):
        with pytest.raises(ValueError):
            O.add(base, bad)
    assert O.get(base, "f0001")["category"] == "A"
    with pytest.raises(ValueError):
        O.get(base, "none")
    after = base.where("fact_id <> 'f0000'").withColumn("category", F.when(F.col("fact_id") == "f0002", "C").otherwise(F.col("category"))).unionByName(base.limit(1).withColumn("fact_id", F.lit("n")))
    assert {(r.fact_id, r.change, tuple(r.attributes or [])) for r in O.change_log(base, after, "t").collect()} == {("f0000", "deleted", ()), ("f0002", "updated", ("category",)), ("n", "added", ())}
    edges = spark.createDataFrame([("a", "b", "p", 1.0)], "src string, dst string, predicate string, weight double")
    sinks.write_snapshot(base, edges, f"file://{tmp_path}/snap")
    f, e = sinks.read_snapshot(spark, f"file://{tmp_path}/snap")
    assert {r.fact_id: r.usage_count for r in f.collect()} == {"f0000": 0, "f0001": 1, "f0002": 2} and e.first().dst == "b" and "publication_date" in f.columns
    (tmp_path / "in.json").write_text(json.dumps({"x": {"fact_statement": "s", "tags": ["a", "b"], "related_facts": "q, r", "date_recorded": "2024-01-02T03:04:05", "access_level": "public", "reliability_rating": "verified", "usage_count": 3}, "y": {"tags": "m, n", "publication_date": "odd"}}))
    got = {r.fact_id: r for r in ingest.load_facts_json(spark, str(tmp_path / "in.json")).collect()}
    assert got["x"].tags == ["a", "b"] and got["x"].related_facts == ["q", "r"] and got["x"].date_recorded.year == 2024 and got["x"].reliability_rating == "VERIFIED" and got["y"].tags == ["m", "n"] and got["y"].publication_date is None


def test_pages_by_callback(spark):
    pages = spark.createDataFrame([("u1", "<b>x</b>"), ("u2", "fail"), ("u3", None)], "url string, html string")

    def parser(page):
        if page == "fail":
            raise ValueError(page)
        return [{"fact_statement": page, "reliability_rating": "VERIFIED"}, {"subject": 3}]

    got = {r.fact_id: r for r in ingest.facts_of_pages(pages, parser).collect()}
    assert set(got) == {"u1#0", "u1#1"} and got["u1#0"].reliability_rating == "VERIFIED" and got["u1#1"].subject == "3" and got["u1#1"].category == "General"


def test_models_reports(spark):
    agreed = spark.createDataFrame([("s1", 2, 5, "a,b", "LIKELY_TRUE"), ("s2", 3, 3, "a,b,c", "VERIFIED"), ("s0", 2, 5, "b,d", "LIKELY_TRUE")], "fact_statement string, agreement int, members int, source_models string, reliability_rating string")
    assert [r.fact_statement for r in models.report_rows(agreed).collect()] == ["s2", "s0", "s1"]
    assert [r.quality_score for r in models.verified_facts(agreed, 3).collect()] == [43.0]
    row = models.manifest(agreed, "m", 2).first()
    assert (row.models, row.facts, row.verified, row.likely_true, row.possibly_true, row.input_facts) == ("a,b,c,d", 3, 1, 2, 0, 3)
    text = spark.createDataFrame([("m", "d", ["p", "q"])], "model string, domain string, prompts array<string>")
    assert text.select(models.model_content_hash("model", "domain", "prompts").alias("h")).first().h == hashlib.sha256(b"m\0d\0p\0q\0").hexdigest()
    owner = spark.createDataFrame([(("x",), None, "y"), (None, "s", "y"), (None, None, "y")], "model_provenance struct<model: string>, _source string, model string")
    assert [r[0] for r in owner.select(models.model_of(owner)).collect()] == ["x", "s", "y"] and models.of_models(owner).count() == 1
    assert models.list_models(lambda: ["b", "a", "x-Embed", "a"]) == ["a", "b"] and models.list_models(lambda: 1 / 0) == []
    drops = spark.createDataFrame([("d1", "Marie Curie discovered Radium."), ("d2", None), ("d3", " ")], "drop_id string, source_text string")
    assert {r.drop_id for r in models.reextract(drops, "svo").collect()} == {"d1-reextract-svo"}
    said = {"facts": [{"subject": "Cells", "predicate": "hold", "object": "DNA", "confidence": 0.9}]}
    prompts = spark.createDataFrame([("bio", "ask", "list")], "domain string, prompt string, prompt_type string")
    assert [r.agreement for r in models.probe_domain(prompts, {"m1": lambda p: said, "m2": lambda p: said}).collect()] == [2]
    facts, edges = models.consensus_graph(spark.createDataFrame([(1, "Marie Curie discovered Radium. Radium is a metal.")], "doc_id long, text string"), ["svo", "pattern"])
    assert facts.where("agreement = 2").count() == 1 and edges.count() >= 1
    stats = O.dataset_stats(spark.createDataFrame([([("user", "abc"), ("assistant", "x")], "VERIFIED"), ([("user", "a")], None)], "messages array<struct<role: string, content: string>>, reliability_rating string")).first()
    assert (stats.records, stats.verified, stats.unverified, stats.mean_user_chars, stats.mean_assistant_chars) == (2, 1, 1, 2.0, 1.0)
    assert models.batch_report(spark.createDataFrame([("ok", 3), ("skipped", 0), ("error: x", 0)], "status string, facts int")).first().asDict() == {"items": 3, "dropped": 1, "skipped": 1, "errors": 1, "facts": 3}


def test_streams_of_fact_changes(spark, tmp_path):
    def made(action, at, *values):
        df = spark.createDataFrame([(i, at, c, n) for i, c, n in values], "fact_id string, ts string, category string, n int")
        return events.change_events(df, action)

    path = f"file://{tmp_path}/in"
    steps = [made("add", "2024-01-01", ("a", "x", 1), ("b", "y", 2)), made("update", "2024-01-02", ("a", "z", None), ("q", "w", 1)), made("delete", "2024-01-03", ("b", None, None)), made("add", "2024-01-04", ("b", "again", None))]
    for part in steps[:3]:
        events.export_events(part, path)
    events.upsert_facts(events.read_changes(spark, path), f"file://{tmp_path}/out", f"file://{tmp_path}/check").awaitTermination()
    state = spark.read.parquet(f"file://{tmp_path}/out/0")
    assert {r.fact_id: (r.data, r.gone) for r in state.collect()} == {"a": ({"category": "z", "n": "1"}, False), "b": ({}, True), "q": ({}, True)}
    events.export_events(steps[3], path)
    events.upsert_facts(events.read_changes(spark, path), f"file://{tmp_path}/out", f"file://{tmp_path}/check").awaitTermination()
    state = {r.fact_id: r for r in spark.read.parquet(f"file://{tmp_path}/out/1").collect()}
    assert state["b"].data == {"category": "again"} and not state["b"].gone and state["a"].data["category"] == "z"
    with pytest.raises(ValueError):
        made("odd", "2024-01-01", ("a", "x", 1))


def test_watched_files(spark, tmp_path):
    files = lambda *x: spark.createDataFrame(list(x), "path string, modified timestamp, text string")
    import datetime as dt

    store, day = f"file://{tmp_path}/w", lambda n: dt.datetime(2024, 1, n)

    def process(path, text):
        if text == "bad":
            raise ValueError("bad text")
        return len(text)

    first = {r.path: (r.state, r.error) for r in events.scan_folder(spark, files(("a", day(1), "xy"), ("b", day(1), "bad"), ("c", day(1), "")), store, process).collect()}
    assert first == {"a": ("PROCESSED", None), "b": ("FAILED", "bad text"), "c": ("SKIPPED", None)}
    again = {r.path: r.state for r in events.scan_folder(spark, files(("a", day(1), "xy"), ("b", day(1), "ok"), ("c", day(2), "new")), store, process).collect()}
    assert again == {"b": "PROCESSED", "c": "PROCESSED"}
    assert {r.path: r.state for r in events.watched(spark, store).collect()} == {"a": "PROCESSED", "b": "PROCESSED", "c": "PROCESSED"}


def test_budgets_of_long_groups(spark):
    rows = [(g, i, "x" * (4 * ((i * 7) % 11 + 1))) for g in ("a", "b", None) for i in range(300)]
    got = {}
    for r in O.budget(spark.createDataFrame(rows, "g string, n int, record string"), 60, ["n"], ["g"]).collect():
        got.setdefault(r.g, []).append((r.position, r.cost))
    used, want = 0, []
    for i in range(300):
        cost = (i * 7) % 11 + 1
        if used + cost <= 60:
            want.append((len(want), cost))
            used += cost
    assert all(sorted(v) == want for v in got.values()) and set(got) == {"a", "b", None}


def test_small_helpers(spark, tmp_path):
    from factloom.functions import text as T
    from factloom.operators import graph, vectors

    row = spark.createDataFrame([(" Is  Located\tin ",)], "p string").select(T.normal_predicate("p").alias("p"), T.utc_now().alias("t")).first()
    assert row.p == "is_located_in" and row.t.endswith("Z") and len(row.t) == 20
    assert models.generate(lambda p: ("a", None), "x") == ("a", 0.0) and models.generate(lambda p: 1 / 0, "x") == ("", 0.0)
    f = spark.createDataFrame([("a",), ("b",), ("c",)], "block_id string")
    e = spark.createDataFrame([("a", "b", "p", 1.0), ("b", "c", "p", 1.0), ("c", "a", "p", 1.0)], "src string, dst string, predicate string, weight double")
    left, links = graph.delete_facts(f, e, f.where("block_id = 'b'"))
    assert {r.block_id for r in left.collect()} == {"a", "c"} and [r.src for r in links.collect()] == ["c"]
    facts = spark.createDataFrame([("s1", "one.", "VERIFIED", 12.6), ("s1", "two.", "VERIFIED", 3.0), ("s2", "three.", "VERIFIED", 5.0)], "source string, fact_statement string, reliability_rating string, quality_score double")
    store = f"file://{tmp_path}/store"
    assert sinks.drop_summary(spark, store).count() == 0
    sinks.write_drops(facts, store, "2024-01-01T00:00:00Z")
    assert {r.source: r.num_facts for r in sinks.drop_summary(spark, store).collect()} == {"s1": 2, "s2": 1}
    records = [json.loads(r.record) for r in sinks.drop_records(spark, store).collect()]
    assert sorted(len(r["facts"]) for r in records) == [1, 2]
    table = sinks.rebuild_catalog(spark, store, f"file://{tmp_path}/catalog")
    assert {r.quality_score for r in table.collect()} == {13, 3, 5} and O.load_seen(spark, f"file://{tmp_path}/catalog").count() == 3
    v = spark.createDataFrame([(i, [1.0, i / 100]) if i < 5 else (i, [i / 100, 1.0]) for i in range(10)], "vec_id long, embedding array<double>")
    two = {r.vec_id: r.cluster for r in vectors.cluster_vectors(v, 2, rounds=10).collect()}
    assert len({two[i] for i in range(5)}) == 1 and two[0] != two[9]
    assert {r.cluster for r in vectors.cluster_vectors(v, 3).collect()} <= set(range(10))
    with pytest.raises(ValueError):
        vectors.assign_clusters(v, spark.range(vectors.CENTRES + 1).select(F.col("id").alias("cluster"), F.array(F.lit(1.0)).alias("centre")))
