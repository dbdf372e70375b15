"""Command line: ``python -m factloom COMMAND``. A store is a folder of drops; results are printed as JSON lines."""

from __future__ import annotations

import argparse
import datetime
import importlib
import json
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import schema, session
from factloom.functions import text as T
from factloom.operators import evaluation, extract, graph, models, similarity
from factloom.operators import facts as O
from factloom.plans import tools
from factloom.sources import ingest, sinks
from factloom.streaming import events

#: longest objects; strict asks for named things too
FILTERS = {"none": None, "standard": 80, "strict": 60}


def documents_to_facts(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Facts of all files of a folder, of quality, with the columns of a store."""
    found = extract.extract_facts(ingest.load_folder(spark, args.path), "source_id", args.engine, args.coref)
    longest = args.longest if args.filter == "standard" else FILTERS[args.filter] and min(FILTERS[args.filter], args.longest)
    if longest is not None:
        found = found.where(T.is_acceptable("subject", "object", F.col("subject_type") if args.filter == "strict" else None, longest=longest))
    rated = found.withColumns({"reliability_rating": F.lit(args.reliability), "category": extract.category(), "usage_count": F.lit(1), "source": F.col("source_id")})
    return rated.withColumn("quality_score", O.quality_score())


def store_facts(spark: SparkSession, path: str) -> DataFrame:
    """Facts of a store with ids, as the graph and the catalog take them."""
    rows = sinks.read_drops(spark, path)
    return rows.withColumns({"block_id": T.block_id("subject", "predicate", "object"), "agreement": F.lit(1)}).withColumn("fact_id", F.concat_ws(":", "drop_id", "block_id"))


def show(rows: DataFrame, limit: int | None = None) -> None:
    for r in (rows if limit is None else rows.limit(limit)).collect():
        print(json.dumps(r.asDict(True), ensure_ascii=False, default=str))


def distill(spark, a):
    facts = documents_to_facts(spark, a)
    facts = similarity.deduplicate(facts, a.dedup) if a.dedup else facts
    facts = facts.orderBy(F.desc("quality_score"), "fact_id").limit(a.top_k) if a.top_k else facts
    print(sinks.write_training(facts, a.output, a.format))


def drop(spark, a):
    new = sinks.write_drops(documents_to_facts(spark, a), a.store, now())
    sinks.write_texts(ingest.load_folder(spark, a.path), new, a.store)
    show(new)


def catalog(spark, a):
    rows = store_facts(spark, a.store)
    given = {"source": a.source, "reliability_rating": a.reliability, "category": a.category}
    if a.min_quality is None and not any(given.values()):
        show(O.catalog_stats(rows))
    else:
        show(O.catalog_query(rows, a.min_quality, a.limit, **given))


def compile_(spark, a):
    print(sinks.write_training(O.catalog_query(store_facts(spark, a.store), a.min_quality), a.output, a.format))


def audit(spark, a):
    show(O.audit(store_facts(spark, a.store)))


def lifecycle(spark, a):
    if a.what == "reextract":
        return reextract(spark, a)
    rows = store_facts(spark, a.store)
    show(O.promote(rows, a.min_sources) if a.what == "promote" else O.contradictions(rows))


def reason(spark, a):
    rows = O.ingest(store_facts(spark, a.store).limit(0), store_facts(spark, a.store))
    edges = graph.link(rows)
    show({"link": lambda: edges, "contradictions": lambda: graph.contradictions(rows), "transitive": lambda: graph.transitive(rows, edges), "validate": lambda: graph.reconcile(rows).where("demoted"), "instructions": lambda: graph.chain_instructions(rows, edges), "taxonomy": lambda: graph.taxonomy(rows), "types": lambda: graph.semantic_types(rows), "entities": lambda: similarity.resolve_entities(rows)[0]}[a.what]())


def ask(spark, a):
    rows = O.ingest(store_facts(spark, a.store).limit(0), store_facts(spark, a.store))
    print(graph.context(graph.retrieve(rows, graph.link(rows), a.query, a.top_k, a.hops, verified_only=not a.unverified)).first()[0])


def prepare(spark, a):
    rows = O.prepare_sft(spark.read.text(a.path), a.min_reliability)
    rows.where("problem IS NULL").select("value").write.mode("overwrite").text(a.output)
    show(rows.groupBy(F.coalesce("problem", F.lit("kept")).alias("verdict")).count())


def evaluate(spark, a):
    """Precision, recall and F1 of an extractor over labelled texts."""
    texts, gold = evaluation.load_gold_items(spark, a.gold)
    found = extract.extract_facts(texts, "item", a.engine).select(F.col("source_id").cast("int").alias("item"), F.col("ordinal").alias("position"), "subject", "predicate", "object")
    print(evaluation.render_report("Extraction", evaluation.evaluate(found, gold).first().asDict()))


def batch(spark, a):
    """A drop for each file of a folder; those that the store has already are skipped."""
    found, _ = session.stage_table(documents_to_facts(spark, a), "batch")
    new = sinks.write_drops(found, a.store, now())
    rows = found.groupBy("source").agg(F.count("*").alias("facts")).join(new.select("source", F.lit("ok").alias("status")), "source", "left")
    rows = rows.select("source", F.when(F.col("status").isNull(), 0).otherwise(F.col("facts")).alias("facts"), F.coalesce("status", F.lit("skipped")).alias("status"))
    show(rows.orderBy("source"))
    show(models.batch_report(rows))


def reextract(spark, a):
    texts = sinks.read_texts(spark, a.store)
    facts = models.reextract(texts, a.engine).withColumns({"reliability_rating": F.lit("UNVERIFIED"), "category": extract.category(), "usage_count": F.lit(1), "source": F.col("drop_id")})
    show(sinks.write_drops(facts.withColumn("quality_score", O.quality_score()), a.store, now()))


def backend(name: str):
    """What ``module:function`` names."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def probe(spark, a):
    """Ask a back end for facts of a domain; the outputs are JSON lines."""
    asked = models.prompts(spark, a.domain, a.entities or [], a.number, a.seed, a.negative)
    outputs = extract.probe(asked, backend(a.backend), a.model, a.backend)
    outputs.write.mode("append").json(a.output)
    print(spark.read.json(a.output).count())


def probed(spark, path: str) -> DataFrame:
    """Claims of probe outputs, as corroboration takes them."""
    rows = extract.probe_facts(spark.read.schema(extract.PROBED).json(path))
    return session.stage_table(rows.withColumns({"model": models.model_of(rows), "pos": F.monotonically_increasing_id()}), "claims")[0]


def graveyard(spark, a):
    """Every model on every domain, each once; an error stays with its pair."""
    done = sinks.read_json(spark, a.output, "model string, domain string, facts long, status string").where("status = 'ok'")
    ask = backend(a.backend)
    rows, _ = session.stage_table(models.run_grid(spark, models.list_models(lambda: a.models), a.domains, done, ask), "grid")
    rows.where("status <> 'skipped'").write.mode("append").json(a.output)
    show(rows.orderBy("model", "domain"))
    show(models.batch_report(rows))


def model_distill(spark, a):
    """Corroborated facts of probe outputs as training records, with a manifest."""
    claims = probed(spark, a.path)
    chosen, _ = session.stage_table(models.select(claims, a.min_agreement, a.min_reliability), "selected")
    named = chosen.withColumns({"category": F.lit("General"), "fact_id": F.col("seed").cast("string")})
    print(sinks.write_training(named, a.output, a.format, [F.desc("agreement"), F.desc("quality_score"), "fact_statement"]))
    show(models.manifest(chosen, a.name, a.min_agreement, claims))
    show(O.distilled_stats(claims, chosen))


def model_eval(spark, a):
    """A model's facts against a gold set; with --ci a missed gate is an error."""
    gold, negative = evaluation.load_gold_facts(spark, a.gold)
    shard = models.statement_tier(probed(spark, a.path))
    row = evaluation.evaluate_shard(shard, gold, negative).first().asDict()
    failures = evaluation.check_gates(row)
    print(evaluation.render_report("Model facts", row, failures))
    show(evaluation.shard_blocks(shard, gold, negative).orderBy("scope", "key"))
    return 1 if a.ci and failures else 0


def graph_ingest(spark, a):
    """Corroborated facts of probe outputs into a graph snapshot."""
    agreed = models.verified_facts(models.statement_tier(probed(spark, a.path)), a.min_models)
    facts = agreed.withColumns({"fact_id": F.col("seed").cast("string"), "block_id": T.block_id("subject", "predicate", "object")})
    facts, _ = session.stage_table(facts, "graph")
    sinks.write_snapshot(facts, graph.link(facts), a.output)
    print(facts.count())


def watch(spark, a):
    """Facts of new, changed and failed files of a folder, pass after pass."""
    while True:
        files = watched_files(spark, a.path)
        done = events.scan_folder(spark, files, f"{a.store}/watched", count_facts)
        fresh = files.join(done.where("state = 'PROCESSED'").select("path"), "path", "left_semi").withColumn("source_id", F.col("path"))
        rated = extract.extract_facts(fresh, "source_id", a.engine).withColumns({"reliability_rating": F.lit("UNVERIFIED"), "category": extract.category(), "usage_count": F.lit(1), "source": F.col("source_id")})
        sinks.write_drops(rated.withColumn("quality_score", O.quality_score()), a.store, now())
        show(done.orderBy("path"))
        if a.once:
            return
        time.sleep(a.every)


def watched_files(spark, path: str) -> DataFrame:
    files = ingest.load_folder(spark, path).select("path", "text")
    times = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("modificationTime").alias("modified"))
    return files.join(times, "path")


def count_facts(path: str, text: str) -> int:
    """Sentences that may hold a fact: what a file is watched for."""
    return sum(1 for s in (text or "").split(".") if len(s.split()) > 2)


def consensus(spark, a):
    """What several extractors find in the same files."""
    docs = ingest.load_folder(spark, a.path)
    facts, edges = models.consensus_graph(docs, a.engines.split(","), "source_id")
    show(facts.orderBy(F.desc("agreement"), "fact_statement"), a.limit)
    show(spark.createDataFrame([(facts.count(), edges.count())], "facts long, edges long"))


def crawl(spark, a):
    """Facts that a back end tells on a topic and on the topics that it names."""
    found = models.crawl(spark, a.topic, backend(a.backend), a.depth, a.fan_out, a.least)
    rows = found.withColumns({"reliability_rating": F.lit("UNVERIFIED"), "category": extract.category(), "usage_count": F.lit(1), "source": F.col("source_id")})
    show(sinks.write_drops(rows.withColumn("quality_score", O.quality_score()), a.store, now()))


def critique(spark, a):
    """Facts that rules, and a back end where one is named, don't hold to be factual."""
    judged = models.critic(store_facts(spark, a.store), backend(a.backend) if a.backend else None)
    show(judged.where("NOT factual").select("fact_id", "fact_statement", "verdict"))


def compile_sft(spark, a):
    print(sinks.write_training(O.at_least(store_facts(spark, a.store), a.min_reliability), a.output, a.format))


def serve(spark, a):
    """Tool calls as JSON lines: ``{"name": …, "arguments": …}`` in, the result out; ``{"name": "list_tools"}`` lists them."""
    rows = O.ingest(store_facts(spark, a.store).limit(0), store_facts(spark, a.store))
    served = tools.GraphTools(session.stage_table(rows, "served")[0])
    for line in sys.stdin:
        if not line.strip():
            continue
        try:
            call = json.loads(line)
            answer = {"ok": True, "result": tools.list_tools()} if call.get("name") == "list_tools" else tools.handle_tool_call(served, call.get("name", ""), call.get("arguments"))
        except (ValueError, AttributeError) as e:
            answer = {"ok": False, "error": str(e)}
        print(json.dumps(answer, ensure_ascii=False, default=str), flush=True)


def entities(spark, a):
    """Names that are one entity's, and the facts rewritten."""
    names, facts = similarity.resolve_entities(store_facts(spark, a.store), a.threshold)
    show(names.orderBy("canonical", "entity"))
    if a.output:
        facts.write.mode("overwrite").json(a.output)


def graph_instructions(spark, a):
    """Instructions from chains and contradictions of a store's graph."""
    rows = O.ingest(store_facts(spark, a.store).limit(0), store_facts(spark, a.store))
    found = graph.chain_instructions(rows, graph.link(rows), a.max_chains).select("instruction", "response").unionByName(graph.contradiction_instructions(rows).select("instruction", "response"))
    found.select(F.to_json(F.struct("instruction", F.lit("").alias("input"), F.col("response").alias("output"))).alias("value")).write.mode("overwrite").text(a.output)
    print(spark.read.text(a.output).count())


def ontology(spark, a):
    rows = store_facts(spark, a.store)
    types = graph.semantic_types(rows)
    for part in (graph.taxonomy(rows), types, graph.relation_schema(rows, types)):
        show(part.orderBy(*part.columns))


def now() -> str:
    return datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="factloom")
    sub = out.add_subparsers(dest="command", required=True)

    def command(name, run, *arguments):
        p = sub.add_parser(name, help=(run.__doc__ or "").strip() or None)
        p.set_defaults(run=run)
        for flags, options in arguments:
            p.add_argument(*flags, **options)

    arg = lambda *flags, **options: (flags, options)
    store, form = arg("store"), arg("--format", default="chat", choices=["chat", "instruction", "text", "alpaca", "sharegpt", "plain"])
    source = [arg("path"), arg("--engine", default="svo"), arg("--coref", action="store_true"), arg("--filter", default="standard", choices=list(FILTERS)), arg("--longest", type=int, default=80), arg("--reliability", default="UNVERIFIED", choices=schema.TIERS)]
    command("distill", distill, *source, arg("output"), form, arg("--dedup", type=float, default=0.8), arg("--top-k", type=int))
    command("drop", drop, *source, store)
    command("catalog", catalog, store, arg("--source"), arg("--reliability"), arg("--category"), arg("--min-quality", type=float), arg("--limit", type=int, default=20))
    command("compile", compile_, store, arg("output"), form, arg("--min-quality", type=float))
    command("audit-store", audit, store)
    command("lifecycle", lifecycle, arg("what", choices=["promote", "contradictions", "reextract"]), store, arg("--min-sources", type=int, default=2), arg("--engine", default="pattern"))
    command("graph-reason", reason, arg("what", choices=["link", "contradictions", "transitive", "validate", "instructions", "taxonomy", "types", "entities"]), store)
    command("query-graph", ask, store, arg("query"), arg("--top-k", type=int, default=5), arg("--hops", type=int, default=2), arg("--unverified", action="store_true"))
    command("model-prep", prepare, arg("path"), arg("output"), arg("--min-reliability", choices=schema.TIERS))
    back, agreed = arg("--backend", required=True), arg("--min-agreement", type=int, default=1)
    command("eval", evaluate, arg("gold"), arg("--engine", default="svo"))
    command("batch", batch, *source, store)
    command("model-probe", probe, arg("domain"), arg("output"), back, arg("--model", default="custom"), arg("--entities", nargs="*"), arg("--number", type=int, default=10), arg("--seed", type=int, default=42), arg("--negative", action="store_true"))
    command("graveyard", graveyard, arg("output"), back, arg("--models", nargs="+", required=True), arg("--domains", nargs="+", required=True))
    command("model-distill", model_distill, arg("path"), arg("output"), form, agreed, arg("--min-reliability", default="UNVERIFIED", choices=schema.TIERS), arg("--name", default="model_shard"))
    command("model-eval", model_eval, arg("path"), arg("gold"), arg("--ci", action="store_true"))
    command("graph-ingest", graph_ingest, arg("path"), arg("output"), arg("--min-models", type=int, default=1))
    command("watch-daemon", watch, arg("path"), store, arg("--engine", default="svo"), arg("--once", action="store_true"), arg("--every", type=float, default=5.0))
    command("consensus", consensus, arg("path"), arg("--engines", default="svo,pattern"), arg("--limit", type=int, default=20))
    command("crawl", crawl, arg("topic"), store, back, arg("--depth", type=int, default=2), arg("--fan-out", type=int, default=3), arg("--least", type=float, default=-1.5))
    command("critique", critique, store, arg("--backend"))
    command("compile-sft", compile_sft, store, arg("output"), arg("--format", default="alpaca", choices=["alpaca", "sharegpt"]), arg("--min-reliability", default="UNVERIFIED", choices=schema.TIERS))
    command("serve-mcp", serve, store)
    command("resolve-entities", entities, store, arg("--threshold", type=float, default=0.85), arg("--output"))
    command("compile-graph-instructions", graph_instructions, store, arg("output"), arg("--max-chains", type=int))
    command("distill-ontology", ontology, store)
    return out


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(arguments)
    spark = spark or SparkSession.getActiveSession() or session.local_session()
    code = args.run(spark, args)
    session.clean(spark)
    return code or 0


if __name__ == "__main__":
    sys.exit(main())
