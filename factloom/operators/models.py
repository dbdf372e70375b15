"""Model outputs as facts: prompts, probing grids, crawls, corroboration and selection."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from factloom import schema
from factloom.functions import text as T
from factloom.operators import extract, graph, similarity
from factloom.session import stage_table

_TRIPLE = "subject-predicate-object"
#: kind of prompt to (entities it needs, its text)
PROMPTS = {
    "entity": (1, f"State three distinct, verified factual statements about {{a}} in the field of {{domain}}. Write each as a clear {_TRIPLE} triple."),
    "relation": (2, f"State how {{a}} and {{b}} are related in the field of {{domain}}, as one or more {_TRIPLE} facts."),
    "concept": (1, f"Explain the concept of {{a}} in {{domain}} as three concise, verified {_TRIPLE} facts."),
    "list": (1, f"List five verified, atomic facts about {{a}} in {{domain}}, every one a distinct {_TRIPLE} triple and none a sentence about {{domain}} itself."),
    "negative": (1, f"Name a common misconception about {{a}} in {{domain}}, then give only the correct fact, as a {_TRIPLE} triple."),
}
BARE = f"List five verified, atomic facts about {{domain}}, every one a distinct {_TRIPLE} triple."
GRADE = {"VERIFIED": 40, "LIKELY_TRUE": 30, "POSSIBLY_TRUE": 20, "UNVERIFIED": 10}


def render(kind: str, **fields: str) -> str:
    if kind not in PROMPTS:
        raise ValueError(f"unknown kind of prompt {kind!r}; there are {', '.join(PROMPTS)}")
    try:
        return PROMPTS[kind][1].format(**fields)
    except KeyError as e:
        raise ValueError(f"a {kind} prompt needs {e}") from e


def seed_entities(facts: DataFrame, limit: int = 50) -> DataFrame:
    """Subjects in the order in which they first appear by fact id."""
    return facts.where("subject <> ''").groupBy("subject").agg(F.min("fact_id").alias("first")).orderBy("first", "subject").limit(limit).select("subject")


def prompts(spark: SparkSession, domain: str, entities: list[str], n: int = 10, seed: int = 42, negative: bool = False) -> DataFrame:
    """``number, domain, prompt_type, prompt``: the i-th prompt's kind and entities are chosen by a hash of seed and i."""
    kinds = [k for k, (needs, _) in PROMPTS.items() if needs <= len(entities) and (negative or k != "negative")]
    rows = spark.range(n).select(F.col("id").alias("number"), F.lit(domain).alias("domain"))
    pick = lambda salt, m: F.pmod(F.xxhash64(F.lit(seed), "number", F.lit(salt)), F.lit(m)).cast("int")
    if not kinds:
        return rows.select("*", F.lit("list").alias("prompt_type"), F.lit(BARE.format(domain=domain)).alias("prompt"))
    names, m = F.array(*map(F.lit, entities)), len(entities)
    rows = rows.withColumn("prompt_type", F.get(F.array(*map(F.lit, kinds)), pick(1, len(kinds)))).withColumn("i", pick(2, m))
    rows = rows.withColumn("a", F.get(names, F.col("i"))).withColumn("b", F.get(names, (F.col("i") + 1 + pick(3, max(1, m - 1))) % m))
    text = F.create_map(*[F.lit(x) for k in kinds for x in (k, PROMPTS[k][1].replace("{domain}", domain))])[F.col("prompt_type")]
    return rows.select("number", "domain", "prompt_type", F.replace(F.replace(text, F.lit("{a}"), F.col("a")), F.lit("{b}"), F.col("b")).alias("prompt"))


def run_grid(spark: SparkSession, models: list[str], domains: list[str], done: DataFrame, prober: Callable[[str, str], int], parallel: int = 8) -> DataFrame:
    """``model, domain, facts, status`` of every pair: skipped where ``done`` (model, domain) has it; an error stays with its pair."""
    grid = spark.createDataFrame([(m,) for m in models], "model string").crossJoin(spark.createDataFrame([(d,) for d in domains], "domain string"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for m, d in zip(pdf["model"], pdf["domain"]):
                try:
                    out.append((m, d, int(prober(m, d) or 0), "ok"))
                except Exception as e:
                    out.append((m, d, 0, f"error: {e}"))
            yield pd.DataFrame(out, columns=["model", "domain", "facts", "status"])

    kind = "model string, domain string, facts long, status string"
    todo = grid.join(done.select("model", "domain").distinct(), ["model", "domain"], "left_anti").repartition(parallel).mapInPandas(run, kind)
    skipped = grid.join(done.select("model", "domain").distinct(), ["model", "domain"], "left_semi").select("model", "domain", F.lit(0).cast("long").alias("facts"), F.lit("skipped").alias("status"))
    return todo.unionByName(skipped)


def language_models(names: DataFrame, column: str = "model") -> DataFrame:
    return names.where(~F.contains(F.lower(column), F.lit("embed")))


def crawl(spark: SparkSession, seed: str, backend: Callable[[str], tuple[str, float]], depth: int = 2, fan_out: int = 3, least: float = -1.5, model: str = "custom") -> DataFrame:
    """Facts of texts that a back end gives (with their mean log probability) on a topic, then on the topics it names,
    level by level; each topic once, at most ``fan_out`` new ones from each. Topics are few: ``fan_out`` to the power of depth."""
    kind = "topic string, text string, logprob double"

    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            said = [backend(f"Provide a concise list of factual assertions about '{t}'.") for t in pdf["topic"]]
            yield pd.DataFrame({"topic": pdf["topic"], "text": [s[0] for s in said], "logprob": [float(s[1]) for s in said]})

    first = spark.createDataFrame([(seed.strip(),)] if seed.strip() else [], "topic string")
    level, _ = stage_table(first, "topics")
    seen, found = level.select(F.lower("topic").alias("low")), None
    for at in range(depth + 1):
        if level.isEmpty():
            break
        # a topic is asked once: what was said is a table
        texts, _ = stage_table(level.repartition(max(1, fan_out**at)).mapInPandas(ask, kind), "said")
        sure = texts.where((F.trim("text") != "") & ((F.col("logprob") >= least) | (F.col("logprob") == 0)))
        rows = extract.extract_facts(sure.select(F.concat(F.lit("crawler-"), F.lower(F.trim("topic"))).alias("topic"), "text"), "topic").withColumns({"depth": F.lit(at), "source_models": F.array(F.lit(model))})
        rows, _ = stage_table(rows, "crawled")
        found = rows if found is None else found.unionByName(rows)
        named = rows.select("source_id", "ordinal", F.posexplode(F.array("subject", "object")).alias("k", "topic")).withColumn("topic", F.trim("topic")).withColumn("low", F.lower("topic")).where("low <> ''")
        new = named.join(seen, "low", "left_anti").groupBy("source_id", "low").agg(F.min(F.struct("ordinal", "k", "topic")).alias("m"))
        new = new.withColumn("n", F.row_number().over(Window.partitionBy("source_id").orderBy("m"))).where(F.col("n") <= fan_out)
        level, _ = stage_table(new.groupBy("low").agg(F.min_by("m.topic", F.struct("source_id", "m")).alias("topic")).select("topic"), "topics")
        seen, _ = stage_table(seen.union(level.select(F.lower("topic"))), "seen")
    return found


def statement_tier(claims: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Clusters of claims (``pos, model`` and a fact) with their agreement."""
    return similarity.agree(claims, similarity.cluster(claims, threshold))


def select(claims: DataFrame, min_agreement: int = 1, min_reliability: str = "UNVERIFIED", threshold: float = 0.8, good: Column | None = None, dedup: float | None = 0.9, top_k: int | None = None) -> DataFrame:
    """Corroborated facts: clustered, rated by agreement, filtered, without near duplicates, best first."""
    rows = statement_tier(claims, threshold).where((F.col("agreement") >= min_agreement) & (schema.rank("reliability_rating") > schema.TIERS.index(min_reliability)))
    grade = F.create_map(*[F.lit(x) for kv in GRADE.items() for x in kv])
    rows = rows.withColumn("quality_score", (grade[F.col("reliability_rating")] + F.col("agreement")).cast("double")).withColumn("answer", F.col("fact_statement"))
    about = F.coalesce(F.nullif("subject", F.lit("")), F.lit("General"))
    rows = rows.withColumn("question", F.concat(F.lit("State a verified fact about "), about, F.lit(".")))
    rows = rows.where(good) if good is not None else rows
    if dedup:
        rows = similarity.deduplicate(rows, dedup, key="seed", order=[-F.col("agreement"), -F.col("quality_score"), F.col("fact_statement")])
    rows = rows.orderBy(F.desc("agreement"), F.desc("quality_score"), "fact_statement")
    return rows if top_k is None else rows.limit(top_k)


def report(agreed: DataFrame) -> DataFrame:
    """One row: clusters and how many of each tier, the unverified counted as possibly true."""
    n = lambda *t: F.count(F.when(F.col("reliability_rating").isin(*t), 1))
    return agreed.agg(F.count("*").alias("clusters"), n("VERIFIED").alias("verified"), n("LIKELY_TRUE").alias("likely"), n("POSSIBLY_TRUE", "UNVERIFIED").alias("possibly"))


def report_rows(agreed: DataFrame, limit: int | None = None) -> DataFrame:
    """Clusters as a report lists them: most models first, then most members, then by statement."""
    rows = agreed.select("fact_statement", "agreement", "members", "source_models", "reliability_rating").orderBy(F.desc("agreement"), F.desc("members"), "fact_statement")
    return rows if limit is None else rows.limit(limit)


def verified_facts(agreed: DataFrame, min_models: int = 2) -> DataFrame:
    """Facts that enough models hold, with a quality of their tier's grade and the number of models."""
    grade = F.create_map(*[F.lit(x) for kv in GRADE.items() for x in kv])
    return agreed.where(F.col("agreement") >= min_models).withColumn("quality_score", (grade[F.col("reliability_rating")] + F.col("agreement")).cast("double"))


def manifest(agreed: DataFrame, name: str = "model_shard", min_agreement: int = 1, claims: DataFrame | None = None) -> DataFrame:
    """One row: the models that contributed, facts by tier, and how many claims they came from."""
    rows = agreed.where(F.col("agreement") >= min_agreement)
    tiers = ("VERIFIED", "LIKELY_TRUE", "POSSIBLY_TRUE")
    # facts are counted once, by who said them
    held, _ = stage_table(rows.groupBy("source_models").agg(F.count("*").alias("facts"), *[F.count(F.when(F.col("reliability_rating") == t, 1)).alias(t.lower()) for t in tiers]), "manifest")
    counts = held.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in held.columns[1:]])
    names = held.select(F.explode(F.split("source_models", ",")).alias("m")).where("m <> ''").distinct().agg(F.array_join(F.array_sort(F.collect_list("m")), ",").alias("models"))  # one a model
    total = held.agg(F.coalesce(F.sum("facts"), F.lit(0)).alias("input_facts")) if claims is None else claims.agg(F.count("*").alias("input_facts"))
    return counts.crossJoin(names).crossJoin(total).select(F.lit(name).alias("shard"), "models", "facts", "verified", "likely_true", "possibly_true", F.lit(min_agreement).alias("min_agreement"), "input_facts")  # one row each


def model_of(facts: DataFrame) -> Column:
    """The model that a fact is of: its provenance's, else its source, else its model."""
    names = dict(facts.dtypes)
    found = [F.col("model_provenance.model")] if "model_provenance" in names else []
    return F.coalesce(*found, *[F.col(c) for c in ("_source", "model") if c in names], F.lit(None).cast("string"))


def of_models(facts: DataFrame) -> DataFrame:
    """Facts that a model gave: those with a provenance."""
    return facts.where("model_provenance IS NOT NULL")


def model_content_hash(model: str | Column, domain: str | Column, prompts: str | Column) -> Column:
    """What names a model's drop: a hash of model, domain and each prompt, ended by a zero sign each."""
    c = lambda x: F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))
    parts = F.concat(F.array(c(model), c(domain)), F.col(prompts) if isinstance(prompts, str) else prompts)
    return F.sha2(F.concat(F.array_join(parts, "\0"), F.lit("\0")), 256)


def probe_domain(prompts_: DataFrame, backends: dict[str, Callable], threshold: float = 0.8) -> DataFrame:
    """The same prompts to several models, and what they agree on."""
    rows = reduce(DataFrame.unionByName, [extract.probe_facts(extract.probe(prompts_, b, m)) for m, b in backends.items()])
    claims, _ = stage_table(rows.withColumns({"model": model_of(rows), "pos": F.monotonically_increasing_id()}), "probed")
    return statement_tier(claims, threshold)


def reextract(drops: DataFrame, engine: str, resolve: bool = False) -> DataFrame:
    """Facts of every drop (``drop_id, source_text``) that has a text, extracted anew, as drops named for the engine."""
    texts = drops.where("trim(source_text) <> ''").select(F.concat("drop_id", F.lit(f"-reextract-{engine}")).alias("drop_id"), F.col("source_text").alias("text"))
    return extract.extract_facts(texts, "drop_id", engine, resolve).withColumnRenamed("source_id", "drop_id")


def list_models(lister: Callable[[], list[str]]) -> list[str]:
    """Names that a lister gives, without those that only embed; none where it fails."""
    try:
        return sorted({n for n in lister() if n and "embed" not in n.lower()})
    except Exception:
        return []


def generate(backend: Callable[[str], str | tuple[str, float]], prompt: str) -> tuple[str, float]:
    """What a back end says and its mean log probability: 0 where it gives none, no text where it fails."""
    try:
        said = backend(prompt)
    except Exception:
        return "", 0.0
    return (str(said[0]), float(said[1] or 0.0)) if isinstance(said, tuple) else (str(said), 0.0)


def batch_report(rows: DataFrame) -> DataFrame:
    """One row of a batch (``status, facts`` an item): items, dropped, skipped, errors, facts."""
    n = lambda cond: F.count(F.when(cond, 1))
    status = F.col("status")
    return rows.agg(F.count("*").alias("items"), n(status == "ok").alias("dropped"), n(status == "skipped").alias("skipped"), n(status.startswith("error")).alias("errors"), F.coalesce(F.sum("facts"), F.lit(0)).alias("facts"))


def consensus(docs: DataFrame, engines: list[str], id_column: str = "doc_id") -> DataFrame:
    """Facts that several extractors find in the same texts: an engine is a model."""
    return similarity.agree_exact(engine_claims(docs, engines, id_column))


def engine_claims(docs: DataFrame, engines: list[str], id_column: str = "doc_id") -> DataFrame:
    return reduce(DataFrame.unionByName, [extract.extract_facts(docs, id_column, name).withColumn("model", F.lit(name)) for name in engines])


def consensus_graph(docs: DataFrame, engines: list[str], id_column: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(facts, edges) of all engines: extracted, agreed on, put into a graph, linked, and contradictions demoted."""
    agreed = consensus(docs, engines, id_column)
    grade = F.create_map(*[F.lit(x) for kv in GRADE.items() for x in kv])
    facts = agreed.withColumns({
        "fact_statement": T.verbalize("subject", "predicate", "object"), "block_id": T.block_id("subject", "predicate", "object"),
        "quality_score": (grade[F.col("reliability_rating")] + F.col("agreement")).cast("double"),
    })
    facts, _ = stage_table(graph.reconcile(facts), "consensus")
    return facts, graph.link(facts)


def critic(facts: DataFrame, backend: Callable[[str], bool] | None = None) -> DataFrame:
    """Facts with a verdict by rules, and by a back end for those that pass."""
    from factloom.operators.facts import demote

    judged = facts.withColumn("verdict", T.critique())
    ok = F.col("verdict.is_factual")
    if backend is not None:
        ask = F.pandas_udf(lambda s: s.map(lambda t: bool(backend(t))), BooleanType())
        ok = ok & ask("fact_statement")
    return demote(judged.withColumn("factual", ok), ~F.col("factual"))
