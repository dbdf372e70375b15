"""Every query of the library by name, with its SQL where SQL can express it. All run over whole tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom import schema
from factloom.functions import text as T
from factloom.operators import analysis, chain, embed, evaluation, extract, graph, models, sharding, similarity, vectors
from factloom.operators import facts as O
from factloom.plans.views import BLOCK_SQL, CLAIMS_SQL, EDGES_SQL, FACTS_SQL, RANK_SQL, claims, facts, table
from factloom.sources import ingest
from factloom.streaming import events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NORM = "trim(regexp_replace(lower(coalesce({}, '')), '\\s+', ' ', 'g'))"


def query(name: str, sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def over_facts(name: str, sql: str | None = None, edges: bool = False):
    """A query of the fact view (and of its links)."""
    text = None if sql is None else f"WITH {FACTS_SQL.strip()}{EDGES_SQL if edges else ''} {sql}"

    def keep(f: Callable[[DataFrame], DataFrame]):
        @query(name, text)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            rows = facts(spark, sf_dir)
            return f(rows, graph.link(rows)) if edges else f(rows)

        return f

    return keep


# filters, projections, summaries

over_facts("quality_score", "SELECT fact_id, quality_score FROM facts")(lambda f: f.select("fact_id", "quality_score"))
over_facts("reliability_filter", f"SELECT fact_id, reliability_rating FROM facts WHERE {RANK_SQL.format('reliability_rating')} >= 3")(lambda f: O.at_least(f, "LIKELY_TRUE").select("fact_id", "reliability_rating"))
over_facts("attribute_filter", "SELECT fact_id FROM facts WHERE category = 'Market' AND source = 'src2'")(lambda f: O.matching(f, category="Market", source="src2").select("fact_id"))
over_facts("catalog_query", "SELECT fact_id, quality_score FROM facts WHERE category = 'Market' AND quality_score >= 30 ORDER BY quality_score DESC, fact_id LIMIT 100")(
    lambda f: O.catalog_query(f, min_quality=30, limit=100, category="Market").select("fact_id", "quality_score")
)
over_facts("select_top", "SELECT fact_id, (row_number() OVER (ORDER BY quality_score DESC, fact_id))::INTEGER AS rank FROM facts QUALIFY rank <= 50")(lambda f: O.select_top(f, 50).select("fact_id", "rank"))
over_facts("reliability_summary", "SELECT t.reliability_rating, count(f.fact_id) AS n FROM (VALUES ('UNVERIFIED'), ('POSSIBLY_TRUE'), ('LIKELY_TRUE'), ('VERIFIED')) t(reliability_rating) LEFT JOIN facts f USING (reliability_rating) GROUP BY 1")(O.reliability_summary)
over_facts("category_summary", "SELECT category, count(*) AS n FROM facts GROUP BY 1")(O.category_summary)
_TIERS = ", ".join(f"count(*) FILTER (reliability_rating = '{t}') AS {t.lower()}" for t in schema.TIERS)
over_facts("catalog_stats", f"SELECT count(*) AS total_facts, count(DISTINCT drop_id) AS total_drops, count(DISTINCT source) AS sources, {_TIERS} FROM facts")(O.catalog_stats)
over_facts(
    "store_stats",
    "SELECT count(*) AS drops, sum(n)::BIGINT AS facts, string_agg(source, ',' ORDER BY source) AS sources FROM (SELECT source, count(*) AS n FROM facts GROUP BY 1)",
)(lambda f: O.store_stats(O.drop_tables(f)))
over_facts(
    "drop_tables",
    "SELECT substr(sha256(body), 1, 16) AS drop_id, source, sha256(body) AS source_hash, n AS num_facts FROM (SELECT source, count(*) AS n, "
    "count(*) || ':' || sum(('0x' || substr(md5(fact_statement), 1, 15))::BIGINT)::VARCHAR || ':' || sum(('0x' || substr(md5(fact_statement), 16, 15))::BIGINT)::VARCHAR AS body FROM facts GROUP BY 1)",
)(O.drop_tables)
over_facts(
    "audit_summary",
    f"""SELECT count(DISTINCT drop_id) AS drops, count(*) AS facts, count(*) FILTER (trim(subject) = '' OR trim(predicate) = '' OR trim(object) = '' OR trim(fact_statement) = '') AS missing,
    count(*) - count(DISTINCT lower(trim(subject)) || chr(0) || lower(trim(predicate)) || chr(0) || lower(trim(object))) AS duplicates, {_TIERS} FROM facts""",
)(O.audit)
over_facts(
    "quality_filter",
    """SELECT fact_id, length(subject) >= 2 AND object <> '' AND regexp_matches(subject, '^\\p{Lu}') AND NOT regexp_matches(subject, '^[A-Z][a-z]+ing$') AND length(object) <= 80 AS acceptable,
    CASE WHEN length(subject) >= 2 AND object <> '' AND regexp_matches(subject, '^\\p{Lu}') AND NOT regexp_matches(subject, '^[A-Z][a-z]+ing$') AND length(object) <= 80 THEN round(0.5 + 0.2 * (1 - length(object) / 80.0), 6)
    ELSE 0.2 END::DOUBLE AS score FROM facts""",
)(lambda f: f.select("fact_id", T.is_acceptable().alias("acceptable"), F.round(T.quality(), 6).alias("score")))
over_facts(
    "heuristic_critique",
    """SELECT fact_id, CASE WHEN lower(subject) IN ('he','it','she','that','them','these','they','this','those') OR lower(object) IN ('he','it','she','that','them','these','they','this','those') THEN false
    WHEN length(fact_statement) < 5 THEN false WHEN lower(subject) = lower(predicate) OR lower(predicate) = lower(object) THEN false ELSE true END AS is_factual,
    CASE WHEN length(fact_statement) < 5 THEN 0.9 WHEN lower(subject) = lower(predicate) OR lower(predicate) = lower(object) THEN 0.85 ELSE 0.7 END::DOUBLE AS confidence_score FROM facts""",
)(lambda f: f.withColumn("c", T.critique()).select("fact_id", "c.is_factual", "c.confidence_score"))
over_facts(
    "critic_demotion", "SELECT fact_id, CASE WHEN length(object) <= 4 THEN 'UNVERIFIED' ELSE reliability_rating END AS reliability_rating, CASE WHEN length(object) <= 4 THEN 0 ELSE quality_score END::DOUBLE AS quality_score FROM facts"
)(lambda f: O.demote(f, F.length("object") <= 4).select("fact_id", "reliability_rating", "quality_score"))


def _qa(f: DataFrame) -> DataFrame:
    return f.withColumns({"question": T.question("subject", "predicate"), "answer": F.col("object")})


_Q_SQL = "CASE predicate WHEN 'located_in' THEN 'Where is ' || subject || ' located?' ELSE 'What does ' || subject || ' ' || replace(predicate, '_', ' ') || '?' END"
over_facts("qa_pairs", f"SELECT fact_id, {_Q_SQL} AS question, object AS answer FROM facts")(lambda f: _qa(f).select("fact_id", "question", "answer"))
_J = lambda x: f"to_json({x})::VARCHAR"
over_facts("compile_chat", f"""SELECT fact_id, '{{"messages":[{{"role":"user","content":' || {_J(_Q_SQL)} || '}},{{"role":"assistant","content":' || {_J('object')} || '}}]}}' AS record FROM facts""")(
    lambda f: _qa(f).select("fact_id", extract.record("chat").alias("record"))
)
over_facts("compile_instruction", f"""SELECT fact_id, '{{"instruction":' || {_J(_Q_SQL)} || ',"input":"","output":' || {_J('object')} || '}}' AS record FROM facts""")(
    lambda f: _qa(f).select("fact_id", extract.record("instruction").alias("record"))
)
_ABOUT = "'State a verified fact about ' || subject || '.'"
over_facts("compile_alpaca", f"""SELECT fact_id, '{{"instruction":' || {_J(_ABOUT)} || ',"input":"","output":' || {_J('fact_statement')} || '}}' AS record FROM facts""")(
    lambda f: _qa(f).select("fact_id", extract.record("alpaca").alias("record"))
)
over_facts("compile_sharegpt", f"""SELECT fact_id, '{{"conversations":[{{"from":"human","value":' || {_J(_ABOUT)} || '}},{{"from":"gpt","value":' || {_J('fact_statement')} || '}}]}}' AS record FROM facts""")(
    lambda f: _qa(f).select("fact_id", extract.record("sharegpt").alias("record"))
)
over_facts("compile_text", "SELECT fact_id, '- ' || fact_statement AS record FROM facts")(lambda f: _qa(f).select("fact_id", extract.record("text").alias("record")))
over_facts("block_id", f"SELECT fact_id, {BLOCK_SQL} AS block_id FROM facts")(lambda f: f.select("fact_id", T.block_id("subject", "predicate", "object").alias("block_id")))
over_facts("predicate_family", "SELECT fact_id, split_part(lower(predicate), '_', 1) AS family, CASE WHEN regexp_matches(object, '^\\p{Lu}') THEN 'ENTITY' ELSE 'CONCEPT' END AS object_type, greatest(1, length(fact_statement) // 4) AS tokens FROM facts")(
    lambda f: f.select("fact_id", T.predicate_family("predicate").alias("family"), T.coarse_type("object").alias("object_type"), T.token_estimate("fact_statement").alias("tokens"))
)
over_facts("unseen_facts", f"SELECT min(fact_id) AS fact_id, {NORM.format('fact_statement')} AS fingerprint FROM facts WHERE {NORM.format('fact_statement')} NOT IN (SELECT {NORM.format('fact_statement')} FROM facts WHERE source = 'src0') GROUP BY 2")(
    lambda f: O.unseen(f, f.where("source = 'src0'").select(T.norm("fact_statement").alias("fingerprint")).distinct()).select("fact_id", "fingerprint")
)
over_facts("drops_used", "SELECT category, string_agg(DISTINCT drop_id, ',' ORDER BY drop_id) AS drops FROM facts WHERE quality_score >= 30 GROUP BY 1")(
    lambda f: O.catalog_query(f, min_quality=30).groupBy("category").agg(F.array_join(F.array_sort(F.collect_set("drop_id")), ",").alias("drops"))
)
_SEARCH = " + ".join(f"contains(lower({c}), '{w}')::INTEGER" for c in ("subject", "object", "fact_statement") for w in ("nation", "located")) + " + " + " + ".join(f"2 * contains(lower({c}), 'nation located')::INTEGER" for c in ("subject", "object", "fact_statement"))
over_facts("search_facts", f"SELECT fact_id, ({_SEARCH})::INTEGER AS score FROM facts WHERE {_SEARCH} > 0")(lambda f: O.search(f, "nation located", ["subject", "object", "fact_statement"]).select("fact_id", "score"))


# lifecycle and corroboration

_PROMOTE = f"SELECT {NORM.format('object')} AS key, count(DISTINCT source) AS sources, max({RANK_SQL.format('reliability_rating')}) AS r FROM facts GROUP BY 1"


@over_facts(
    "promote_reliability",
    f"""SELECT key AS statement, sources, CASE r WHEN 3 THEN 'LIKELY_TRUE' WHEN 2 THEN 'POSSIBLY_TRUE' ELSE 'UNVERIFIED' END AS current, CASE r WHEN 3 THEN 'VERIFIED' WHEN 2 THEN 'LIKELY_TRUE' ELSE 'POSSIBLY_TRUE' END AS proposed
    FROM (SELECT {NORM.format("predicate || ' ' || object")} AS key, count(DISTINCT source) AS sources, max({RANK_SQL.format('reliability_rating')}) AS r FROM facts WHERE reliability_rating <> 'VERIFIED' GROUP BY 1) WHERE sources >= 2 AND r < 4""",
)
def _promote(f: DataFrame) -> DataFrame:
    # what is said of an object, whoever it is said of
    said = f.where("reliability_rating <> 'VERIFIED'").withColumn("fact_statement", T.norm(F.concat_ws(" ", "predicate", "object")))
    return O.promote(said)


@query(
    "lifecycle_contradictions",
    """WITH s AS (SELECT 'part ' || l_partkey AS subject, 'supplied_by' AS predicate, 'supplier ' || l_suppkey AS object, string_agg(DISTINCT 'src' || (l_linenumber % 5), ',' ORDER BY 'src' || (l_linenumber % 5)) AS sources FROM lineitem GROUP BY 1, 2, 3)
    SELECT subject, predicate, count(*)::INTEGER AS n_objects, string_agg(object || '<-' || sources, '; ' ORDER BY object) AS objects FROM s GROUP BY 1, 2 HAVING count(*) > 1""",
)
def _lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.contradictions(claims(spark, sf_dir).withColumn("source", F.replace("model", F.lit("m"), F.lit("src"))))


@query(
    "agreement_reliability",
    f"""WITH {CLAIMS_SQL}, a AS (SELECT subject, predicate, object, count(DISTINCT model) AS agreement, string_agg(DISTINCT model, ',' ORDER BY model) AS source_models FROM claims GROUP BY 1, 2, 3)
    SELECT subject, predicate, object, agreement, source_models, CASE WHEN agreement >= 3 THEN 'VERIFIED' WHEN agreement = 2 THEN 'LIKELY_TRUE' ELSE 'POSSIBLY_TRUE' END AS reliability_rating,
    CASE WHEN w >= 3 THEN 'VERIFIED' WHEN w >= 1.5 THEN 'LIKELY_TRUE' ELSE 'POSSIBLY_TRUE' END AS weighted_rating FROM (SELECT *, agreement * 1.0 AS w FROM a)""",
)
def _agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.agree_exact(claims(spark, sf_dir))


_WEIGHTED = [("gpt-4", 3.0), ("qwen2.5-0.5b", 0.5), ("llama3-8b", 1.5), ("other", 1.0), ("gemini-1.5-flash", 2.0)]


@query(
    "weighted_reliability",
    f"""WITH {CLAIMS_SQL}, m AS (SELECT DISTINCT subject, CASE model {" ".join(f"WHEN 'm{i}' THEN {w}" for i, (_, w) in enumerate(_WEIGHTED))} END AS w, model FROM claims)
    SELECT subject, round(sum(w), 3)::DOUBLE AS weight, CASE WHEN sum(w) >= 3 THEN 'VERIFIED' WHEN sum(w) >= 1.5 THEN 'LIKELY_TRUE' WHEN sum(w) >= 0.5 THEN 'POSSIBLY_TRUE' ELSE 'UNVERIFIED' END AS reliability_rating FROM m GROUP BY 1""",
)
def _weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.element_at(F.array(*[F.lit(n) for n, _ in _WEIGHTED]), F.substring("model", 2, 3).cast("int") + 1)
    per = claims(spark, sf_dir).select("subject", names.alias("model")).distinct().groupBy("subject").agg(F.sum(T.model_weight("model")).alias("w"))
    return per.select("subject", F.round("w", 3).alias("weight"), T.weighted_tier(F.col("w")).alias("reliability_rating"))


for _name, _rule in (("higher_reliability", f"CASE WHEN b.fact_id IS NULL OR {RANK_SQL.format('a.reliability_rating')} >= {RANK_SQL.format('b.reliability_rating')} THEN 1 ELSE 2 END"), ("keep_first", "1"), ("keep_second", "2")):

    @over_facts(
        f"merge_{_name}",
        f""", a AS (SELECT * FROM facts WHERE category <> 'Market'), b AS (SELECT fact_id, CASE reliability_rating WHEN 'VERIFIED' THEN 'POSSIBLY_TRUE' ELSE 'LIKELY_TRUE' END AS reliability_rating, 'second' AS source FROM facts WHERE category <> 'Supply')
        SELECT coalesce(a.fact_id, b.fact_id) AS fact_id, CASE WHEN a.fact_id IS NULL THEN b.reliability_rating WHEN b.fact_id IS NULL THEN a.reliability_rating WHEN {_rule} = 1 THEN a.reliability_rating ELSE b.reliability_rating END AS reliability_rating,
        CASE WHEN a.fact_id IS NULL THEN b.source WHEN b.fact_id IS NULL THEN a.source WHEN {_rule} = 1 THEN a.source ELSE b.source END AS source FROM a FULL JOIN b ON a.fact_id = b.fact_id""",
    )
    def _merge(f: DataFrame, how: str = _name) -> DataFrame:
        second = f.where("category <> 'Supply'").withColumns({"reliability_rating": F.when(F.col("reliability_rating") == "VERIFIED", "POSSIBLY_TRUE").otherwise("LIKELY_TRUE"), "source": F.lit("second")})
        return O.merge(f.where("category <> 'Market'"), second, how).select("fact_id", "reliability_rating", "source")


_WORDS = "list_distinct(list_filter(string_split(" + NORM + ", ' '), lambda x: x <> ''))"


@query(
    "jaccard_pairs",
    f"""WITH t AS (SELECT p_partkey AS id, {_WORDS.format("p_name || ' ' || p_type || ' ' || p_brand || ' ' || p_size")} AS w FROM part), e AS (SELECT id, len(w) AS n, unnest(w) AS k FROM t)
    SELECT x.id AS a, y.id AS b, round(count(*) / (any_value(x.n) + any_value(y.n) - count(*)), 6) AS similarity FROM e x JOIN e y ON x.k = y.k AND x.id < y.id GROUP BY 1, 2 HAVING count(*) / (any_value(x.n) + any_value(y.n) - count(*)) >= 0.8""",
)
def _jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type", "p_brand", "p_size").alias("text"))
    return similarity.jaccard_pairs(rows, 0.8).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("near_dup_dedup")
def _dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("fact_id"), F.concat_ws(" ", "p_name", "p_type", "p_brand", "p_size").alias("fact_statement"), F.col("p_retailprice").alias("quality_score"))
    return similarity.deduplicate(rows).select("fact_id")


@query("cluster_leaders")
def _cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.col("p_brand").alias("subject"), F.lit("makes").alias("predicate"), F.concat_ws(" ", "p_name", "p_type", "p_size").alias("object"), F.concat_ws(" ", "p_name", "p_type", "p_brand", "p_size").alias("fact_statement"))
    return similarity.cluster(rows)


@over_facts("entity_resolution")
def _entities(f: DataFrame) -> DataFrame:
    return similarity.resolve_entities(f)[1].select("block_id", "subject", "predicate", "object")


_PART = "p_name || ' ' || p_type || ' ' || p_brand || ' ' || p_size"
_CONTENT = "list_filter(string_split(trim(regexp_replace(regexp_replace(lower({}), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: w <> '' AND NOT list_contains([" + ", ".join(f"'{w}'" for w in schema.SIMILARITY_STOPWORDS) + "], w))"
_COUNTS = "list_sum(list_transform(list_distinct({0}), lambda w: len(list_filter({0}, lambda v: v = w)) * len(list_filter({1}, lambda v: v = w))))"


@query(
    "tf_similarity",
    f"WITH t AS (SELECT p_partkey, {_CONTENT.format("p_name || ' ' || p_type")} AS x, {_CONTENT.format("p_type || ' ' || p_name || ' ' || p_brand")} AS y FROM part) "
    f"SELECT p_partkey, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE 0.405 * {_COUNTS.format('x', 'y')} / sqrt({_COUNTS.format('x', 'x')}::DOUBLE * {_COUNTS.format('y', 'y')}) END, 6)::DOUBLE AS similarity FROM t",
)
def _tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("x"), F.concat_ws(" ", "p_type", "p_name", "p_brand").alias("y"))
    return rows.select("p_partkey", F.round(similarity.tf_similarity("x", "y"), 6).alias("similarity"))


# graph

over_facts("find_by_subject", "SELECT fact_id FROM facts WHERE contains(lower(subject), 'nation')")(lambda f: graph.find_by_subject(f, "Nation").select("fact_id"))
over_facts("find_by_reliability", "SELECT block_id, quality_score FROM facts WHERE reliability_rating = 'VERIFIED' ORDER BY quality_score DESC, block_id LIMIT 100")(lambda f: graph.find_by_reliability(f, "VERIFIED").select("block_id", "quality_score"))
over_facts("auto_link", "SELECT src, dst, predicate, weight FROM edges", edges=True)(lambda f, e: e)
_NEG = "list_has_any(string_split(lower({}), ' '), ['not', 'never', 'no', 'cannot', 'fails'])"
_PAIRS = "facts a JOIN facts b ON lower(b.subject) = lower(a.subject) AND lower(b.object) = lower(a.object) AND a.block_id < b.block_id"
over_facts("graph_contradictions", f"SELECT a.block_id AS a, b.block_id AS b FROM {_PAIRS} WHERE {_NEG.format('a.predicate')} <> {_NEG.format('b.predicate')}")(
    lambda f: graph.contradictions(f).select(F.col("a_block_id").alias("a"), F.col("b_block_id").alias("b"))
)
over_facts(
    "transitive_inferences",
    """SELECT t.* FROM (SELECT a.subject, a.predicate, b.object, a.fact_statement AS step1, b.fact_statement AS step2 FROM edges e JOIN facts a ON e.src = a.block_id JOIN facts b ON e.dst = b.block_id WHERE a.predicate = b.predicate
    QUALIFY row_number() OVER (PARTITION BY lower(a.subject), lower(a.predicate), lower(b.object) ORDER BY e.src, e.dst) = 1) t""",
    edges=True,
)(graph.transitive)
over_facts("conflict_pairs", "SELECT subject, object, count(DISTINCT predicate) AS predicates FROM facts GROUP BY 1, 2 HAVING count(DISTINCT predicate) > 1")(graph.conflict_pairs)
over_facts(
    "reconcile_demote",
    f""", c AS (SELECT a.block_id AS ai, b.block_id AS bi, a.quality_score AS aq, b.quality_score AS bq FROM {_PAIRS} WHERE {_NEG.format('a.predicate')} <> {_NEG.format('b.predicate')} AND a.reliability_rating <> 'UNVERIFIED' AND b.reliability_rating <> 'UNVERIFIED'),
    d AS (SELECT ai AS block_id FROM c WHERE aq <= bq UNION SELECT bi FROM c WHERE bq <= aq)
    SELECT block_id, CASE WHEN d.block_id IS NOT NULL THEN 'UNVERIFIED' ELSE reliability_rating END AS reliability_rating, d.block_id IS NOT NULL AS demoted FROM facts LEFT JOIN d USING (block_id)""",
)(lambda f: graph.reconcile(f).select("block_id", "reliability_rating", "demoted"))
over_facts(
    "chain_instructions",
    """SELECT src, dst, t.k::INTEGER AS template, CASE t.k WHEN 0 THEN 'Trace the relationship connection starting from ' || a.subject || ' to ' || b.object || '.' WHEN 1 THEN 'Explain the sequence of connections linking ' || a.subject || ' to ' || b.object || '.'
    ELSE 'If ' || a.fact_statement || ' and we know that ' || b.subject || ' connects to ' || b.object || ', what is the second step in the path?' END AS instruction,
    CASE t.k WHEN 0 THEN 'According to the knowledge graph, ' || a.subject || ' connects to ' || b.object || ' through the intermediate concept ' || a.object || '. Specifically, we know that: ' || chr(10) || '- ' || a.fact_statement || ' (Reliability: ' || a.reliability_rating || ')' || chr(10) || '- ' || b.fact_statement || ' (Reliability: ' || b.reliability_rating || ')'
    WHEN 1 THEN 'The logical path connecting ' || a.subject || ' to ' || b.object || ' is:' || chr(10) || '1. ' || a.fact_statement || chr(10) || '2. ' || b.fact_statement ELSE 'The second step in the path is: ' || b.fact_statement END AS response
    FROM edges e JOIN facts a ON e.src = a.block_id JOIN facts b ON e.dst = b.block_id, (VALUES (0), (1), (2)) t(k) WHERE a.reliability_rating <> 'UNVERIFIED' AND b.reliability_rating <> 'UNVERIFIED'""",
    edges=True,
)(graph.chain_instructions)
over_facts(
    "contradiction_instructions",
    f"""SELECT a.block_id AS a, b.block_id AS b, 'Evaluate the following two conflicting claims and determine which is more reliable:' || chr(10) || '1. ' || a.fact_statement || chr(10) || '2. ' || b.fact_statement AS instruction,
    CASE WHEN ra > rb THEN 'Claim 1 (''' || a.fact_statement || ''') is more reliable. It is rated ' || a.reliability_rating || ' (Agreement count: ' || a.agreement || '), whereas Claim 2 (''' || b.fact_statement || ''') is rated ' || b.reliability_rating || ' (Agreement count: ' || b.agreement || ').'
    WHEN rb > ra THEN 'Claim 2 (''' || b.fact_statement || ''') is more reliable. It is rated ' || b.reliability_rating || ' (Agreement count: ' || b.agreement || '), whereas Claim 1 (''' || a.fact_statement || ''') is rated ' || a.reliability_rating || ' (Agreement count: ' || a.agreement || ').'
    WHEN a.agreement > b.agreement THEN 'Claim 1 (''' || a.fact_statement || ''') is more reliable. It has higher model agreement count (' || a.agreement || ') compared to Claim 2 (' || b.agreement || ').'
    WHEN b.agreement > a.agreement THEN 'Claim 2 (''' || b.fact_statement || ''') is more reliable. It has higher model agreement count (' || b.agreement || ') compared to Claim 1 (' || a.agreement || ').'
    ELSE 'Both claims have equal reliability ratings (' || a.reliability_rating || ') and agreement counts (' || a.agreement || '). Neither claim can be conclusively preferred without additional context.' END AS response
    FROM (SELECT *, {RANK_SQL.format('reliability_rating')} AS ra FROM facts) a JOIN (SELECT *, {RANK_SQL.format('reliability_rating')} AS rb FROM facts) b ON lower(b.subject) = lower(a.subject) AND lower(b.object) = lower(a.object) AND a.block_id < b.block_id WHERE lower(a.predicate) <> lower(b.predicate)""",
)(graph.contradiction_instructions)
over_facts("taxonomy", "SELECT object AS parent, string_agg(DISTINCT subject, '|' ORDER BY subject) AS children FROM facts WHERE lower(predicate) IN ('is a', 'is a type of', 'subclass of', 'type of') GROUP BY 1")(graph.taxonomy)
_TYPES = """, x AS (SELECT subject AS concept, 'out' AS side, predicate AS p FROM facts UNION ALL SELECT object, 'in', predicate FROM facts),
types AS (SELECT concept, CASE WHEN regexp_matches(lower(concept), '(ation|ing|process|sis)$') THEN 'PROCESS' WHEN bool_or(side = 'out' AND p IN ('causes','contains','fuels','produce','produces','synthesizes')) THEN 'ENTITY'
WHEN bool_or(side = 'in' AND p IN ('is located in','is part of','located in','occurs in','part of')) THEN 'LOCATION' WHEN bool_or(side = 'out' AND p IN ('exhibits','has','is')) THEN 'ATTRIBUTE' ELSE 'CONCEPT' END AS type FROM x GROUP BY 1)"""
_spoken = lambda f: f.withColumn("predicate", F.replace("predicate", F.lit("_"), F.lit(" ")))
_SPOKEN = ", said AS (SELECT subject, replace(predicate, '_', ' ') AS predicate, object FROM facts)" + _TYPES.replace("FROM facts", "FROM said")
over_facts("semantic_types", _SPOKEN + " SELECT concept, type FROM types")(lambda f: graph.semantic_types(_spoken(f)))
over_facts("relation_schema", _SPOKEN + " SELECT DISTINCT a.type AS subject_type, predicate, b.type AS object_type FROM said JOIN types a ON subject = a.concept JOIN types b ON object = b.concept")(
    lambda f: graph.relation_schema(_spoken(f), graph.semantic_types(_spoken(f)))
)
_HIT = " + ".join(f"contains(lower(fact_statement), '{w}')::INTEGER + 2 * contains(lower(subject), '{w}')::INTEGER + 2 * contains(lower(object), '{w}')::INTEGER" for w in ("where", "nation_3"))
over_facts("rag_seeds", f"SELECT block_id, score FROM (SELECT block_id, ({_HIT})::INTEGER AS score FROM facts) WHERE score > 0 ORDER BY score DESC, block_id LIMIT 20")(lambda f: graph.seeds(f, "Where is NATION_3", 20).select("block_id", "score"))
_REACH = "both_ AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)"
_GROUPS = f", {_REACH}, r(b, c) AS (SELECT block_id, block_id FROM facts UNION SELECT dst, c FROM r JOIN both_ ON src = b), groups AS (SELECT b AS block_id, min(c) AS component FROM r GROUP BY 1)"
over_facts("components", _GROUPS + " SELECT block_id, component FROM groups", edges=True)(lambda f, e: graph.components(f, e))
over_facts(
    "bfs_hops",
    f", {_REACH}, z AS (SELECT block_id AS b FROM facts WHERE fact_id = 'n3'), h1 AS (SELECT dst AS b FROM both_ JOIN z ON src = b), h2 AS (SELECT dst AS b FROM both_ JOIN h1 ON src = b) SELECT b AS block_id, min(h)::INTEGER AS hop FROM (SELECT b, 0 AS h FROM z UNION ALL SELECT b, 1 FROM h1 UNION ALL SELECT b, 2 FROM h2) GROUP BY 1",
    edges=True,
)(lambda f, e: graph.hops(f.where("fact_id = 'n3'"), e, 2))
over_facts(
    "graph_stats",
    _GROUPS + """, u AS (SELECT DISTINCT least(src, dst) AS x, greatest(src, dst) AS y FROM edges WHERE src <> dst),
    t AS (SELECT count(*) AS triangles FROM u a JOIN u b ON a.y = b.x JOIN u c ON c.x = a.x AND c.y = b.y),
    n AS (SELECT count(*) AS nodes FROM groups), m AS (SELECT count(DISTINCT src || dst) AS edges FROM edges)
    SELECT nodes, m.edges, round(m.edges / (nodes::DOUBLE * (nodes - 1)), 9) AS density, (SELECT count(DISTINCT component) FROM groups) AS components, triangles FROM n, m, t""",
    edges=True,
)(graph.graph_stats)
_ROUNDS = 10
_RANKS = f""", l AS MATERIALIZED (SELECT DISTINCT src, dst FROM edges), dg AS MATERIALIZED (SELECT src, count(*) AS deg FROM l GROUP BY 1), ids AS MATERIALIZED (SELECT DISTINCT block_id FROM facts),
pr(block_id, rank, k) AS (SELECT block_id, 1.0::DOUBLE / (SELECT count(*) FROM ids), 0 FROM ids UNION ALL
 SELECT i.block_id, 0.15::DOUBLE / (SELECT count(*) FROM ids) + 0.85::DOUBLE * (coalesce(g.got, 0) + w.loose / (SELECT count(*) FROM ids)), w.k + 1
 FROM ids i CROSS JOIN (SELECT sum(CASE WHEN dg.src IS NULL THEN p.rank ELSE 0 END) AS loose, max(p.k) AS k FROM pr p LEFT JOIN dg ON dg.src = p.block_id HAVING max(p.k) < {_ROUNDS}) w
 LEFT JOIN (SELECT l.dst, sum(p.rank / dg.deg) AS got FROM pr p JOIN l ON l.src = p.block_id JOIN dg ON dg.src = l.src GROUP BY 1) g ON g.dst = i.block_id),
ranks AS (SELECT block_id, rank FROM pr WHERE k = {_ROUNDS})"""
_ranked = lambda f, e: graph.pagerank(f, e, rounds=_ROUNDS, tolerance=0.0)
over_facts("pagerank", _RANKS + " SELECT block_id, round(rank, 9) AS rank FROM ranks", edges=True)(lambda f, e: _ranked(f, e).select("block_id", F.round("rank", 9).alias("rank")))
_HIT5 = f"SELECT block_id, ({_HIT})::INTEGER AS score, reliability_rating FROM facts QUALIFY row_number() OVER (ORDER BY score DESC, block_id) <= 5 AND score > 0"
_FOUND = _RANKS + f""", {_REACH}, bad AS (SELECT DISTINCT lower(trim(subject)) AS s, lower(trim(object)) AS o FROM facts GROUP BY subject, object HAVING count(DISTINCT predicate) > 1),
blocked AS (SELECT block_id FROM facts WHERE reliability_rating = 'UNVERIFIED' OR (lower(trim(subject)), lower(trim(object))) IN (SELECT (s, o) FROM bad) OR (lower(trim(subject)), lower(trim(object))) IN (SELECT (o, s) FROM bad)),
z AS (SELECT block_id AS b FROM ({_HIT5}) WHERE reliability_rating <> 'UNVERIFIED'), w AS (SELECT src, dst FROM both_ WHERE dst NOT IN (SELECT block_id FROM blocked)),
h1 AS (SELECT dst AS b FROM w JOIN z ON src = b), h2 AS (SELECT dst AS b FROM w JOIN h1 ON src = b),
near AS (SELECT b AS block_id, min(h)::INTEGER AS hop FROM (SELECT b, 0 AS h FROM z UNION ALL SELECT b, 1 FROM h1 UNION ALL SELECT b, 2 FROM h2) GROUP BY 1),
found AS (SELECT f.*, n.hop, round(0.7::DOUBLE * ((contains(lower(f.fact_statement), 'where')::INTEGER + contains(lower(f.fact_statement), 'nation_3')::INTEGER) / 2.0::DOUBLE) + 0.3::DOUBLE * r.rank / (SELECT max(rank) FROM ranks), 6) AS hybrid
 FROM near n JOIN facts f USING (block_id) JOIN ranks r USING (block_id) ORDER BY hybrid DESC, block_id LIMIT 10)"""
_ask = lambda f, e: graph.retrieve(f, e, "Where is NATION_3", ranks=_ranked(f, e))
over_facts("rag_hybrid", _FOUND + " SELECT block_id, hop, hybrid FROM found", edges=True)(lambda f, e: _ask(f, e).select("block_id", "hop", "hybrid"))
over_facts(
    "rag_context",
    _FOUND + """ SELECT CASE WHEN count(*) = 0 THEN 'No relevant facts found in the knowledge graph.' ELSE '### Verified Knowledge Graph Facts:' || chr(10) ||
    string_agg('- **' || subject || '** ' || predicate || ' **' || object || '** (Statement: "' || fact_statement || '", Reliability: ' || reliability_rating || ')', chr(10) ORDER BY hybrid DESC, block_id) END AS context FROM found""",
    edges=True,
)(lambda f, e: graph.context(_ask(f, e)))
# every path without a repeated node, of which the shortest of each pair count; the fact view's links run in three levels
_PATHS = """, l AS MATERIALIZED (SELECT DISTINCT src, dst FROM edges WHERE src <> dst), walk(s, t, via) AS (SELECT src, dst, [src, dst] FROM l UNION ALL SELECT s, dst, list_append(via, dst) FROM walk JOIN l ON t = src WHERE NOT list_contains(via, dst)),
best AS (SELECT *, count(*) OVER (PARTITION BY s, t) AS paths FROM (SELECT * FROM walk QUALIFY len(via) = min(len(via)) OVER (PARTITION BY s, t))),
mid AS (SELECT v, sum(1.0::DOUBLE / paths) AS d FROM (SELECT unnest(via[2:-2]) AS v, paths FROM best WHERE len(via) > 2) GROUP BY 1), ids AS (SELECT DISTINCT block_id FROM facts), n AS (SELECT count(*)::DOUBLE AS n FROM ids),
central AS (SELECT block_id, coalesce(d, 0) / ((n - 1) * (n - 2)) AS centrality FROM ids CROSS JOIN n LEFT JOIN mid ON v = block_id)"""
over_facts("fact_importance", _PATHS + f" SELECT block_id, round(2 * {RANK_SQL.format('reliability_rating')} + 0.5 * usage_count + 30 * centrality, 6) AS importance FROM facts JOIN central USING (block_id)", edges=True)(
    lambda f, e: graph.importance(f, graph.betweenness(f, e)).select("block_id", F.round("importance", 6).alias("importance"))
)
over_facts("central_facts", _PATHS + " SELECT block_id, round(centrality, 9) AS centrality FROM central ORDER BY central.centrality DESC, block_id LIMIT 20", edges=True)(
    lambda f, e: analysis.central_facts(f, e, 20).select("block_id", F.round("centrality", 9).alias("centrality"))
)
_JOINED = """, l AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst), j AS MATERIALIZED (SELECT x, y, count(*) AS w FROM (SELECT src AS x, dst AS y FROM l UNION ALL SELECT dst, src FROM l) GROUP BY 1, 2),
k AS (SELECT a.x, sum(a.w * b.w * c.w) AS t FROM j a JOIN j b ON a.y = b.x AND a.x <> b.y JOIN j c ON c.x = a.x AND c.y = b.y WHERE a.y < b.y GROUP BY 1), dd AS (SELECT x, sum(w) AS d, count(*) FILTER (w = 2) AS m FROM j GROUP BY 1),
cl AS (SELECT DISTINCT f.block_id, coalesce(k.t / (dd.d * (dd.d - 1) - 2 * dd.m)::DOUBLE, 0)::DOUBLE AS clustering FROM facts f LEFT JOIN dd ON dd.x = f.block_id LEFT JOIN k ON k.x = f.block_id)"""
over_facts("clustering", _JOINED + " SELECT block_id, round(clustering, 9) AS clustering FROM cl", edges=True)(lambda f, e: analysis.clustering(f, e).select("block_id", F.round("clustering", 9).alias("clustering")))
# the fact view isn't connected, so there is no mean path
over_facts(
    "graph_statistics",
    SQL["graph_stats"].split(EDGES_SQL, 1)[1].rsplit("SELECT nodes,", 1)[0] + _JOINED + """ SELECT nodes, m.edges, round(m.edges / (nodes::DOUBLE * (nodes - 1)), 9) AS density, (SELECT count(DISTINCT component) FROM groups) AS components, triangles,
    (SELECT round(avg(clustering), 9) FROM cl) AS clustering, (SELECT count(DISTINCT component) FROM groups) = 1 AS connected, NULL::DOUBLE AS mean_path FROM n, m, t""",
    edges=True,
)(analysis.graph_statistics)
for _name in ("components", "graph_stats", "pagerank", "rag_hybrid", "rag_context", "fact_importance", "central_facts", "graph_statistics"):
    SQL[_name] = SQL[_name].replace("WITH ", "WITH RECURSIVE ", 1)
over_facts("graph_match", "SELECT a.subject AS subject, b.object AS object, a.block_id AS src FROM edges r JOIN facts a ON r.src = a.block_id JOIN facts b ON r.dst = b.block_id WHERE contains(lower(a.subject), 'nation') AND b.reliability_rating IN ('VERIFIED', 'LIKELY_TRUE')", edges=True)(
    lambda f, e: graph.graph_sql(f.sparkSession, f, e, "MATCH (a:Fact)-[r:RELATED]->(b:Fact) WHERE toLower(a.subject) CONTAINS 'nation' AND b.reliability_rating IN ['VERIFIED', 'LIKELY_TRUE'] RETURN a.subject AS subject, b.object AS object, a.block_id AS src LIMIT 1000000")
)
over_facts("dashboard_facts", _SPOKEN + """, p AS (SELECT subject AS child, min(object) AS parent FROM said WHERE lower(predicate) IN ('is a', 'is a type of', 'subclass of', 'type of') GROUP BY 1)
SELECT f.fact_id, a.type AS subject_class, b.type AS object_class, p.parent FROM facts f JOIN types a ON f.subject = a.concept JOIN types b ON f.object = b.concept LEFT JOIN p ON p.child = f.subject""")(
    lambda f: analysis.enriched(_spoken(f)).select("fact_id", "subject_class", "object_class", "parent")
)
over_facts("likely_names", "SELECT fact_id, regexp_matches(subject, '^(Dr|Mr|Mrs|Ms|Prof) ') OR regexp_matches(subject, '^\\s*\\p{Lu}\\S*\\s+\\p{Lu}\\S*\\s*$') AS name FROM facts")(lambda f: f.select("fact_id", analysis.likely_name("subject").alias("name")))


# analysis of parts as facts: statements of their words, types as categories, brands as sources


def part_facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf_dir, "part")
    rating = F.element_at(F.array(*map(F.lit, schema.TIERS)), (F.col("p_partkey") % 4 + 1).cast("int"))
    rows = p.select(F.col("p_partkey").alias("fact_id"), F.concat_ws(" ", "p_name", "p_type", "p_brand", "p_size").alias("fact_statement"), F.col("p_type").alias("category"), F.col("p_brand").alias("source_id"), rating.alias("reliability_rating"))
    return rows, rows.select(F.col("fact_id").alias("src"), (F.col("fact_id") + 1).alias("dst"))


_ALIKE = f"""WITH t AS (SELECT p_partkey AS id, p_type, p_brand, {_WORDS.format(_PART)} AS w FROM part), e AS (SELECT id, len(w) AS n, unnest(w) AS k FROM t),
j AS (SELECT x.id AS a, y.id AS b, count(*) / (any_value(x.n) + any_value(y.n) - count(*)) AS s FROM e x JOIN e y ON x.k = y.k AND x.id < y.id GROUP BY 1, 2)"""


@query("statement_contradictions", _ALIKE + " SELECT a, b, round(s, 6) AS similarity FROM j WHERE s > 0.7 AND abs(a % 4 - b % 4) >= 2")
def _statement_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.contradictions(part_facts(spark, sf_dir)[0]).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("missing_links", _ALIKE + " SELECT a, b, round(v, 6) AS similarity FROM (SELECT a, b, 0.4 * s + 0.2 * (x.p_type = y.p_type)::INTEGER + 0.1 * (x.p_brand = y.p_brand)::INTEGER AS v FROM j JOIN t x ON x.id = a JOIN t y ON y.id = b) WHERE v >= 0.6 - 1e-9 AND b - a <> 1")
def _missing_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.missing_links(*part_facts(spark, sf_dir)).select("a", "b", F.round("similarity", 6).alias("similarity"))


_VECTORS = f"""WITH c AS (SELECT id, k, count(*) AS c FROM (SELECT p_partkey AS id, unnest({_CONTENT.format(_PART)}) AS k FROM part) GROUP BY 1, 2), l AS (SELECT id, sqrt(sum(c * c)) AS l FROM c GROUP BY 1),
d AS (SELECT x.id AS a, y.id AS b, sum(x.c * y.c) AS d FROM c x JOIN c y ON x.k = y.k AND x.id < y.id GROUP BY 1, 2), s AS (SELECT a, b, 0.405 * d / (x.l * y.l) AS s FROM d JOIN l x ON x.id = a JOIN l y ON y.id = b)"""


@query("fact_connections", _VECTORS + " SELECT a, b, round(s, 6)::DOUBLE AS similarity FROM s WHERE s >= 0.35 AND b - a <> 1")
def _connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.connections(*part_facts(spark, sf_dir), least=0.35).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("similar_facts", _VECTORS + " SELECT fact_id, round(s, 6)::DOUBLE AS similarity FROM (SELECT b AS fact_id, s FROM s WHERE a = 7 UNION ALL SELECT a, s FROM s WHERE b = 7) WHERE s >= 0.2")
def _similar_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.similar_facts(part_facts(spark, sf_dir)[0], 7, 0.2).select("fact_id", F.round("similarity", 6).alias("similarity"))


# evaluation

_GOLD = """, gold AS (SELECT s_name AS item, s_name AS subject, 'located' AS predicate, lower(n_name) AS object, s_suppkey AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT s_name, s_name, 'located_in', 'nowhere', s_suppkey FROM supplier WHERE s_suppkey % 5 = 0)"""
_HOLDS = "(contains(lower({0}), lower({1})) OR contains(lower({1}), lower({0})))"
_FAMILY = "split_part(lower({}), '_', 1)"


def gold_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    real = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.col("s_name").alias("item"), F.col("s_name").alias("subject"), F.lit("located").alias("predicate"), F.lower("n_name").alias("object"), F.col("s_suppkey").alias("k"))
    return real.unionByName(s.where("s_suppkey % 5 = 0").select(F.col("s_name").alias("item"), F.col("s_name").alias("subject"), F.lit("located_in").alias("predicate"), F.lit("nowhere").alias("object"), F.col("s_suppkey").alias("k")))


@query(
    "extraction_eval",
    f"""WITH RECURSIVE {FACTS_SQL.strip()}{_GOLD}, p AS (SELECT subject AS item, *, row_number() OVER (PARTITION BY subject ORDER BY predicate, object) AS i FROM facts WHERE category = 'Supply'), q AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY predicate, object) AS j FROM gold),
    m AS (SELECT p.item, p.i, list(q.j ORDER BY q.j) AS js FROM p JOIN q ON p.item = q.item WHERE {_HOLDS.format('p.subject', 'q.subject')} AND {_HOLDS.format('p.object', 'q.object')} AND {_HOLDS.format(_FAMILY.format('p.predicate'), _FAMILY.format('q.predicate'))} GROUP BY 1, 2),
    r(item, i, used) AS (SELECT DISTINCT item, 0::BIGINT, []::BIGINT[] FROM m UNION ALL SELECT item, i, CASE WHEN f IS NULL THEN used ELSE list_append(used, f) END FROM
      (SELECT r.item, r.i + 1 AS i, r.used, list_filter(coalesce(m.js, []), lambda x: NOT list_contains(r.used, x))[1] AS f FROM r LEFT JOIN m ON m.item = r.item AND m.i = r.i + 1 WHERE r.i < (SELECT max(i) FROM p))),
    c AS (SELECT coalesce(sum(n), 0) AS tp, (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM q) AS ng FROM (SELECT max(len(used)) AS n FROM r GROUP BY item))
    SELECT tp::BIGINT AS tp, (np - tp)::BIGINT AS fp, (ng - tp)::BIGINT AS fn, round(tp / np, 4) AS precision, round(tp / ng, 4) AS recall, round(2 * (tp / np) * (tp / ng) / (tp / np + tp / ng), 4) AS f1 FROM c""",
)
def _extraction_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.evaluate(facts(spark, sf_dir).where("category = 'Supply'").withColumn("item", F.col("subject")), gold_triples(spark, sf_dir))


_LIKE = f"{_HOLDS.format('f.subject', 'g.subject')} AND {_HOLDS.format('f.object', 'g.object')}"
_FLAGS = f"""{_GOLD}, pos AS (SELECT *, row_number() OVER () AS g FROM gold WHERE k % 2 = 0), neg AS (SELECT * FROM gold WHERE k % 6 = 0 AND object <> 'nowhere'),
hits AS MATERIALIZED (SELECT DISTINCT f.fact_id, g.g FROM facts f JOIN pos g ON {_LIKE}), flags AS (SELECT f.*, f.fact_id IN (SELECT fact_id FROM hits) AS good, f.fact_id IN (SELECT f.fact_id FROM facts f JOIN neg g ON {_LIKE}) AS bad FROM facts f)"""


def _shard(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    gold = gold_triples(spark, sf_dir)
    return facts(spark, sf_dir), gold.where("k % 2 = 0"), gold.where("k % 6 = 0 AND object <> 'nowhere'")


@query(
    "shard_eval",
    f"""WITH {FACTS_SQL.strip()}{_FLAGS} SELECT count(*) AS n, round(avg(good::INTEGER), 4) AS precision, round(avg(good::INTEGER) FILTER (reliability_rating = 'VERIFIED'), 4) AS verified_precision,
    round(avg(bad::INTEGER), 4) AS hallucination, round((SELECT count(DISTINCT g) FROM hits) / (SELECT count(*) FROM pos), 4) AS coverage FROM flags""",
)
def _shard_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.evaluate_shard(*_shard(spark, sf_dir))


@query(
    "shard_blocks",
    f"""WITH {FACTS_SQL.strip()}{_FLAGS}, wide AS (SELECT fact_id, good, 'overall' AS scope, 'all' AS key FROM flags UNION ALL SELECT fact_id, good, 'tier', reliability_rating FROM flags UNION ALL SELECT fact_id, good, 'agreement', agreement::VARCHAR FROM flags),
    b AS (SELECT scope, key, count(*) AS n, count(*) FILTER (good) AS tp, count(*) FILTER (NOT good) AS fp FROM wide GROUP BY 1, 2),
    m AS (SELECT scope, key, (SELECT count(*) FROM pos) - count(DISTINCT g) AS fn FROM wide LEFT JOIN hits USING (fact_id) GROUP BY 1, 2),
    v AS (SELECT *, tp / n AS p, CASE WHEN tp + fn = 0 THEN 1 ELSE tp / (tp + fn) END AS r FROM b JOIN m USING (scope, key))
    SELECT scope, key, n, tp, fp, fn, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 4) AS f1 FROM v""",
)
def _shard_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.shard_blocks(*_shard(spark, sf_dir))


# distillation, stores, ledgers

over_facts("distilled_stats", "SELECT count(*) AS total_facts, count(*) FILTER (quality_score >= 30) AS selected_facts, count(*) FILTER (quality_score < 30) AS removed_facts, 1 - count(*) FILTER (quality_score >= 30) / count(*) AS reduction_ratio FROM facts")(
    lambda f: O.distilled_stats(f, f.where("quality_score >= 30")).select("total_facts", "selected_facts", "removed_facts", "reduction_ratio")
)


@query(
    "model_manifest",
    f"""WITH {CLAIMS_SQL}, a AS (SELECT subject, predicate, object, count(DISTINCT model) AS agreement FROM claims GROUP BY 1, 2, 3 HAVING count(DISTINCT model) >= 2)
    SELECT 'suppliers' AS shard, (SELECT string_agg(DISTINCT model, ',' ORDER BY model) FROM claims JOIN a USING (subject, predicate, object)) AS models, count(*) AS facts, count(*) FILTER (agreement >= 3) AS verified, count(*) FILTER (agreement = 2) AS likely_true,
    0::BIGINT AS possibly_true, 2 AS min_agreement, (SELECT count(*) FROM claims) AS input_facts FROM a""",
)
def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = claims(spark, sf_dir)
    return models.manifest(similarity.agree_exact(rows), "suppliers", 2, rows)


over_facts("change_log", """SELECT fact_id, CASE WHEN category = 'Market' THEN 'deleted' ELSE 'updated' END AS change, CASE WHEN category = 'Market' THEN NULL ELSE 'reliability_rating' END AS attributes FROM facts WHERE category = 'Market' OR reliability_rating = 'VERIFIED'
UNION ALL SELECT 'new', 'added', NULL""")(
    lambda f: O.change_log(
        f, f.where("category <> 'Market'").withColumn("reliability_rating", F.when(F.col("reliability_rating") == "VERIFIED", "LIKELY_TRUE").otherwise(F.col("reliability_rating"))).unionByName(f.limit(1).withColumn("fact_id", F.lit("new"))), "2024-01-01T00:00:00Z"
    ).select("fact_id", "change", F.array_join("attributes", ",").alias("attributes"))
)
_MOD = "0"
for _k in range(4):
    _MOD = f"(({_MOD}) * 4294967296 + ('0x' || substr(md5(fact_id), {1 + 8 * _k}, 8))::BIGINT) % 7"
over_facts("fact_shards", f"SELECT fact_id, ({_MOD})::BIGINT AS shard FROM facts")(lambda f: f.select("fact_id", sharding.md5_mod("fact_id", 7).alias("shard")))
over_facts("shard_placement", "SELECT fact_id, format('shard_{:04d}', 1 + (row_number() OVER (ORDER BY substr(md5(fact_id), 1, 3), fact_id) - 1) // 100) AS shard_id FROM facts")(lambda f: sharding.place(f, capacity=100).select("fact_id", "shard_id"))
over_facts("shard_statistics", "SELECT format('shard_{:04d}', 1 + (k - 1) // 100) AS shard_id, count(*) AS facts, count(*) >= 100 AS full FROM (SELECT row_number() OVER (ORDER BY substr(md5(fact_id), 1, 3), fact_id) AS k FROM facts) GROUP BY 1")(
    lambda f: sharding.statistics(sharding.optimize(sharding.place(f.select("fact_id"), capacity=1000), 100), 100)
)


# texts, pages, conversations

SENTENCE_SQL = "list_filter(list_transform(regexp_extract_all({}, '[^.!?\\n]+[.!?]?'), lambda s: trim(regexp_replace(s, '^\\s+|\\s+$', '', 'g'))), lambda s: s <> '')"
_MASKED = "coalesce(text, '')"
for _a in T.ABBREVIATIONS:
    _MASKED = f"replace({_MASKED}, '{_a}', '{_a.replace('.', chr(1))}')"


@query("sentence_split", f"SELECT doc_id, (generate_subscripts(s, 1) - 1)::INTEGER AS position, replace(unnest(s), '{chr(1)}', '.') AS sentence FROM (SELECT doc_id, {SENTENCE_SQL.format(_MASKED)} AS s FROM documents)")
def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences("text")).alias("position", "sentence"))


@query("content_hash", "SELECT doc_id, sha256(text) AS hash, greatest(1, length(text) // 4) AS tokens FROM documents")
def _hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.content_hash("text").alias("hash"), T.token_estimate("text").alias("tokens"))


@query("svo_facts")
def _svo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_facts(table(spark, sf_dir, "documents"))


@query("coref_facts")
def _coref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_facts(table(spark, sf_dir, "documents"), resolve=True).select("fact_id", "subject", "predicate", "object")


@query("distill_chat")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to sentences, facts, those of quality, and chat records."""
    found = extract.extract_facts(table(spark, sf_dir, "documents")).withColumn("category", F.lit("General"))
    good = found.where(T.is_acceptable("subject", "object", F.col("subject_type"), longest=60))
    return good.select("fact_id", F.round(T.quality("subject", "object", F.col("subject_type"), 60), 6).alias("quality"), extract.record("chat").alias("record"))


_BODY = "coalesce(nullif(regexp_extract(html, '(?is)<body(?:\\s[^>]*)?>(.*)</body>', 1), ''), html, '')"
for _pattern, _to in [("(?is)<script\\b[^>]*>.*?</script>", "' '"), ("(?is)<style\\b[^>]*>.*?</style>", "' '"), ("(?i)</(?:article|blockquote|div|h[1-6]|li|p|section|tr)\\s*>|<br\\s*/?>", "chr(10)"), ("<[^>]+>", "''")]:
    _BODY = f"regexp_replace({_BODY}, '{_pattern}', {_to}, 'g')"
for _entity, _sign in [("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("copy", "\xa9"), ("middot", "\xb7"), ("nbsp", "\xa0")]:
    _BODY = f"replace({_BODY}, '&{_entity};', '{_sign}')"
_BODY = f"regexp_replace({_BODY}, '&amp;?', '&', 'g')"
_LINES = "list_filter(list_transform(regexp_split_to_array({}, '[\\n\\r]'), lambda s: regexp_replace(s, '^[\\s\x85\xa0]+|[\\s\x85\xa0]+$', '', 'g')), lambda s: s <> '')"


@query("html_to_text", f"SELECT page_id, array_to_string({_LINES.format(_BODY)}, chr(10)) AS text FROM pages")
def _html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", ingest.html_to_text("html").alias("text"))


@query(
    "markdown_to_text",
    "SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '`{3}[A-Za-z0-9]*\\n?', '', 'g'), '!\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '\\[([^\\]]+)\\]\\([^)]*\\)', '\\1', 'g'), "
    "'(?m)^\\s{0,3}#{1,6}\\s*', '', 'g'), '(?m)^\\s{0,3}>\\s?', '', 'g'), '(?m)^\\s{0,3}[*+-]\\s+', '', 'g'), '(?m)^\\s{0,3}\\d+\\.\\s+', '', 'g'), '[~_*`]', '', 'g'), '\\n\\n\\n+', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS text FROM documents",
)
def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", ingest.markdown_to_text("text").alias("text"))


_CHAT = "SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn, role, text) AS m FROM conversations GROUP BY 1"
_PROBLEM = """CASE WHEN len(m) < 2 THEN 'too few turns' WHEN len(list_filter(m, lambda x: x.role IS NULL OR x.content IS NULL)) > 0 THEN 'no role or content' WHEN len(list_filter(m, lambda x: x.role NOT IN ('user', 'assistant'))) > 0 THEN 'invalid role'
WHEN len(list_filter(m, lambda x: trim(x.content) = '')) > 0 THEN 'empty content' WHEN NOT (list_contains(list_transform(m, lambda x: x.role), 'user') AND list_contains(list_transform(m, lambda x: x.role), 'assistant')) THEN 'one side only' END"""


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return rows.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"))


@query("chat_validate", f"SELECT conv_id, coalesce({_PROBLEM}, 'ok') AS verdict FROM ({_CHAT})")
def _validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(spark, sf_dir).select("conv_id", F.coalesce(O.chat_problem(), F.lit("ok")).alias("verdict"))


@query("dataset_stats", "SELECT role, count(DISTINCT conv_id) AS conversations, count(*) AS turns, round(avg(length(text)), 1) AS mean_chars FROM conversations GROUP BY 1")
def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.countDistinct("conv_id").alias("conversations"), F.count("*").alias("turns"), F.round(F.avg(F.length("text")), 1).alias("mean_chars"))


@query(
    "record_stats",
    f"""WITH c AS ({_CHAT}), t AS (SELECT conv_id, unnest(m) AS x FROM c)
    SELECT (SELECT count(*) FROM c) AS records, (SELECT count(*) FROM c WHERE conv_id % 4 = 0) AS unverified, (SELECT count(*) FROM c WHERE conv_id % 4 = 1) AS possibly_true, (SELECT count(*) FROM c WHERE conv_id % 4 = 2) AS likely_true, (SELECT count(*) FROM c WHERE conv_id % 4 = 3) AS verified,
    round(sum(length(x.content)) FILTER (x.role = 'user') / count(*) FILTER (x.role = 'user'), 1) AS mean_user_chars, round(sum(length(x.content)) FILTER (x.role = 'assistant') / count(*) FILTER (x.role = 'assistant'), 1) AS mean_assistant_chars FROM t""",
)
def _record_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations(spark, sf_dir)
    return O.dataset_stats(rows.withColumn("reliability_rating", F.element_at(F.array(*map(F.lit, schema.TIERS)), (F.col("conv_id") % 4 + 1).cast("int"))))


@query(
    "token_budget",
    """WITH RECURSIVE t AS (SELECT conv_id, text AS record, greatest(1, length(text) // 4) AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS i FROM conversations WHERE text IS NOT NULL),
    r(conv_id, i, used, kept) AS (SELECT conv_id, i, CASE WHEN cost <= 200 THEN cost ELSE 0 END, cost <= 200 FROM t WHERE i = 1
      UNION ALL SELECT t.conv_id, t.i, CASE WHEN r.used + t.cost <= 200 THEN r.used + t.cost ELSE r.used END, r.used + t.cost <= 200 FROM r JOIN t ON t.conv_id = r.conv_id AND t.i = r.i + 1)
    SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1)::INTEGER AS position, cost, record FROM r JOIN t USING (conv_id, i) WHERE kept""",
)
def _budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", F.col("text").alias("record"))
    return O.budget(rows, 200, ["turn", "record"], ["conv_id"])


_SPLIT_KEY = "conv_id::VARCHAR || ':' || turn::VARCHAR"


@query("train_val_split", f"SELECT conv_id, turn, CASE WHEN row_number() OVER (ORDER BY md5('42:' || {_SPLIT_KEY})) <= round_even((SELECT count(*) FROM conversations) * 0.8, 0) THEN 'train' ELSE 'val' END AS part FROM conversations")
def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return O.split(rows, 0.8, F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))).select("conv_id", "turn", "part")


_RELATED = ", ".join(f"('{k}', [" + ", ".join(f"'{w}'" for w in v[:3]) + "])" for k, v in schema.RELATED.items())


@query(
    "query_expansion",
    f"""WITH rel(k, v) AS (VALUES {_RELATED}), q AS (SELECT p_partkey, 'search data ' || p_name AS text, regexp_extract_all(lower('search data ' || p_name), '[a-z0-9_]+') AS own FROM part),
    o AS (SELECT p_partkey, unnest(own) AS w FROM q), m AS (SELECT p_partkey, list_sort(list_distinct(flatten(list(v)))) AS more FROM o JOIN rel ON k = w GROUP BY 1)
    SELECT p_partkey, text || ' ' || array_to_string(list_filter(coalesce(more, []), lambda x: NOT list_contains(own, x)), ' ') AS expanded FROM q LEFT JOIN m USING (p_partkey)""",
)
def _expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.expand_query(F.concat(F.lit("search data "), "p_name")).alias("expanded"))


# vectors

_DOT = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_COS = f"round({_DOT} / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6)"


@query("vector_topk", f"SELECT b.vec_id, {_COS} AS similarity FROM embeddings a, embeddings b WHERE a.vec_id = 0 AND b.vec_id <> 0 ORDER BY 2 DESC, 1 LIMIT 20")
def _topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.similar_to(table(spark, sf_dir, "embeddings"), 0, 20)


@query(
    "cosine_by_label",
    "WITH p AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), s AS (SELECT label, i, sum(x) AS s FROM p GROUP BY 1, 2), n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) SELECT s.label, n, round((sum(s * s) - n) / (n * (n - 1)), 5) AS cohesion FROM s JOIN n USING (label) GROUP BY s.label, n",
)
def _cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.mean_similarity(table(spark, sf_dir, "embeddings"))


@query(
    "vector_clusters",
    f"SELECT b.vec_id, (arg_max(a.vec_id, (round({_DOT} / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 9), -a.vec_id))) AS cluster FROM embeddings a, embeddings b WHERE a.vec_id < 8 GROUP BY 1",
)
def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return vectors.assign_clusters(e, e.where("vec_id < 8").select(F.col("vec_id").alias("cluster"), F.col("embedding").alias("centre")))


@query(
    "hash_embedding_topk",
    f"""WITH w AS (SELECT p_partkey AS id, unnest(list_filter(string_split({NORM.format("p_name || ' ' || p_type")}, ' '), lambda x: x <> '')) AS w FROM part), h AS (SELECT id, (('0x' || substr(md5(w), 1, 12))::BIGINT % 64) AS b FROM w),
    v AS (SELECT id, (b + k) % 64 AS i, sum(x) AS x FROM h, (VALUES (0, 1.0), (1, 0.5), (2, 0.25)) t(k, x) GROUP BY 1, 2), n AS (SELECT id, sqrt(sum(x * x)::DOUBLE) AS n FROM v GROUP BY 1)
    SELECT v.id AS p_partkey, round((sum(v.x * o.x) / (any_value(n.n) * (SELECT n FROM n WHERE id = 1)))::DOUBLE, 6) AS similarity FROM v JOIN v o ON o.id = 1 AND o.i = v.i JOIN n ON n.id = v.id WHERE v.id <> 1 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
)
def _hash_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return vectors.similar_to(vectors.hash_embedding(rows, "p_partkey", "text", 64), 1, 20, key="p_partkey")


# events


@query("event_windows", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.windowed(table(spark, sf_dir, "events"))


@query("event_history", "SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.history(table(spark, sf_dir, "events"), 5).select("event_id", "user_id")


@query(
    "event_state",
    "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) FILTER (value IS NOT NULL) AS value FROM events GROUP BY 1 HAVING arg_max(event_type, (ts, event_id)) <> 'error'",
)
def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.state(table(spark, sf_dir, "events"))


@query(
    "hash_chain_verify",
    # whatever the hashes are, a chain that was built right holds
    "SELECT (user_id % 64)::VARCHAR AS ledger, ((k - 1) // 10 + 1)::BIGINT AS index, true AS linked, true AS intact FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id % 64 ORDER BY ts, event_id) AS k FROM events) GROUP BY 1, 2",
)
def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 64).alias("ledger"), "event_id", "ts", F.to_json(F.struct("event_id", "user_id", "event_type")).alias("body"))
    return chain.verify(chain.build(rows, "ledger", ["ts", "event_id"], "body", zeros=1))


@over_facts("ranked_digest", "SELECT fact_id, row_number() OVER (PARTITION BY category ORDER BY quality_score DESC, fact_id) || '. ' || fact_statement || ' [' || category || '; ' || reliability_rating || ']' AS line FROM facts")
def _digest(f: DataFrame) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("quality_score"), "fact_id"))
    return f.select("fact_id", F.concat(n.cast("string"), F.lit(". "), "fact_statement", F.lit(" ["), "category", F.lit("; "), "reliability_rating", F.lit("]")).alias("line"))


def event_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes of users: a signup adds, an error deletes, others update."""
    e = table(spark, sf_dir, "events")
    action = F.when(F.col("event_type") == "signup", "add").when(F.col("event_type") == "error", "delete").otherwise("update")
    part = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    data = F.map_from_entries(F.filter(F.array(part("event_type", F.col("event_type")), part("value", F.round("value", 4).cast("string"))), lambda x: x["v"].isNotNull()))
    return e.select(F.lpad(F.col("event_id").cast("string"), 20, "0").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), action.alias("action"), F.col("user_id").cast("string").alias("fact_id"), data.alias("data"))


_LIVES = """WITH e AS (SELECT user_id, ts, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), m AS (SELECT user_id, max(k) FILTER (event_type = 'signup') AS since, max(k) FILTER (event_type = 'error') AS ended FROM e GROUP BY 1)"""


@query("change_state", _LIVES + " SELECT user_id::VARCHAR AS fact_id, arg_max(event_type, k) AS last_type, count(*) AS events FROM e JOIN m USING (user_id) WHERE since IS NOT NULL AND (ended IS NULL OR ended < since) AND k >= since GROUP BY 1")
def _change_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = event_changes(spark, sf_dir)
    none = spark.createDataFrame([], "fact_id string, ts timestamp, event_id string, data map<string, string>, gone boolean")
    live = events.apply_changes(none, changes).where("NOT gone").select("fact_id", F.col("data")["event_type"].alias("last_type"))
    since = changes.where("action = 'add'").groupBy("fact_id").agg(F.max(F.struct("ts", "event_id")).alias("since"))
    n = changes.join(since, "fact_id").where(F.struct("ts", "event_id") >= F.col("since")).groupBy("fact_id").agg(F.count("*").alias("events"))
    return live.join(n, "fact_id").select("fact_id", "last_type", "events")


@over_facts(
    "ledger_state",
    """SELECT fact_id, CASE WHEN quality_score >= 30 THEN 'reviewed' ELSE category END AS category, reliability_rating, CASE WHEN quality_score >= 30 THEN 2 ELSE 1 END::BIGINT AS transactions, category <> 'Market' OR quality_score < 30 AS verified FROM facts""",
)
def _ledger(f: DataFrame) -> DataFrame:
    """Each fact is added, the better ones are updated after; the chain says what they are, and what differs from that."""
    held = f.withColumn("data", F.create_map(F.lit("category"), F.col("category"), F.lit("reliability_rating"), F.col("reliability_rating"))).withColumns({"ledger": F.lit("main"), "at": F.lit("2024-01-01T00:00:00")})
    new = held.where("quality_score >= 30").withColumns({"data": F.create_map(F.lit("category"), F.lit("reviewed")), "at": F.lit("2024-01-02T00:00:00")})
    rows = held.select("fact_id", "at", chain.transaction("add_fact", "at", "fact_id", "data").alias("body")).unionByName(new.select("fact_id", "at", chain.transaction("update_fact", "at", "fact_id", "data").alias("body")))
    ledgers = rows.withColumn("ledger", F.substring(F.md5("fact_id"), 1, 2))
    entries = chain.fact_transactions(chain.build(ledgers, "ledger", ["at", "fact_id"], "body", zeros=1, genesis=True))
    said = chain.rebuild(entries, ["category", "reliability_rating"])
    real = f.withColumn("category", F.when((F.col("quality_score") >= 30) & (F.col("category") != "Market"), "reviewed").otherwise(F.col("category"))).select("fact_id", "category", "reliability_rating")
    return said.join(chain.verify_facts(real, entries).select("fact_id", "transactions", "verified"), "fact_id")


@query("page_facts", "SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS subject FROM pages WHERE regexp_extract(html, '(?s)<title>(.*?)</title>', 1) <> ''")
def _page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.facts_of_pages(table(spark, sf_dir, "pages"), title_fact, url="page_id").select(F.col("url_reference").cast("long").alias("page_id"), "subject")


def title_fact(page: str) -> list[dict]:
    """What a page is called, as a fact of it."""
    found = re.search(r"<title>(.*?)</title>", page, re.S)
    return [{"subject": found[1], "predicate": "is a", "object": "page", "fact_statement": f"{found[1]} is a page."}] if found and found[1] else []


@query("near_vectors", f"SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {_DOT} / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))) >= 0.4")
def _near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embed.near_pairs(table(spark, sf_dir, "embeddings"), 0.4, "vec_id")
    x, y = F.col("a").cast("long"), F.col("b").cast("long")
    return found.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
