"""Facts as a property graph: links, contradictions, inference, traversal, ranking, instructions and ontology."""

from __future__ import annotations

import re

from py4j.java_gateway import is_instance_of
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom import schema
from factloom.functions import text as T
from factloom.plans import match
from factloom.session import drop_path, stage_table

TAXONOMY = ["is a", "is a type of", "subclass of", "type of"]
RULES = {
    "attribute_outgoing": "exhibits has is".split(),
    "entity_outgoing": "causes contains fuels produce produces synthesizes".split(),
    "location_incoming": "located in,is located in,part of,is part of,occurs in".split(","),
    "process_suffixes": "ation ing process sis".split(),
}


def find_by_subject(facts: DataFrame, subject: str) -> DataFrame:
    return facts.where(F.contains(F.lower("subject"), F.lit(subject.lower())))


def find_by_reliability(facts: DataFrame, rating: str, limit: int = 100) -> DataFrame:
    return facts.where(F.col("reliability_rating") == rating).orderBy(F.desc("quality_score"), "block_id").limit(limit)


def link(facts: DataFrame) -> DataFrame:
    """``src, dst, predicate, weight``: an edge where a fact's object is another's subject, one for each pair."""
    a = facts.select(F.col("block_id").alias("src"), F.col("predicate").alias("p"), F.lower("object").alias("k"))
    b = facts.select(F.col("block_id").alias("dst"), F.col("predicate").alias("q"), F.lower("subject").alias("k"))
    found = a.join(b, "k").where("src <> dst").groupBy("src", "dst").agg(F.min(F.concat("p", F.lit("_"), "q")).alias("predicate"))
    return found.select("src", "dst", "predicate", F.lit(1.0).alias("weight"))


def _side(facts: DataFrame, name: str) -> DataFrame:
    keep = ["block_id", "fact_statement", "predicate", "reliability_rating", "quality_score", "agreement"]
    return facts.select(F.lower("subject").alias("s"), F.lower("object").alias("o"), *[F.col(c).alias(f"{name}_{c}") for c in keep])


def pairs_of(facts: DataFrame) -> DataFrame:
    """Pairs of facts with equal subject and object, the smaller id first."""
    return _side(facts, "a").join(_side(facts, "b"), ["s", "o"]).where("a_block_id < b_block_id")


def _negated(p: str) -> Column:
    return F.arrays_overlap(T.words(p), F.array(*map(F.lit, schema.NEGATIONS)))


def contradictions(facts: DataFrame) -> DataFrame:
    """Pairs of which exactly one predicate is negated."""
    return pairs_of(facts).where(_negated("a_predicate") != _negated("b_predicate"))


def transitive(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """``subject, predicate, object, step1, step2``: chains of one predicate; of equal results the least by ids."""
    a = facts.select(F.col("block_id").alias("src"), "subject", "predicate", F.col("fact_statement").alias("step1"))
    b = facts.select(F.col("block_id").alias("dst"), F.col("predicate").alias("q"), "object", F.col("fact_statement").alias("step2"))
    found = edges.select("src", "dst").join(a, "src").join(b, "dst").where("predicate = q")
    return found.groupBy(F.lower("subject"), F.lower("predicate"), F.lower("object")).agg(F.min_by(F.struct("subject", "predicate", "object", "step1", "step2"), F.struct("src", "dst")).alias("t")).select("t.*")


def conflict_pairs(facts: DataFrame) -> DataFrame:
    """Subject and object, as written, that several predicates join: one aggregation in place of a self-join."""
    return facts.groupBy("subject", "object").agg(F.countDistinct("predicate").alias("predicates")).where("predicates > 1")


def reconcile(facts: DataFrame) -> DataFrame:
    """``facts`` with the lower-quality side of each contradiction UNVERIFIED, both where equal; ``demoted`` says which."""
    open_ = contradictions(facts).where("a_reliability_rating <> 'UNVERIFIED' AND b_reliability_rating <> 'UNVERIFIED'")
    low = F.when(F.col("a_quality_score") < F.col("b_quality_score"), F.array("a_block_id")).when(F.col("b_quality_score") < F.col("a_quality_score"), F.array("b_block_id")).otherwise(F.array("a_block_id", "b_block_id"))
    out = open_.select(F.explode(low).alias("block_id")).distinct().withColumn("demoted", F.lit(True))
    joined = facts.join(out, "block_id", "left").withColumn("demoted", F.coalesce("demoted", F.lit(False)))
    return joined.withColumn("reliability_rating", F.when(F.col("demoted"), "UNVERIFIED").otherwise(F.col("reliability_rating")))


def chain_instructions(facts: DataFrame, edges: DataFrame, max_chains: int | None = None) -> DataFrame:
    """``src, dst, template, instruction, response``: three for each edge between verified enough facts."""
    side = lambda n, k: facts.where("reliability_rating <> 'UNVERIFIED'").select(F.col("block_id").alias(k), *[F.col(c).alias(c[0] + n) for c in ("subject", "object", "fact_statement", "reliability_rating")])
    c = edges.select("src", "dst").join(side("1", "src"), "src").join(side("2", "dst"), "dst")
    if max_chains is not None:
        c = c.orderBy("src", "dst").limit(max_chains)
    s1, o1, f1, r1, s2, o2, f2, r2 = (F.col(k) for k in ("s1", "o1", "f1", "r1", "s2", "o2", "f2", "r2"))
    t = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in x])
    texts = [
        (t("Trace the relationship connection starting from ", s1, " to ", o2, "."), t("According to the knowledge graph, ", s1, " connects to ", o2, " through the intermediate concept ", o1, ". Specifically, we know that: \n- ", f1, " (Reliability: ", r1, ")\n- ", f2, " (Reliability: ", r2, ")")),
        (t("Explain the sequence of connections linking ", s1, " to ", o2, "."), t("The logical path connecting ", s1, " to ", o2, " is:\n1. ", f1, "\n2. ", f2)),
        (t("If ", f1, " and we know that ", s2, " connects to ", o2, ", what is the second step in the path?"), t("The second step in the path is: ", f2)),
    ]
    return c.select("src", "dst", F.posexplode(F.array(*[F.struct(a.alias("instruction"), b.alias("response")) for a, b in texts])).alias("template", "t")).select("src", "dst", "template", "t.*")


def contradiction_instructions(facts: DataFrame) -> DataFrame:
    """``a, b, instruction, response``: which of two claims that differ in predicate is more reliable."""
    p = pairs_of(facts).where("lower(a_predicate) <> lower(b_predicate)")
    s1, s2, r1, r2 = F.col("a_fact_statement"), F.col("b_fact_statement"), F.col("a_reliability_rating"), F.col("b_reliability_rating")
    n1, n2 = (F.coalesce(c, F.lit(1)).cast("string") for c in (F.col("a_agreement"), F.col("b_agreement")))
    k1, k2 = schema.rank("a_reliability_rating"), schema.rank("b_reliability_rating")
    t = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])

    def rated(x, s, r, n, y, r_, n_):
        return t(f"Claim {x} ('", s, "') is more reliable. It is rated ", r, " (Agreement count: ", n, f"), whereas Claim {y} ('", s2 if y == 2 else s1, "') is rated ", r_, " (Agreement count: ", n_, ").")

    def agreed(x, s, n, y, n_):
        return t(f"Claim {x} ('", s, "') is more reliable. It has higher model agreement count (", n, f") compared to Claim {y} (", n_, ").")

    verdict = (
        F.when(k1 > k2, rated(1, s1, r1, n1, 2, r2, n2)).when(k2 > k1, rated(2, s2, r2, n2, 1, r1, n1))
        .when(n1.cast("int") > n2.cast("int"), agreed(1, s1, n1, 2, n2)).when(n2.cast("int") > n1.cast("int"), agreed(2, s2, n2, 1, n1))
        .otherwise(t("Both claims have equal reliability ratings (", r1, ") and agreement counts (", n1, "). Neither claim can be conclusively preferred without additional context."))
    )
    ask = t("Evaluate the following two conflicting claims and determine which is more reliable:\n1. ", s1, "\n2. ", s2)
    return p.select(F.col("a_block_id").alias("a"), F.col("b_block_id").alias("b"), ask.alias("instruction"), verdict.alias("response"))


def taxonomy(facts: DataFrame) -> DataFrame:
    """``parent, children`` (sorted)."""
    rows = facts.where(F.lower("predicate").isin(*TAXONOMY)).select(F.trim("object").alias("parent"), F.trim("subject").alias("child")).where("parent <> '' AND child <> ''")
    return rows.groupBy("parent").agg(F.array_join(F.array_sort(F.collect_set("child")), "|").alias("children"))


def semantic_types(facts: DataFrame, rules: dict | None = None) -> DataFrame:
    """``concept, type`` by its ending, then by the predicates that leave and reach it."""
    use = RULES | (rules or {})
    rows = facts.select(F.trim("subject").alias("s"), F.trim("predicate").alias("p"), F.trim("object").alias("o")).where("s <> '' AND o <> ''")
    flag = lambda side, key: (F.lit(side) == F.col("side")) & F.coalesce(F.col("p").isin(*use[key]), F.lit(False))
    ends = rows.select(F.explode(F.array(F.struct(F.col("s").alias("concept"), F.lit("out").alias("side"), "p"), F.struct(F.col("o").alias("concept"), F.lit("in").alias("side"), "p"))).alias("x")).select("x.*")
    per = ends.groupBy("concept").agg(*[F.max(flag(side, key)).alias(name) for side, key, name in (("out", "entity_outgoing", "e"), ("in", "location_incoming", "l"), ("out", "attribute_outgoing", "a"))])
    suffix = F.lower("concept").rlike("(" + "|".join(use["process_suffixes"]) + ")$")
    return per.select("concept", F.when(suffix, "PROCESS").when(F.col("e"), "ENTITY").when(F.col("l"), "LOCATION").when(F.col("a"), "ATTRIBUTE").otherwise("CONCEPT").alias("type"))


def relation_schema(facts: DataFrame, types: DataFrame) -> DataFrame:
    rows = facts.select(F.trim("subject").alias("s"), F.trim("predicate").alias("predicate"), F.trim("object").alias("o")).where("s <> '' AND predicate <> '' AND o <> ''").distinct()
    x, y = types.toDF("s", "subject_type"), types.toDF("o", "object_type")
    return rows.join(x, "s").join(y, "o").select("subject_type", "predicate", "object_type").distinct()


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6, every: int = 5) -> DataFrame:
    """``block_id, rank``: power iteration from equal ranks; what dangling nodes hold is spread evenly. Stops when the
    ranks change by less than ``tolerance`` a node, tested when lineage is cut."""
    spark = nodes.sparkSession
    out = edges.select("src", "dst").distinct()
    out, out_at = stage_table(out.join(out.groupBy("src").agg(F.count("*").alias("deg")), "src"), "links")
    ids, ids_at = stage_table(nodes.select("block_id").distinct(), "nodes")
    n = ids.count()
    if not n:
        return ids.withColumn("rank", F.lit(0.0))
    ranks, at = ids.withColumn("rank", F.lit(1.0 / n)), None
    dangling = ids.join(out.select(F.col("src").alias("block_id")).distinct(), "block_id", "left_anti").withColumn("dangling", F.lit(1))
    base, base_at = stage_table(ids.join(dangling, "block_id", "left").fillna(0, ["dangling"]), "base")
    ranks = base.withColumn("rank", F.lit(1.0 / n))
    done = 0
    while done < rounds:
        before = ranks
        for _ in range(min(every, rounds - done)):
            given = ranks.join(out, ranks["block_id"] == out["src"]).groupBy("dst").agg(F.sum(F.col("rank") / F.col("deg")).alias("got"))
            loose = ranks.agg(F.coalesce(F.sum(F.when(F.col("dangling") == 1, F.col("rank"))), F.lit(0.0)).alias("loose"))
            ranks = ranks.join(given, ranks["block_id"] == given["dst"], "left").crossJoin(F.broadcast(loose)).select(
                "block_id", "dangling", (F.lit((1 - damping) / n) + F.lit(damping) * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / n)).alias("rank")
            )
            done += 1
        ranks, next_at = stage_table(ranks, "ranks")
        change = ranks.join(before.select("block_id", F.col("rank").alias("old")), "block_id").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
        if at:
            drop_path(spark, at)
        at = next_at
        if change < n * tolerance * every:
            break
    drop_path(spark, out_at, ids_at, base_at)
    return ranks.select("block_id", "rank")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``block_id, component``: the least id reachable whatever the direction. Large stars and small stars take turns: every
    node's greater neighbours, then its smaller ones, are tied to the least of them, until nothing changes. Rounds grow with
    the logarithm of the longest path, and no step joins on the label that a giant component shares."""
    spark = nodes.sparkSession
    u, v = F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")
    now, at = stage_table(edges.select(u, v).where("u <> v").distinct(), "stars")
    old, before = [], None
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        after, next_at = stage_table(small, "stars")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        old.append(at)
        now, at = after, next_at
        if state == before:
            break
        before = state
    found, _ = stage_table(nodes.select("block_id").distinct().join(now.toDF("block_id", "component"), "block_id", "left").select("block_id", F.coalesce("component", "block_id").alias("component")), "components")
    drop_path(spark, *old, at)
    return found


def delete_facts(facts: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, edges) without some facts (``block_id``) and the links that touch them."""
    gone = ids.select("block_id").distinct()
    left = edges.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti").select(*edges.columns)
    return facts.join(gone, "block_id", "left_anti").select(*facts.columns), left


def hops(seeds: DataFrame, edges: DataFrame, most: int, blocked: DataFrame | None = None) -> DataFrame:
    """``block_id, hop``: nodes within ``most`` steps of the seeds, whatever the direction; blocked nodes aren't entered."""
    spark = seeds.sparkSession
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    if blocked is not None:
        both = both.join(blocked.select(F.col("block_id").alias("dst")), "dst", "left_anti").select("src", "dst")
    both, both_at = stage_table(both, "both")
    seen, at = stage_table(seeds.select("block_id", F.lit(0).alias("hop")).distinct(), "seen")
    for h in range(1, most + 1):
        front = both.join(seen.where(F.col("hop") == h - 1).select(F.col("block_id").alias("src")), "src").select(F.col("dst").alias("block_id")).distinct()
        after, next_at = stage_table(seen.unionByName(front.join(seen, "block_id", "left_anti").withColumn("hop", F.lit(h))), "seen")
        grew = after.where(F.col("hop") == h).limit(1).count()
        drop_path(spark, at)
        seen, at = after, next_at
        if not grew:
            break
    drop_path(spark, both_at)
    return seen


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, components, triangles."""
    e = edges.select("src", "dst").distinct()
    u = e.select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).where("x <> y").distinct()
    tri = u.toDF("x", "y").join(u.toDF("y", "z"), "y").join(u.toDF("x", "z"), ["x", "z"]).agg(F.count("*").alias("triangles"))
    c = components(nodes, edges).agg(F.countDistinct("component").alias("components"))
    row = nodes.select("block_id").distinct().agg(F.count("*").alias("nodes")).crossJoin(e.agg(F.count("*").alias("edges"))).crossJoin(c).crossJoin(tri)
    return row.select("nodes", "edges", F.round(F.when(F.col("nodes") > 1, F.col("edges") / (F.col("nodes").cast("double") * (F.col("nodes") - 1))).otherwise(0.0), 9).alias("density"), "components", "triangles")


def betweenness(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``block_id, centrality``: the normalised share of shortest paths through each node, directed.

    Searches from all sources advance together, a level at a time, as joins on (source, node) with path counts;
    dependencies then flow back level by level, along the links that the search took: a node's other links into the next
    level are of other sources. Only nodes with links out are sources. Work and state are sources x reach, as in any exact
    algorithm."""
    spark = nodes.sparkSession
    e, e_at = stage_table(edges.select("src", "dst").where("src <> dst").distinct(), "links")
    n = nodes.select("block_id").distinct().count()
    sources = nodes.select(F.col("block_id").alias("s")).distinct().join(e.select(F.col("src").alias("s")).distinct(), "s", "left_semi")
    levels = [stage_table(sources.select("s", F.col("s").alias("v"), F.lit(1.0).alias("paths")), "level")]
    seen, seen_at = stage_table(levels[0][0].select("s", "v"), "seen")
    trash = [e_at]
    while True:
        step = levels[-1][0].join(e, F.col("v") == F.col("src")).groupBy("s", F.col("dst").alias("v")).agg(F.sum("paths").alias("paths")).join(seen, ["s", "v"], "left_anti")
        level = stage_table(step, "level")
        trash.append(level[1])
        if not level[0].limit(1).count():
            break
        levels.append(level)
        after, next_at = stage_table(seen.union(level[0].select("s", "v")), "seen")
        trash.append(seen_at)
        seen, seen_at = after, next_at
    total, below = None, None
    for depth in range(len(levels) - 1, 0, -1):
        here = levels[depth][0]
        here = here.withColumn("d", F.lit(0.0)) if below is None else here.join(below, ["s", "v"], "left").fillna(0.0, ["d"])
        upper = levels[depth - 1][0].select("s", F.col("v").alias("u"), F.col("paths").alias("pu"))
        give = upper.join(e, F.col("u") == F.col("src")).select("s", "u", "pu", F.col("dst").alias("v")).join(here, ["s", "v"]).groupBy("s", F.col("u").alias("v")).agg(F.sum(F.col("pu") / F.col("paths") * (1 + F.col("d"))).alias("d"))
        below, at = stage_table(give, "flow")
        trash.append(at)
        part = below.where("s <> v")
        total = part if total is None else total.unionByName(part)
    scale = float((n - 1) * (n - 2)) if n > 2 else 1.0
    found = total.groupBy(F.col("v").alias("block_id")).agg((F.sum("d") / scale).alias("centrality")) if total is not None else nodes.select("block_id", F.lit(0.0).alias("centrality")).limit(0)
    result, _ = stage_table(nodes.select("block_id").distinct().join(found, "block_id", "left").fillna(0.0, ["centrality"]), "centrality")
    drop_path(spark, seen_at, *trash)
    return result


def importance(facts: DataFrame, centrality: DataFrame) -> DataFrame:
    related = F.coalesce(F.size("related_facts"), F.lit(0)) if "related_facts" in facts.columns else F.lit(0)
    return facts.join(centrality, "block_id").select("block_id", (2 * schema.rank("reliability_rating") + 0.5 * F.coalesce("usage_count", F.lit(0)) + 30 * F.col("centrality") + 0.5 * F.greatest(related, F.lit(0))).alias("importance"))


def query_terms(query: str) -> list[str]:
    """Words of three letters and more."""
    return [w for w in query.lower().split() if w[2:]]


def seeds(facts: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """Facts that hold words of the query: 1 in the statement, 2 in the subject, 2 in the object; without words the first by id."""
    terms = query_terms(query)
    if not terms:
        return facts.orderBy("block_id").limit(limit).withColumn("score", F.lit(0))
    hit = lambda c, w: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(w)).cast("int")
    score = sum((hit("fact_statement", w) + 2 * hit("subject", w) + 2 * hit("object", w) for w in terms), F.lit(0))
    return facts.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "block_id").limit(limit)


def vector_seeds(facts: DataFrame, vector: list[float], limit: int = 5, column: str = "embedding") -> DataFrame:
    """Facts whose embeddings are nearest to a vector, by cosine; a partial top list in each task."""
    score = T.cosine(column, F.array(*[F.lit(float(x)) for x in vector]))
    return facts.where(F.col(column).isNotNull()).withColumn("score", score).orderBy(F.desc("score"), "block_id").limit(limit)


def retrieve(facts: DataFrame, edges: DataFrame, query: str, top_k: int = 5, most: int = 2, weight: float = 0.3, verified_only: bool = True, ranks: DataFrame | None = None, vector: list[float] | None = None) -> DataFrame:
    """``block_id, hybrid``: seeds and their surroundings by likeness and PageRank; conflicting facts aren't entered. Likeness
    is the share of matched words, or with the query's ``vector`` the cosine of ``embedding``. Ranks of a graph that is asked
    often are given, so that no question computes them again."""
    first = seeds(facts, query, top_k) if vector is None else vector_seeds(facts, vector, top_k)
    first = first.where("reliability_rating <> 'UNVERIFIED'") if verified_only else first
    low = lambda c: F.lower(F.trim(c))
    bad = conflict_pairs(facts).select(low("subject").alias("s"), low("object").alias("o")).distinct()
    clash = facts.select("block_id", low("subject").alias("s"), low("object").alias("o")).join(bad.union(bad.select("o", "s")), ["s", "o"], "left_semi").select("block_id")
    blocked = clash.union(facts.where("reliability_rating = 'UNVERIFIED'").select("block_id")) if verified_only else clash
    found = hops(first, edges, most, blocked)
    ranks = pagerank(facts, edges) if ranks is None else ranks
    top = ranks.agg(F.max("rank").alias("top"))
    terms = query_terms(query)
    if vector is None:
        sim = sum((F.contains(F.lower("fact_statement"), F.lit(w)).cast("int") for w in terms), F.lit(0)) / max(1, len(terms))
    else:
        sim = F.coalesce(T.cosine("embedding", F.array(*[F.lit(float(x)) for x in vector])), F.lit(0.0))
    rows = found.join(facts, "block_id").join(ranks, "block_id", "left").crossJoin(F.broadcast(top))
    score = (1 - weight) * sim + weight * F.coalesce(F.col("rank"), F.lit(0.0)) / F.col("top")
    return rows.withColumn("hybrid", F.round(score, 6)).orderBy(F.desc("hybrid"), "block_id").limit(2 * top_k)


def context(found: DataFrame) -> DataFrame:
    """One row of Markdown for a prompt."""
    line = F.concat(F.lit("- **"), "subject", F.lit("** "), "predicate", F.lit(" **"), "object", F.lit('** (Statement: "'), "fact_statement", F.lit('", Reliability: '), "reliability_rating", F.lit(")"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("hybrid")).alias("h"), "block_id", line.alias("line")))), lambda x: x["line"])
    return found.agg(F.when(F.count("*") == 0, "No relevant facts found in the knowledge graph.").otherwise(F.concat(F.lit("### Verified Knowledge Graph Facts:\n"), F.array_join(lines, "\n"))).alias("context"))


def parsed(spark: SparkSession, text: str):
    """The plan of a query that only reads, and whether its outermost step is a LIMIT; a ValueError says why it isn't one."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:
        raise ValueError(f"can't be parsed: {str(e).splitlines()[0]}") from None
    gateway, package = spark.sparkContext._gateway, "org.apache.spark.sql.catalyst.plans.logical"
    todo, nodes = [plan], []
    while todo:
        node = todo.pop()
        nodes.append(node)
        if any(is_instance_of(gateway, node, f"{package}.{k}") for k in ("Command", "ParsedStatement")):
            raise ValueError("only a single SELECT is allowed")
        for inner in (node.children(), node.innerChildren()):
            todo += [x for x in (inner.apply(i) for i in range(inner.size())) if is_instance_of(gateway, x, f"{package}.LogicalPlan")]
    if re.search(r"\b(?:java_method|reflect|try_reflect)\s*\(", text, re.I):
        raise ValueError("functions that call into the runtime are not allowed")
    while plan.nodeName() == "UnresolvedWith":
        plan = plan.children().apply(0)
    return plan.nodeName() == "GlobalLimit"


def graph_sql(spark: SparkSession, facts: DataFrame, edges: DataFrame, query: str, limit: int = 100) -> DataFrame:
    """A read-only query over the views ``Fact`` and ``RELATED``: one SELECT, or a MATCH pattern. What writes is refused by
    its parsed plan; a query whose outermost step isn't a LIMIT gets one."""
    text = query.strip().rstrip(";").strip()
    text = match.translate(text) if re.match(r"MATCH\b", text, re.I) else text
    capped = parsed(spark, text)
    facts.createOrReplaceTempView("Fact")
    edges.createOrReplaceTempView("RELATED")
    found = spark.sql(text)
    return found if capped else found.limit(limit)
