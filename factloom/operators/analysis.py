"""Analysis of a fact graph: contradictions, missing links, connections, central facts, names, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import schema
from factloom.functions import text as T
from factloom.operators import graph, similarity
from factloom.session import drop_path, stage_table

#: what each attribute adds to the likeness of two facts
WEIGHTS = {"fact_statement": 0.4, "category": 0.2, "tags": 0.2, "source_id": 0.1, "author_creator": 0.1}
SCALE = 0.405
TITLES = "Dr Mr Mrs Ms Prof".split()


def contradictions(facts: DataFrame, over: float = 0.7, apart: int = 2, key: str = "fact_id") -> DataFrame:
    """``a, b, similarity``: facts whose statements are alike, by more than ``over``, and whose tiers are ``apart`` or more."""
    near = similarity.jaccard_pairs(facts, over, key, "fact_statement").where(F.col("similarity") > over + 1e-12)
    rank = lambda c: facts.select(F.col(key).alias(c), schema.rank("reliability_rating").alias(f"r{c}"))
    return near.join(rank("a"), "a").join(rank("b"), "b").where(F.abs(F.col("ra") - F.col("rb")) >= apart).select("a", "b", "similarity")


def unlinked(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs (a < b) that no edge joins, whatever its direction."""
    both = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    return pairs.join(both, ["a", "b"], "left_anti")


def missing_links(facts: DataFrame, edges: DataFrame, threshold: float = 0.6, key: str = "fact_id") -> DataFrame:
    """``a, b, similarity`` of facts without an edge whose weighted likeness of attributes reaches the threshold, exactly.

    What the attributes beside the statement can add at most says how alike statements must be, and so which are joined.
    Where attributes alone can reach the threshold, facts that are equal in enough of them are met too."""
    spark = facts.sparkSession
    have = {c for c in WEIGHTS if c in facts.columns}
    given = facts.select(key, *[F.col(c) if c in have else F.lit(None).cast("array<string>" if c == "tags" else "string").alias(c) for c in WEIGHTS])
    rows, rows_at = stage_table(given.withColumn("__words", T.word_set("fact_statement")), "facts")
    held = rows.agg(*[F.max((F.size(c) > 0 if c == "tags" else F.col(c).isNotNull()).cast("int")).alias(c) for c in WEIGHTS if c != "fact_statement"]).first()
    most = sum(w for c, w in WEIGHTS.items() if c != "fact_statement" and held[c])
    need = (threshold - most) / WEIGHTS["fact_statement"]
    pairs = similarity.jaccard_pairs(rows, min(1.0, max(need - 1e-9, 1e-9)), key, "fact_statement").select("a", "b") if need <= 1 else None
    if need <= 1e-9:
        # without a common word, attributes must do: each set of them that could, joined by equality (tags by a common one)
        names = [c for c in WEIGHTS if c != "fact_statement" and held[c]]
        for mask in range(1, 1 << len(names)):
            some = [c for i, c in enumerate(names) if mask >> i & 1]
            if sum(WEIGHTS[c] for c in some) < threshold - 1e-9 or any(sum(WEIGHTS[c] for c in some if c != d) >= threshold - 1e-9 for d in some):
                continue  # only the smallest that reach it
            side = lambda k: rows.select(F.col(key).alias(k), *[F.explode(F.array_distinct("tags")).alias("tags") if c == "tags" else F.col(c) for c in some])  # noqa: B023, E731
            pairs = pairs.union(side("a").join(side("b"), some).where("a < b").select("a", "b"))
    if pairs is None:
        return rows.select(F.col(key).alias("a"), F.col(key).alias("b"), F.lit(0.0).alias("similarity")).limit(0)
    # words are those that were split once for each fact, and attributes that no fact has aren't sent
    side = lambda k: rows.select(F.col(key).alias(k), F.struct("__words", *[F.col(c) if held.asDict().get(c) else F.lit(None).cast("array<string>" if c == "tags" else "string").alias(c) for c in WEIGHTS if c != "fact_statement"]).alias(f"f{k}"))
    scored = unlinked(pairs if need > 1e-9 else pairs.distinct(), edges).join(side("a"), "a").join(side("b"), "b").select("a", "b", similarity.attribute_similarity("fa", "fb", "__words").alias("similarity"))
    found, _ = stage_table(scored.where(F.col("similarity") >= threshold - 1e-9), "missing-links")
    drop_path(spark, rows_at)
    return found.orderBy(F.desc("similarity"), "a", "b")


def connections(facts: DataFrame, edges: DataFrame, least: float = 0.4, key: str = "fact_id") -> DataFrame:
    """``a, b, similarity`` of facts without an edge whose statements' scaled cosine of word counts reaches ``least``."""
    if least > SCALE:
        return facts.select(F.col(key).alias("a"), F.col(key).alias("b"), F.lit(0.0).alias("similarity")).limit(0)
    found = similarity.cosine_pairs(facts, least / SCALE, key, "fact_statement")
    return unlinked(found, edges).select("a", "b", (SCALE * F.col("cosine")).alias("similarity")).orderBy(F.desc("similarity"), "a", "b")


def similar_facts(facts: DataFrame, ident: str, least: float = 0.5, key: str = "fact_id") -> DataFrame:
    """``key, similarity`` of the other facts whose statements are like one fact's, the likest first."""
    one = facts.where(F.col(key) == ident).select(similarity.content_words("fact_statement").alias("w")).limit(1).collect()  # one row
    rows = facts.where((F.col(key) != ident) if one else F.lit(False))
    scored = rows.select(key, similarity.tf_similarity_to("fact_statement", one[0]["w"] if one else [], SCALE).alias("similarity"))
    return scored.where(F.col("similarity") >= least - 1e-12).orderBy(F.desc("similarity"), key)


def central_facts(facts: DataFrame, edges: DataFrame, top: int = 5) -> DataFrame:
    """``block_id, centrality`` of the facts that most shortest paths pass."""
    return graph.betweenness(facts, edges).orderBy(F.desc("centrality"), "block_id").limit(top)


def likely_name(text: str | Column) -> Column:
    """Whether a text begins with a title or is two capitalised words."""
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return c.rlike(rf"^(?:{'|'.join(TITLES)}) ") | c.rlike(r"(?U)^\s*\p{Lu}\S*\s+\p{Lu}\S*\s*$")


def enriched(facts: DataFrame) -> DataFrame:
    """``facts`` with ``subject_class, object_class`` of the ontology, and the ``parent`` of the subject in the taxonomy."""
    types = graph.semantic_types(facts)
    parents = graph.taxonomy(facts).select(F.explode(F.split("children", r"\|")).alias("child"), "parent").groupBy("child").agg(F.min("parent").alias("parent"))
    out = facts.withColumns({"__s": F.trim("subject"), "__o": F.trim("object")})
    out = out.join(types.toDF("__s", "subject_class"), "__s", "left").join(types.toDF("__o", "object_class"), "__o", "left").join(parents.toDF("__s", "parent"), "__s", "left")
    return out.drop("__s", "__o")


def clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``block_id, clustering``: of a node's pairs of neighbours, directions kept, the share that is joined: triangles of
    directed edges over all that its degrees allow."""
    e = edges.select("src", "dst").where("src <> dst").distinct()
    both = e.select(F.col("src").alias("x"), F.col("dst").alias("y")).union(e.select("dst", "src"))
    weight = both.groupBy("x", "y").agg(F.count("*").alias("w"))  # 2 where the edge goes both ways
    weight, at = stage_table(weight, "joined")
    up = weight.where("x < y")
    tri = up.toDF("a", "b", "w1").join(up.toDF("b", "c", "w2"), "b").join(up.toDF("a", "c", "w3"), ["a", "c"]).select(F.explode(F.array("a", "b", "c")).alias("block_id"), (F.col("w1") * F.col("w2") * F.col("w3")).alias("t"))
    t = tri.groupBy("block_id").agg(F.sum("t").alias("t"))
    deg = weight.groupBy(F.col("x").alias("block_id")).agg(F.sum("w").alias("d"), F.count(F.when(F.col("w") == 2, 1)).alias("m"))
    share = F.col("t") / (F.col("d") * (F.col("d") - 1) - 2 * F.col("m"))
    found, _ = stage_table(nodes.select("block_id").distinct().join(deg.join(t, "block_id"), "block_id", "left").select("block_id", F.coalesce(share, F.lit(0.0)).alias("clustering")), "clustering")
    drop_path(nodes.sparkSession, at)
    return found


def mean_path(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: ``connected`` (whatever the direction), and where it is the mean length of shortest directed paths over all
    ordered pairs (those without a path add 0). Work and state are pairs within reach, as in any exact algorithm."""
    spark = nodes.sparkSession
    e, e_at = stage_table(edges.select("src", "dst").where("src <> dst").distinct(), "links")
    n = nodes.select("block_id").distinct().count()
    groups = graph.components(nodes, edges).select("component").distinct().count()
    if groups != 1:
        drop_path(spark, e_at)
        return spark.createDataFrame([(False, None)], "connected boolean, mean_path double")
    front, at = stage_table(nodes.select(F.col("block_id").alias("s"), F.col("block_id").alias("v")).distinct(), "front")
    seen, seen_at, total, step = front, None, 0, 0
    while True:
        step += 1
        reached = front.join(e, front["v"] == e["src"]).select("s", F.col("dst").alias("v")).distinct()
        new, new_at = stage_table(reached.join(seen, ["s", "v"], "left_anti"), "front")
        found = new.count()
        if not found:
            drop_path(spark, new_at)
            break
        total += step * found
        both, both_at = stage_table(seen.union(new), "seen")
        drop_path(spark, at, *([seen_at] if seen_at else []))
        front, at, seen, seen_at = new, new_at, both, both_at
    drop_path(spark, e_at, at, *([seen_at] if seen_at else []))
    return spark.createDataFrame([(True, total / (n * (n - 1)) if n > 1 else 0.0)], "connected boolean, mean_path double")


def graph_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: what :func:`graph.graph_stats` has, the mean clustering, whether all is connected, and the mean path."""
    mean = clustering(nodes, edges).agg(F.round(F.coalesce(F.avg("clustering"), F.lit(0.0)), 9).alias("clustering"))
    path = mean_path(nodes, edges).select("connected", F.round("mean_path", 9).alias("mean_path"))
    return graph.graph_stats(nodes, edges).crossJoin(mean).crossJoin(path)  # one row each

