"""Evaluation of extracted triples and of model facts against gold sets, with gates."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators.similarity import contained
from factloom.session import stage_table

#: gold facts that a task can be sent with their embeddings; more are given in parts
GOLD_ROWS = 20_000
GATES = {"min_precision": 0.80, "min_verified_precision": 0.90, "max_hallucination": 0.10, "min_coverage": 0.30}
_TRIPLE = "array<struct<subject: string, predicate: string, object: string, context: string>>"


def load_gold_items(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(``item, text``, ``item, position, subject, predicate, object``) of a JSON file of labelled texts: a list, or an
    object with ``items``; an item is its number."""
    raw = spark.read.text(path, wholetext=True)
    item = f"struct<text: string, facts: {_TRIPLE}>"
    rows = raw.select(F.coalesce(F.from_json("value", f"items array<{item}>")["items"], F.from_json("value", f"array<{item}>")).alias("items"))
    rows = rows.select(F.posexplode("items").alias("item", "i"))
    return rows.select("item", "i.text"), rows.select("item", F.posexplode("i.facts").alias("position", "f")).select("item", "position", "f.subject", "f.predicate", "f.object")


def load_gold_facts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(positive, negative) facts of a JSON object with ``facts`` and ``negative``; either may be absent."""
    parsed = spark.read.text(path, wholetext=True).select(F.from_json("value", f"facts {_TRIPLE}, negative {_TRIPLE}").alias("g"))
    return tuple(parsed.select(F.explode(f"g.{side}").alias("f")).select("f.*") for side in ("facts", "negative"))


def same_part(a: str | Column, b: str | Column) -> Column:
    """Whether one of two normalised texts contains the other; an empty one is only like an empty one."""
    x, y = T.norm(a), T.norm(b)
    return F.when((x == "") | (y == ""), x == y).otherwise(F.contains(x, y) | F.contains(y, x))


def same_predicate(a: str | Column, b: str | Column) -> Column:
    """Families of predicates are equal or one contains the other."""
    x, y = T.predicate_family(a), T.predicate_family(b)
    return F.contains(x, y) | F.contains(y, x)


def triple_matches(p: str, g: str) -> Column:
    part = lambda c: same_part(f"{p}.{c}", f"{g}.{c}")
    return F.coalesce(part("subject") & part("object") & same_predicate(f"{p}.predicate", f"{g}.predicate"), F.lit(False))


def triple_text(*columns: str | Column) -> Column:
    """Normalised parts of a triple, those that are there, in one text."""
    parts = F.array(*[T.norm(c) for c in columns or ("subject", "predicate", "object")])
    return F.array_join(F.filter(parts, lambda x: x != ""), " ")


def _numbered(rows: DataFrame, item: str) -> DataFrame:
    """Triples of each item with their place: ``position`` where there is one, else by their text."""
    order = ["position"] if "position" in rows.columns else []
    at = F.row_number().over(Window.partitionBy(item).orderBy(*order, "subject", "predicate", "object"))
    return rows.select(item, "subject", "predicate", "object", at.alias("at"))


def ratio(top: Column, bottom: Column, empty: Column | float) -> Column:
    return F.when(bottom == 0, empty).otherwise(top / bottom)


def evaluate(predicted: DataFrame, gold: DataFrame, item: str = "item") -> DataFrame:
    """One row: true and false positives, misses, precision, recall and F1 of triples. In each item every prediction, in
    order, takes the first gold triple that it matches and no other has taken. Nothing predicted is precise where
    nothing was to be found."""
    p, g = _numbered(predicted, item), _numbered(gold, item)
    pairs = p.alias("p").join(g.alias("g"), p[item].eqNullSafe(g[item])).where(triple_matches("p", "g")).select(F.col(f"p.{item}").alias("item"), F.col("p.at").alias("i"), F.col("g.at").alias("j"))
    per = pairs.groupBy("item", "i").agg(F.array_sort(F.collect_list("j")).alias("js")).groupBy("item").agg(F.array_sort(F.collect_list(F.struct("i", "js"))).alias("own"))
    free = lambda used, js: F.slice(F.array_except(js, used), 1, 1)
    taken = F.aggregate("own", F.array().cast("array<int>"), lambda used, x: F.concat(used, free(used, x["js"])))
    hits = per.agg(F.coalesce(F.sum(F.size(taken)), F.lit(0)).alias("tp"))
    totals = hits.crossJoin(predicted.agg(F.count("*").alias("np"))).crossJoin(gold.agg(F.count("*").alias("ng")))  # one row each
    return totals.select("tp", (F.col("np") - F.col("tp")).alias("fp"), (F.col("ng") - F.col("tp")).alias("fn")).select("tp", "fp", "fn", *scores(F.when(F.col("fn") == 0, 1.0).otherwise(0.0)))


def scores(nothing: Column | float) -> list[Column]:
    """Precision, recall and F1 of ``tp, fp, fn``; ``nothing`` is the precision where nothing was predicted."""
    p = ratio(F.col("tp"), F.col("tp") + F.col("fp"), nothing)
    r = ratio(F.col("tp"), F.col("tp") + F.col("fn"), 1.0)
    return [F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(ratio(2 * p * r, p + r, 0.0), 4).alias("f1")]


def lenient_pairs(facts: DataFrame, gold: DataFrame) -> DataFrame:
    """``id, gold``: facts and gold facts whose subjects and objects contain one another, either way. The subjects are
    matched by an index of letters, so no fact meets all of the gold."""
    parts = lambda d, key, c: d.select(key, T.norm("subject").alias(f"{c}s"), T.norm("object").alias(f"{c}o")).where(f"{c}s <> '' AND {c}o <> ''")
    x, y = parts(facts, "id", "f"), parts(gold, "gold", "g")
    meet = contained(x.select("fs"), y.select("gs")).toDF("fs", "gs").union(contained(y.select("gs"), x.select("fs")).toDF("gs", "fs").select("fs", "gs")).distinct()
    return x.join(meet, "fs").join(y, "gs").where(F.contains("fo", F.col("go")) | F.contains("go", F.col("fo"))).select("id", "gold").distinct()


def cosine_pairs_of(facts: DataFrame, gold: DataFrame, embedder, threshold: float) -> DataFrame:
    """``id, gold``: facts whose embedded triple reaches the threshold to a gold fact's. The gold is bounded and sent whole."""
    said = F.array_join(F.filter(F.array(*[T.norm(c) for c in ("subject", "predicate", "object", "context") if c in gold.columns]), lambda x: x != ""), " ")
    rows = gold.select("gold", said.alias("text")).limit(GOLD_ROWS + 1).collect()
    if len(rows) > GOLD_ROWS:
        raise ValueError(f"give gold facts in parts of {GOLD_ROWS} at most")
    names = np.array([r["gold"] for r in rows], np.int64)
    sent = facts.sparkSession.sparkContext.broadcast(unit(np.array([embedder(r["text"]) for r in rows], np.float64)) if rows else None)

    def run(parts):
        for pdf in parts:
            if not len(pdf) or sent.value is None:
                continue
            i, j = np.nonzero(unit(np.array([embedder(t) for t in pdf["text"]], np.float64)) @ sent.value.T >= threshold)
            yield pd.DataFrame({"id": pdf["id"].to_numpy()[i], "gold": names[j]})

    return facts.select("id", triple_text().alias("text")).mapInPandas(run, "id long, gold long")


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def shard_matches(shard: DataFrame, gold: DataFrame, negative: DataFrame, embedder=None, threshold: float = 0.82) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts with ``id, tier, agreement, good, bad``, (id, gold) pairs with tier, gold with ``gold``), staged."""
    agreed = [c for c in ("cross_model_agreement", "agreement") if c in shard.columns]
    agreement = F.coalesce(*[F.col(c).cast("int") for c in agreed], F.lit(1))
    predicate = F.col("predicate") if "predicate" in shard.columns else F.lit(None).cast("string").alias("predicate")
    facts, _ = stage_table(shard.select(F.monotonically_increasing_id().alias("id"), "subject", predicate, "object", F.coalesce("reliability_rating", F.lit("UNVERIFIED")).alias("tier"), agreement.alias("agreement")), "shard")
    keyed = [stage_table(g.withColumn("gold", F.monotonically_increasing_id()), "gold")[0] for g in (gold, negative)]
    match = (lambda g: lenient_pairs(facts, g)) if embedder is None else (lambda g: cosine_pairs_of(facts, g, embedder, threshold))
    hits, _ = stage_table(match(keyed[0]), "hits")
    false, _ = stage_table(match(keyed[1]).select("id").distinct(), "false")
    flagged = facts.join(hits.select("id").distinct().withColumn("good", F.lit(1)), "id", "left").join(false.withColumn("bad", F.lit(1)), "id", "left").fillna(0, ["good", "bad"])
    return stage_table(flagged, "flagged")[0], hits, keyed[0]


def evaluate_shard(shard: DataFrame, gold: DataFrame, negative: DataFrame, embedder=None, threshold: float = 0.82) -> DataFrame:
    """One row: facts, precision over all and of VERIFIED (null where none), hallucination rate and coverage of the gold."""
    flagged, hits, positive = shard_matches(shard, gold, negative, embedder, threshold)
    row = flagged.agg(
        F.count("*").alias("n"), F.coalesce(F.avg("good"), F.lit(1.0)).alias("precision"), F.avg(F.when(F.col("tier") == "VERIFIED", F.col("good"))).alias("verified_precision"), F.coalesce(F.avg("bad"), F.lit(0.0)).alias("hallucination")
    )
    covered = hits.agg(F.countDistinct("gold").alias("covered")).crossJoin(positive.agg(F.count("*").alias("all_gold")))
    return row.crossJoin(covered).select("n", *[F.round(c, 4).alias(c) for c in ("precision", "verified_precision", "hallucination")], F.round(ratio(F.col("covered"), F.col("all_gold"), 0.0), 4).alias("coverage"))


def shard_blocks(shard: DataFrame, gold: DataFrame, negative: DataFrame, embedder=None, threshold: float = 0.82) -> DataFrame:
    """``scope, key, n, tp, fp, fn, precision, recall, f1`` over all facts, by tier, and by agreement (its calibration)."""
    flagged, hits, positive = shard_matches(shard, gold, negative, embedder, threshold)
    part = lambda scope, key: F.struct(F.lit(scope).alias("scope"), key.alias("key"))
    scopes = F.explode(F.array(part("overall", F.lit("all")), part("tier", F.col("tier")), part("agreement", F.col("agreement").cast("string")))).alias("s")
    wide = flagged.select("id", "good", scopes).select("id", "good", "s.scope", "s.key")
    found = wide.join(hits, "id").groupBy("scope", "key").agg(F.countDistinct("gold").alias("matched"))
    counts = wide.groupBy("scope", "key").agg(F.count("*").alias("n"), F.sum("good").alias("tp"))
    total = positive.agg(F.count("*").alias("all_gold"))
    rows = counts.join(found, ["scope", "key"], "left").crossJoin(total).select("scope", "key", "n", "tp", (F.col("n") - F.col("tp")).alias("fp"), (F.col("all_gold") - F.coalesce("matched", F.lit(0))).alias("fn"))
    return rows.select("*", *scores(1.0))


def check_gates(row: Mapping, gates: Mapping[str, float] = GATES) -> list[str]:
    """What a row of :func:`evaluate_shard` misses."""
    out = []
    for gate, limit in gates.items():
        side, _, name = gate.partition("_")
        value = row[name]
        if value is not None and (value < limit if side == "min" else value > limit):
            out.append(f"{name} {value:.4g} is {'below' if side == 'min' else 'above'} {limit:g}")
    return out


def render_report(title: str, row: Mapping, failures: list[str] | None = None) -> str:
    """A row of figures as text, a line each, and what gates say of it."""
    lines = [title, "-" * len(title), *(f"{k:<22}{v:.4f}" if isinstance(v, float) else f"{k:<22}{v}" for k, v in row.items())]
    if failures is not None:
        lines += ["gates: passed"] if not failures else ["gates: failed", *(f"  {f}" for f in failures)]
    return "\n".join(lines)


__all__ = ["GATES", "check_gates", "evaluate", "evaluate_shard", "load_gold_facts", "load_gold_items", "render_report", "shard_blocks", "triple_matches", "triple_text"]
