"""Fact tables: filters, ranks, summaries, stores, promotion and budgets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom import schema
from factloom.functions import text as T


def quality_score(rating: str = "reliability_rating", usage: str = "usage_count") -> Column:
    return (schema.rank(rating) * 10 + F.coalesce(F.col(usage), F.lit(0)) * 2).cast("double")


def at_least(facts: DataFrame, rating: str) -> DataFrame:
    return facts.where(schema.rank("reliability_rating") >= schema.TIERS.index(rating) + 1)


def matching(facts: DataFrame, **attributes) -> DataFrame:
    """Rows that equal all attributes."""
    return facts.where(reduce(lambda a, b: a & b, (F.col(k) == v for k, v in attributes.items()), F.lit(True)))


def catalog_query(facts: DataFrame, min_quality: float | None = None, limit: int | None = None, **equal) -> DataFrame:
    found = matching(facts, **{k: v for k, v in equal.items() if v is not None})
    if min_quality is not None:
        found = found.where(F.col("quality_score") >= min_quality)
    found = found.orderBy(F.desc("quality_score"), "fact_id")
    return found if limit is None else found.limit(limit)


def add(facts: DataFrame, new: DataFrame) -> DataFrame:
    """``facts`` and new ones, with their quality; ValueError where one isn't valid, is there already or comes twice."""
    missing = sorted({"fact_id", "fact_statement", "reliability_rating"} - set(new.columns))
    if missing:
        raise ValueError(f"facts need {', '.join(missing)}")
    _, bad = validate(new)
    if not bad.isEmpty():
        raise ValueError("facts need an id and a known rating")
    if not new.groupBy("fact_id").count().where("count > 1").isEmpty() or not new.join(facts.select("fact_id"), "fact_id", "left_semi").isEmpty():
        raise ValueError("an id is there already")
    usage = new if "usage_count" in new.columns else new.withColumn("usage_count", F.lit(0))
    return facts.unionByName(usage.withColumn("quality_score", quality_score()).select(*[c for c in facts.columns if c in usage.columns or c == "quality_score"]), allowMissingColumns=True)


def get(facts: DataFrame, fact_id: str) -> dict:
    """A fact's attributes; ValueError where there is none."""
    row = facts.where(F.col("fact_id") == fact_id).first()
    if row is None:
        raise ValueError(f"no fact {fact_id!r}")
    return row.asDict(True)


def change_log(before: DataFrame, after: DataFrame, at: str) -> DataFrame:
    """``fact_id, change, attributes, at``: facts that were added, deleted, or updated and in what."""
    names = [c for c in after.columns if c != "fact_id" and c in before.columns]
    old = before.select("fact_id", F.struct(*names).alias("o"))
    new = after.select("fact_id", F.struct(*names).alias("n"))
    rows = old.join(new, "fact_id", "full")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")), F.lit(c)) for c in names]))
    kind = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "deleted").when(F.size(changed) > 0, "updated")
    return rows.select("fact_id", kind.alias("change"), F.when(kind == "updated", changed).alias("attributes"), F.lit(at).alias("at")).where("change IS NOT NULL")


def distilled_stats(total: DataFrame, selected: DataFrame) -> DataFrame:
    """One row: facts in all, selected, removed, and the share removed (0 of none)."""
    row = total.agg(F.count("*").alias("total_facts")).crossJoin(selected.agg(F.count("*").alias("selected_facts")))  # one row each
    share = F.when(F.col("total_facts") == 0, 0.0).otherwise(1 - F.col("selected_facts") / F.col("total_facts"))
    return row.select("total_facts", "selected_facts", (F.col("total_facts") - F.col("selected_facts")).alias("removed_facts"), share.alias("reduction_ratio"))


def dataset_stats(records: DataFrame) -> DataFrame:
    """One row over chat records (``messages, reliability_rating``): how many, of each tier, and mean characters of what
    users and assistants say."""
    said = lambda role: F.aggregate(F.filter("messages", lambda m: m["role"] == role), F.lit(0), lambda n, m: n + F.coalesce(F.length(m["content"]), F.lit(0)))
    turns = lambda role: F.size(F.filter("messages", lambda m: m["role"] == role))
    rows = records.select("reliability_rating", *[f(r).alias(n + r) for r in ("user", "assistant") for f, n in ((said, "chars_"), (turns, "turns_"))])
    mean = lambda r: F.round(F.coalesce(F.sum(f"chars_{r}") / F.nullif(F.sum(f"turns_{r}"), F.lit(0)), F.lit(0.0)), 1).alias(f"mean_{r}_chars")
    tiers = [F.count(F.when(F.coalesce("reliability_rating", F.lit("UNVERIFIED")) == t, 1)).alias(t.lower()) for t in schema.TIERS]
    return rows.agg(F.count("*").alias("records"), *tiers, mean("user"), mean("assistant"))


def validate(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with an id and a known rating, and the others."""
    ok = F.coalesce((F.trim("fact_id") != "") & F.col("reliability_rating").isin(*schema.TIERS), F.lit(False))
    return facts.where(ok), facts.where(~ok)


def update(facts: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes`` (fact_id and any attributes, nulls for no change, one row an id) applied; quality computed anew."""
    new = [c for c in changes.columns if c != "fact_id"]
    if unknown := sorted(set(new) - set(facts.columns)):
        raise ValueError(f"no such attribute: {', '.join(unknown)}")
    joined = facts.alias("f").join(changes.alias("c"), "fact_id", "left")
    out = joined.select("fact_id", *[F.coalesce(F.col(f"c.{c}"), F.col(f"f.{c}")).alias(c) if c in new else F.col(f"f.{c}").alias(c) for c in facts.columns if c != "fact_id"])
    return out.withColumn("quality_score", quality_score()).select(facts.columns)


def delete(facts: DataFrame, ids: DataFrame) -> DataFrame:
    return facts.join(ids.select("fact_id"), "fact_id", "left_anti")


def merge(a: DataFrame, b: DataFrame, strategy: str = "higher_reliability") -> DataFrame:
    """Facts of both by id; where both have one: the higher rating's (the first's if equal), the first's or the second's."""
    if strategy not in ("higher_reliability", "keep_first", "keep_second"):
        raise ValueError(f"unknown strategy {strategy!r}")
    both = a.withColumn("__side", F.lit(1)).unionByName(b.withColumn("__side", F.lit(2)), allowMissingColumns=True)
    order = {"higher_reliability": [F.desc(schema.rank("reliability_rating")), F.asc("__side")], "keep_first": [F.asc("__side")], "keep_second": [F.desc("__side")]}[strategy]
    return both.withColumn("__n", F.row_number().over(Window.partitionBy("fact_id").orderBy(*order))).where("__n = 1").drop("__n", "__side")


def ingest(old: DataFrame, new: DataFrame, upsert: bool = True) -> DataFrame:
    """A table unique on ``block_id``: the new row replaces the old one, or is left out where there is one."""
    both = old.withColumn("__t", F.lit(0)).unionByName(new.withColumn("__t", F.lit(1)), allowMissingColumns=True)
    order = F.desc("__t") if upsert else F.asc("__t")
    return both.withColumn("__n", F.row_number().over(Window.partitionBy("block_id").orderBy(order, "fact_statement"))).where("__n = 1").drop("__n", "__t")


def demote(rows: DataFrame, flagged: Column) -> DataFrame:
    """What a critic flags becomes UNVERIFIED and of no quality."""
    return rows.withColumns({"quality_score": F.when(flagged, 0.0).otherwise(F.col("quality_score")), "reliability_rating": F.when(flagged, "UNVERIFIED").otherwise(F.col("reliability_rating"))})


def reliability_summary(facts: DataFrame) -> DataFrame:
    """``reliability_rating, n`` for all four tiers."""
    tiers = facts.sparkSession.createDataFrame([(t,) for t in schema.TIERS], "reliability_rating string")
    found = facts.groupBy("reliability_rating").agg(F.count("*").alias("n"))
    return F.broadcast(tiers).join(found, "reliability_rating", "left").select("reliability_rating", F.coalesce("n", F.lit(0)).alias("n"))


def category_summary(facts: DataFrame) -> DataFrame:
    return facts.groupBy("category").agg(F.count("*").alias("n"))


def catalog_stats(facts: DataFrame) -> DataFrame:
    """One row: facts, drops, sources and counts by tier."""
    tiers = [F.count(F.when(F.col("reliability_rating") == t, 1)).alias(t.lower()) for t in schema.TIERS]
    return facts.agg(F.count("*").alias("total_facts"), F.countDistinct("drop_id").alias("total_drops"), F.countDistinct("source").alias("sources"), *tiers)


def store_stats(drops: DataFrame) -> DataFrame:
    return drops.agg(F.count("*").alias("drops"), F.sum("num_facts").alias("facts"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def audit(facts: DataFrame) -> DataFrame:
    """One row: drops, facts, rows with a missing part, duplicate triples, counts by tier (null is UNVERIFIED)."""
    empty = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    key = F.struct(*[F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))) for c in ("subject", "predicate", "object")])
    rating = F.coalesce("reliability_rating", F.lit("UNVERIFIED"))
    missing = empty("subject") | empty("predicate") | empty("object") | empty("fact_statement")
    return facts.agg(
        F.countDistinct("drop_id").alias("drops"), F.count("*").alias("facts"), F.count(F.when(missing, 1)).alias("missing"),
        (F.count("*") - F.countDistinct(key)).alias("duplicates"), *[F.count(F.when(rating == t, 1)).alias(t.lower()) for t in schema.TIERS],
    )


def select_top(facts: DataFrame, k: int) -> DataFrame:
    """The k best by quality, then id, with their rank."""
    best = facts.orderBy(F.desc("quality_score"), "fact_id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("quality_score"), "fact_id")))  # of k rows


def promote(facts: DataFrame, min_sources: int = 2) -> DataFrame:
    """Statements of several sources below the top tier, with the next tier."""
    key = T.norm("fact_statement")
    per = facts.withColumn("statement_key", key).where("statement_key <> ''").groupBy("statement_key").agg(
        F.countDistinct("source").alias("sources"), F.max(schema.rank("reliability_rating")).alias("r"), F.max_by("fact_statement", "fact_id").alias("statement")
    )
    return per.where((F.col("sources") >= min_sources) & (F.col("r") < len(schema.TIERS))).select(
        "statement", "sources", schema.tier(F.col("r")).alias("current"), schema.tier(F.col("r") + 1).alias("proposed")
    )


def contradictions(facts: DataFrame) -> DataFrame:
    """(subject, predicate) with several objects: the objects, sorted, each with its sources."""
    rows = facts.where((T.norm("subject") != "") & (T.norm("predicate") != "") & F.col("object").isNotNull())
    per = rows.groupBy("subject", "predicate", T.norm("object").alias("object")).agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    both = per.groupBy("subject", "predicate").agg(F.array_sort(F.collect_list(F.struct("object", "sources"))).alias("o")).where(F.size("o") > 1)
    return both.select("subject", "predicate", F.size("o").alias("n_objects"), F.array_join(F.transform("o", lambda x: F.concat(x["object"], F.lit("<-"), x["sources"])), "; ").alias("objects"))


def body_hash(statement: str = "fact_statement") -> Column:
    """An aggregate that names a set of statements, repeats counted, whatever their order: of their number and two sums of
    parts of their digests. Nothing is collected, so a source may hold any number."""
    part = lambda at: F.sum(F.conv(F.substring(F.md5(F.coalesce(F.col(statement), F.lit(""))), at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return F.sha2(F.concat_ws(":", F.count("*").cast("string"), part(1), part(16)), 256)


def drop_tables(facts: DataFrame) -> DataFrame:
    """Headers of immutable drops: one for each source, named by a hash of what it holds."""
    body = facts.groupBy("source").agg(F.count("*").alias("num_facts"), body_hash().alias("source_hash"))
    return body.select(F.substring("source_hash", 1, 16).alias("drop_id"), "source", "source_hash", "num_facts")


def unseen(facts: DataFrame, seen: DataFrame) -> DataFrame:
    """First row of each statement that ``seen`` (fingerprint) doesn't hold."""
    first = facts.withColumn("fingerprint", T.norm("fact_statement")).withColumn("__n", F.row_number().over(Window.partitionBy("fingerprint").orderBy("fact_id"))).where("__n = 1").drop("__n")
    return first.join(seen.select("fingerprint"), "fingerprint", "left_anti")


def load_seen(spark: SparkSession, path: str) -> DataFrame:
    """``fingerprint`` of the facts that a table of Parquet files has, for :func:`unseen`."""
    return spark.read.parquet(path).select(T.norm("fact_statement").alias("fingerprint")).distinct()


def search(facts: DataFrame, query: str, fields: list[str]) -> DataFrame:
    """Facts by how many (term, field) hold, the whole phrase counting as all its terms once more for each field."""
    terms = query.lower().split()
    low = {f: F.lower(F.coalesce(F.col(f), F.lit(""))) for f in fields}
    score = sum((F.contains(low[f], F.lit(t)).cast("int") for f in fields for t in terms), F.lit(0)) + sum((F.contains(low[f], F.lit(query.lower())).cast("int") * len(terms) for f in fields), F.lit(0))
    return facts.withColumn("score", score).where("score > 0")


def budget(records: DataFrame, max_tokens: int, order: list, group: list[str]) -> DataFrame:
    """Greedy by rank within each group: a record is kept if what is left of the budget holds it, else skipped. Groups are
    read in order, a batch at a time, so one of any size is never held whole."""
    kinds = dict(records.dtypes)
    ranked = records.select(*group, T.token_estimate("record").alias("cost"), "record", F.struct(*order).alias("__o")).repartition(*group).sortWithinPartitions(*group, "__o").drop("__o")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, used, n = None, 0, 0
        for pdf in parts:
            keep, at = [], []
            for k, (key, cost) in enumerate(zip(zip(*[pdf[g] for g in group]), pdf["cost"])):
                key = tuple(None if pd.isna(x) else x for x in key)
                if key != now:
                    now, used, n = key, 0, 0
                if used + cost <= max_tokens:
                    keep.append(k), at.append(n)
                    used, n = used + cost, n + 1
            out = pdf.iloc[keep]
            yield out.assign(position=pd.Series(at, index=out.index, dtype="int32"))[[*group, "position", "cost", "record"]]

    return ranked.mapInPandas(run, ", ".join([*(f"`{g}` {kinds[g]}" for g in group), "position int", "cost " + dict(ranked.dtypes)["cost"], "record string"]))


def split(records: DataFrame, ratio: float, key: Column, seed: int = 42) -> DataFrame:
    """``part`` train or val by the order of a seeded hash; train has the rounded share exactly, by range sort and counts."""
    hashed = records.withColumn("__h", F.md5(F.concat_ws(":", F.lit(str(seed)), key)))
    bucket = F.conv(F.substring("__h", 1, 3), 16, 10).cast("int")
    hashed = hashed.withColumn("__b", bucket)
    counts = hashed.groupBy("__b").agg(F.count("*").alias("n"))
    before = counts.select("__b", (F.sum("n").over(Window.orderBy("__b")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))  # 4096 rows at most
    at = F.row_number().over(Window.partitionBy("__b").orderBy("__h")) + F.col("before")
    return hashed.join(F.broadcast(before), "__b").withColumn("part", F.when(at <= F.bround(F.col("total") * F.lit(float(ratio))), "train").otherwise("val")).drop("__h", "__b", "before", "total")


def chat_problem(messages: str = "messages") -> Column:
    """Why an array of (role, content) isn't a chat record; null where it is."""
    m = F.col(messages)
    return (
        F.when(m.isNull(), "no messages")
        .when(F.size(m) < 2, "too few turns")
        .when(F.exists(m, lambda x: x["role"].isNull() | x["content"].isNull()), "no role or content")
        .when(F.exists(m, lambda x: ~x["role"].isin("user", "assistant")), "invalid role")
        .when(F.exists(m, lambda x: F.trim(x["content"]) == ""), "empty content")
        .when(~F.exists(m, lambda x: x["role"] == "user") | ~F.exists(m, lambda x: x["role"] == "assistant"), "one side only")
    )


def prepare_sft(lines: DataFrame, min_reliability: str | None = None) -> DataFrame:
    """``value, problem`` of chat records in JSON lines; a record kept has no problem."""
    kinds = "messages array<struct<role: string, content: string>>, metadata struct<reliability: string>"
    rows = lines.where(F.trim("value") != "").withColumn("r", F.from_json("value", kinds)).select("value", F.col("r.messages").alias("messages"), F.coalesce("r.metadata.reliability", F.lit("UNVERIFIED")).alias("rating"))
    low = F.lit(False) if min_reliability is None else schema.rank("rating") < schema.TIERS.index(min_reliability) + 1
    return rows.select("value", F.coalesce(chat_problem(), F.when(low, "below the least rating")).alias("problem"))
