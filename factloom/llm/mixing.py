"""Mixing sources to target weights.

Every document of a source gets a hash-random key for each epoch; within a source, documents are in the order of
(epoch, key), and token counts are summed along it until the source's exact budget: the document at the cut gives
only the tokens that are still missing. A source whose budget exceeds its tokens repeats in further epochs.

The order is a range sort by (source, slice of the key space): a source has as many slices as its rows need, so a
hot source is spread over tasks. Slice totals (few rows) are summed over a source's slices first, and running sums
within a slice start from there. Whole epochs before the last need no order at all.

Defined results: documents of null text, or without tokens, are not mixed; a null source is a source of its own; a
document without id is keyed like the others; repeated rows of an id are ordered by token count and count each;
rows that agree in id, source and token count are taken in the order of their text and then of a hash of all columns; a
text of any length is counted and cut whole; a source of weight zero, or not among given weights, gives nothing; an empty
table gives an empty result; extra columns, whatever their names, are kept by :func:`mix_documents` and ignored by
:func:`mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.blocks import fresh_name, quoted
from factloom.llm.packing import word_count
from factloom.session import stage_table

SEED, EXPONENT, SLICE_ROWS = 17, 0.5, 100_000


def budgets(counts: DataFrame, weights: dict[str | None, float] | None = None, total: int | None = None, exponent: float = EXPONENT) -> DataFrame:
    """``source, rows, tokens, budget``. Weights are given, or the sources' token shares to the power ``exponent``;
    the total is given, or that of all tokens."""
    per = counts.groupBy("source").agg(F.count("*").alias("rows"), F.sum("n_tokens").alias("tokens"))
    if weights is None:
        per = per.withColumn("weight", F.pow(F.col("tokens").cast("double"), F.lit(float(exponent))))
    else:
        chosen = counts.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "name string, weight double")
        per = per.join(F.broadcast(chosen), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    whole = Window.partitionBy(F.lit(1))  # one row for each source
    goal = F.sum("tokens").over(whole) if total is None else F.lit(int(total))
    share = F.round(F.col("weight") / F.sum("weight").over(whole), 9)
    return per.select("source", "rows", "tokens", F.floor(share * goal).cast("long").alias("budget")).where("tokens > 0 AND budget > 0")


def mix(counts: DataFrame, weights: dict[str | None, float] | None = None, total: int | None = None, exponent: float = EXPONENT, seed: int = SEED, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``doc_id, source, epoch, n_tokens, taken`` for ``counts`` of doc_id, source and n_tokens: one row for each
    time that a document is taken, with the tokens taken."""
    counts = counts.select("doc_id", F.col("source").cast("string").alias("source"), F.col("n_tokens").cast("long").alias("n_tokens")).where("n_tokens > 0")
    counts, _ = stage_table(counts, "counts")
    plan = budgets(counts, weights, total, exponent).select(
        F.col("source").alias("p_source"),
        F.expr("budget div tokens").alias("full"),
        (F.col("budget") % F.col("tokens")).alias("rest"),
        F.ceil(F.col("rows") / slice_rows).cast("long").alias("slices"),
    )
    planned = counts.join(plan, F.col("source").eqNullSafe(F.col("p_source")))
    whole = planned.where("full > 0").select("doc_id", "source", F.explode(F.sequence(F.lit(0), (F.col("full") - 1).cast("int"))).alias("epoch"), "n_tokens", F.col("n_tokens").alias("taken"))
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("full").cast("string"), F.lit(str(seed))))
    last = planned.where("rest > 0").withColumn("key", key)
    last = last.withColumn("slice", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / float(1 << 32) * F.col("slices")).cast("long"))
    totals = last.groupBy("source", "slice").agg(F.sum("n_tokens").alias("sum"))
    before = totals.select(
        F.col("source").alias("s_source"), F.col("slice").alias("s_slice"), (F.sum("sum").over(Window.partitionBy("source").orderBy("slice")) - F.col("sum")).alias("start")
    )
    # slices that begin at or past the budget aren't sorted
    last = last.join(before, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("slice") == F.col("s_slice"))).where("start < rest")
    running = F.sum("n_tokens").over(Window.partitionBy("source", "slice").orderBy("key", "n_tokens").rowsBetween(Window.unboundedPreceding, 0))
    last = last.withColumn("ahead", F.col("start") + running - F.col("n_tokens")).where("ahead < rest")
    cut = last.select("doc_id", "source", F.col("full").cast("int").alias("epoch"), "n_tokens", F.least(F.col("n_tokens"), F.col("rest") - F.col("ahead")).alias("taken"))
    return whole.unionByName(cut)


def first_words(text: str, n: str) -> Column:
    """The first ``n`` words of a text and what stands before them."""
    white = r"[ \t\n\r\f\x0b]"
    words = F.regexp_extract_all(text, F.lit(rf"{white}*[^{white[1:]}+"), F.lit(0))
    return F.array_join(F.slice(words, 1, F.col(n).cast("int")), "")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mixture takes them, the one at each cut shortened; columns as in ``docs``."""
    key, n, of, count, cut = (fresh_name(docs, "__" + x) for x in ("key", "n", "of", "whole", "cut"))
    same = Window.partitionBy(key)
    keyed = docs.withColumn(key, F.struct(F.col("doc_id").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("n_tokens")))
    taken = mix(keyed.select(f"{key}.*"), **options).withColumn(key, F.struct("doc_id", "source", "n_tokens"))
    whole = F.col("taken") == F.col("n_tokens")
    chosen = taken.groupBy(key).agg(F.count(F.when(whole, 1)).alias(count), F.max(F.when(~whole, F.col("taken"))).alias(cut))
    # rows that agree in all of the key share what was taken of it, by their text and then by all their columns
    order = F.row_number().over(same.orderBy("text", F.xxhash64(*[F.col(c) for c in hashable(docs)])))
    numbered = keyed.withColumns({n: order, of: F.count("*").over(same)}).join(chosen, key)
    times = F.expr(f"cast({count} div {of} + if({n} <= {count} % {of}, 1, 0) as int)")
    shortened = F.col(n) == F.expr(f"{count} % {of} + 1")
    kept = F.concat(F.array_repeat(F.lit(None).cast("long"), times), F.when(shortened & F.col(cut).isNotNull(), F.array(cut)).otherwise(F.expr("cast(array() as array<bigint>)")))
    rows = numbered.withColumn(cut, F.explode(kept))
    out = {"text": F.when(F.col(cut).isNull(), F.col("text")).otherwise(first_words("text", cut))}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col(cut).isNull(), F.col("n_chars")).otherwise(F.length(first_words("text", cut)).cast("long"))
    return rows.select(*[out[c].alias(c) if c in out else F.col(q) for c, q in zip(docs.columns, quoted(docs.columns))])


def hashable(docs: DataFrame) -> list[str]:
    """The columns that a hash can tell apart (maps, and what holds them, can't be hashed)."""
    return [q for q, f in zip(quoted(docs.columns), docs.schema.fields) if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs.select("doc_id", "source", word_count().alias("n_tokens")))


SQL = f"""
WITH c AS (SELECT doc_id, source, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0b]+')) AS n_tokens FROM documents),
d AS (SELECT * FROM c WHERE n_tokens > 0),
p AS (SELECT source, sum(n_tokens)::BIGINT AS tokens, pow(sum(n_tokens)::DOUBLE, {EXPONENT}) AS weight FROM d GROUP BY source),
b AS (SELECT source, tokens, floor(round(weight / (SELECT sum(weight) FROM p), 9) * (SELECT sum(tokens) FROM p))::BIGINT AS budget FROM p),
q AS (SELECT source, tokens, budget // tokens AS whole, budget % tokens AS rest FROM b WHERE budget > 0),
e AS (SELECT d.doc_id, d.source, d.n_tokens, q.whole, q.rest, md5(concat_ws(':', coalesce(d.doc_id::VARCHAR, '-'), q.whole::VARCHAR, '{SEED}')) AS k
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
r AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY k, n_tokens ROWS UNBOUNDED PRECEDING) - n_tokens AS ahead FROM e)
SELECT doc_id, source, u.epoch::INTEGER AS epoch, n_tokens::BIGINT AS n_tokens, n_tokens::BIGINT AS taken
FROM e, LATERAL (SELECT unnest(range(0, whole)) AS epoch) u
UNION ALL
SELECT doc_id, source, whole::INTEGER, n_tokens::BIGINT, least(n_tokens, rest - ahead)::BIGINT FROM r WHERE ahead < rest
"""
