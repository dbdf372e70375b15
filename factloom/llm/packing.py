"""Cost-balanced packing of documents into training sequences.

A document of n tokens costs ``linear * n + quadratic * n^2``. Documents are dealt to shards by a hash of their id,
as many shards as the number of documents needs; within a shard they are taken in descending order, and each goes
to the sequence of lowest cost so far that still has room for its tokens, a new sequence being opened where none
has. Only ids and token counts are shuffled.

Defined results: null and empty texts have no tokens and go to no sequence; a null id is kept and packed; a document
longer than a sequence is cut into pieces of a whole sequence and a rest, packed like documents; ties in size go by
id and piece; repeated rows are packed once each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.session import stage_table

CAPACITY, LINEAR, QUADRATIC, SHARD_ROWS = 4096, 1.0, 1.0 / 1024, 50_000
SCHEMA = "doc_id long, piece int, n_tokens int, shard int, sequence int, position int"


def word_count(text: str | Column = "text") -> Column:
    """White-space separated words: the token count where no tokenizer's counts are given."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\f\x0b]+")), F.lit(0)).cast("long")


def assign(sizes: np.ndarray, capacity: int, linear: float, quadratic: float) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and start position of each item; ``sizes`` descend and none is over ``capacity``.

    As sizes descend, a sequence found too full waits until an item fits it; so every item meets few sequences.
    """
    sequences = -(-int(sizes.sum()) // capacity)
    ready = [(0.0, s) for s in range(sequences)]
    waiting: list[tuple[int, int, float]] = []  # by most room
    used = [0] * sequences
    where, position = np.empty(len(sizes), np.int32), np.empty(len(sizes), np.int32)
    for i, n in enumerate(sizes.tolist()):
        while waiting and -waiting[0][0] >= n:
            room, s, cost = heapq.heappop(waiting)
            heapq.heappush(ready, (cost, s))
        while ready and used[ready[0][1]] + n > capacity:
            cost, s = heapq.heappop(ready)
            heapq.heappush(waiting, (used[s] - capacity, s, cost))
        if ready:
            cost, s = heapq.heappop(ready)
        else:
            cost, s = 0.0, len(used)
            used.append(0)
        where[i], position[i] = s, used[s]
        used[s] += n
        heapq.heappush(ready, (cost + linear * n + quadratic * n * n, s))
    return where, position


def pack(counts: DataFrame, capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``doc_id, piece, n_tokens, shard, sequence, position`` for ``counts`` of doc_id and n_tokens."""
    counts = counts.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_tokens").cast("long").alias("n_tokens"), F.monotonically_increasing_id().alias("row")).where("n_tokens > 0")
    counts, _ = stage_table(counts, "counts")
    shards = max(1, -(-counts.count() // shard_rows))
    hot, _ = stage_table(counts.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > shard_rows).select(F.col("doc_id").alias("hot")), "hot-ids")
    by = F.xxhash64("doc_id")
    if not hot.isEmpty():  # rows of an id, or of none, that would overfill a shard go by row
        marked = counts.join(hot.withColumn("spread", F.lit(True)), F.col("doc_id").eqNullSafe(F.col("hot")), "left").drop("hot")
        counts, by = marked, F.when(F.col("spread"), F.xxhash64("doc_id", "row")).otherwise(by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        pdf["sequence"], pdf["position"] = assign(pdf["n_tokens"].to_numpy(), capacity, linear, quadratic)
        return pdf[["doc_id", "piece", "n_tokens", "shard", "sequence", "position"]]

    pieces = F.transform(F.sequence(F.lit(0), F.expr(f"cast((n_tokens - 1) div {capacity} as int)")), lambda k: F.least(F.lit(capacity), F.col("n_tokens") - k * capacity).cast("int"))
    items = counts.select("doc_id", F.posexplode(pieces).alias("piece", "n_tokens"), F.pmod(by, F.lit(shards)).cast("int").alias("shard"))
    return items.groupBy("shard").applyInPandas(run, SCHEMA)


def pack_documents(docs: DataFrame, **options) -> DataFrame:
    return pack(docs.select("doc_id", word_count().alias("n_tokens")), **options)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
