"""Vectors: stable hash embeddings, search, upserts and clustering."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as T

#: vectors that are made at once
VECTORS = 1_024


def hash_embedding(rows: DataFrame, key: str, text: str, dim: int = 384) -> DataFrame:
    """``key, embedding``: each word adds 1, 1/2 and 1/4 to three neighbouring places that its MD5 names; unit length. Texts
    without words have none. A row's words are counted where the row is, so nothing is sent or held for others."""
    place = lambda w: (F.conv(F.substring(F.md5(w), 1, 12), 16, 10).cast("long") % dim).cast("int")
    words = rows.select(key, F.transform(T.words(text), place).alias("__at")).where(F.size("__at") > 0)
    return words.select(key, spread("__at", dim).alias("embedding"))


def spread(places: str, dim: int) -> Column:
    """The unit vector of the places that words name."""

    @F.pandas_udf("array<double>")
    def run(at: pd.Series) -> pd.Series:
        row, col = np.repeat(np.arange(len(at)), np.array([len(x) for x in at], np.int64)), np.concatenate([*at, np.zeros(0, np.int64)]).astype(np.int64)
        out = []
        for begin in range(0, len(at), VECTORS):
            mine = slice(*np.searchsorted(row, [begin, begin + VECTORS]))
            n = min(VECTORS, len(at) - begin)
            x = np.zeros(n * dim)
            for i, v in enumerate((1.0, 0.5, 0.25)):
                np.add.at(x, (row[mine] - begin) * dim + (col[mine] + i) % dim, v)
            x = x.reshape(n, dim)
            out += list(x / np.linalg.norm(x, axis=1, keepdims=True))
        return pd.Series(out, dtype=object)

    return run(places)


def nearest_to(rows: DataFrame, query: list[float], k: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The k most similar rows to one vector: a partial top-k in each task, merged."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.select(key, F.round(T.cosine(column, q), 6).alias("similarity")).orderBy(F.desc("similarity"), key).limit(k)


def similar_to(rows: DataFrame, ident, k: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The k rows most similar to one of the rows, itself left out before the cut."""
    one = rows.where(F.col(key) == ident).select(F.col(column).alias("__q")).limit(1)
    return rows.where(F.col(key) != ident).crossJoin(F.broadcast(one)).select(key, F.round(T.cosine(column, "__q"), 6).alias("similarity")).orderBy(F.desc("similarity"), key).limit(k)


def upsert(index: DataFrame, new: DataFrame, key: str = "vec_id") -> DataFrame:
    return index.join(new.select(key), key, "left_anti").unionByName(new)


def remove(index: DataFrame, ids: DataFrame, key: str = "vec_id") -> DataFrame:
    return index.join(ids.select(key), key, "left_anti")


#: centres that are sent to every task
CENTRES = 4_096


def assign_clusters(rows: DataFrame, centres: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``key, cluster``: the most similar of at most ``CENTRES`` centres (``cluster, centre``)."""
    if centres.limit(CENTRES + 1).count() > CENTRES:
        raise ValueError(f"there may be {CENTRES} centres")
    pairs = rows.crossJoin(F.broadcast(centres)).select(key, "cluster", F.round(T.cosine(column, "centre"), 9).alias("s"))
    return pairs.groupBy(key).agg(F.max_by("cluster", F.struct("s", -F.col("cluster"))).alias("cluster"))


def random_centres(rows: DataFrame, k: int, seed: int = 42, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``cluster, centre``: k rows that a seeded hash picks."""
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(min(k, CENTRES)).select(F.col(key).alias("cluster"), F.col(column).alias("centre"))


def cluster_vectors(rows: DataFrame, k: int, seed: int = 42, rounds: int = 1, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``key, cluster``: each row with the most similar of k random rows; with more rounds centres become the means of
    their rows, and the cluster is a number."""
    if rounds <= 1:
        return assign_clusters(rows, random_centres(rows, k, seed, key, column), key, column)
    model = KMeans(k=k, seed=seed, maxIter=rounds, distanceMeasure="cosine", featuresCol="__v", predictionCol="cluster")
    held = rows.where(F.exists(column, lambda x: x != 0)).select(key, array_to_vector(F.col(column).cast("array<double>")).alias("__v"))  # a cosine needs a length
    return model.fit(held).transform(held).select(key, "cluster")


def mean_similarity(rows: DataFrame, label: str = "label", column: str = "embedding") -> DataFrame:
    """``label, n, cohesion``: the mean cosine of unit vectors of a label to one another, from sums alone."""
    unit = rows.select(label, F.posexplode(column).alias("i", "x"))
    sums = unit.groupBy(label, "i").agg(F.sum(F.col("x").cast("double")).alias("s"))
    per = sums.groupBy(label).agg(F.sum(F.col("s") * F.col("s")).alias("ss"))
    n = rows.groupBy(label).agg(F.count("*").alias("n"))
    return per.join(n, label).select(label, "n", F.round((F.col("ss") - F.col("n")) / (F.col("n") * (F.col("n") - 1)), 5).alias("cohesion"))


def shard_of(ident: str | Column, n: int) -> Column:
    return F.pmod(F.xxhash64(ident), F.lit(n)).cast("int")


def last_n(rows: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= n).drop("__n")
