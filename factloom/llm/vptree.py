"""Approximate nearest neighbours by vantage-point trees, one for each shard.

Vectors are put into cells by the nearest of a bounded number of pivots and each cell into shards of at most about
``SHARD_ROWS`` vectors. A shard's tree splits its vectors at the median distance from a vantage point, again and
again, and keeps for both halves the least and greatest distance from it. By the triangle inequality nothing in a
half is nearer to a query than the gap between the query's distance and that range; a half is skipped where the gap
times ``factor`` exceeds the distance of the k-th neighbour found so far. Factor 1 is exact search; a greater one
trusts the gap to understate, which it does the more, the more dimensions there are.

The queries are those rows that ``asked`` picks (the registered query: every id divisible by ``EVERY``) and are met with
all rows. Each is answered in its own shard first; with the distance so found, whole cells are skipped by the same bound,
and it goes to the shards of the others. A tree is sent only where queries came to it, once for each ``GROUP_ROWS`` of
them, so a task holds one shard and one group, and what is shuffled follows the vectors and the routed queries.

Distances are differences of coordinates: the faster expansion of the square, about the shard's own centre, only picks
what may be near enough, with an allowance for its rounding, so vectors far from the origin lose no digit.

Defined results: rows of null id, of null vector, with a null, not-a-number or infinite component or one beyond
``LARGEST``, or of another dimension than most rows (of equally common ones the smallest) are neither queries nor
neighbours; of repeated rows of an id one counts (the least vector); distances are rounded to six places and ties go to
the smaller id; where there are fewer than k others all are returned; an empty table, or one without queries, gives an
empty result; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.session import drop_path, stage_table

K, FACTOR, SHARD_ROWS, GROUP_ROWS, PIVOTS, LEAF, EVERY = 10, 2.0, 8192, 16_384, 256, 128, 50
LARGEST = 1e100  # of a component: its square and the sum of squares are still numbers
REQUEST = "cell int, part int, vec_id long, v array<double>, tau double"


class Tree:
    """A vantage-point tree over rows of ``x``; ``order`` has the rows, a node is a range of it."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF) -> None:
        self.nodes: list[tuple] = []
        order = np.argsort(ids, kind="stable")
        stack = [(order, None, 0)]
        parts: list[np.ndarray] = []
        at = 0
        while stack:
            own, parent, side = stack.pop()
            me = len(self.nodes)
            if parent is not None:
                self.nodes[parent][1 + side] = me
            if len(own) > leaf:
                v = x[own[np.argmax(apart(x[own], x[own[0]]))]]  # a point at the rim splits best
                d = apart(x[own], v)
                by = np.argsort(d, kind="stable")
                half = len(own) // 2
                if d[by[0]] < d[by[-1]]:
                    near, far = by[:half], by[half:]
                    self.nodes.append([v, -1, -1, (d[near[0]], d[near[-1]]), (d[far[0]], d[far[-1]])])
                    stack += [(own[far], me, 1), (own[near], me, 0)]
                    continue
            self.nodes.append([None, at, at + len(own)])
            parts.append(own)
            at += len(own)
        rows = np.concatenate(parts) if parts else order
        self.ids, self.x = ids[rows], x[rows]

    def search(self, ids: np.ndarray, q: np.ndarray, k: int, factor: float, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each query its up to k nearest (distance, id) other than itself, at most ``limit`` away; padded with inf and -1."""
        best = np.full((len(q), k), np.inf), np.full((len(q), k), -1, np.int64)
        tau = np.full(len(q), np.inf) if limit is None else limit.copy()
        todo: list[tuple[int, np.ndarray, np.ndarray | None]] = [(0, np.arange(len(q)), None)]
        while todo:
            node, who, gap = todo.pop()
            if gap is not None:
                keep = gap * factor <= tau[who]
                who = who[keep]
            if not len(who):
                continue
            v, a, b, *ranges = self.nodes[node]
            if v is None:
                self._leaf(a, b, who, ids, q, k, best, tau)
                continue
            d = apart(q[who], v)
            gaps = [gap_between(d, low, high) for low, high in ranges]
            inner = gaps[0] <= gaps[1]
            # last in, first out: each query's likelier half is searched before the other
            todo.append((a, who[~inner], gaps[0][~inner]))
            todo.append((b, who[inner], gaps[1][inner]))
            todo.append((b, who[~inner], gaps[1][~inner]))
            todo.append((a, who[inner], gaps[0][inner]))
        return best

    def _leaf(self, a: int, b: int, who: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int, best: tuple, tau: np.ndarray) -> None:
        x, names = self.x[a:b], self.ids[a:b]
        centre = x.mean(0)
        for s in range(0, len(who), 512):
            w = who[s : s + 512]
            i, j = np.nonzero(near_enough(q[w] - centre, x - centre, tau[w]) & (ids[w][:, None] != names))
            if not len(i):
                continue
            exact = np.round(apart(q[w[i]], x[j]), 6)
            d = np.full((len(w), b - a), np.inf)
            d[i, j] = np.where(exact <= tau[w[i]], exact, np.inf)
            some = np.flatnonzero(np.isfinite(d).any(1))
            if not len(some):
                continue
            w, d = w[some], d[some]
            cand = np.concatenate([best[0][w], d], 1)
            name = np.concatenate([best[1][w], np.broadcast_to(names, d.shape)], 1)
            top = np.lexsort((name, cand), axis=1)[:, :k]
            best[0][w], best[1][w] = np.take_along_axis(cand, top, 1), np.take_along_axis(name, top, 1)
            tau[w] = np.minimum(tau[w], best[0][w, k - 1])


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of the rows of ``x`` from ``y`` (one vector, or one for each)."""
    d = x - y
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def gap_between(d: np.ndarray, low: float, high: float) -> np.ndarray:
    """How far at least a point is from those whose distance from a vantage point is in a range, rounding allowed for."""
    return np.maximum(0, np.maximum(d - high, low - d) - 2e-6 - 1e-12 * (d + high))


def near_enough(q: np.ndarray, x: np.ndarray, tau: np.ndarray) -> np.ndarray:
    """Which pairs may be within ``tau``, by the expanded square; none that is gets lost to rounding."""
    sizes = np.einsum("ij,ij->i", q, q)[:, None] + np.einsum("ij,ij->i", x, x)
    return sizes * (1 - 1e-15 * (x.shape[1] + 8)) - 2 * (q @ x.T) <= ((tau + 2e-6) * (1 + 1e-12))[:, None] ** 2


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of every row of ``a`` from every row of ``b``, rounded so that equal ones are equal."""
    return np.round(np.stack([apart(a, y) for y in b], 1), 6) if len(b) else np.zeros((len(a), 0))


def vectors(table: DataFrame) -> DataFrame:
    """``vec_id, v``: the rows that take part, doubles of one dimension."""
    clean = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(
        f"vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) <= {LARGEST})"
    )
    common = clean.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1)
    return clean.join(F.broadcast(common), F.size("v") == F.col("dim")).groupBy("vec_id").agg(F.min("v").alias("v"))


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def matrix_of(pdf: pd.DataFrame) -> np.ndarray:
    return matrix(pdf["v"]) if len(pdf) else np.zeros((0, 1))


def grouped(trees: DataFrame, requests: DataFrame, group_rows: int) -> tuple[DataFrame, DataFrame]:
    """Requests by shard and ``bunch`` of about ``group_rows``, and for each of these bunches, no others, its tree."""
    sizes = requests.groupBy("cell", "part").agg(F.ceil(F.count("*") / group_rows).alias("bunches"))
    met = requests.join(sizes, ["cell", "part"]).withColumn("bunch", F.pmod(F.xxhash64("vec_id", F.lit(9)), "bunches"))
    sent = trees.join(sizes, ["cell", "part"]).withColumn("bunch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bunches") - 1)))
    return met.drop("bunches"), sent.drop("bunches")


def probe(trees: DataFrame, requests: DataFrame, k: int, factor: float, group_rows: int) -> DataFrame:
    """``vec_id, neighbour, distance``: what each request finds in the one shard that it names, within its ``tau``."""

    def search(key: tuple, asked: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(stored):
            return pd.DataFrame({"vec_id": np.zeros(0, np.int64), "neighbour": np.zeros(0, np.int64), "distance": np.zeros(0)})
        tree, ids = pickle.loads(stored["tree"].iloc[0]), asked["vec_id"].to_numpy()
        best = tree.search(ids, matrix(asked["v"]), k, factor, asked["tau"].to_numpy())
        at = np.isfinite(best[0])
        return pd.DataFrame({"vec_id": np.repeat(ids, at.sum(1)), "neighbour": best[1][at], "distance": best[0][at]})

    keys = ["cell", "part", "bunch"]
    met, sent = grouped(trees, requests, group_rows)
    return met.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(search, "vec_id long, neighbour long, distance double")


def nearest(table: DataFrame, asked: str | Column = "true", k: int = K, factor: float = FACTOR, shard_rows: int = SHARD_ROWS, group_rows: int = GROUP_ROWS, pivots: int = PIVOTS) -> DataFrame:
    """``vec_id, rank, neighbour, distance``: the k nearest others of each row for whose ``vec_id`` ``asked`` holds."""
    if k < 1 or factor < 1:
        raise ValueError("k and factor must be 1 at least")
    spark = table.sparkSession
    clean, clean_at = stage_table(vectors(table), "vectors")
    total = clean.count()
    # at most ``pivots`` vectors, whatever the size of the table
    chosen = clean.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, min(pivots, -(-total // shard_rows)))).toPandas()
    centres = spark.sparkContext.broadcast(matrix_of(chosen))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x, middle = matrix(pdf["v"]), centres.value.mean(0)
                around = centres.value - middle
                sizes = np.einsum("ij,ij->i", around, around)
                cell = (sizes - 2 * ((x - middle) @ around.T)).argmin(1)
                yield pdf.assign(cell=cell.astype(np.int32), far=apart(x, centres.value[cell]))

    placed, placed_at = stage_table(clean.mapInPandas(place, "vec_id long, v array<double>, cell int, far double"), "placed")
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).toPandas().sort_values("cell")  # one row a pivot
    shards = {int(c): -(-int(n) // shard_rows) for c, n in zip(cells["cell"], cells["n"])}
    radius = {int(c): float(r) for c, r in zip(cells["cell"], cells["radius"])}
    sizes = F.create_map(*[F.lit(x) for c, n in shards.items() for x in (c, n)]) if shards else F.lit(None).cast("map<int,int>")
    sharded = placed.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(5)), sizes[F.col("cell")]).cast("int"))

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(pdf["vec_id"].to_numpy(), matrix(pdf["v"]))
        return pd.DataFrame({"cell": [key[0]], "part": [key[1]], "tree": [pickle.dumps(tree, 5)]})

    trees, trees_at = stage_table(sharded.select("cell", "part", "vec_id", "v").groupBy("cell", "part").applyInPandas(build, "cell int, part int, tree binary"), "trees")
    queries = sharded.where(asked).select("cell", "part", "vec_id", "v", F.lit(float("inf")).alias("tau"))
    home, home_at = stage_table(probe(trees, queries, k, factor, group_rows), "home")
    kth = home.groupBy("vec_id").agg(F.max("distance").alias("most"), F.count("*").alias("n")).select("vec_id", F.when(F.col("n") >= k, F.col("most")).otherwise(float("inf")).alias("tau"))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x, own, part, tau = matrix(pdf["v"]), pdf["cell"].to_numpy(), pdf["part"].to_numpy(), pdf["tau"].to_numpy()
            for cell, parts in shards.items():
                gap = gap_between(apart(x, centres.value[cell]), 0.0, radius[cell])
                go = np.flatnonzero((own == cell) | (gap * factor <= tau))
                for p in range(parts):
                    to = go[(own[go] != cell) | (part[go] != p)]
                    if len(to):
                        yield pdf.iloc[to].assign(cell=np.int32(cell), part=np.int32(p))

    asked_again = queries.drop("tau").join(kth, "vec_id", "left").select("cell", "part", "vec_id", "v", F.coalesce("tau", F.lit(float("inf"))).alias("tau"))
    routed, routed_at = stage_table(asked_again.mapInPandas(route, REQUEST), "routed")
    found = home.unionByName(probe(trees, routed, k, factor, group_rows))
    ranked = found.groupBy("vec_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "neighbour"))), 1, k).alias("near"))
    result, _ = stage_table(ranked.select("vec_id", F.posexplode("near").alias("rank", "e")).select("vec_id", (F.col("rank") + 1).alias("rank"), "e.neighbour", "e.distance"), "neighbours")
    drop_path(spark, clean_at, placed_at, trees_at, home_at, routed_at)
    return result


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % EVERY == 0)


SQL = f"""
WITH v AS (SELECT vec_id, min(embedding::DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL GROUP BY vec_id),
d AS (SELECT a.vec_id, b.vec_id AS neighbour, round(list_distance(a.v, b.v), 6) AS distance FROM v a JOIN v b ON a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour) AS rank FROM d)
SELECT vec_id, rank::INTEGER AS rank, neighbour, distance FROM r WHERE rank <= {K}
"""
