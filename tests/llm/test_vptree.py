import numpy as np
import pytest

from factloom.llm import vptree as V


def brute(ids, x, k):
    d = V.distances(x, x)
    d[ids[:, None] == ids] = np.inf
    out = {}
    for i, row in zip(ids, d):
        best = sorted((s, j) for s, j in zip(row, ids) if np.isfinite(s))[:k]
        out[int(i)] = [(int(j), float(s)) for s, j in best]
    return out


def result(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.vec_id, r.rank)):
        out.setdefault(r.vec_id, []).append((r.neighbour, r.distance))
    return out


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_tree_is_exact_at_factor_one(spread):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8))
    x = centres[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 8)) * spread
    x[100:140] = x[7]  # ties
    ids = rng.permutation(1500).astype(np.int64)
    tree = V.Tree(ids, x, leaf=20)
    got = tree.search(tree.ids, tree.x, 6, 1.0)
    want = brute(ids, x, 6)
    for i, name, d in zip(tree.ids, got[1], got[0]):
        assert [(int(a), float(b)) for a, b in zip(name, d)] == want[int(i)]


def test_shards_and_groups_are_exact_at_factor_one(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 5)) + rng.integers(0, 4, 400)[:, None] * 3
    df = spark.createDataFrame([(int(i), [float(v) for v in row], "a") for i, row in enumerate(x)], "vec_id long, embedding array<double>, cell string")
    got = result(V.nearest(df, k=5, factor=1.0, shard_rows=60, group_rows=150, pivots=4).collect())
    assert got == brute(np.arange(400), x, 5)


def test_recall_of_the_default(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    pdf = df.toPandas()
    want = brute(pdf["vec_id"].to_numpy(), np.stack(pdf["embedding"]).astype(float), V.K)
    got = result(V.nearest(df, shard_rows=100).collect())
    recall = np.mean([len({n for n, _ in got[i]} & {n for n, _ in want[i]}) / V.K for i in want])
    assert recall >= 0.9


@pytest.mark.parametrize("kind", ["flat4", "flat8", "flat16", "clusters", "long8"])
def test_recall_of_the_default_on_structure(kind):
    rng = np.random.default_rng(8)
    n = 4096
    if kind == "clusters":
        x = rng.normal(size=(40, 64))[rng.integers(0, 40, n)] + rng.normal(size=(n, 64)) * 0.1
    else:
        d = int(kind.strip("flatong"))
        x = rng.normal(size=(n, d)) @ rng.normal(size=(d, 64))
    if kind != "long8":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = V.Tree(np.arange(n), x)
    got = tree.search(tree.ids, tree.x, V.K, V.FACTOR)[1]
    want = tree.search(tree.ids, tree.x, V.K, 1.0)[1]
    assert np.mean([len({*a} & {*b}) / V.K for a, b in zip(got, want)]) >= 0.95


def test_recall_of_the_default_over_shards(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1200, 4)) @ rng.normal(size=(4, 32))
    df = spark.createDataFrame([(i, row) for i, row in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got, want = result(V.nearest(df, shard_rows=150).collect()), brute(np.arange(1200), x, V.K)
    assert np.mean([len({n for n, _ in got[i]} & {n for n, _ in want[i]}) / V.K for i in want]) >= 0.95


@pytest.mark.parametrize("offset", [1e6, 1e9])
def test_vectors_far_from_the_origin_are_exact_at_factor_one(spark, offset):
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(300, 6)), 3) + offset
    x[50:60] = x[3]
    df = spark.createDataFrame([(i, row) for i, row in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = result(V.nearest(df, k=5, factor=1.0, shard_rows=60, group_rows=50, pivots=4).collect())
    assert got == brute(np.arange(300), x, 5)


def test_chosen_queries_meet_all_rows(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(500, 4))
    df = spark.createDataFrame([(i, row, 1, 2, 3, 4.0) for i, row in enumerate(x.tolist())], "vec_id long, embedding array<double>, cell int, part int, `a.b` int, tau double")
    got = result(V.nearest(df, "vec_id % 50 = 0", k=4, factor=1.0, shard_rows=70, group_rows=3, pivots=3).collect())
    assert got == {i: v for i, v in brute(np.arange(500), x, 4).items() if i % 50 == 0}
    assert V.nearest(df, "vec_id < 0").count() == 0


def test_trees_go_only_where_queries_do(spark):
    trees = spark.createDataFrame([(c, p, b"t") for c in range(5) for p in range(3)], "cell int, part int, tree binary")
    requests = spark.createDataFrame([(1, 2, i, [0.0], 1.0) for i in range(95)] + [(4, 0, 7, [0.0], 1.0)], V.REQUEST)
    met, sent = V.grouped(trees, requests, 10)
    assert met.count() == 96 and sent.count() == 11
    assert met.join(sent, ["cell", "part", "bunch"]).count() == 96


def test_defined_results(spark):
    schema = "vec_id long, embedding array<double>"
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (None, [1.0, 1.0]), (3, None), (4, [float("nan"), 1.0]), (5, [1.0]), (6, [0.0, 1.0]), (7, [float("inf"), 0.0]), (8, [None, 1.0]), (9, [])]
    got = result(V.nearest(spark.createDataFrame(rows, schema)).collect())
    assert got == {1: [(2, 0.0), (6, 1.414214)], 2: [(1, 0.0), (6, 1.414214)], 6: [(1, 1.414214), (2, 1.414214)]}
    huge = [(i, [float(i), 1.0]) for i in range(30)] + [(40, [1e160, 1.0]), (41, [-1e99, 0.0]), (42, [1e99, 0.0])]
    got = result(V.nearest(spark.createDataFrame(huge, schema), factor=1.0).collect())
    assert len(got) == 32 and 40 not in got and all(len(v) == 10 for v in got.values()) and got[0][0] == (1, 1.0)
    assert V.nearest(spark.createDataFrame([], schema)).count() == 0
    assert V.nearest(spark.createDataFrame([(1, [0.0, 0.0])], schema)).count() == 0
    with pytest.raises(ValueError):
        V.nearest(spark.createDataFrame([], schema), factor=0.5)
