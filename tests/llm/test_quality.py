import itertools

import numpy as np

from factloom.llm import quality as Q

DOCS = "doc_id long, text string, quality int, keep string"


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    row = np.array([0] * 1 + [1] * 5 + [2] * 7 + [5] * 3)
    scores, t = rng.normal(size=(len(row), 2)) * 2, rng.normal(size=(2, 2))
    good, pairs, logz = Q.marginals(scores, t, row)
    want, total, both = np.zeros(len(row)), 0.0, np.zeros((2, 2))
    for r in np.unique(row):
        at = np.flatnonzero(row == r)
        weights = {y: np.exp(sum(scores[i, v] for i, v in zip(at, y)) + sum(t[a, b] for a, b in zip(y, y[1:]))) for y in itertools.product((0, 1), repeat=len(at))}
        z = sum(weights.values())
        total += np.log(z)
        for y, w in weights.items():
            want[at] += np.array(y) * w / z
            for a, b in zip(y, y[1:]):
                both[a, b] += w / z
    assert np.allclose(good, want) and np.allclose(pairs, both) and np.isclose(logz, total)


def test_lines_differ_from_their_document_only_plainly():
    good = np.array([0.95, 0.4, 0.05, 0.99, 0.97, 0.02, 0.5])
    row, label = np.array([0, 0, 0, 1, 1, 2, 3]), np.array([1, 1, 1, 0, 0, 1, 0])
    assert Q.line_labels(good, row, label).tolist() == [1, 1, 0, 1, 0, 1, 0]
    assert Q.line_labels(np.zeros(0), np.zeros(0, int), np.zeros(0, int)).tolist() == []


def brute_features(text):
    """Features of every line, by string operations."""
    lines = [x for x in text.replace("\r", "\n").split("\n") if x]
    out = []
    for line in lines:
        words = line.split()
        n = len(line)
        share = lambda chars: sum(c in chars for c in line)  # noqa: B023, E731
        again = sum(a == b for a, b in zip(words, words[1:]))
        k = max(len(words), 1)
        letters = sum(c.isascii() and c.isalpha() or ord(c) >= 192 for c in line)
        out.append(
            [
                share("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / n,
                share("0123456789") / n,
                min(share("#$%&*@^~<>{}[]\\=+_/") / k, 3),
                min(share("|!") / k, 3),
                letters / n,
                again / k,
                (len(words) - len(set(words))) / k * min(k / 20, 1),
                min(sum(len(w.encode()) for w in words) / k, 20) / 10,
                np.log1p(n) / 5,
                line[-1] in ".!?\"')",
                1,
            ]
        )
    return np.array(out, float).reshape(-1, Q.FEATURES), [len(x) for x in lines]


def test_features_and_documents_equal_brute_force(spark):
    texts = ["One line.\nTWO words here, two two!\n\n| a | b |", "étude de l'âme\r\nfin", "#### 1234 $$ x", "", "a", "word word word " * 30 + "\nend"]
    rng = np.random.default_rng(3)
    w, t = rng.normal(size=3 * Q.FEATURES), rng.normal(size=(2, 2))
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in Q.classify(df, w, t).collect()}
    for i, text in enumerate(texts):
        x, sizes = brute_features(text)
        n = len(x)
        if not n:
            assert (got[i].quality, got[i].keep, got[i].n_lines) == (0, 0, 0)
            continue
        pad = np.zeros((1, Q.FEATURES))
        full = np.concatenate([x, np.concatenate([pad, x[:-1]]), np.concatenate([x[1:], pad])], 1) @ w
        good, z = np.zeros(n), 0.0
        for y in itertools.product((0, 1), repeat=n):
            p = np.exp(sum(f for f, v in zip(full, y) if v) + sum(t[a, b] for a, b in zip(y, y[1:])))
            z, good = z + p, good + p * np.array(y)
        assert np.isclose(got[i].quality, np.average(good / z, weights=sizes), atol=2e-6), text
        assert got[i].n_good == (good / z >= 0.5).sum() and got[i].keep == (got[i].quality >= Q.THRESHOLD)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    model = Q.learn(docs, labels.where("doc_id % 2 = 0"))
    known = {r.doc_id: r.quality for r in labels.where("doc_id % 2 = 1").collect()}
    rows = [r for r in Q.classify(docs, *model).collect() if r.doc_id in known]
    assert np.mean([r.keep == known[r.doc_id] for r in rows]) > 0.95
    assert model[1].std() > 0.1  # neighbouring labels are coupled


def test_defined_results(spark):
    docs = [(1, "A good line of text stands here.\nAnd one more."), (1, "A good line of text stands here.\nAnd one more."), (2, None), (3, ""), (4, "\n\r\n"), (None, "one"), (6, "#### $$$$ 1234\n||||"), (5, "#### $$$$ |||| 1234\n" * 20_000)]
    df = spark.createDataFrame([(*d, 7, "x") for d in docs], DOCS)
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 0), (None, 1, 0), (2, None, 1)], "doc_id long, quality int, toxic int")
    rows = Q.classify(df, *Q.learn(df, labels)).collect()
    assert len(rows) == 8 and {r.quality for r in rows if r.doc_id in (2, 3, 4)} == {0.0}
    assert all(r.keep == 0 for r in rows if r.doc_id in (2, 3, 4, 5)) and next(r for r in rows if r.doc_id == 5).n_lines == 20_000
    assert all(r.keep == 1 for r in rows if r.doc_id == 1)
    none = Q.classify(df, *Q.learn(df, labels.limit(0))).collect()
    assert all(r.keep == 1 for r in none if r.n_lines) and all(r.n_good == r.n_lines for r in none)
    assert Q.classify(df.limit(0), *Q.learn(df.limit(0), labels)).count() == 0
