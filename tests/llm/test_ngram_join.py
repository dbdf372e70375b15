import random
import re

import numpy as np

from factloom.llm import ngram_join as J


def grams(text, n=J.N):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def brute(docs, threshold=J.THRESHOLD):
    sets = {i: grams(t) for i, t in docs if i is not None and grams(t)}
    ids = sorted(sets)
    return {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def brute_classes(docs):
    pairs = brute(docs)
    ids = sorted({i for i, _ in docs if i is not None})
    group = {i: i for i in ids}
    for a, b in sorted(pairs):
        low, high = sorted((group[a], group[b]))
        group = {k: low if v == high else v for k, v in group.items()}
    return {i: (group[i], sum(i in p for p in pairs)) for i in ids}


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["und", "große", "é"]
    docs = []
    for i in range(160):
        if i and r.random() < 0.6:
            w = r.choice(docs)[1].split()
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                w[r.randrange(len(w))] = r.choice(words)
        else:
            w = [r.choice(words) for _ in range(r.choice([1, 2, 3, 8, 40, 300]))]
        docs.append((i, " ".join(w)))
    return docs


def test_pairs_equal_brute_force(spark):
    for seed in (1, 2):
        docs = corpus(seed)
        pairs = J.ngram_pairs(spark.createDataFrame(docs, "doc_id long, text string"))
        full = {(r.doc_a, r.doc_b): round(r.jaccard, 6) for r in J.expand_pairs(pairs).collect()}
        want = brute(docs)
        assert set(full) <= set(want) and all(full[k] == want[k] for k in full)
        assert len(full) >= 0.99 * len(want)


def test_classes_equal_brute_force(spark):
    docs = corpus(3) + [(500, None), (501, "..."), (None, "a b c")]
    got = {r.doc_id: (r.class_id, r.links) for r in J.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_classes(docs) and max(n for _, n in got.values()) > 2


def test_pairs_at_the_threshold_that_share_no_minhash_are_found(spark):
    # the 12 permutations that candidates once met under part each of these pairs, whose Jaccard is exactly 0.5
    docs = [t for k in (6387, 12988) for t in (f"a{k} b{k} c{k} d{k}", f"a{k} b{k} c{k}")]
    words = [f"x3147y{i}" for i in range(22)]
    docs = list(enumerate([*docs, " ".join(words), " ".join(words[:12])]))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(r.doc_a, r.doc_b) for r in J.ngram_pairs(df).collect()} == set(brute(docs)) == {(0, 1), (2, 3), (4, 5)}
    assert {r.doc_id: (r.class_id, r.links) for r in J.classes(df).collect()} == brute_classes(docs)
    assert sorted(r.doc_id for r in J.keep_one(df).collect()) == [0, 2, 4]


def test_no_pair_is_lost_whatever_the_blocks(spark, monkeypatch):
    # where more than two sets meet a tree is built, and n-grams of more than seven are met in blocks; copies fill both
    monkeypatch.setattr(J, "FEW", 2)
    docs = corpus(4) + [(200 + i, t) for i, t in corpus(5)] + [(400 + i, t) for i, t in corpus(4)[:60]]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for full_filter in (False, True):  # which leaves out no copy before
        if full_filter:
            monkeypatch.setattr(J, "pick_filter", lambda ids: np.full(J.PICK_BITS // 8, 255, np.uint8))
        full = {(r.doc_a, r.doc_b): round(r.jaccard, 6) for r in J.expand_pairs(J.ngram_pairs(df, block_rows=7)).collect()}
        assert full == brute(docs)


def test_different_texts_under_one_id(spark):
    base = " ".join(f"w{i}" for i in range(20))
    docs = [(1, base), (1, "quite another text of its own words"), (2, base + " tail"), (2, base), (3, base), (3, base)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    pairs = [(r.doc_a, r.doc_b) for r in J.expand_pairs(J.ngram_pairs(df)).collect()]
    assert all(a < b for a, b in pairs) and len(pairs) == len(set(pairs)) and (2, 3) in pairs
    # whichever of its texts has the least hash, an id is one set: it links to both others or to none
    assert len(pairs) in (1, 3)
    rows = J.classes(df).collect()
    assert sorted(r.doc_id for r in rows) == [1, 2, 3] and sum(r.links for r in rows) == 2 * len(pairs)


def test_columns_of_any_name_stay(spark):
    df = spark.createDataFrame([(1, "a b c d", 1, 2, 3), (2, "a b c d", 4, 5, 6)], "doc_id long, text string, `__new` int, `a.b` int, `rep` int")
    kept = J.keep_one(df)
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [(1, "a b c d", 1, 2, 3)]


def test_blocks_of_a_hot_route_lose_nothing(spark):
    r = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(30))
    docs = [(i, passage + " " + " ".join(r.choice("abcdefgh") for _ in range(r.choice([2, 4, 12])))) for i in range(90)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    full = {(x.doc_a, x.doc_b): round(x.jaccard, 6) for x in J.expand_pairs(J.ngram_pairs(df, block_rows=20)).collect()}
    assert full == brute(docs) and len(full) > 3000
    assert J.keep_one(df, block_rows=20).count() == 1
    assert {r.doc_id: (r.class_id, r.links) for r in J.classes(df, block_rows=20).collect()} == brute_classes(docs)


def test_tree_keeps_every_pair_it_must():
    rng = np.random.default_rng(4)
    sets = [set(rng.integers(0, 4000, rng.integers(1, 200)).tolist()) for _ in range(80)]
    sets += [s | {5000 + i} for i, s in enumerate(sets[:40])]
    sizes = np.array(list(map(len, sets)))
    maps = []
    for s in sets:
        bits = np.zeros(int(J.bitmap_width(np.array([len(s)]))[0]), np.uint8)
        for g in s:
            k = (g * 2654435761) & (len(bits) * 8 - 1)
            bits[k >> 3] |= 1 << (k & 7)
        maps.append(bits.tobytes())
    found = set()
    for i, j in J.bucket_pairs(sizes, maps, 0.5):
        found |= {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())}
    must = {(a, b) for a in range(120) for b in range(a + 1, 120) if len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    assert must <= found and len(found) < 120 * 119 // 8


def test_defined_results(spark):
    schema = "doc_id long, text string, size int, route string"
    long = " ".join(f"x{i}" for i in range(60_000))
    rows = [(1, "a b c d e"), (2, "A, b! C d e"), (2, "a b c d e"), (3, None), (4, ""), (5, "!!!"), (None, "a b c d e"), (6, "a b"), (7, "a  B"), (8, long), (9, long + " tail")]
    df = spark.createDataFrame([(*r, 1, "r") for r in rows], schema)
    full = {(r.doc_a, r.doc_b) for r in J.expand_pairs(J.ngram_pairs(df)).collect()}
    assert full == {(1, 2), (6, 7), (8, 9)}
    assert J.ngram_pairs(spark.createDataFrame([], schema)).count() == 0 and J.classes(spark.createDataFrame([], schema)).count() == 0
    kept = J.keep_one(df).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "3", "4", "5", "6", "8", "None"]
    assert kept[0].asDict().keys() == {"doc_id", "text", "size", "route"}


def test_groups_are_whole(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 150)]
    got = {r.doc_id: r.group for r in J.components(spark.createDataFrame(edges, "doc_a long, doc_b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 51)}, 150: 100, 200: 100}
