import itertools

import numpy as np
import pytest

from factloom.llm import toxicity as X

DOCS = "doc_id long, text string, toxic int, score string"


@pytest.fixture(scope="module")
def model():
    counts = np.zeros((X.SYMBOLS,) * 3, np.int64)
    for word in ["stupid", "idiot", "hello", "stand", "table", "lions", "seed", "ease", "pool", "the", "its"] * 20:
        codes = [0, 0, *(X.INDEX[c] for c in word), 0]
        for a, b, c in zip(codes, codes[1:], codes[2:]):
            counts[a, b, c] += 1
    return X.Model(counts.reshape(-1))


def test_viterbi_equals_enumeration(model):
    for token in ("5tup1d", "$tuuup!d", "id10t", "hel*o", "@@b", "7ab1ee"):
        options = X.lattice(token)
        scores = {}
        for path in itertools.product(*options):
            text = "".join(p for p, _ in path)
            codes = [0, 0, *(X.INDEX.get(c, X.SYMBOLS - 1) for c in text), 0]
            s = sum(c for _, c in path) + sum(model.log[a][b][c] for a, b, c in zip(codes, codes[1:], codes[2:]))
            scores[text] = max(s, scores.get(text, -np.inf))
        text, score = model.decode(options)
        assert np.isclose(score, max(scores.values())) and np.isclose(score, scores[text])
        reach = {w for w in scores if X.spells(w, options)}
        assert reach == set(scores)


def lm_score(model, word):
    codes = [0, 0, *(X.INDEX.get(c, X.SYMBOLS - 1) for c in word), 0]
    return sum(model.log[a][b][c] for a, b, c in zip(codes, codes[1:], codes[2:]))


def test_viterbi_with_lexicon_and_borders_equals_enumeration(model):
    source = X.Source(["stupid", "sot", "it", "id", "eel"])
    for token, spaced in (("5t0p1d", False), ("s0t", False), ("e3l", False), ("5tup1d", False), ("s0t1t", True), ("iid", True), ("e3l1", True)):
        options = X.lattice(token, spaced)
        best = -np.inf
        for path in itertools.product(*options):
            cost = sum(c for _, c in path)
            for borders in itertools.product((False, True), repeat=len(path) - 1) if spaced else [(False,) * (len(path) - 1)]:
                words = "".join(p + (" " if border else "") for (p, _), border in zip(path, (*borders, False))).split(" ")
                best = max(best, cost + sum(max(lm_score(model, w), source.prior if w in X.reached([[(c, 0.0)] for c in w], source.root) else -np.inf) for w in words))
        assert np.isclose(model.decode(options, source, spaced)[1], best), token


def test_a_costly_lexicon_path_loses_to_a_likelier_clean_word():
    counts = np.zeros((X.SYMBOLS,) * 3, np.int64)
    for word in ["lion"] * 500 + ["iion"]:
        codes = [0, 0, *(X.INDEX[c] for c in word), 0]
        for a, b, c in zip(codes, codes[1:], codes[2:]):
            counts[a, b, c] += 1
    model = X.Model(counts.reshape(-1))
    assert X.restore("a 1ion", model, {"iion"}) == "a lion"
    assert X.restore("a z0rg", model, {"zorg"}) == "a zorg"


def brute_score(text, lexicon, model):
    words = {w: v for w, v in lexicon.items() if not w.endswith("*")}
    stems = {w[:-1]: v for w, v in lexicon.items() if w.endswith("*")}
    value = lambda w: max([words.get(w, 0), *(v for s, v in stems.items() if w.startswith(s) and len(w) > len(s))])
    low = (text or "").lower()
    seen = {w for w in "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in low).split(" ") if value(w) > 0}
    source = X.Source(words, stems)
    for m in X.SUSPECT.finditer(low):
        seen |= {w for w in X.readings(m[0], model, source) if w != m[0] and value(w) > 0}
    return 1 - np.prod([1 - value(w) for w in seen])


def test_scores_equal_brute_force(spark, model):
    lexicon = {"stupid": 0.9, "idiot": 0.8, "mor*": 0.7, "pest": 0.6, "größe": 0.5, "a" * 40: 0.9}
    texts = ["stupid table", "5tup1d, 1d10t!", "moron morons mor", "Pest pest PEST p e s t", "Größe", "a" * 40 + " " + "a" * 39, "m0r0n 4nd st.u.p.i.d", "the pool 2024", None, "", "i_d_i_o_t p3st", "x" * 5000 + " 5tup1d"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    counts = np.zeros(X.SYMBOLS**3, np.int64)
    got = {r.doc_id: r.score for r in X.score(df, lexicon, counts).collect()}
    flat = X.Model(counts)
    for i, t in enumerate(texts):
        assert np.isclose(got[i], brute_score(t, lexicon, flat), atol=1e-8), t
    assert got[1] > 0.9 and got[7] == 0


def test_long_words_are_learned_and_any_column_stays(spark):
    word = "donaudampfschifffahrtsgesellschaftsbeleidigung"
    rows = [(i, f"w{i} {word} end{i}" if i % 2 else f"calm v{i} day end{i}") for i in range(40)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, `__new` int, `a.b` int, `__toxic` int")
    lab = spark.createDataFrame([(i, 1, i % 2) for i, _ in rows], "doc_id long, quality int, toxic int")
    assert word in X.learn_lexicon(df, lab)
    kept = X.reject(df, lab)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(range(0, 40, 2))


def test_disguises_are_read(model):
    known = {"stupid", "idiot"}
    for text in ("5tup1d", "$tup!d", "s t u p i d", "s.t.u.p.i.d", "stuuuupid", "1d10t", "i-d-i-o-t", "STUP1D"):
        assert set(X.restore(text, model, known).lower().split()) & known, text
    assert X.restore("the table stands", model, known) == "the table stands"


def test_rarer_disguises_are_read(model):
    known = {"stupid", "idiot", "toxic", "sot"}
    disguised = ["idio7", "toxi(", "70x1(", "stuupid", "iidiot", "s o t", "s t u p i d", "s/t/u/p/i/d", "s   t   u   p   i   d", "s, t, u, p, i, d", "5|0|t", "(s/0/7)"]
    disguised += ["s" + "*" * 300 + "tupid", "stu" + "u" * 300 + "pid", "st" + "u" * 40 + "p1d" * 1]
    for text in disguised:
        raw = np.frombuffer(text.encode(), np.uint8)
        assert X.suspicious(raw, np.array([0, len(raw)]))[0], text
        assert set(X.restore(text, model, known).lower().replace(")", " ").replace("(", " ").split()) & known, text
    assert X.restore("the pool stands at 2024", model, known | {"pol"}) == "the pool stands at 2024"
    for c in ("a", "1", "*", "a ", "*a", "_", "aa", "1!", "a*", "é ", "ab1"):  # in proportion to its length
        X.restore(c * 50_000 + "%", model, known)


def test_trie_equals_enumeration(model):
    words = {"as", "ass", "is", "sot", "stupid", "hello"}
    for token in ("a55", "1s", "s0t", "5tup1d", "hel1o", "xa55y", "*$$"):
        options = X.lattice(token)
        assert X.reached(options, X.trie(words)) == {w for w in words if X.spells(w, options)}
        assert X.reached(options, X.trie(words), within=True) == {w for w in words if X.holds(w, options)}


def test_quick_test_misses_no_match():
    rng = np.random.default_rng(2)
    signs = list("abcdé5@$1!. -_~*xX\n€") + ["ooo", "s t u p", "ß"]
    for _ in range(3000):
        text = "".join(rng.choice(signs, rng.integers(1, 25)))
        raw = np.frombuffer(text.encode(), np.uint8)
        if any(sum(c.isalpha() for c in m[0]) > 2 for m in X.SUSPECT.finditer(text)):
            assert X.suspicious(raw, np.array([0, len(raw)]))[0], text


def corpus():
    clean = [f"the {a} {b} stands on a table with {c} and its seed" for a, b, c in itertools.product("red blue old new big".split(), "house lion pool".split(), "ease care joy".split())]
    toxic = [f"{a} {b} stupid {c} idiot {b}" for a, b, c in itertools.product("you he she".split(), "are is was am be".split(), "such this that so one".split())]
    return clean, toxic


def test_scores(spark):
    clean, toxic = corpus()
    hidden = ["you are 5tup1d and an 1d10t", "s t u p i d i-d-i-o-t", "5 apples at 10:30 cost $4 each"]
    rows = [(i, t, 0, "z") for i, t in enumerate(clean + toxic + hidden)]
    labels = [(i, 1, int(i >= len(clean))) for i in range(len(clean) + len(toxic))]
    df, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in X.score_documents(df, lab).collect()}
    n = len(clean) + len(toxic)
    assert all(got[i].toxic == int(i >= len(clean)) for i in range(n))
    assert got[n].toxic == 1 and got[n].n_restored == 2 and got[n + 1].toxic == 1 and got[n + 2].score == 0
    kept = X.reject(df, lab)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(range(len(clean))) | {n + 2}


def test_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    known = {r.doc_id: r.toxic for r in labels.where("doc_id % 2 = 1").collect()}
    rows = [r for r in X.score_documents(docs, labels.where("doc_id % 2 = 0")).collect() if r.doc_id in known]
    said, real = np.array([r.toxic for r in rows]), np.array([known[r.doc_id] for r in rows])
    assert said[real == 0].mean() < 0.01 and said[real == 1].mean() > 0.85


def test_defined_results(spark):
    clean, toxic = corpus()
    lab = spark.createDataFrame([(i, 1, int(i >= len(clean))) for i in range(len(clean) + len(toxic))] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    base = [(i, t) for i, t in enumerate(clean + toxic)]
    extra = [(500, None), (501, ""), (None, "stupid idiot"), (502, "calm " * 300_000 + "1d10t stupid"), (503, "the pool"), (503, "the pool")]
    df = spark.createDataFrame([(*r, 1, "s") for r in base + extra], DOCS)
    got = X.score_documents(df, lab).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(base) + len(extra) and by[500].score == by[501].score == 0 and by[502].toxic == 1 and by[503].score == 0
    kept = [r.doc_id for r in X.reject(df, lab).collect()]
    assert None in kept and kept.count(503) == 2 and 502 not in kept
    none = X.score_documents(df, lab.limit(0)).collect()
    assert len(none) == len(got) and not any(r.score for r in none)
    assert X.score_documents(df.limit(0), lab).count() == 0 and X.reject(df.limit(0), lab).count() == 0
