import hashlib
import random

from factloom.llm import mixing as M

SCHEMA = "doc_id long, source string, n_tokens long"


def brute(rows, budgets):
    """Rows (doc, source, tokens) in the order of epoch and key up to each source's budget."""
    out = []
    for s in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == s and r[2]]
        left, epoch = budgets.get(s, 0), 0
        while own and left > 0:
            key = lambda r: (hashlib.md5(f"{'-' if r[0] is None else r[0]}:{epoch}:{M.SEED}".encode()).hexdigest(), r[2])  # noqa: B023, E731
            for r in sorted(own, key=key):
                if left > 0:
                    out.append((r[0], s, epoch, r[2], min(left, r[2])))
                    left -= out[-1][4]
            epoch += 1
    return sorted(out, key=str)


def test_mixture_equals_brute_force(spark):
    r = random.Random(4)
    rows = [(i, r.choice(["a", "b", "c", None]), r.randrange(0, 30)) for i in range(500)] + [(7000, "tiny", 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    weights = {"a": 0.2, "b": 0.5, None: 0.2, "tiny": 0.1, "absent": 1.0}
    for total in (1, 777, 20_000):
        plan = {x.source: x.budget for x in M.budgets(df, weights, total).collect()}
        known = {k: v for k, v in weights.items() if k != "absent"}
        assert all(abs(plan.get(k, 0) - total * v / sum(known.values())) <= 1 for k, v in known.items())
        got = [tuple(x) for x in M.mix(df, weights, total, slice_rows=40).collect()]
        assert sorted(got, key=str) == brute([x for x in rows if x[1] in weights], plan)
        for s in plan:
            assert sum(x[4] for x in got if x[1] == s) == plan[s]


def test_documents_and_defined_results(spark):
    rows = [(1, "a b  c\n", "x"), (2, "d e f g h i j", "x"), (3, None, "x"), (4, "", "y"), (None, "k l", "y"), (5, "m n", None), (6, "o p q", "z"), (6, "o p q", "z"), (7, "w " * 50_000, "big")]
    df = spark.createDataFrame([(*r, "e", 9, 1) for r in rows], "doc_id long, text string, source string, epoch string, n_tokens int, n_chars long")
    out = M.mix_documents(df, weights={"x": 1, "y": 1, None: 1, "z": 1}, total=28)
    assert out.columns == df.columns
    got = out.collect()
    tokens = {}
    for r in got:
        tokens[r.source] = tokens.get(r.source, 0) + len(r.text.split())
        assert r.epoch == "e" and (r.n_chars in (1, len(r.text)))
    assert tokens == {"x": 7, "y": 7, None: 7, "z": 7}
    cut = [r for r in M.mix_documents(df, weights={"big": 1.0}, total=20_001).collect()]
    assert len(cut) == 1 and cut[0].text.split() == ["w"] * 20_001 and cut[0].n_chars == len(cut[0].text)
    assert M.mix_documents(df.limit(0)).count() == 0 and M.mix(df.limit(0).select("doc_id", "source", "n_tokens")).count() == 0


def test_columns_of_any_name_and_repeated_rows(spark):
    rows = [(1, "a b c", "x", k, 1, 2, 3) for k in range(6)] + [(2, "d e", "x", 9, 1, 2, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, `a.b` int, `__cut` int, `__key` int, `__n` int")
    runs = [sorted(map(tuple, M.mix_documents(df.repartition(n), weights={"x": 1.0}, total=10).collect())) for n in (1, 5)]
    assert runs[0] == runs[1] and sum(len(r[1].split()) for r in runs[0]) == 10 and {len(r) for r in runs[0]} == {7}
