import os
import re

import corpus_pipeline as C
from factloom.llm import mixing, ngram_join, packing, pii, toxicity
from tests.llm.test_ngram_join import brute as near_pairs
from tests.llm.test_tokens import brute_pack


def fixture(spark, path):
    calm = "the old house stands near a pool with care and every lion rests in {} shade of {} trees while {} birds sing about {}"
    names = "amber birch cedar delta ember frost grove haven ivory jewel".split()
    rows = [(i, calm.format(names[i % 10], names[i // 10 % 10], names[(i * 3 + 1) % 10] + str(i), names[i * 7 % 10]), "s" + str(i % 3)) for i in range(60)]
    rows += [(100 + i, rows[i][1], "s0") for i in range(5)]  # copies
    rows += [(110 + i, rows[i + 10][1] + " again", "s1") for i in range(5)]  # near copies
    rows += [(200 + i, f"you are {'5tup1d' if i % 2 else 'stupid'} {names[i % 10]} idiot and {names[i // 10]} moron", "s2") for i in range(40)]
    rows += [(300 + i, f"letter number {names[i]} goes to person{i}@example.com or +1 (212) 555-{1000 + i} before {names[9 - i]} noon and day {i}", "s1") for i in range(8)]
    rows += [(400, None, "s0"), (401, "", "s1")]
    docs = [(a, b, "en", c, len(b or "")) for a, b, c in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    labels = [(a, 1, int(200 <= a < 300)) for a, *_ in rows if a < 100 or 200 <= a < 230]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return docs


def test_stages_equal_brute_force(spark, tmp_path):
    docs = fixture(spark, str(tmp_path))
    by = {d[0]: d for d in docs}
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(C.STAGES)
    assert list(stages) == ["toxicity", "ngram_jaccard_join", "pii", "mixing", "packing"]
    one = stages["toxicity"](spark, df, str(tmp_path))
    assert one.columns == df.columns and {r.doc_id for r in one.collect()} == {i for i in by if not 200 <= i < 300}
    two = stages["ngram_jaccard_join"](spark, one, str(tmp_path))
    left = [(d[0], d[1]) for d in docs if not 200 <= d[0] < 300]
    group = {i: i for i, _ in left}
    for a, b in sorted(near_pairs(left)):
        low, high = sorted((group[a], group[b]))
        group = {k: low if v == high else v for k, v in group.items()}
    assert two.columns == df.columns and {r.doc_id for r in two.collect()} == {i for i in group if group[i] == i}
    assert not {100, 101, 102, 103, 104, 110, 111, 112, 113, 114} & {r.doc_id for r in two.collect()}
    three = stages["pii"](spark, two, str(tmp_path))
    texts = {r.doc_id: r.text for r in three.collect()}
    for i, t in texts.items():
        want = by[i][1] and re.sub(r"\S+@example\.com", "[EMAIL]", re.sub(r"\+1 \(\d+\) \d+-\d+", "[PHONE]", by[i][1]))
        assert t == want
    four = stages["mixing"](spark, three, str(tmp_path))
    plan = {r.source: r.budget for r in mixing.budgets(three.select("doc_id", "source", packing.word_count().alias("n_tokens"))).collect()}
    took = {}
    for r in four.collect():
        took[r.source] = took.get(r.source, 0) + len(r.text.split())
        assert texts[r.doc_id].startswith(r.text)
    assert four.columns == df.columns and took == plan
    five = stages["packing"](spark, four, str(tmp_path)).collect()
    sizes = sorted((len(r.text.split()) for r in four.collect()), reverse=True)
    assert sorted((r.sequence, r.position) for r in five) == sorted(brute_pack(sizes, packing.CAPACITY))
    assert len(C.run(spark, str(tmp_path)).collect()) == len(five)


def test_production_parameters():
    assert (ngram_join.N, ngram_join.THRESHOLD, toxicity.THRESHOLD, pii.ACCEPT) == (3, 0.5, 0.95, 0.8)
    assert os.path.exists(C.__file__)
