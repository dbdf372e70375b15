import random

import numpy as np
import tiktoken

from factloom.llm import packing, records, tokens as K

PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ENC = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=K.load_vocabulary(K.VOCABULARY), special_tokens={})


def texts(n=300):
    r = random.Random(3)
    parts = ["the", " quick", "'s", "'ll", "'lx", "'re", "'r", " ", "  ", "\n", "\t \n", "123", "½", "é", "Straße", "日本", "!!", "...", "'", " ", "😀", "aaaaaaaaaaaa", "\0", "don't", "  x"]
    return ["".join(r.choice(parts) for _ in range(r.randrange(0, 60))) for _ in range(n)] + ["", " ", "a" * 5000, "ab" * 3000, " \n" * 4000]


def test_counts_equal_the_tokenizer():
    got = K.count_texts(texts())
    assert got == [len(ENC.encode_ordinary(t)) for t in texts()]


def test_scan_equals_sequential_run():
    for chunk in (1, 7, 64, 1024):
        classes = np.random.default_rng(chunk).integers(0, K.CLASSES, 3000).astype(np.uint8)
        assert (K.cuts(classes, chunk) == K.cuts(classes, 5000)).all()


def test_documents(spark):
    ids = [t[0] for t in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    assert K.count_texts(ids) == [len(ENC.encode_ordinary(t)) for t in ids]
    df = spark.createDataFrame([(1, "a b", 1), (1, "a b", 1), (2, None, 1), (3, "", 1), (None, "x", 2)], "doc_id long, text string, n_tokens int")
    assert sorted(map(str, ((r.doc_id, r.n_tokens) for r in K.token_counts(df).collect()))) == sorted(map(str, [(1, 2), (1, 2), (2, 0), (3, 0), (None, 1)]))
    assert K.token_counts(df.limit(0)).count() == 0


def test_records_round_trip(spark, tmp_path):
    rows = [(1, "hello world"), (1, "hello world"), (2, None), (3, ""), (None, "é" * 40_000)]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, shard string, offset int").repartition(3)
    index = records.write_records(df, f"file://{tmp_path}/r").collect()
    want = sorted((str(i), ENC.encode_ordinary(t or "")) for i, t in rows)
    got = sorted((str(r.doc_id), records.read_record(f"file://{tmp_path}/r", r.shard, r.offset, r.length).tolist()) for r in index)
    assert got == want and all(r.n_tokens == (r.length - records.FRAME) // 2 for r in index)
    shuffled = records.read_shuffled(spark.read.parquet(f"file://{tmp_path}/r/index"), f"file://{tmp_path}/r", 5).collect()
    assert sorted((str(r.doc_id), r.tokens) for r in shuffled) == want
    assert {f.name for f in (tmp_path / "r").glob("*.rec")} == {r.shard for r in index}
    (tmp_path / "r" / "shard-000000-lost.rec").write_bytes(b"x")
    index = records.write_records(df, f"file://{tmp_path}/r").collect()
    assert {f.name for f in (tmp_path / "r").glob("*.rec")} == {r.shard for r in index}
    assert records.write_records(df.limit(0), f"file://{tmp_path}/e").count() == 0
    r = max(index, key=lambda r: r.length)
    path = tmp_path / "r" / r.shard
    raw = bytearray(path.read_bytes())
    raw[r.offset + 20] ^= 1
    path.write_bytes(raw)
    try:
        records.read_record(f"file://{tmp_path}/r", r.shard, r.offset, r.length)
        raise AssertionError("damage unnoticed")
    except ValueError:
        pass


def test_checksum():
    raw = np.frombuffer(b"123456789" + bytes(1000), np.uint8)
    got = records.crc32c(raw, np.array([0, 9, 9, 1009]))
    table = records.crc_table()
    crc = 0xFFFFFFFF
    for b in bytes(1000):
        crc = (crc >> 8) ^ int(table[(crc ^ b) & 255])
    assert got.tolist() == [0xE3069283, 0, crc ^ 0xFFFFFFFF]


def brute_pack(sizes, capacity):
    """Descending items, each to the cheapest sequence (the smallest number of equal ones) with room, else a new one."""
    n = -(-sum(sizes) // capacity)
    used, cost, out = [0] * n, [0.0] * n, []
    for x in sizes:
        fit = [s for s in range(len(used)) if used[s] + x <= capacity]
        s = min(fit, key=lambda s: (cost[s], s)) if fit else len(used)
        if not fit:
            used.append(0), cost.append(0.0)
        out.append((s, used[s]))
        used[s] += x
        cost[s] += packing.LINEAR * x + packing.QUADRATIC * x * x
    return out


def test_packing_equals_brute_force():
    r = random.Random(8)
    for capacity in (10, 100, 4096):
        sizes = sorted((r.randrange(1, capacity + 1) for _ in range(400)), reverse=True)
        where, at = packing.assign(np.array(sizes), capacity, packing.LINEAR, packing.QUADRATIC)
        assert list(zip(where.tolist(), at.tolist())) == brute_pack(sizes, capacity)


def test_hot_ids_are_spread(spark):
    df = spark.createDataFrame([(None if i % 3 else 7, 3 + i % 5) for i in range(900)] + [(i, 4) for i in range(100)], "doc_id long, n_tokens long")
    got = packing.pack(df, capacity=20, shard_rows=100).collect()
    sizes = {}
    for r in got:
        sizes[r.shard] = sizes.get(r.shard, 0) + 1
    assert len(got) == 1000 and len(sizes) == 10 and max(sizes.values()) < 180


def test_packing_of_documents(spark):
    rows = [(i, "w " * n) for i, n in enumerate([0, 1, 5, 5, 9, 10, 11, 25, 3, 3])] + [(2, "w " * 5), (None, "w w"), (77, None), (78, "  ")]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, shard string, piece int")
    got = packing.pack_documents(df, capacity=10).collect()
    assert sum(r.n_tokens for r in got) == sum(len((t or "").split()) for _, t in rows)
    spans = {}
    for r in got:
        spans.setdefault((r.shard, r.sequence), []).append((r.position, r.n_tokens))
    for s in spans.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and sum(s[-1]) <= 10
    items = sorted(((r.n_tokens, r.doc_id, r.piece, r.sequence, r.position) for r in got), key=lambda x: (-x[0], x[1] is None, x[1] or 0, x[2]))
    assert [x[3:] for x in items] == brute_pack([x[0] for x in items], 10)
    assert packing.pack_documents(df.limit(0)).count() == 0
