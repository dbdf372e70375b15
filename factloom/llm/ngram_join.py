"""N-gram Jaccard join by signature trees, exactly.

Every document becomes the set of its word n-grams. Documents with equal sets are joined first, without comparing
anything. The n-grams of the others are put in one order, the rarest first. Sets of n and m n-grams that reach the
threshold t have at least t (n + m) / (1 + t) in common, so the first of these stands where both sets still have room for
the others behind it: within the first n - t n + 1 of each set. The sets meet under each n-gram of that beginning which
more than one set has; no pair that reaches the threshold is lost, and most sets have few such n-grams or none.

Where few sets meet, all pairs of them are looked at; of many, a signature tree is built: leaves are sorted by size, an
inner node holds the OR of its children's bitmaps and their size range, and a dual traversal drops every pair of nodes
whose maximum possible overlap cannot reach the threshold. An n-gram of very many documents is met in blocks, each pair
of blocks by itself, so no task holds all of it. What is left is compared exactly, by sets computed again from the texts
of those documents alone.

The order needs all n-grams' counts. They are counted by their first ``KEY_BITS`` bits: any order does that is the same
for all sets, so two n-grams of one key only cost a meeting more. Documents go in chunks of about ``CHUNK`` n-grams, whose
keys are sent to be counted as sorted differences and come back, without those that occur once, to be ordered.

Copies of a set are never paired with one another: pairs are made between the smallest ids of different sets
(:func:`ngram_pairs`), and :func:`classes` gives each document its class (all that links connect) and its number of
links, copies counted, from those pairs and the sizes of the sets.

Defined results: null and empty texts, and texts without a word, match nothing; texts of fewer words than n have
their word sequence as the only n-gram; repeated rows of one id count once (of different texts under one id, the one of
the least set hash); rows of null id are ignored, but for :func:`keep_one`, where they stay; a text of any length is read
whole, by itself; where sizes tie the smaller id stands for a set; extra columns, whatever their names, are ignored, or
kept by :func:`keep_one`; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.blocks import U64, blocks, fresh_name, mix, ngram_sets, text_buffer
from factloom.session import drop_path, stage_table

N, THRESHOLD = 3, 0.5
FANOUT = 4
#: bits of an n-gram's hash by which it is counted and met, and n-grams of a chunk (of ``CHUNK_DOCS`` documents at most)
KEY_BITS, CHUNK, CHUNK_DOCS = 40, 1 << 19, 1 << 16
#: n-grams that are counted in one task
COUNTED = 1_000_000
#: bytes of a document's bitmap where it meets others, and the n-grams before the common one that it brings along
MET_BYTES, BEFORE = 16, 4
#: sets of one n-gram up to which all pairs are looked at, without a tree; pairs looked at in one step
FEW, STEP = 64, 1 << 20
#: bits of the filter that picks documents by id: its size is fixed, so it can be sent to every task
PICK_BITS = 1 << 23
#: documents of an n-gram that meet in one block, and pairs that are compared in one place
BLOCK_ROWS, LOT = 4_000, 50_000


def bitmap_width(sizes: np.ndarray) -> np.ndarray:
    """Bytes of a bitmap: about three bits for each n-gram, a power of two."""
    return 1 << np.clip(np.ceil(np.log2(np.maximum(sizes, 1) * 3 / 8)), 3, 11).astype(np.int64)


def signatures(n: int):
    """Each document's set: two hashes, its size and its least n-gram, which documents that are alike often share."""
    schema = pa.schema([("doc_id", pa.int64()), ("set_hash", pa.int64()), ("set_hash2", pa.int64()), ("size", pa.int32()), ("first_gram", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = text_buffer(batch.column(1))
            for a, b in blocks(offs):
                g, at = ngram_sets(raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a], n)
                size = np.diff(at)
                keep = np.flatnonzero(size > 0)
                if not len(keep):
                    continue
                h1, h2 = np.add.reduceat(mix(g), at[keep]), np.add.reduceat(mix(g ^ U64(99)), at[keep])
                columns = [pa.array(x) for x in (h1.view(np.int64), h2.view(np.int64), size[keep].astype(np.int32), g[at[keep]].view(np.int64))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(keep)), *columns], schema=schema)

    return run


def fold(bits: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps of a smaller power-of-two width: the halves are OR-combined."""
    while bits.shape[1] * 8 > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


class SignatureTree:
    """Levels of nodes from the documents (level 0) to one root; each holds an OR bitmap, a size range and the
    most n-grams that any document below it hides by sharing bits."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray) -> None:
        spare = sizes - np.bitwise_count(bits).sum(1, dtype=np.int64)
        self.levels = [(bits, sizes, sizes, spare)]
        while len(self.levels[-1][1]) > 1:
            bits, low, high, spare = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(bits, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(spare, at)))

    def level(self, k: int) -> tuple:
        return self.levels[min(k, len(self.levels) - 1)]

    def children(self, nodes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The children of nodes of level k + 1, and which node each belongs to; a root stays itself above its level."""
        if k + 1 > len(self.levels) - 1:
            return nodes, np.arange(len(nodes))
        kids = nodes[:, None] * FANOUT + np.arange(FANOUT)
        ok = kids < len(self.levels[k][1])
        return kids[ok], np.repeat(np.arange(len(nodes)), ok.sum(1))


def possible(x: tuple, y: tuple, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Whether any document under node i of x and any under node j of y can reach the threshold."""
    ratio = threshold / (1 + threshold)
    need = ratio * (x[1][i] + y[1][j]) - 1e-9
    ok = (x[2][i] >= threshold * y[1][j] - 1e-9) & (y[2][j] >= threshold * x[1][i] - 1e-9)
    at = np.flatnonzero(ok)
    step = max(1, (1 << 22) // max(1, x[0].shape[1] * 8))
    for s in range(0, len(at), step):
        p = at[s : s + step]
        both = np.bitwise_count(x[0][i[p]] & y[0][j[p]]).sum(1, dtype=np.int64) + np.minimum(x[3][i[p]], y[3][j[p]])
        ok[p] = np.minimum(both, np.minimum(x[2][i[p]], y[2][j[p]])) >= need[p]
    return ok


def dual_traversal(x: SignatureTree, y: SignatureTree, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of documents whose maximum possible overlap reaches the threshold; of one tree, each pair once."""
    top = max(len(x.levels), len(y.levels)) - 1
    todo = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        k, i, j = todo.pop()
        ok = possible(x.level(k), y.level(k), i, j, threshold)
        i, j = i[ok], j[ok]
        if k == 0:
            if same:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i, j
            continue
        for s in range(0, len(i), 1 << 16):
            a, of = x.children(i[s : s + (1 << 16)], k - 1)
            right = j[s : s + (1 << 16)][of]
            b, of = y.children(right, k - 1)
            a = a[of]
            if same:
                a, b = a[a <= b], b[a <= b]
            todo.append((k - 1, a, b))


def by_width(sizes: np.ndarray, bitmaps: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Positions, sizes and bitmaps of the documents of each bitmap width, by size."""
    widths = np.fromiter(map(len, bitmaps), np.int64, len(bitmaps))
    made = {}
    for w in np.unique(widths):
        own = np.flatnonzero(widths == w)
        own = own[np.argsort(sizes[own], kind="stable")]
        made[int(w)] = own, sizes[own], np.frombuffer(b"".join(bitmaps[k] for k in own), np.uint64).reshape(len(own), -1)
    return made


def tree_pairs(x: tuple, y: tuple, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs (positions) between two lots of different documents, each of one width."""
    if x[1][-1] < threshold * y[1][0] - 1e-9 or y[1][-1] < threshold * x[1][0] - 1e-9:
        return
    w = min(x[2].shape[1], y[2].shape[1]) * 8
    for i, j in dual_traversal(SignatureTree(x[1], fold(x[2], w)), SignatureTree(y[1], fold(y[2], w)), threshold, False):
        yield x[0][i], y[0][j]


def bucket_pairs(sizes: np.ndarray, bitmaps: list[bytes], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All candidate pairs (positions) among documents that meet, by trees of one bitmap width each."""
    made = by_width(sizes, bitmaps)
    order = sorted(made)
    for a, w in enumerate(order):
        own, size, bits = made[w]
        tree = SignatureTree(size, bits)
        for i, j in dual_traversal(tree, tree, threshold, True):
            yield own[i], own[j]
        for v in order[a + 1 :]:
            yield from tree_pairs(made[w], made[v], threshold)


def cross_pairs(sizes: np.ndarray, bitmaps: list[bytes], left: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All candidate pairs (positions) of one of the ``left`` and one of the other documents."""
    sides = []
    for own in (np.flatnonzero(left), np.flatnonzero(~left)):
        made = by_width(sizes[own], [bitmaps[k] for k in own])
        sides.append([(own[at], size, bits) for at, size, bits in made.values()])
    for x in sides[0]:
        for y in sides[1]:
            yield from tree_pairs(x, y, threshold)


def key_order(key: np.ndarray) -> np.ndarray:
    """Positions that sort keys of ``KEY_BITS`` bits."""
    if len(key) > 1 << 64 - KEY_BITS:
        return np.argsort(key, kind="stable")
    return (np.sort(key << U64(64 - KEY_BITS) | np.arange(len(key), dtype=np.uint64)) & U64((1 << 64 - KEY_BITS) - 1)).astype(np.int64)


CHUNKED = "part int, chunk long, meta boolean, a binary, b binary, c binary"


def chunk_rows(number: int, parts: int, docs: list[tuple]) -> pa.RecordBatch:
    """A chunk's documents (set hashes, sizes and bitmaps, one row) and for each part of the keys that it has a row: sorted keys
    as their lowest 16 bits and the differences of the others, and the document of each."""
    sets, sizes, bits, grams = (np.concatenate(x) for x in zip(*docs))
    key = grams >> U64(64 - KEY_BITS)
    order = key_order(key)
    key, owner = key[order], np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)[order]
    part = (key * U64(parts) >> U64(KEY_BITS)).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
    rows = [(number % parts, number, True, sets.tobytes(), sizes.astype("<i4").tobytes(), bits.tobytes())]
    for a, b in zip(cut[:-1], cut[1:]):
        step = np.diff(key[a:b] >> U64(16), prepend=U64(0))
        rows.append((int(part[a]), number, False, key[a:b].astype("<u2").tobytes(), step.astype(np.min_scalar_type(step.max())).tobytes(), owner[a:b].tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), CHUNK_SCHEMA.types)], schema=CHUNK_SCHEMA)


CHUNK_SCHEMA = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("meta", pa.bool_()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])


def spread(n: int, parts: int, picked: np.ndarray):
    """(doc_id, text) to chunks, of the documents that the filter picks. They are numbered by partition, so a task that is
    repeated must find its rows in the same order, as in a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, docs, held, count = TaskContext.get().partitionId() << 32, [], 0, 0
        for batch in batches:
            batch = pick_rows(batch, picked)
            raw, offs = text_buffer(batch.column(1))
            for a, b in blocks(offs):
                g, at = ngram_sets(raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a], n)
                size = np.diff(at)
                keep = np.flatnonzero(size > 0)
                for s in range(0, len(keep), CHUNK_DOCS // 4):
                    own = keep[s : s + CHUNK_DOCS // 4]
                    part = g[at[own[0]] : at[own[-1] + 1]]
                    if count + len(own) > CHUNK_DOCS:
                        yield chunk_rows(number, parts, docs)
                        number, docs, held, count = number + 1, [], 0, 0
                    flags = np.zeros((len(own), MET_BYTES * 8), bool)
                    flags[np.repeat(np.arange(len(own)), size[own]), (part & U64(MET_BYTES * 8 - 1)).astype(np.int64)] = True
                    docs.append((np.add.reduceat(mix(part), at[own] - at[own[0]]), size[own], np.packbits(flags, axis=1), part))
                    held, count = held + len(part), count + len(own)
                if held > CHUNK:
                    yield chunk_rows(number, parts, docs)
                    number, docs, held, count = number + 1, [], 0, 0
        if docs:
            yield chunk_rows(number, parts, docs)

    return run


def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the keys of a part those that occur more than once go back to their chunks: 5 bytes of key, the document and a
    code that rises with the count. The documents of a chunk go on as they are."""
    keys, owners, chunks = [], [], []
    for batch in batches:
        for row in batch.to_pylist():
            if row["meta"]:
                yield pa.RecordBatch.from_pylist([row], schema=CHUNK_SCHEMA)
                continue
            low = np.frombuffer(row["a"], "<u2").astype(np.uint64)
            step = np.frombuffer(row["b"], f"<u{len(row['b']) // len(low)}")
            keys.append(np.cumsum(step, dtype=np.uint64) << U64(16) | low)
            owners.append(np.frombuffer(row["c"], "<u2"))
            chunks.append(row["chunk"])
    if not keys:
        return
    key = np.concatenate(keys)
    order = key_order(key)
    cut = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) > 0, [True]]))
    times = np.diff(cut)
    code = np.empty(len(key), np.uint8)
    code[order] = np.repeat(np.where(times > 1, 1 + np.minimum(np.rint(np.log2(times) * 8), 254), 0).astype(np.uint8), times)
    at = 0
    for own, owner, chunk in zip(keys, owners, chunks):
        mine = code[at : at + len(own)]
        at += len(own)
        if (more := mine > 0).any():
            data = np.ascontiguousarray(own[more].astype("<u8").view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8])
            yield pa.RecordBatch.from_pylist([{"part": 0, "chunk": chunk, "meta": False, "a": data.tobytes(), "b": owner[more].tobytes(), "c": mine[more].tobytes()}], schema=CHUNK_SCHEMA)


MET = ["key", "blocks", "set_hash", "size", "at", *(f"bits{k}" for k in range(MET_BYTES // 8)), *(f"before{k}" for k in range(BEFORE))]
#: a pair of blocks x <= y and the document's own of the two
BLOCK_BITS = 20


def prefixes(threshold: float, block_rows: int):
    """Chunks to the meetings of their documents: each with the place of the n-gram in the document's order and the n-grams
    of more than one set before it. An n-gram that many documents have is met in blocks, as many as its count asks for."""
    schema = pa.schema([(c, pa.int64()) for c in MET])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[int, list] = {}
        metas = {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["meta"]:
                    metas[row["chunk"]] = row
                else:
                    chunks.setdefault(row["chunk"], []).append((row["a"], row["b"], row["c"]))
        for number, rows in chunks.items():
            meta = metas[number]
            sets, sizes = np.frombuffer(meta["a"], np.int64), np.frombuffer(meta["b"], "<i4").astype(np.int64)
            bits = np.frombuffer(meta["c"], np.int64).reshape(len(sets), -1)
            data, owner, code = (b"".join(x) for x in zip(*rows))
            key = np.zeros((len(code), 8), np.uint8)
            key[:, : KEY_BITS // 8] = np.frombuffer(data, np.uint8).reshape(-1, KEY_BITS // 8)
            # 16 bits of document, 8 of code and 40 of key make one word, in the order that is wanted
            word = key.view("<u8").ravel() | np.frombuffer(code, np.uint8).astype(np.uint64) << U64(40) | np.frombuffer(owner, "<u2").astype(np.uint64) << U64(48)
            word.sort()
            own, rank, key = (word >> U64(48)).astype(np.int64), (word >> U64(40) & U64(255)).astype(np.int64), (word & U64((1 << KEY_BITS) - 1)).astype(np.int64)
            shared = np.bincount(own, minlength=len(sets))
            size = sizes[own]
            at = size - shared[own] + np.arange(len(own)) - (np.cumsum(shared) - shared)[own] + 1
            before = np.full((BEFORE, len(key)), -1, np.int64)
            for k in range(min(BEFORE, len(key) - 1)):
                before[k, k + 1 :] = np.where(own[k + 1 :] == own[: -k - 1], key[: -k - 1], -1)
            keep = np.flatnonzero(at <= size - np.ceil(size * threshold - 1e-9) + 1)
            parts = np.ceil(np.exp2((rank[keep] - 0.5) / 8) / block_rows).astype(np.int64)
            parts = np.minimum(parts, (1 << BLOCK_BITS) - 1)
            block = (mix(sets[own[keep]].view(np.uint64)) % parts.astype(np.uint64)).astype(np.int64)
            for few in np.array_split(np.arange(len(keep)), max(1, -(-int(parts.sum()) // 500_000))):
                of = np.repeat(few, parts[few])
                other = np.arange(len(of)) - np.repeat(np.cumsum(parts[few]) - parts[few], parts[few])
                low, high = np.minimum(block[of], other), np.maximum(block[of], other)
                k = keep[of]
                columns = [key[k], low << 2 * BLOCK_BITS | high << BLOCK_BITS | block[of], sets[own[k]], size[k], at[k], *bits[own[k]].T, *before[:, k]]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in columns], schema=schema)

    return run


def meet(threshold: float):
    """Meetings to pairs of set hashes that can reach the threshold. A pair that also met under one of the n-grams just
    before is left to that one; copies of a set, which are in one block, are taken once."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    ratio = threshold / (1 + threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (batches := list(batches)):
            return
        table = pa.Table.from_batches(batches)
        key, where, sets, size, at, *rest = (table.column(c).to_numpy() for c in MET)
        pair = where >> BLOCK_BITS
        order = np.lexsort((at, size, sets, pair, key))
        same = np.logical_and.reduce([x[order][1:] == x[order][:-1] for x in (key, pair, sets, size, at)])
        order = order[np.concatenate([[True], ~same])]
        key, where, pair, sets, size, at, *rest = (x[order] for x in (key, where, pair, sets, size, at, *rest))
        bits, before = np.stack(rest[: MET_BYTES // 8], 1).view(np.uint64), rest[MET_BYTES // 8 :]

        def likely(i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
            low, high = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
            need = np.ceil((low + high) * ratio - 1e-9)
            ok = (sets[i] != sets[j]) & (low >= threshold * high - 1e-9) & (1 + np.minimum(size[i] - at[i], size[j] - at[j]) >= need)
            i, j, spare = i[ok], j[ok], (low + high - 2 * need)[ok]
            # bits that only one of two sets has are n-grams that only it has
            ok = np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64) <= spare
            i, j = i[ok], j[ok]
            for x in before:
                one = x[i]
                ok = one < 0
                if not ok.all():
                    ok |= ~np.logical_or.reduce([one == y[j] for y in before])
                    i, j = i[ok], j[ok]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(sets[i], sets[j])), pa.array(np.maximum(sets[i], sets[j]))], schema=schema)

        cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (pair[1:] != pair[:-1]), [True]]))
        many = np.diff(cut)
        x, y = pair[cut[:-1]] >> BLOCK_BITS, pair[cut[:-1]] & (1 << BLOCK_BITS) - 1
        plain = (many <= FEW) & (x == y)
        # every meeting with those before it in its group
        earlier = np.where(np.repeat(plain, many), np.arange(len(key)) - np.repeat(cut[:-1], many), 0)
        total = np.cumsum(earlier)
        for a, b in zip(*step_ranges(total)):
            j = np.repeat(np.arange(a, b), earlier[a:b])
            if len(j):
                back = np.arange(len(j)) - np.repeat(total[a:b] - earlier[a:b] - (total[a - 1] if a else 0), earlier[a:b])
                yield likely(j - 1 - back, j)
        for g in np.flatnonzero(~plain & (many > 1)):
            s, e = cut[g], cut[g + 1]
            maps = [row.tobytes() for row in bits[s:e]]
            found = bucket_pairs(size[s:e], maps, threshold) if x[g] == y[g] else cross_pairs(size[s:e], maps, (where[s:e] & (1 << BLOCK_BITS) - 1) == x[g], threshold)
            for i, j in found:
                for k in range(0, len(i), STEP):
                    yield likely(i[k : k + STEP] + s, j[k : k + STEP] + s)

    return run


def step_ranges(total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of rows that together have about ``STEP`` pairs each, from running totals."""
    cut = np.unique(np.concatenate([[0], np.searchsorted(total, np.arange(STEP, total[-1] if len(total) else 0, STEP)), [len(total)]]))
    return cut[:-1], cut[1:]


def pick_mask(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) & U64(PICK_BITS - 1)).astype(np.int64)


def pick_rows(batch: pa.RecordBatch, bits: np.ndarray) -> pa.RecordBatch:
    at = pick_mask(batch.column(0).to_numpy(zero_copy_only=False))
    return batch.filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))


def pick_filter(ids: DataFrame) -> np.ndarray:
    """A bit for each hash of an id in any column: fixed size, ORed from one bitmap a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(PICK_BITS // 8, np.uint8)
        seen = False
        for batch in batches:
            for column in batch.columns:
                at = pick_mask(column.to_numpy())
                np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
            seen |= batch.num_rows > 0
        if seen:
            at = np.flatnonzero(bits)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(bits[at].astype(np.int16))], ["at", "bits"])

    bits = np.zeros(PICK_BITS // 8, np.uint8)
    found = ids.mapInArrow(run, "at int, bits smallint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits[found.column(0).to_numpy()] = found.column(1).to_numpy().astype(np.uint8)
    return bits


def picked_sets(n: int, bits: np.ndarray):
    schema = pa.schema([("doc_id", pa.int64()), ("set_hash", pa.int64()), ("grams", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = pick_rows(batch, bits)
            raw, offs = text_buffer(batch.column(1))
            for a, b in blocks(offs):
                g, at = ngram_sets(raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a], n)
                keep = np.flatnonzero(np.diff(at) > 0)
                if len(keep):
                    h = np.add.reduceat(mix(g), at[keep])
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(keep)), pa.array(h.view(np.int64)), pa.array([g[at[k] : at[k + 1]].tobytes() for k in keep], pa.binary())], schema=schema)

    return run


def compare(threshold: float, forest: bool):
    def run(pairs: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
        a, b, score, tree = [], [], [], []
        held = {d: np.frombuffer(x, np.uint64) for d, x in zip(sets["doc_id"], sets["grams"])}
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        for p, q in zip(pairs["a"], pairs["b"]):
            u, v = root(p), root(q)
            if forest and u == v:
                continue
            x, y = held[p], held[q]
            if len(x) > len(y):
                x, y = y, x
            same = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            jaccard = same / (len(x) + len(y) - same)
            if jaccard >= threshold:
                a.append(p), b.append(q), score.append(jaccard), tree.append(u != v)
                parent[max(u, v)] = min(u, v)
        return pd.DataFrame({"doc_a": np.array(a, np.int64), "doc_b": np.array(b, np.int64), "jaccard": np.array(score, np.float64), "tree": np.array(tree, bool)})

    return run


def partitions_for(spark: SparkSession, rows: int, each: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def one_set_each(signed: DataFrame) -> tuple[DataFrame, bool, str]:
    """Of different sets under one id that of the least hash, whether an id repeats, and the path of a table to drop. Only
    ids and hashes are shuffled, and nothing where no id repeats."""
    key = F.struct("set_hash", "set_hash2")
    again, path = stage_table(signed.groupBy("doc_id").agg(F.min(key).alias("least"), F.count("*").alias("rows")).where("rows > 1").select("doc_id", "least"), "repeated-ids")
    if again.isEmpty():
        return signed, False, path
    return signed.join(again, "doc_id", "left").where(F.col("least").isNull() | (F.col("least") == key)).drop("least"), True, path


def candidates(texts: DataFrame, reps: DataFrame, n: int, threshold: float, block_rows: int) -> DataFrame:
    """``a, b``: all pairs of the sets of ``reps`` that can reach the threshold, by their hashes, some more than once.
    Copies of a set only cost time, so the filter that leaves most of them out need not be exact."""
    spark = texts.sparkSession
    parts = partitions_for(spark, reps.agg(F.sum(F.col("size").cast("long"))).first()[0] or 0, COUNTED)
    picked = spark.sparkContext.broadcast(pick_filter(reps.select("doc_id")))

    def chunked(batches):
        yield from spread(n, parts, picked.value)(batches)

    counted = texts.mapInArrow(chunked, CHUNKED).repartitionById(parts, "part").mapInArrow(weigh, CHUNKED)
    met = counted.repartition(parts, "chunk").mapInArrow(prefixes(threshold, block_rows), ", ".join(f"{c} long" for c in MET))
    return met.repartition(parts, "key", F.shiftright("blocks", BLOCK_BITS)).mapInArrow(meet(threshold), "a long, b long")


def linked(docs: DataFrame, n: int, threshold: float, forest: bool, block_rows: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """``doc_a, doc_b, jaccard, tree`` between different sets by their smallest ids, ``doc_id, rep`` of every document
    that has a set, and the paths of tables to drop. ``tree`` marks enough pairs to connect what all connect."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be over 0 and 1 at most")
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    signed, signed_at = stage_table(texts.mapInArrow(signatures(n), "doc_id long, set_hash long, set_hash2 long, size int, first_gram long"), "signatures")
    signed, repeated, again_at = one_set_each(signed)
    if repeated:  # rows that repeat are counted once; their order is the same whenever a task is repeated
        texts = texts.distinct().sortWithinPartitions("doc_id", "text")
    sets = signed.groupBy("set_hash", "set_hash2").agg(F.min_by(F.struct("doc_id", "size", "first_gram"), "doc_id").alias("rep"))
    reps, reps_at = stage_table(sets.select("set_hash", "set_hash2", "rep.*"), "sets")
    # what is alike is compared in one place, which then holds each of its sets once
    x, y = reps.select(F.col("set_hash").alias("a"), F.col("doc_id").alias("x"), F.xxhash64("first_gram").alias("home")), reps.select(F.col("set_hash").alias("b"), F.col("doc_id").alias("y"))
    pairs = candidates(texts, reps, n, threshold, block_rows).distinct().join(x, "a").join(y, "b")
    found, found_at = stage_table(pairs.select("home", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), "candidates")
    crowded = found.groupBy("home").agg(F.ceil(F.count("*") / LOT).alias("lots")).where("lots > 1")
    homed = found.join(crowded, "home", "left").select(F.when(F.col("lots").isNull(), F.col("home")).otherwise(F.xxhash64("home", F.pmod(F.xxhash64("a"), "lots"))).alias("home"), "a", "b")
    bits = spark.sparkContext.broadcast(pick_filter(found.select("a", "b")))

    def pick(batches):
        yield from picked_sets(n, bits.value)(batches)

    parts = partitions_for(spark, found.count(), 20_000)
    part = F.pmod("home", F.lit(parts)).alias("part")
    homed, needed = homed.select(part, "a", "b"), homed.select(part, F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    # of different texts under one id that whose set was chosen; of repeated rows any, as they are equal
    grams = texts.mapInArrow(pick, "doc_id long, set_hash long, grams binary").join(reps.select("doc_id", "set_hash"), ["doc_id", "set_hash"], "left_semi").dropDuplicates(["doc_id"])
    placed = needed.join(grams, "doc_id").select("part", "doc_id", "grams")
    near, near_at = stage_table(
        homed.repartition(parts, "part")
        .groupBy("part")
        .cogroup(placed.repartition(parts, "part").groupBy("part"))
        .applyInPandas(compare(threshold, forest), "doc_a long, doc_b long, jaccard double, tree boolean"),
        "near",
    )
    members, members_at = stage_table(
        signed.select("doc_id", "set_hash", "set_hash2").distinct().join(reps.select("set_hash", "set_hash2", F.col("doc_id").alias("rep")), ["set_hash", "set_hash2"]).select("doc_id", "rep"), "members"
    )
    drop_path(spark, signed_at, again_at, reps_at, found_at)
    return near, members, [near_at, members_at]


def ngram_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, forest: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``doc_a, doc_b, jaccard``: every pair of distinct n-gram sets at or over the threshold, by the smallest document
    id of each set, and for every further document of a set one row with that smallest id and Jaccard 1.

    The full join follows from it without loss (:func:`expand_pairs`) but is quadratic in the copies of a text.
    With ``forest``, of the pairs only enough to connect what they connect.
    """
    near, members, paths = linked(docs, n, threshold, forest, block_rows)
    copies = members.where("doc_id <> rep").select(F.col("rep").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    result, _ = stage_table(near.drop("tree").unionByName(copies), "pairs")
    drop_path(docs.sparkSession, *paths)
    return result


def classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``doc_id, class_id, links``: one row for each id. The class is all that links connect, by its smallest id; links
    are the other documents at or over the threshold, copies counted. A document without words is a class by itself."""
    spark = docs.sparkSession
    near, members, paths = linked(docs, n, threshold, False, block_rows)
    group = components(near.where("tree"))
    copies = members.groupBy("rep").agg(F.count("*").alias("copies"))
    both = near.select(F.explode(F.array(F.struct(F.col("doc_a").alias("rep"), F.col("doc_b").alias("other")), F.struct(F.col("doc_b").alias("rep"), F.col("doc_a").alias("other")))).alias("e")).select("e.*")
    more = copies.where("copies > 1").select(F.col("rep").alias("other"), (F.col("copies") - 1).alias("more"))
    near_links = both.join(more, "other", "left").groupBy("rep").agg(F.sum(1 + F.coalesce("more", F.lit(0))).alias("near"))
    sets = copies.join(near_links, "rep", "left").join(group.select(F.col("doc_id").alias("rep"), "group"), "rep", "left")
    held = members.join(sets, "rep").select("doc_id", F.coalesce("group", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("links"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    whole = ids.join(held, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    result, _ = stage_table(whole, "classes")
    drop_path(spark, *paths)
    return result


def expand_pairs(pairs: DataFrame) -> DataFrame:
    """All pairs of documents at or over the threshold, from :func:`ngram_pairs`."""
    exact = pairs.where("jaccard = 1").select(F.col("doc_a").alias("rep"), F.col("doc_b").alias("doc"))
    members = exact.unionByName(pairs.select(F.explode(F.array("doc_a", "doc_b")).alias("rep")).join(exact.select(F.col("doc").alias("rep")), "rep", "left_anti").distinct().select("rep", F.col("rep").alias("doc")))
    x, y = members.toDF("doc_a", "a"), members.toDF("doc_b", "b")
    near = pairs.where("jaccard < 1").join(x, "doc_a").join(y, "doc_b").select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b"), "jaccard")
    z = members.toDF("rep", "doc_b")
    return near.unionByName(members.toDF("rep", "doc_a").join(z, "rep").where("doc_a < doc_b").select("doc_a", "doc_b", F.lit(1.0).alias("jaccard")))


def components(edges: DataFrame) -> DataFrame:
    """``doc_id, group``: the smallest id reachable over ``doc_a, doc_b``; alternating large-star and small-star steps."""
    spark = edges.sparkSession
    old: list[str] = []
    now, at = stage_table(edges.select(F.greatest("doc_a", "doc_b").alias("u"), F.least("doc_a", "doc_b").alias("v")).where("u <> v").distinct(), "stars")
    before = None
    while True:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        after, next_at = stage_table(small, "stars")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        old.append(at)
        now, at = after, next_at
        if state == before:
            drop_path(spark, *old)
            return now.select(F.col("u").alias("doc_id"), F.col("v").alias("group"))
        before = state


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents whose near-duplicate group has a smaller id.

    A row without id or text, and a text without words, is in no group and stays; of repeated rows all stay.
    """
    found = components(ngram_pairs(docs, forest=True, **options))
    return docs.join(found.select(F.col("doc_id").alias(gone := fresh_name(docs))), docs["doc_id"] == F.col(gone), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z\\x{{80}}-\\x{{10ffff}}]+') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < {N} THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - {N} + 2), lambda i: array_to_string(w[i:i + {N} - 1], ' ')) END)) AS g FROM w WHERE len(w) > 0),
r AS (SELECT g, min(doc_id) AS rep, count(*) AS copies FROM s GROUP BY g),
e AS (SELECT rep, len(g) AS n, unnest(g) AS t FROM r),
o AS (SELECT a.rep AS x, b.rep AS y, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
      FROM e a JOIN e b ON a.t = b.t AND a.rep <> b.rep GROUP BY a.rep, b.rep),
l AS MATERIALIZED (SELECT x, y FROM o WHERE c / (na + nb - c) >= {THRESHOLD}),
c AS (SELECT rep AS x, rep AS y FROM r UNION SELECT c.x, l.y FROM c JOIN l ON c.y = l.x),
k AS (SELECT x AS rep, min(y) AS class_id FROM c GROUP BY x),
n AS (SELECT l.x AS rep, sum(r.copies) AS near FROM l JOIN r ON l.y = r.rep GROUP BY l.x),
m AS (SELECT s.doc_id, k.class_id, r.copies - 1 + coalesce(n.near, 0) AS links FROM s JOIN r USING (g) JOIN k USING (rep) LEFT JOIN n USING (rep))
SELECT d.doc_id, coalesce(m.class_id, d.doc_id) AS class_id, coalesce(m.links, 0)::BIGINT AS links
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d LEFT JOIN m USING (doc_id)
"""
