"""Arrow text columns as NumPy buffers: word spans, word hashes and word n-gram hashes without per-row Python."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

U64 = np.uint64
BLOCK = 1 << 20
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)
_rng = np.random.default_rng(20240607)
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_pow = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: bytes of words: ASCII letters, digits and every byte of a character beyond ASCII
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(97, 123), *range(65, 91), *range(128, 256)]] = True
#: what SQL calls the same words, after lower()
WORD_SQL = r"[0-9a-z\x{80}-\x{10ffff}]+"


def fresh_name(table: DataFrame, stem: str = "__new") -> str:
    """A column name that the table doesn't have, whatever the case of its names."""
    taken = {c.lower() for c in table.columns}
    while stem in taken:
        stem += "_"
    return stem


def quoted(names: Iterable[str]) -> list[str]:
    """Column names as Spark reads them, dots included."""
    return ["`" + n.replace("`", "``") + "`" for n in names]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i modulo 2^64 for i < n."""
    if len(_pow[0]) < n:
        size = max(n, BLOCK + 4096)
        for k, base in enumerate((_P, _PINV)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _pow[k] = np.multiply.accumulate(out)
    return _pow[0][:n], _pow[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and the n + 1 offsets of a text column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text is a range of its own."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def spans(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of ``table`` bytes that lie within a row."""
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = table[raw]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:n]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(offsets, starts, "right") - 1


def hash_sums(raw: np.ndarray) -> np.ndarray:
    """Prefix sums from which span_hashes reads any span's hash."""
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(BYTE_VALUE[raw] * powers(len(raw) + 1)[0][: len(raw)], out=sums[1:])
    return sums


def span_hashes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each span's bytes, equal for equal bytes anywhere."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = hash_sums(raw) if sums is None else sums
    return mix((sums[stops] - sums[starts]) * powers(len(raw) + 1)[1][starts] + (stops - starts).astype(np.uint64))


def hash_words(words: list[str]) -> np.ndarray:
    """span_hashes of whole strings."""
    data = [w.encode() for w in words]
    stops = np.cumsum([len(x) for x in data], dtype=np.int64)
    raw = np.frombuffer(b"".join(data), np.uint8)
    return span_hashes(raw, stops - np.array([len(x) for x in data], np.int64), stops)


def ngram_sets(raw: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct word n-gram hashes, sorted, as values and offsets.

    A row of fewer than ``n`` words has its whole word sequence as its only n-gram; one without words has none.
    """
    rows = len(offsets) - 1
    starts, stops, row = spans(raw, offsets)
    h = span_hashes(raw, starts, stops)
    per = np.bincount(row, minlength=rows)
    ends = np.cumsum(per)
    firsts = ends - per
    if len(h) >= n:
        g = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            g = mix(g + h[k : len(h) - n + 1 + k] * U64(2 * k + 1))
        keep = row[: len(g)] == row[n - 1 :]
        g, grow = g[keep], row[: len(keep)][keep]
    else:
        g, grow = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((per > 0) & (per < n))
    if len(short):
        s = np.full(len(short), 7, np.uint64)
        for k in range(n - 1):
            has = per[short] > k
            s[has] = mix(s[has] * U64(3) + h[firsts[short[has]] + k])
        g, grow = np.concatenate([g, s]), np.concatenate([grow, short])
    order = np.argsort(g, kind="stable")
    order = order[np.argsort(grow[order], kind="stable")]
    g, grow = g[order], grow[order]
    if len(g):
        keep = np.ones(len(g), bool)
        keep[1:] = (g[1:] != g[:-1]) | (grow[1:] != grow[:-1])
        g, grow = g[keep], grow[keep]
    return g, np.concatenate([[0], np.cumsum(np.bincount(grow, minlength=rows))]).astype(np.int64)
