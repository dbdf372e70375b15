"""Token counts by finite-state transducers compiled from a byte-level BPE vocabulary.

Two deterministic transducers run one after the other.

* The *splitter* cuts text into pre-tokens (letters, numbers, other signs, white space, contractions) over
  character classes. A transition is annotated with the cuts it emits, at the current or at the previous
  character. Text is cut into equal chunks, all run in lockstep: each chunk's map from every entry state to its
  exit state is computed first, the maps are composed by a parallel prefix scan, and a second pass from the
  states so found emits the cuts. A document's end is a character class that returns every state to the start.
* The *counter* reads a pre-token's bytes. Its states are compiled when first met, from the vocabulary: the longest
  suffix that still begins a token, with the last token and the relative token count at each place where a token
  may begin. A transition is annotated with the tokens that reading its byte adds (below zero where a longer token
  replaces several). The token sequence of a prefix ends with the only token that is compatible with the one
  before it, so the count is that of the merge procedure, not an estimate.

Defined results: null and empty texts have no tokens; a text of any length is read whole, in a block of its own; rows are
counted one by one, so repeated rows and ids, and null ids, give a row each; an empty table gives an empty result; extra
columns, whatever their names, are ignored. The vocabulary is a file that every worker reads (``VOCABULARY`` by default).
"""

from __future__ import annotations

import base64
import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from factloom.llm.blocks import BLOCK, blocks, text_buffer

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CHUNK = 1024

# character classes
C_LETTER, C_STMD, C_R, C_V, C_L, C_E, C_NUMBER, C_OTHER, C_QUOTE, C_SPACE, C_WHITE, C_END = range(12)
# states: start, letters, numbers, others, one space, one other white, white run ending in a space, in other white,
# quote at a pre-token's start, quote and r, v, l, finished contraction
S_START, S_LET, S_NUM, S_OTH, S_1S, S_1W, S_RS, S_RW, S_Q, S_QR, S_QV, S_QL, S_DONE = range(13)
STATES, CLASSES = 13, 12
HERE, BEFORE = 1, 2
_WHITE = {9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}


def _plain(cls: int) -> int:
    """The state of a pre-token that begins with this class."""
    if cls <= C_E:
        return S_LET
    return {C_NUMBER: S_NUM, C_OTHER: S_OTH, C_QUOTE: S_Q, C_SPACE: S_1S, C_WHITE: S_1W}[cls]


def _transition(state: int, cls: int) -> tuple[int, int]:
    letter, white = cls <= C_E, cls in (C_SPACE, C_WHITE)
    if cls == C_END:
        return S_START, BEFORE if state in (S_QR, S_QV, S_QL) else 0
    if state in (S_START, S_DONE):
        return _plain(cls), HERE
    if state == S_LET:
        return (S_LET, 0) if letter else (_plain(cls), HERE)
    if state == S_NUM:
        return (S_NUM, 0) if cls == C_NUMBER else (_plain(cls), HERE)
    if state == S_OTH:
        return (S_OTH, 0) if cls in (C_OTHER, C_QUOTE) else (_plain(cls), HERE)
    if state in (S_1S, S_1W, S_RS, S_RW):
        if white:
            return (S_RS if cls == C_SPACE else S_RW), 0
        run = BEFORE if state in (S_RS, S_RW) else 0
        if state in (S_1S, S_RS):  # the last space joins what follows
            return (S_OTH if cls == C_QUOTE else _plain(cls)), run
        return _plain(cls), run | HERE
    if state == S_Q:
        if cls in (C_OTHER, C_QUOTE):
            return S_OTH, 0
        if cls == C_STMD:
            return S_DONE, 0
        if cls in (C_R, C_V, C_L):
            return {C_R: S_QR, C_V: S_QV, C_L: S_QL}[cls], 0
        return _plain(cls), HERE
    if (state in (S_QR, S_QV) and cls == C_E) or (state == S_QL and cls == C_L):
        return S_DONE, 0
    after, emitted = _transition(S_LET, cls)
    return after, emitted | BEFORE


@functools.cache
def splitter() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of every character, and next state and emission of ``state * CLASSES + class``."""
    table = np.full(0x110000, C_OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = C_LETTER
        elif kind == "N":
            table[c] = C_NUMBER
    table[list(_WHITE)] = C_WHITE
    for text, cls in (("stmd", C_STMD), ("r", C_R), ("v", C_V), ("l", C_L), ("e", C_E), ("'", C_QUOTE), (" ", C_SPACE)):
        table[[ord(x) for x in text]] = cls
    step = [_transition(s, c) for s in range(STATES) for c in range(CLASSES)]
    return table, np.array([x[0] for x in step], np.uint8), np.array([x[1] for x in step], np.uint8)


def compose_scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of chunk state maps (chunks x states), in log2(chunks) parallel steps."""
    maps = maps.copy()
    step = 1
    while step < len(maps):
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.int64), 1)
        step *= 2
    return maps


def cuts(classes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Whether a pre-token begins at each character of a stream of classes."""
    _, goto, emit = splitter()
    n = len(classes)
    rows = -(-n // chunk)
    grid = np.full(rows * chunk, C_END, np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(rows, chunk).T)
    # each chunk's map; entry states that have met are followed once
    state = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], rows, 1)
    at = 0
    while at < chunk and not (state == state[0]).all():
        state = goto[state.astype(np.int16) * CLASSES + grid[at]]
        at += 1
    one = state[0]
    for k in range(at, chunk):
        one = goto[one.astype(np.int16) * CLASSES + grid[k]]
    maps = np.repeat(one[:, None], STATES, 1) if at < chunk else np.ascontiguousarray(state.T)
    enter = np.zeros(rows, np.uint8)
    enter[1:] = compose_scan(maps)[:-1, S_START]
    out = np.empty((chunk, rows), np.uint8)
    one = enter
    for k in range(chunk):
        move = one.astype(np.int16) * CLASSES + grid[k]
        out[k] = emit[move]
        one = goto[move]
    marks = np.ascontiguousarray(out.T).reshape(-1)
    begin = (marks & HERE).astype(bool)
    begin[:-1] |= (marks[1:] & BEFORE).astype(bool)
    return begin[:n]


def pretokens(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """For each text, in order, its number and its pre-tokens."""
    table = splitter()[0]
    joined = "\0".join(texts) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    stops = np.cumsum(lengths)
    classes = table[codes]
    classes[stops - 1] = C_END
    begin = cuts(classes)
    begin[stops - 1] = True  # the separator ends the last pre-token
    at = np.flatnonzero(begin)
    last = np.searchsorted(at, stops - 1)
    where, first = at.tolist(), 0
    for i, to in enumerate(last.tolist()):
        yield i, [joined[x:y] for x, y in zip(where[first:to], where[first + 1 : to + 1])]
        first = to + 1


@functools.cache
def load_vocabulary(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int], below: int = 1 << 60) -> list[int]:
    """The merge procedure itself, for short strings; with ``below``, as far as merges of a lower rank go."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        if ranks.get(parts[best] + parts[best + 1], 1 << 60) >= below:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


class Counter:
    """The counting transducer of one vocabulary; states and transitions are kept once compiled."""

    MOST = 2_000_000  # transitions kept; past that the compiled part is dropped and compiled again as needed

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.text = {v: k for k, v in ranks.items()}
        self.prefixes = {k[:i] for k in ranks for i in range(1, len(k) + 1)}
        self.fits: dict[int, bool] = {}
        self.split: dict[int, tuple[int, int]] = {}
        self.reset()

    def reset(self) -> None:
        # key: (suffix, for each place in it (last token, count there less count here) or None); place 0 of a word has token -1
        self.keys: list[tuple] = [(b"", ((-1, 0),))]
        self.ids = {self.keys[0]: 0}
        self.moves: dict[int, tuple[int, int]] = {}

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one; a byte is twice itself."""
        found = self.split.get(token)
        if found is None:
            piece = self.text[token]
            parts = merge(piece, self.ranks, token) if len(piece) > 1 else [token, token]
            found = self.split[token] = (parts[0], parts[1])
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the two tokens' joined bytes gives these two: no merge across their border comes before
        the merges that made what lies on either side of it, undone from the last to the first."""
        if left < 0:
            return True
        key = left << 20 | right
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) > self.MOST:
                self.fits.clear()
            found = self.fits[key] = self._compatible(left, right)
        return found

    def _compatible(self, left: int, right: int) -> bool:
        before = 1 << 60
        while True:
            if self.ranks.get(self.text[left] + self.text[right], 1 << 60) < before:
                return False
            # the later merge of the two is undone; of equal ones the left one was made first
            undo_left = left > right
            for turn in (undo_left, not undo_left):
                token = left if turn else right
                if len(self.text[token]) > 1:
                    before = token if turn else token + 1
                    if turn:
                        left = self.halves(left)[1]
                    else:
                        right = self.halves(right)[0]
                    break
            else:
                return True

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        suffix, places = self.keys[state]
        longer = suffix + bytes((byte,))
        for k, place in enumerate(places):
            token = self.ranks.get(longer[k:])
            if place is not None and token is not None and self.compatible(place[0], token):
                delta = place[1] + 1
                break
        else:
            raise ValueError("the vocabulary has no token for this byte")
        first = next(k for k in range(len(longer) + 1) if not longer[k:] or longer[k:] in self.prefixes)
        kept = longer[first:]
        new = tuple(
            None if (p := places[first + k]) is None or kept[k:] not in self.prefixes else (p[0], p[1] - delta) for k in range(len(kept))
        ) + ((token, 0),)
        key = (kept, new)
        to = self.ids.get(key)
        if to is None:
            to = self.ids[key] = len(self.keys)
            self.keys.append(key)
        self.moves[state << 8 | byte] = found = (to, delta)
        return found

    def count(self, piece: bytes) -> int:
        if len(self.moves) > self.MOST:
            self.reset()
        state = total = 0
        get = self.moves.get
        for byte in piece:
            state, delta = get(state << 8 | byte) or self.compile(state, byte)
            total += delta
        return total


@functools.cache
def counter(path: str) -> Counter:
    return Counter(load_vocabulary(path))


class WordCounts(dict):
    """Pre-token to token count, filled by the transducer; bounded."""

    def __init__(self, path: str) -> None:
        self.counter = counter(path)

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        found = self.counter.count(word.encode("utf-8", "surrogatepass"))
        if len(word) < 64:
            self[word] = found
        return found


@functools.cache
def word_counts(path: str) -> WordCounts:
    return WordCounts(path)


def count_texts(texts: list[str], path: str = VOCABULARY) -> list[int]:
    known = word_counts(path)
    return [sum(map(known.__getitem__, words)) for _, words in pretokens(texts)]


def text_blocks(batch: pa.RecordBatch, column: int, limit: int = BLOCK) -> Iterator[tuple[int, int, list[str]]]:
    """Row ranges of about ``limit`` bytes and their texts; nulls are empty."""
    _, offs = text_buffer(batch.column(column))
    for a, b in blocks(offs, limit):
        yield a, b, [x or "" for x in batch.column(column).slice(a, b - a).to_pylist()]


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_tokens``: one row for each row of ``docs``, other columns ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_blocks(batch, 1):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(count_texts(texts, vocabulary), pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
