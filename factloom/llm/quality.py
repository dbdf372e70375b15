"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's features are read from its bytes (shares of capitals, digits, signs and
separators, word lengths, repeated words, length, its end) and stand beside those of the lines before and after it;
a 2 x 2 transition matrix couples neighbouring labels. Forward-backward gives each line's marginal probability of
being good, and a document's quality is their mean weighted by line length. The field is fitted by gradient ascent on
at most ``SAMPLE`` labelled documents, chosen by a hash of their id. Labels are of documents, so lines get theirs in two
steps (:func:`line_labels`): a field without transitions is fitted to the documents' labels, and what it says of single
lines changes those that plainly differ from their document, all but the line that says most for its label. The field is
then fitted to these, and learns from documents of both kinds of lines how one follows the other.

Defined results: null and empty texts, and those of empty lines only, have no lines, quality 0 and keep 0; a text of
any length is read whole; rows are scored one by one, so repeated ids and rows repeat and a null id stays; of different
texts under a labelled id the least is learned from, of different labels the greater; a quality at the threshold keeps;
without labels of both kinds every line is good; an empty table gives an empty result; extra columns, whatever their
names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.blocks import blocks, span_hashes, spans, text_buffer

SAMPLE, THRESHOLD, STEPS = 4_000, 0.5, 150
#: P(good) up to which a line of a good document is bad, and from which one of a bad document is good
PLAIN = 0.1, 0.9
FEATURES = 11
NOT_NEWLINE = np.ones(256, bool)
NOT_NEWLINE[[10, 13]] = False
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, np.int32)
    out[[ord(c) for c in chars]] = 1
    return out


UPPER, DIGIT, SIGN, BAR = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789"), _class("#$%&*@^~<>{}[]\\=+_/"), _class("|!")
LETTER = _class("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
LETTER[192:] = 1  # a first byte stands for its character
HEAD = np.ones(256, np.int32)
HEAD[128:192] = 0
END = _class(".!?\"')")


def line_features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines x FEATURES), length in characters and row of every line that isn't empty."""
    starts, stops, row = spans(raw, offsets, NOT_NEWLINE)
    if not len(starts):
        return np.zeros((0, FEATURES)), np.zeros(0), row
    bounds = np.stack([starts, stops], 1).reshape(-1)

    def total(table: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.append(table[raw], 0), bounds)[::2].astype(np.float64)

    length = np.maximum(total(HEAD), 1)
    w0, w1, _ = spans(raw, offsets, NOT_SPACE)
    h = span_hashes(raw, w0, w1)
    line = np.searchsorted(starts, w0, "right") - 1
    words = np.maximum(np.bincount(line, minlength=len(starts)), 1)
    again = np.zeros(len(h))
    again[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    order = np.lexsort((h, line))
    seen = np.zeros(len(h))
    seen[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (line[order[1:]] == line[order[:-1]])
    size = (w1 - w0).astype(np.float64)
    repeats = np.bincount(line, again, len(starts)) / words
    common = np.bincount(line, seen, len(starts)) / words
    x = np.stack(
        [
            total(UPPER) / length,
            total(DIGIT) / length,
            np.minimum(total(SIGN) / words, 3),
            np.minimum(total(BAR) / words, 3),
            total(LETTER) / length,
            repeats,
            common * np.minimum(words / 20, 1),
            np.minimum(np.bincount(line, size, len(starts)) / words, 20) / 10,
            np.log1p(length) / 5,
            END[raw[stops - 1]],
            np.ones(len(starts)),
        ],
        1,
    )
    return x, length, row


def with_neighbours(x: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Each line's features, then those of the line before and the line after in its document (0 where none)."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    same = (row[1:] == row[:-1])[:, None]
    before[1:], after[:-1] = x[:-1] * same, x[1:] * same
    return np.concatenate([x, before, after], 1)


def marginals(scores: np.ndarray, transition: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over all documents at once: P(good) of each line, expected transition counts, log Z.

    ``scores`` are log potentials (lines x 2). Documents are in lockstep: step k is the k-th line of each that has one.
    """
    n = len(row)
    if not n:
        return np.zeros(0), np.zeros((2, 2)), 0.0
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    size = np.diff(np.append(first, n))
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    steps = [first[: np.searchsorted(-size, -k, "left")] + k for k in range(int(size[0]))]
    a, b = scores.copy(), np.zeros_like(scores)
    for at in steps[1:]:
        a[at] += np.logaddexp(a[at - 1, :1] + transition[0], a[at - 1, 1:] + transition[1])
    for at in steps[:0:-1]:
        s = scores[at] + b[at]
        b[at - 1] = np.logaddexp(transition[:, 0] + s[:, :1], transition[:, 1] + s[:, 1:])
    logz = np.logaddexp(a[:, 0] + b[:, 0], a[:, 1] + b[:, 1])
    good = np.exp(np.minimum(a[:, 1] + b[:, 1] - logz, 0))
    pairs = np.zeros((2, 2))
    inner = np.flatnonzero(np.concatenate([[False], row[1:] == row[:-1]]))
    for i in (0, 1):
        for j in (0, 1):
            pairs[i, j] = np.exp(a[inner - 1, i] + transition[i, j] + scores[inner, j] + b[inner, j] - logz[inner]).sum()
    return good, pairs, float(logz[first].sum())


def line_labels(good: np.ndarray, row: np.ndarray, label: np.ndarray, plain: tuple[float, float] = PLAIN) -> np.ndarray:
    """Labels of lines from those of their documents: lines that plainly differ change, but not all of a document."""
    out = np.where((label == 1) & (good <= plain[0]), 0, np.where((label == 0) & (good >= plain[1]), 1, label))
    if len(row):
        # the line that says most for its document's label keeps it
        order = np.lexsort((np.where(label == 1, -good, good), row))
        first = order[np.concatenate([[True], row[order][1:] != row[order][:-1]])]
        out[first] = label[first]
    return out


def fit(x: np.ndarray, row: np.ndarray, label: np.ndarray, steps: int = STEPS, rate: float = 0.1, decay: float = 1e-3, chain: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Weights of P(good) features and transition matrix (0 without ``chain``), by Adam on the mean conditional log
    likelihood of lines."""
    w, t = np.zeros(x.shape[1]), np.zeros((2, 2))
    if not len(label) or label.min() == label.max():
        w[FEATURES - 1] = 10.0
        return w, t
    inner = np.flatnonzero(np.concatenate([[False], row[1:] == row[:-1]]))
    real = np.zeros((2, 2))
    np.add.at(real, (label[inner - 1], label[inner]), 1)
    m = [np.zeros_like(w), np.zeros_like(t)]
    v = [np.zeros_like(w), np.zeros_like(t)]
    n = len(label)
    for k in range(1, steps + 1):
        scores = np.stack([np.zeros(n), x @ w], 1)
        good, pairs, _ = marginals(scores, t, row)
        grads = [x.T @ (label - good) / n - decay * w, (real - pairs) / n - 0.05 * t if chain else np.zeros((2, 2))]
        for p, g, i in ((w, grads[0], 0), (t, grads[1], 1)):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            p += rate * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.999**k)) + 1e-8)
    return w, t


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Fit on the lines of at most ``sample`` labelled documents; only their features reach the driver."""
    chosen = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = text_buffer(batch.column(0))
            label = batch.column(1).to_numpy(zero_copy_only=False)
            ids = batch.column(2).to_numpy(zero_copy_only=False)
            for a, b in blocks(offs):
                x, _, row = line_features(raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                for r in np.unique(row):
                    one = x[row == r].astype(np.float32)
                    yield pa.RecordBatch.from_arrays([pa.array([ids[a + r]]), pa.array([label[a + r]], pa.int32()), pa.array([one.tobytes()], pa.binary())], ["doc_id", "quality", "lines"])

    # the sample is bounded, so it can be sent whole
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen.withColumn("doc_id", F.col("doc_id").cast("long"))), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("quality").alias("quality")).select("text", "quality", "doc_id")
    found = texts.mapInArrow(run, "doc_id long, quality int, lines binary").toArrow().sort_by("doc_id")
    parts = [np.frombuffer(x.as_py(), np.float32).reshape(-1, FEATURES) for x in found.column("lines")]
    if not parts:
        return fit(np.zeros((0, 3 * FEATURES)), np.zeros(0, np.int64), np.zeros(0, np.int64))
    sizes = [len(p) for p in parts]
    row = np.repeat(np.arange(len(parts)), sizes)
    x = np.concatenate(parts).astype(np.float64)
    x, label = with_neighbours(x, row), np.repeat(found.column("quality").to_numpy(), sizes).astype(np.int64)
    alone, _ = fit(x, row, label, chain=False)
    return fit(x, row, line_labels(1 / (1 + np.exp(-np.clip(x @ alone, -500, 500))), row, label))


def classify(docs: DataFrame, weights: np.ndarray, transition: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, quality, keep, n_lines, n_good``: one row for each row of ``docs``."""
    schema = pa.schema([("doc_id", pa.int64()), ("quality", pa.float64()), ("keep", pa.int32()), ("n_lines", pa.int32()), ("n_good", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = text_buffer(batch.column(1))
            for a, b in blocks(offs):
                x, length, row = line_features(raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                x = with_neighbours(x, row) if len(x) else np.zeros((0, 3 * FEATURES))
                good, _, _ = marginals(np.stack([np.zeros(len(x)), x @ weights], 1), transition, row)
                n = np.bincount(row, minlength=b - a)
                quality = np.bincount(row, good * length, b - a) / np.maximum(np.bincount(row, length, b - a), 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(np.round(quality, 6)),
                        pa.array(((quality >= threshold) & (n > 0)).astype(np.int32)),
                        pa.array(n.astype(np.int32)),
                        pa.array(np.bincount(row, good >= 0.5, b - a).astype(np.int32)),
                    ],
                    schema=schema,
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, quality double, keep int, n_lines int, n_good int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return classify(docs, *learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
