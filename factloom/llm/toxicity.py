"""Toxicity by noisy-channel deobfuscation.

A toxic writer's word passes a channel that swaps letters for look-alikes, spaces letters out and repeats them. What
was meant is read back by Viterbi search over a character lattice: each sign offers the letters it may stand for (with
a channel cost), a run of a letter offers one or two of them, single letters with separators offer a word border between
any two. Paths are scored by two sources of words: a character trigram language model, counted over the whole corpus, and
with weight ``SOURCE`` the lexicon, each of its words as likely as another. The best path alone is what was meant: a
lexicon word that is spelled at too great a cost loses to a likelier clean word. A word that is plain but for a letter
twice, as many words are, is read otherwise than written only where the language model alone prefers that.

Signs that can only stand for themselves leave nothing to search, so lattices are built only for words with a look-alike
anywhere, a letter doubled, or three single letters with any separators; they are searched only where some path has a
lexicon word or beginning at all (no other could be scored), and each distinct one once a task. Numbers of digits alone
are left as numbers. Letters beyond Latin are one symbol of the language model; lexicon words in them are read as others.

Restored words are scored by a lexicon learned from labelled documents: for each word of ``MIN_WORD`` letters at least, and
each beginning that several words share, in how many distinct contexts (left neighbours) it stands in toxic and in clean
documents, so that copies of one text don't count as evidence.
A document's score is the noisy-or over the evidence of its distinct lexicon words; it is toxic from ``THRESHOLD`` on.
The lexicon is fitted on at most ``SAMPLE`` labelled documents, chosen by a hash of their id; all that they show is kept.

Defined results: null and empty texts score 0; a text, word or spaced run of any length is read whole; repeated rows and
ids are scored row by row; an id labelled twice is toxic if once it is; without labels the lexicon is empty and every
score 0; of equally likely readings the first in the order of the lattice counts; an empty table gives an empty result;
extra columns, whatever their names, are ignored by :func:`score` and kept by :func:`reject`.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.blocks import blocks, fresh_name, hash_sums, hash_words, span_hashes, spans, text_buffer

SAMPLE, THRESHOLD, CONTEXTS, PURITY, SOURCE = 20_000, 0.95, 4, 12.0, 0.05
MIN_WORD, MIN_STEM, MAX_STEM = 3, 4, 8
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "*": "aeiou", "€": "e", "£": "l",
}
#: log costs of the channel: a swapped sign, a letter repeated once more than meant, a sign dropped
SWAP, REPEAT, DROP = -1.0, -0.7, -4.0
SIGNS = "".join(LOOKALIKES)
_ALPHABET = "\0abcdefghijklmnopqrstuvwxyzßàáâäãåæçèéêëìíîïñòóôöõøùúûüýÿœ"
SYMBOLS = len(_ALPHABET) + 1  # one for every other letter
INDEX = {c: i for i, c in enumerate(_ALPHABET)}
_S = re.escape(SIGNS)
_SEP = rf"(?:[^\w{_S}]|[_*])+"
_ONE = rf"[^\W_{_S}]|[{_S.replace(re.escape('*'), '')}]"
SPACED = re.compile(rf"(?:(?:{_ONE}){_SEP}){{2,}}(?:{_ONE})")
#: a word with a look-alike anywhere that isn't a number; a letter twice; three single signs with any separators
SUSPECT = re.compile(rf"(?<![\w{_S}])(?!\d+(?![\w{_S}]))(?=[^{_S}\W]*[{_S}])[\w{_S}]{{3,}}|\b(?=\w*?([^\W\d_])\1)\w{{4,}}\b|(?<!\w){SPACED.pattern}(?!\w)")
#: bytes that may begin one: a quick test of whole texts
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
SIGN = np.zeros(256, bool)
SIGN[[ord(c) for c in SIGNS if ord(c) < 128]] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
CASE = np.arange(256, dtype=np.uint8)
CASE[65:91] += 32


def suspicious(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows in which SUSPECT may match, by bytes alone (no row with a match of letters is missed)."""
    rows = np.zeros(len(offsets) - 1, bool)
    if len(raw) < 4:
        return rows
    low, letter, sign = CASE[raw], LETTER[raw], SIGN[raw]
    hit = np.zeros(len(raw), bool)
    other = letter | sign | (raw == 95)
    hit[:-1] |= (sign[:-1] & other[1:]) | (other[:-1] & sign[1:]) | (letter[:-1] & (low[:-1] == low[1:]))
    for n in (2, 3, 4):  # a character of n bytes twice
        same = np.concatenate([raw[:-n] == raw[n:], np.zeros(n, bool)])
        run = same.copy()
        for k in range(1, n):
            run[:-k] &= same[k:]
            run[-k:] = False
        hit |= run & (raw >= 0xC0)
    # three letters, digits or signs that stand alone, as far as bytes tell
    plain = (letter | DIGIT[raw]) & (raw < 0x80)
    after, before = np.ones(len(raw), bool), np.ones(len(raw), bool)
    after[:-1], before[1:] = ~plain[1:], ~plain[:-1]
    single = (plain & after & before) | (sign & ~plain)
    high = raw >= 0xC0
    at = np.flatnonzero(single | high)
    if len(at) > 2:
        row = np.searchsorted(offsets, at, "right") - 1
        hit[at[2:][row[2:] == row[:-2]]] = True
    found = np.flatnonzero(hit)
    rows[np.unique(np.searchsorted(offsets, found, "right") - 1)] = True
    return rows


class Model:
    """Character trigram log probabilities, add-half smoothed, as a table of SYMBOLS^3."""

    def __init__(self, counts: np.ndarray) -> None:
        c = counts.astype(np.float64).reshape(SYMBOLS, SYMBOLS, SYMBOLS) + 0.5
        self.log = np.log(c / c.sum(2, keepdims=True)).tolist()

    def decode(self, options: list[list[tuple[str, float]]], source: Source | None = None, spaced: bool = False) -> tuple[str, float]:
        """The best string through a lattice: at each place one of (string, cost), words from the language model or the
        source, one word or (``spaced``) words with borders after any place."""
        # of each state the score and the pieces so far, as (those before, piece)
        free: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        held: dict[int, tuple[float, tuple | None, dict]] = {id(source.root): (0.0, None, source.root)} if source else {}
        if not options:
            return "", self.log[0][0][0]
        for k, choice in enumerate(options):
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, back) in free.items():
                for piece, cost in choice:
                    x, y, s = a, b, score + cost
                    for c in piece:
                        z = INDEX.get(c, SYMBOLS - 1)
                        s += self.log[x][y][z]
                        x, y = y, z
                    old = after.get((x, y))
                    if old is None or s > old[0]:
                        after[x, y] = (s, (back, piece) if piece else back)
            inside: dict[int, tuple[float, tuple | None, dict]] = {}
            for score, back, node in held.values():
                for piece, cost in choice:
                    n = node
                    for c in piece:
                        n = n.get(c)
                        if n is None:
                            break
                    if n is not None and ((old := inside.get(id(n))) is None or score + cost > old[0]):
                        inside[id(n)] = (score + cost, (back, piece) if piece else back, n)
            free, held = after, inside
            if not spaced and k + 1 < len(options):
                continue
            ended = [(s + self.log[a][b][0], back) for (a, b), (s, back) in free.items()]
            if source:
                ended += [(s + source.prior, back) for s, back, n in held.values() if "" in n]
            score, back = max(ended, key=lambda e: e[0])
            if k + 1 == len(options):
                break
            if score > free.get((0, 0), (-np.inf,))[0]:
                free[0, 0] = (score, (back, " "))
            if source and score > held.get(id(source.root), (-np.inf,))[0]:
                held[id(source.root)] = (score, (back, " "), source.root)
        pieces = []
        while back:
            back, piece = back
            pieces.append(piece)
        return "".join(reversed(pieces)), score


class Source:
    """The lexicon as a source of words: any of them, equally likely; and the beginnings that count."""

    def __init__(self, words: Iterable[str], stems: Iterable[str] = (), weight: float = SOURCE) -> None:
        words = set(words)
        self.root, self.stems = trie(words), trie(stems)
        self.prior = float(np.log(weight / max(1, len(words))))


def lattice(token: str, spaced: bool = False) -> list[list[tuple[str, float]]]:
    """The places of a token and what each may stand for; in a spaced one, where a border may follow any sign, each sign
    has a place and one like that before it may be nothing."""
    token = token.lower()
    out: list[list[tuple[str, float]]] = []
    if spaced:
        for k, c in enumerate(token):
            (choice,) = lattice(c)
            out.append(choice + [("", REPEAT)] if k and token[k - 1] == c else choice)
        return out
    for run in re.finditer(r"(.)\1*", token, re.S):
        c, n = run[1], len(run[0])
        if c in LOOKALIKES:
            swaps = [(x, SWAP - (0.5 if len(LOOKALIKES[c]) > 2 else 0)) for x in LOOKALIKES[c]]
            out.append([(x * k, (s + (n - k) * REPEAT)) for x, s in swaps for k in sorted({1, min(n, 2)})] + [("", DROP)])
        elif c.isalpha():
            out.append([(c * k, (n - k) * REPEAT) for k in sorted({1, min(n, 2)})])
        else:
            out.append([("", 0.0)])
    return out


def trie(words: Iterable[str]) -> dict:
    """Words by their letters; the whole word stands under the empty string."""
    root: dict = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[""] = w
    return root


def reached(options: list[list[tuple[str, float]]], root: dict, within: bool = False, begins: bool = False) -> set[str]:
    """The words of a trie that some path of the lattice is, has in it (``within``) or begins with (``begins``)."""
    found: set[str] = set()
    nodes = {id(root): root}
    for choice in options:
        if within:
            nodes[id(root)] = root
        after: dict[int, dict] = {}
        for node in nodes.values():
            for piece, _ in choice:
                n = node
                for c in piece:
                    n = n.get(c)
                    if n is None:
                        break
                    if begins and "" in n:
                        found.add(n[""])
                if n is not None:
                    after[id(n)] = n
        nodes = after
        if within:
            found |= {n[""] for n in nodes.values() if "" in n}
        elif not nodes:
            break
    return found if within or begins else {n[""] for n in nodes.values() if "" in n}


def readings(token: str, model: Model, source: Source) -> list[str]:
    """The words that a suspicious span is restored to: those of the best path. Where no path has a word or beginning of
    the lexicon nothing is sought, and the span is itself."""
    token = token.lower()
    spaced = bool(SPACED.fullmatch(token))
    options = lattice(re.sub(rf"[^\w{_S}]|_", "", token) if spaced else token, spaced)
    if not reached(options, source.root, within=spaced) and not reached(options, source.stems, within=spaced, begins=True):
        return [token]
    doubled = not spaced and not any(c in LOOKALIKES for c in token) and not re.search(r"(.)\1\1", token)
    return model.decode(options, None if doubled else source, spaced)[0].split()


def spells(word: str, options: list[list[tuple[str, float]]]) -> bool:
    """Whether some path of the lattice is ``word``."""
    reach = {0}
    for choice in options:
        reach = {at + len(p) for at in reach for p, _ in choice if word.startswith(p, at)}
        if not reach:
            return False
    return len(word) in reach


def holds(word: str, options: list[list[tuple[str, float]]]) -> bool:
    """Whether some path of the lattice has ``word`` in it: spaced words follow one another without a border."""
    reach: set[int] = set()
    for choice in options:
        reach = {at + len(p) for at in reach | {0} for p, _ in choice if (p or at) and word.startswith(p, at)}
        if len(word) in reach:
            return True
    return False


def restore(text: str, model: Model, known: Iterable[str] = ()) -> str:
    """The text with every suspicious span replaced by what it is read as."""
    source = Source(known)
    return SUSPECT.sub(lambda m: " ".join(readings(m[0], model, source)), text)


def corpus_trigrams(docs: DataFrame) -> np.ndarray:
    """Character trigram counts of all words of all texts."""
    codes = np.full(0x110000, 0, np.uint8)
    for c, i in INDEX.items():
        codes[ord(c)] = codes[ord(c.upper()) if len(c.upper()) == 1 else ord(c)] = i
    two = np.zeros((256, 256), np.uint8)  # of two-byte characters
    for c in range(0x80, 0x800):
        b = chr(c).encode()
        two[b[0], b[1]] = codes[c] or (SYMBOLS - 1 if chr(c).isalpha() else 0)
    one = codes[:256].copy()
    one[128:] = 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            raw, offs = text_buffer(batch.column(0))
            for a, b in blocks(offs):
                x = raw[offs[a] : offs[b]]
                if len(x) < 2:
                    continue
                s = one[x]
                lead = np.flatnonzero(x[:-1] >= 0xC2)
                s[lead] = np.where(x[lead] < 0xE0, two[x[lead], x[lead + 1]], SYMBOLS - 1)
                s = s[x & 0xC0 != 0x80].astype(np.int32)
                keep = np.ones(len(s), bool)
                keep[1:] = (s[1:] != 0) | (s[:-1] != 0)  # word borders once
                s = np.concatenate([[0], s[keep], [0]]).astype(np.int32)
                # the border before a word counts twice in the model
                first = np.flatnonzero((s[:-1] == 0) & (s[1:] != 0))
                total += np.bincount(s[first + 1], minlength=SYMBOLS**3)
                tri = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
                total += np.bincount(tri[s[1:-1] != 0], minlength=SYMBOLS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["at", "n"])

    out = np.zeros(SYMBOLS**3, np.int64)
    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out


def learn_lexicon(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, contexts: int = CONTEXTS, purity: float = PURITY) -> dict[str, float]:
    """Toxic words, and toxic beginnings of words (``stem*``), with their evidence, from at most ``sample`` labelled
    documents: the share of their contexts that are toxic. Beginnings need ``2 * contexts`` and several words."""
    chosen = labels.select(F.col("doc_id").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = re.findall(r"[^\W_]+", (text or "").lower())
                pairs = sorted({(w, v) for v, w in zip(["", *words], words) if len(w) >= MIN_WORD})
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs]), pa.array([p[1] for p in pairs]), pa.array([toxic] * len(pairs), pa.int32())], schema=schema)

    schema = pa.schema([("word", pa.string()), ("left", pa.string()), ("toxic", pa.int32())])
    # the sample is bounded, so it can be sent whole
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    seen = texts.mapInArrow(run, "word string, left string, toxic int").distinct()
    per = seen.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    stems = F.transform(F.sequence(F.lit(MIN_STEM), F.lit(MAX_STEM)), lambda k: F.when(F.length("word") > k, F.concat(F.substr("word", F.lit(1), k), F.lit("*"))))
    features = F.concat(F.array(F.col("word")), stems)
    counts = per.select(F.explode(features).alias("feature"), "t", "c").where("feature IS NOT NULL").groupBy("feature").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.count(F.when(F.col("t") > 0, 1)).alias("words"))
    stem = F.col("feature").endswith("*")
    strong = counts.where((F.col("t") >= F.when(stem, 2 * contexts).otherwise(contexts)) & (F.col("t") >= purity * F.col("c")) & (~stem | (F.col("words") >= 4)))
    found = {r["feature"]: (r["t"], r["c"]) for r in strong.orderBy(F.desc("t"), "feature").collect()}  # of a bounded sample
    # of beginnings that stand for the same words, the longest
    same = {f[:k] + "*" for f, (t, _) in found.items() if f.endswith("*") for k in range(MIN_STEM, len(f) - 1) if t >= 0.9 * found.get(f[:k] + "*", (1 << 60,))[0]}
    return {f: (t + 0.5) / (t + c + 1.0) for f, (t, c) in found.items() if f not in same}


class Lexicon:
    """Log of what each feature leaves of innocence, by hash of its bytes and by string."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.words = {w: float(np.log1p(-v)) for w, v in lexicon.items() if not w.endswith("*")}
        self.stems = {w[:-1]: float(np.log1p(-v)) for w, v in lexicon.items() if w.endswith("*")}
        self.tables = [(None, *self.table(self.words))]
        sizes = sorted({len(w.encode()) for w in self.stems})
        self.tables += [(n, *self.table({w: v for w, v in self.stems.items() if len(w.encode()) == n})) for n in sizes]

    @staticmethod
    def table(found: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
        h = hash_words(list(found)) if found else np.zeros(0, np.uint64)
        order = np.argsort(h)
        return h[order], np.array(list(found.values()), np.float64)[order]

    def of(self, word: str) -> float:
        return min(self.words.get(word, 0.0), min((self.stems.get(word[:k], 0.0) for k in range(MIN_STEM, min(MAX_STEM + 1, len(word)))), default=0.0))

    def logs(self, raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of every word: its hash and the least log of its features, 0 where it has none."""
        best = np.zeros(len(starts))
        sums = hash_sums(raw)
        whole = span_hashes(raw, starts, stops, sums=sums)
        for n, hashes, values in self.tables:
            if not len(hashes):
                continue
            which = np.arange(len(starts)) if n is None else np.flatnonzero(stops - starts > n)
            h = whole if n is None else span_hashes(raw, starts[which], starts[which] + n, sums=sums)
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            found = np.flatnonzero(hashes[at] == h)
            best[which[found]] = np.minimum(best[which[found]], values[at[found]])
        return whole, best


def score(docs: DataFrame, lexicon: dict[str, float], trigrams: np.ndarray) -> DataFrame:
    """``doc_id, score, toxic, n_words, n_restored``: evidence of all distinct lexicon words, plain or restored."""
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, trigrams))  # what a bounded sample shows, SYMBOLS^3 counts
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("toxic", pa.int32()), ("n_words", pa.int32()), ("n_restored", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, counts = shared.value
        model, known = Model(counts), Lexicon(lexicon)
        source = Source(known.words, known.stems)
        cache: dict[str, list[tuple[np.uint64, float]]] = {}
        for batch in batches:
            texts = batch.column(1)  # in lower case
            raw, offs = text_buffer(texts)
            for a, b in blocks(offs):
                x, o = raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
                starts, stops, row = spans(x, o)
                whole, logs = known.logs(x, starts, stops)
                hit = np.flatnonzero(logs)
                rows, hashes, values = [row[hit]], [whole[hit]], [logs[hit]]
                restored = np.zeros(b - a, np.int32)
                for i in np.flatnonzero(suspicious(x, o)) if lexicon else ():
                    for m in SUSPECT.finditer(texts[a + int(i)].as_py()):
                        token = m[0]
                        meant = cache.get(token)
                        if meant is None:
                            if len(cache) > 200_000:
                                cache.clear()
                            found = [w for w in readings(token, model, source) if w != token and known.of(w) < 0]
                            meant = cache[token] = list(zip(hash_words(found), map(known.of, found))) if found else []
                        for h, value in meant:
                            restored[i] += 1
                            rows.append([i]), hashes.append([h]), values.append([value])
                r, h, v = np.concatenate(rows).astype(np.int64), np.concatenate(hashes).astype(np.uint64), np.concatenate(values)
                order = np.lexsort((h, r))
                r, h, v = r[order], h[order], v[order]
                first = np.ones(len(r), bool)
                first[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
                n = np.bincount(r[first], minlength=b - a)
                value = np.round(1 - np.exp(np.bincount(r[first], v[first], minlength=b - a)), 9)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(value), pa.array((value >= THRESHOLD).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(restored)], schema=schema
                )

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(text).alias("low")).mapInArrow(run, "doc_id long, score double, toxic int, n_words int, n_restored int")


def score_documents(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """Scores of ``docs``, with lexicon and language model from ``corpus`` (``docs`` itself where not given)."""
    corpus = docs if corpus is None else corpus
    lexicon = learn_lexicon(corpus, labels, sample)
    return score(docs, lexicon, corpus_trigrams(corpus))


def reject(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without the rows whose document is toxic; rows without id stay."""
    gone = fresh_name(docs)
    toxic = score_documents(docs, labels, sample=sample).where("toxic = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(toxic, docs["doc_id"] == F.col(gone), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
