"""Personal identifiers by bootstrapped contextual extraction.

Candidates are the spans of a text that could be identifiers at all: seeds wherever they stand in a token, tokens with
a digit or an at sign, values after ``=`` or ``:``, long capitals and hexadecimals, and runs that read as one number. A key
stays with its value only if it is a secret's; else it is the value's left neighbour. Each occurrence of a candidate has
*patterns*: its shape (character classes and run lengths, also with its key), its coarse shape after the word before it,
and its coarse shape before the word after it. Seed entities (a strict expression for each kind) give the first instances. Patterns
and instances form a bipartite graph that is scored in rounds, in Spark:

* a pattern's confidence for a kind is the share of its distinct instances that are known to be of that kind,
  less an allowance for few instances;
* an instance's score for a kind is the noisy-or over its patterns' confidences, the strongest of each type; what reaches
  ``ACCEPT`` becomes known and lends its patterns confidence in the next round.

So a pattern learned from seeds (``password=`` before hexadecimals, a prefix of fixed letters) finds identifiers that no
seed expression describes. All counts are over the whole corpus; known and new identifiers are returned by occurrence.

Defined results: null and empty texts have no occurrence; a text of any length is read whole; repeated rows report
their occurrences again, but a pattern counts distinct instances; an empty table gives an empty result; extra columns
are ignored by :func:`find` and kept, whatever their names, by :func:`redact`. Identifiers have ``MIN_LENGTH`` characters
at least (no seed has fewer) and no upper length; where two kinds tie in score the later name stands; a null id is found
and reported as null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.blocks import blocks, fresh_name, quoted, text_buffer
from factloom.session import drop_path, stage_table

ROUNDS, ACCEPT, ALLOWANCE = 4, 0.8, 0.5
MIN_LENGTH = 6  # characters of an identifier
SEED_TOKENS = 9  # white-space separated groups that a seed may have: an IBAN's
SEEDS = {
    "email": r"[A-Za-z0-9][\w.+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    "ip": r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)",
    "phone": r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}",
    "card": r"(?:\d{4}[ -]?){3}\d{4}",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?",
    "ssn": r"\d{3}-\d{2}-\d{4}",
    "secret": r"(?:AKIA|ASIA)[A-Z0-9]{16}|(?i:password|passwd|pwd|token|secret|api_?key)[\"']?\s*[=:]\s*[\"']?[^\s\"']{8,}[\"']?",
}
_SEED = {k: re.compile(v) for k, v in SEEDS.items()}
#: what is cut out of a stretch before anything else: keyed secrets and their like (an e-mail address by its at sign)
SECRET = re.compile(rf"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{{16}}(?![A-Za-z0-9])|{SEEDS['secret'].split('|', 2)[2]}")
AT = re.compile(r"@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?!\w)")
#: the other seeds within a token
INNER = {k: re.compile(f"(?<!{no}){SEEDS[k]}(?!{end})") for k, no, end in (("ip", r"[\w.]", r"\w|\.\d"), ("phone", r"[\w+]", r"\w"), ("card", r"\w", r"\w"), ("iban", r"\w", r"\w"), ("ssn", r"[\w-]", r"[\w-]"))}
#: a key before its value; a secret's key stays with a value of any form
KEY = re.compile(r"[^\s=:@\d][^\s=:@]*[ \t]*[=:][ \t]*(?!//)")
SECRET_KEY = re.compile(r"(?i:password|passwd|pwd|token|secret|api_?key)[\"']?[ \t]*[=:][ \t]*$")
VALUE = re.compile(r"\"[^\s\"]+\"|'[^\s']+'|[^\s\"'<>]+")
#: runs of tokens that read as one identifier: groups of digits, an IBAN's groups
DIGITS = re.compile(r"\+?\(?\d[\d().-]*(?:[ .-]\(?\d[\d().-]*)+")
GROUPS = re.compile(r"[A-Z]{2}\d{2}(?: [A-Z0-9]{1,4}(?!\w))+")
TOKEN = re.compile(r"\S+")
NEXT = re.compile(r"\W*(\S+)")
OPENING = "\"'(<[{"
OPEN, CLOSE = "\"'(<[{", "\"')>]},.;:!?|*#$%&"
MARK = np.zeros(256, bool)
MARK[[*range(48, 59), 61, 64]] = True
#: letters alone that may be an identifier: the beginnings of fixed letters, hexadecimals
LETTERS = re.compile(r"[A-Z]{11,}|[a-f]{8,}")
BYTES = re.compile(LETTERS.pattern.encode())
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
REACH = 2  # neighbouring tokens read with a marked one


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def seed_kind(text: str) -> str | None:
    """The kind whose seed expression the whole text matches; card numbers need their check digit."""
    for kind, exp in _SEED.items():
        if exp.fullmatch(text):
            if kind == "card" and not luhn(re.sub(r"\D", "", text)):
                continue
            return kind
    return None


def shape(text: str) -> str:
    """Character classes with run lengths: lower case, capitals, digits; hexadecimals and mixed runs are one class."""
    key = ""
    m = re.match(r"([A-Za-z_]\w*)([ \t]*[=:][ \t]*)", text)
    if m:
        key, text = m[1].lower() + m[2].strip(), text[m.end() :]
    out = []
    for run in re.finditer(r"[A-Za-z0-9]+|[^\x00-\x7f]+|.", text, re.S):
        s = run[0]
        if s.isascii() and s.isalnum():
            n = len(s)
            kind = "9" if s.isdigit() else "h" if n >= 8 and re.fullmatch(r"[0-9a-f]+", s) else "X" if s.isupper() or re.fullmatch(r"[A-Z0-9]+", s) else "a" if s.isalpha() else "m"
            out.append(kind + (str(n) if n >= 4 or kind in "hX" else ""))
        else:
            out.append("u" if not s.isascii() else s)
    return key + "|" + "".join(out)


def coarse(text: str) -> str:
    return re.sub(r"\d+", "", shape(text))


def patterns(text: str, left: str, right: str) -> list[tuple[str, str]]:
    """(type, pattern) of one occurrence. Beginnings of fixed letters are a pattern of their own."""
    out = [("shape", shape(text))]
    if left.endswith(("=", ":")):
        out.append(("shape", left.lower() + shape(text)))
    if len(left) > 1:
        out.append(("left", f"{left.lower()}_{coarse(text)}"))
    if len(right) > 1:
        out.append(("right", f"{coarse(text)}_{right.lower()}"))
    if re.fullmatch(r"[A-Z]{3}[A-Z0-9]{8,}", text):
        out.append(("start", f"{text[:4]}{len(text)}"))
    return out


def pieces(run: str) -> Iterator[tuple[int, int]]:
    """Where to cut a run of digit groups: into as many tokens of whole seeds as can be, by dynamic programming, and
    what lies between those. A run that is a seed, or holds none, is one piece."""
    tokens = [m.span() for m in re.finditer(r"\S+", run)]
    if len(tokens) < 2 or not re.match(r"[+(\d]|[A-Z]{2}\d{2}", run) or seed_kind(trimmed(run)):
        yield 0, len(run)
        return
    # best[i]: (tokens in seeds, fewer pieces) of the first i tokens, and the last piece's length in tokens (0: no seed)
    best: list[tuple[int, int, int]] = [(0, 0, 0)]
    for i in range(1, len(tokens) + 1):
        found = (best[i - 1][0], best[i - 1][1], 0)
        for n in range(1, min(SEED_TOKENS, i) + 1):
            if seed_kind(trimmed(run[tokens[i - n][0] : tokens[i - 1][1]])):
                found = max(found, (best[i - n][0] + n, best[i - n][1] - 1, n))
        best.append(found)
    cuts, i = [], len(tokens)
    while i:
        n = best[i][2]
        cuts.append((i - max(n, 1), i, n > 0))
        i -= max(n, 1)
    start = None
    for a, b, seed in reversed(cuts):
        if not seed:
            start = a if start is None else start
            continue
        if start is not None:
            yield tokens[start][0], tokens[a - 1][1]
            start = None
        yield tokens[a][0], tokens[b - 1][1]
    if start is not None:
        yield tokens[start][0], tokens[-1][1]


def trimmed(s: str) -> str:
    return s.rstrip("\"')>]},.;:!?|*#$%&").lstrip("\"'<[{")


def strict(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Keyed secrets and e-mail addresses, wherever they stand."""
    found = []
    for m in SECRET.finditer(text, a, b):
        x, y = m.span()
        end = x + len(m[0].rstrip(CLOSE))
        if y > end and not (text[y - 1] in "\"'" and re.search(r"[=:]\s*[\"']", m[0])) and seed_kind(text[x:end]):
            y = end
        found.append((x, y))
    done = a
    for m in AT.finditer(text, a, b):
        x = m.start()
        while x > done and (text[x - 1].isalnum() or text[x - 1] in "_.+-"):
            x -= 1
        while x < m.start() and not (text[x].isascii() and text[x].isalnum()):
            x += 1
        done = m.end()
        if x < m.start():
            found.append((x, done))
    found.sort()
    out: list[tuple[int, int]] = []
    for x, y in found:
        if not out or x >= out[-1][1]:
            out.append((x, y))
    return out


def inner(s: str) -> list[tuple[int, int]]:
    """Whole seeds within a token, from the left, of several the longest."""
    found = sorted((m.start(), -m.end()) for kind, exp in INNER.items() for m in exp.finditer(s) if kind != "card" or luhn(re.sub(r"\D", "", m[0])))
    out: list[tuple[int, int]] = []
    for x, y in found:
        if not out or x >= out[-1][1]:
            out.append((x, -y))
    return out


def loose(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    """Candidates between the strict ones: values without their keys, runs of groups cut into seeds, single tokens."""
    at, keyed = a, False
    while at < b:
        if text[at].isspace():
            at, keyed = at + 1, False
            continue
        if text[at] in "\"'<[{":
            at += 1
            continue
        key = KEY.match(text, at, b)
        if key:
            secret, run = SECRET_KEY.search(key[0]), DIGITS.match(text, key.end(), b)
            value = None if not secret or run and " " in run[0] else VALUE.match(text, key.end(), b)
            if value:
                yield from parts(text, at + secret.start(), value.end(), True)
                at = value.end()
            else:
                yield from parts(text, at, at + len(key[0].rstrip(" \t=:")), False)
                at, keyed = key.end(), True
            continue
        run = DIGITS.match(text, at, b) or GROUPS.match(text, at, b)
        if run and not run[0][0].isdigit() and run[0][0] not in "+(" and not any(seed_kind(trimmed(run[0][p:q])) for p, q in pieces(run[0])):
            run = None
        run = run or TOKEN.match(text, at, b)
        for p, q in pieces(run[0]):
            yield from parts(text, at + p, at + q, keyed)
        at, keyed = run.end(), False


def parts(text: str, x: int, y: int, keyed: bool) -> Iterator[tuple[int, int]]:
    """A span without what encloses it; where it is no seed but holds some, those and what lies between."""
    s = text[x:y]
    lead = len(s) - len(s.lstrip(OPEN)) if not s.startswith("(") or ")" not in s else 0
    tail = len(s) if s[-1:] in ("'", '"') and re.search(r"[=:][ \t]*[\"']", s) else len(s.rstrip(CLOSE))
    if tail - lead < MIN_LENGTH:
        return
    x, y, s = x + lead, x + tail, s[lead:tail]
    found = [] if seed_kind(s) else inner(s)
    if found:
        at = 0
        for p, q in [*found, (len(s), len(s))]:
            yield from parts(text, x + at, x + p, False)
            if p < q:
                yield x + p, x + q
            at = q
    elif keyed or re.search(r"[\d@]", s) or LETTERS.search(s):
        yield x, y


def word_before(text: str, low: int, x: int) -> str:
    """The token that ends before ``x``, without what opens a quotation or bracket; nothing before ``low`` is read."""
    while x > low and text[x - 1].isspace():
        x -= 1
    while x > low and text[x - 1] in OPENING:
        x -= 1
    start = x
    while start > low and not text[start - 1].isspace():
        start -= 1
    return text[start:x].lstrip(OPENING)


def word_after(text: str, y: int, high: int) -> str:
    """The token that begins after ``y``, from its first word character on; nothing from ``high`` on is read."""
    m = NEXT.match(text, y, high)
    return m[1] if m else ""


def candidates(text: str, marked: list[tuple[int, int]]) -> Iterator[tuple[int, int, str, str]]:
    """Start, end, word before and word after of each candidate; ``marked`` are spans of marked tokens and those near them.
    Words are looked for up to the candidates before and after, so what is read follows the text's length."""
    found: list[tuple[int, int]] = []
    for a, b in marked:
        at = a
        for p, q in [*strict(text, a, b), (b, b)]:
            found += [*loose(text, at, p), *([(p, q)] if q - p >= MIN_LENGTH else [])]
            at = q
    ends = [0, *(y for _, y in found)]
    starts = [*(x for x, _ in found[1:]), len(text)]
    for (x, y), low, high in zip(found, ends, starts):
        yield x, y, word_before(text, min(low, x), x), word_after(text, y, max(high, y))


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to candidate occurrences."""
    names = ["doc_id", "start", "stop", "entity", "seed", "types", "patterns"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
    schema = pa.schema(list(zip(names, kinds)))
    for batch in batches:
        raw, offs = text_buffer(batch.column(1))
        ids = batch.column(0).to_pylist()
        for a, b in blocks(offs):
            x, o = raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
            at = np.union1d(np.flatnonzero(MARK[x]), np.array([m.start() for m in BYTES.finditer(x.tobytes())], np.int64))
            if not len(at):
                continue
            rows: list[list] = [[] for _ in names]
            doc = np.searchsorted(o, at, "right") - 1
            for r in np.unique(doc):
                lo, hi = int(o[r]), int(o[r + 1])
                space = SPACE[x[lo:hi]]
                gaps = np.concatenate([[lo - 1], lo + np.flatnonzero(space & ~np.append(space[1:], False)), [hi]])  # the last of several
                k = np.unique(np.searchsorted(gaps, at[doc == r], "right") - 1)
                cut = np.flatnonzero(np.diff(k) > 2 * REACH)
                begin, end = k[np.concatenate([[0], cut + 1])], k[np.concatenate([cut, [len(k) - 1]])]
                data = x[lo:hi].tobytes()
                text = data.decode()
                plain = len(text) == len(data)
                marked = []
                for p, q in zip(begin, end):
                    s, e = int(gaps[max(0, p - REACH)]) + 1 - lo, int(gaps[min(len(gaps) - 1, q + 1 + REACH)]) - lo
                    marked.append((s, e) if plain else (len(data[:s].decode()), len(data[:e].decode())))
                for start, stop, left, right in candidates(text, marked):
                    s = text[start:stop]
                    found = patterns(s, left, right)
                    for col, v in zip(rows, (ids[a + r], start, stop, s, seed_kind(s), [f[0] for f in found], [f[1] for f in found])):
                        col.append(v)
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], schema=schema)


OCCURRENCE = "doc_id long, start int, stop int, entity string, seed string, types array<string>, patterns array<string>"


def bootstrap(occurrences: DataFrame, rounds: int = ROUNDS, accept: float = ACCEPT, allowance: float = ALLOWANCE) -> DataFrame:
    """``entity, kind, score``: what the pattern-instance graph holds to be identifiers after some rounds."""
    edges, edges_at = stage_table(occurrences.select("entity", F.explode(F.arrays_zip("types", "patterns")).alias("p")).select("entity", F.col("p.types").alias("type"), F.col("p.patterns").alias("pattern")).distinct(), "edges")
    seeds = occurrences.where("seed IS NOT NULL").select("entity", F.col("seed").alias("kind"), F.lit(1.0).alias("score")).distinct()
    known, old = stage_table(seeds, "known")
    drop = [edges_at]
    size = edges.groupBy("type", "pattern").agg(F.count("*").alias("n"))
    for _ in range(rounds):
        held = edges.join(known, "entity").groupBy("type", "pattern", "kind").agg(F.sum("score").alias("s"))
        confident = held.join(size, ["type", "pattern"]).select("type", "pattern", "kind", ((F.col("s") - F.lit(allowance)) / F.col("n")).alias("c")).where("s >= 3 AND c > 0.2")
        best = edges.join(confident, ["type", "pattern"]).groupBy("entity", "kind", "type").agg(F.max("c").alias("c"))
        # a neighbour alone says less than a shape
        weight = F.when(F.col("type").isin("shape", "start"), F.col("c")).otherwise(0.5 * F.col("c"))
        scored = best.groupBy("entity", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least(weight, F.lit(0.999)))))).alias("score")).where(F.col("score") >= accept)
        known, now = stage_table(seeds.unionByName(scored).groupBy("entity", "kind").agg(F.max("score").alias("score")), "known")
        drop.append(old)
        old = now
    drop_path(occurrences.sparkSession, *drop)
    return known.groupBy("entity").agg(F.max_by(F.struct("kind", "score"), F.struct("score", "kind")).alias("k")).select("entity", "k.kind", "k.score")


def find(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, start, stop, entity, kind, score, seeded``: every occurrence of a known or discovered identifier."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    occurrences, _ = stage_table(texts.mapInArrow(scan, OCCURRENCE), "occurrences")
    known = bootstrap(occurrences, **options)
    return occurrences.join(known, "entity").select("doc_id", "start", "stop", "entity", "kind", F.round("score", 6).alias("score"), F.col("seed").isNotNull().cast("int").alias("seeded"))


def redact(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every identifier replaced by its kind in brackets, ``n_chars`` adjusted where there is one."""
    found = find(docs.select(F.xxhash64("text").alias("doc_id"), "text"), **options)
    h, edits, new = (fresh_name(docs, n) for n in ("__h", "__edits", "__text"))
    # spans are those of a text, whatever its rows
    made = found.select(F.col("doc_id").alias(h), F.struct("start", "stop", "kind", "entity").alias("e")).groupBy(h).agg(F.array_sort(F.collect_set("e")).alias(edits))
    merged = F.aggregate(
        edits,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        # an edit made for another text of the same hash doesn't find its entity here
        lambda acc, e: F.when((e["start"] < acc["at"]) | (F.substr("text", e["start"] + 1, e["stop"] - e["start"]) != e["entity"]), acc).otherwise(
            F.struct(e["stop"].alias("at"), F.concat(acc["out"], F.substr("text", acc["at"] + 1, e["start"] - acc["at"]), F.lit("["), F.upper(e["kind"]), F.lit("]")).alias("out"))
        ),
        lambda acc: F.concat(acc["out"], F.substr("text", acc["at"] + 1, F.lit(2147483647))),
    )
    joined = docs.withColumn(h, F.xxhash64("text")).join(made, h, "left").withColumn(new, F.when(F.col(edits).isNull(), F.col("text")).otherwise(merged))
    out = {"text": F.col(new)}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col(edits).isNull(), F.col("n_chars")).otherwise(F.length(new).cast("long"))
    return joined.select(*[out[c].alias(c) if c in out else F.col(q) for c, q in zip(docs.columns, quoted(docs.columns))])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
