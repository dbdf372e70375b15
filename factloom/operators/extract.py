"""Texts to subject-predicate-object facts, coreference, and training records."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as K

from factloom import schema
from factloom.functions import text as T

COPULA = frozenset("are be been being is was were".split())
ROLES = frozenset("author ceo chair chairman creator director editor founder governor head leader manager mayor member owner president professor secretary".split())
IRREGULAR = frozenset("begun born built found given held known led made put sent set taken written".split())
PLACED = frozenset("based born located situated".split())
NOT_VERBS = frozenset("and as at but by for from in of on or that to which who with".split())
LEADING = frozenset("at by for from in on to with".split())
PASSIVE = frozenset("at by from in of on to with".split())
ARTICLES = frozenset("a an the".split())


def _complement(tokens: list[str]) -> str:
    while tokens and tokens[0].lower() in ARTICLES:
        tokens = tokens[1:]
    return " ".join(tokens).rstrip(".,;:!?")


def _copula(after: list[str]) -> tuple[str, str]:
    first, second = after[0].lower(), after[1].lower() if len(after) > 1 else ""
    if first in ROLES and second == "of" and len(after) > 2:
        return f"{first}_of", _complement(after[2:])
    if second in PASSIVE and (first in IRREGULAR or first.endswith("ed")):
        return (f"{first}_{second}" if first in PLACED else first), _complement(after[2:])
    if first in ARTICLES:
        return ("is" if first == "the" else "is_a"), _complement(after[1:])
    return "is", _complement(after)


def _subject(tokens: list[str]) -> int:
    """How many tokens the subject takes: a pronoun, or capitalised words that may be joined."""
    if tokens[0] in ("He", "She", "They", "It") or (tokens[0].lower() in ("he", "she", "they", "it") and tokens[0][0].isupper()):
        return 1
    n = 0
    while n < len(tokens):
        head = tokens[n].rstrip(".,")[:1]
        joins = n > 0 and tokens[n].lower() in ("and", "&") and n + 1 < len(tokens) and tokens[n + 1][:1].isupper()
        if not (head.isalpha() and head.isupper()) and not joins:
            break
        n += 1
    return n


def sentence_facts(sentence: str) -> Iterator[tuple[str, str, str]]:
    """(subject, predicate, object) of one sentence."""
    tokens = sentence.strip().rstrip(".!?").split()
    n = _subject(tokens) if len(tokens) > 1 else 0
    rest = tokens[n:]
    if not n or not rest:
        return
    subject = " ".join(tokens[:n]).rstrip(",")
    low = [t.lower() for t in rest]
    if (at := min((low.index(c) for c in COPULA.intersection(low)), default=0)) > 0:  # nouns before a copula belong to the subject
        subject, rest = f"{subject} {' '.join(rest[:at])}", rest[at:]
    verb = 0
    while verb < len(rest) and rest[verb].lower() not in COPULA and (not rest[verb].isalpha() or rest[verb].lower() in NOT_VERBS):
        verb += 1
    if verb + 1 >= len(rest):
        return
    word, after = rest[verb].lower(), rest[verb + 1 :]
    if word in COPULA:
        predicate, obj = _copula(after)
    else:
        predicate, obj = word, _complement(after[1:] if after[0].lower() in LEADING else after)
    if obj:
        for s in re.split(r"\s(?:&|and)\s", subject):
            if s.strip():
                yield s.strip(), predicate, obj


def _kind(x: str) -> str:
    return "ENTITY" if x[:1].isupper() else "CONCEPT"


TRIPLES = K.ArrayType(K.StructType([K.StructField(x.split()[0], K.StringType()) for x in schema.TRIPLE.split(", ")]))


#: rows of a batch that are Python objects at once
SLICE = 64


def triples(rows: list[list[tuple]]) -> pa.Array:
    """Lists of triples in Arrow's form."""
    columns = list(zip(*(t for own in rows for t in own))) or [()] * len(TRIPLES.elementType)
    parts = pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], TRIPLES.elementType.names)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), parts)


def in_slices(column: pa.Array, run: Callable[[list], pa.Array]) -> pa.Array:
    """What ``run`` makes of a batch, ``SLICE`` rows at a time: however many rows a batch has, few are Python objects."""
    return pa.concat_arrays([run(column.slice(at, SLICE).to_pylist()) for at in range(0, max(1, len(column)), SLICE)])


@F.arrow_udf(TRIPLES)
def svo(found: pa.Array) -> pa.Array:
    """Facts of each row's sentences; Arrow batches, as token logic is sequential."""
    return in_slices(found, lambda rows: triples([[(s, _kind(s), p, o, _kind(o), x) for x in own or [] for s, p, o in sentence_facts(x)] for own in rows]))


NAME = "[A-Z][a-z]+"
PERSON = re.compile(rf"\b{NAME}(?:\s{NAME})+\b")
ENTITY = re.compile(rf"\b(?:The\s)?{NAME}(?:\s{NAME})*\b")


def resolve_pronouns(text: str) -> str:
    """Sentence by sentence, a leading He, She, They or It gives way to the person, plural or entity named last."""
    person = entity = plural = None
    out = []
    for m in re.finditer(r"(\s*)([^.!?]+[.!?]?)", text):
        body = m[2]
        p = re.match(r"(?:He|She|They|It)\b", body)
        if p and (name := {"He": person, "She": person, "They": plural}.get(p[0]) or entity):
            body = name + body[p.end() :]
        out.append(m[1] + body)
        person = ([x[0] for x in PERSON.finditer(body)] or [person])[-1]
        for x in ENTITY.finditer(body):
            entity = x[0]
            if entity.startswith("The ") or entity.endswith("s"):
                plural = entity
    return "".join(out)


@F.arrow_udf(K.StringType())
def coref(x: pa.Array) -> pa.Array:
    return in_slices(x, lambda rows: pa.array([resolve_pronouns(t) if t else t for t in rows], pa.string()))


EXTRACTORS = {"svo": lambda text: svo(T.sentences(text))}


def get_extractor(name: str):
    """A function of a text column to an array of triples; others can be registered in ``EXTRACTORS``."""
    if name == "spacy" and name not in EXTRACTORS:
        raise ImportError("the dependency-parse extractor needs the spacy package; register one in EXTRACTORS")
    if name not in EXTRACTORS:
        raise ValueError(f"unknown extractor {name!r}; there are {', '.join(sorted(EXTRACTORS))}")
    return EXTRACTORS[name]


def extract_facts(docs: DataFrame, id_column: str = "doc_id", extractor: str = "svo", resolve: bool = False) -> DataFrame:
    """``source_id, ordinal`` and triples of every document, with statement, question and answer."""
    text = coref("text") if resolve else F.col("text")
    rows = docs.select(F.col(id_column).cast("string").alias("source_id"), F.posexplode(get_extractor(extractor)(text)).alias("ordinal", "t")).select("source_id", "ordinal", "t.*")
    return rows.select(
        F.concat(F.lit("auto_"), "source_id", F.lit("_"), F.col("ordinal") + 1).alias("fact_id"), "source_id", "ordinal", "subject", "subject_type", "predicate", "object", "object_type", "text",
        T.verbalize("subject", "predicate", "object").alias("fact_statement"), T.question("subject", "predicate").alias("question"), F.trim("object").alias("answer"),
    )


def record(fmt: str, category: str = "category", statement: str = "fact_statement") -> Column:
    """A fact as one line of training data: chat, instruction, alpaca, sharegpt, plain or text."""
    cat = F.coalesce(F.nullif(F.col(category), F.lit("")), F.lit("General"))
    stmt = F.coalesce(F.col(statement), F.lit(""))
    q = F.coalesce(F.nullif(F.col("question"), F.lit("")), F.concat(F.lit("Tell me a fact about "), cat, F.lit(".")))
    a = F.coalesce(F.nullif(F.col("answer"), F.lit("")), stmt)
    about = F.concat(F.lit("State a verified fact about "), F.coalesce(F.nullif(F.col("subject"), F.lit("")), F.lit("General")), F.lit("."))
    if fmt == "chat":
        turn = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
        return F.to_json(F.struct(F.array(turn("user", q), turn("assistant", a)).alias("messages")))
    if fmt == "instruction":
        return F.to_json(F.struct(q.alias("instruction"), F.lit("").alias("input"), a.alias("output")))
    if fmt == "alpaca":
        return F.to_json(F.struct(about.alias("instruction"), F.lit("").alias("input"), stmt.alias("output")))
    if fmt == "sharegpt":
        part = lambda r, c: F.struct(F.lit(r).alias("from"), c.alias("value"))
        return F.to_json(F.struct(F.array(part("human", about), part("gpt", stmt)).alias("conversations")))
    if fmt == "plain":
        return F.to_json(F.struct(stmt.alias("text")))
    if fmt == "text":
        return F.concat(F.lit("- "), F.coalesce(F.nullif(stmt, F.lit("")), a))
    raise ValueError(f"unknown format {fmt!r}")


#: columns of probe outputs
PROBED = (
    "model string, backend string, domain string, prompt string, prompt_type string, "
    "structured_response struct<facts: array<struct<subject: string, predicate: string, object: string, context_or_qualifier: string, confidence: double>>>"
)


def probe_facts(outputs: DataFrame) -> DataFrame:
    """Facts of probe outputs (``model, backend, domain, prompt, prompt_type, structured_response``), echoes dropped."""
    rows = outputs.select("model", "backend", "domain", "prompt", "prompt_type", F.explode("structured_response.facts").alias("f")).select(
        "*", F.trim("f.subject").alias("subject"), F.trim("f.predicate").alias("predicate"), F.trim("f.object").alias("object"), F.col("f.context_or_qualifier").alias("qualifier"), F.col("f.confidence").alias("confidence")
    )
    kept = rows.where("subject <> '' AND predicate <> '' AND object <> ''").where(~T.degenerate("subject", "object", "domain"))
    statement = T.model_statement("subject", "predicate", "object", "qualifier")
    return kept.select(
        statement.alias("fact_statement"), "subject", "predicate", "object",
        F.when(F.coalesce(F.col("domain"), F.lit("")) == "", "General").otherwise(T.capitalised(F.col("domain"))).alias("category"),
        F.lit("POSSIBLY_TRUE").alias("reliability_rating"), T.confidence_quality("confidence").alias("quality_score"),
        F.concat(F.lit("State a verified fact about "), "subject", F.lit(" in "), "domain", F.lit(".")).alias("question"), statement.alias("answer"),
        F.struct("model", "backend", "domain", "prompt", "prompt_type", "confidence").alias("model_provenance"),
    )


def probe(prompts: DataFrame, backend, model: str, name: str = "custom") -> DataFrame:
    """Ask ``backend(prompt) -> dict or JSON text`` each prompt (``domain, prompt, prompt_type``); what can't be parsed has no facts."""
    shape = "struct<facts: array<struct<subject: string, predicate: string, object: string, context_or_qualifier: string, confidence: double>>>"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            said = []
            for p in pdf["prompt"]:
                try:
                    answer = backend(p)
                    said.append(answer if isinstance(answer, str) else json.dumps(answer))
                except Exception:  # one failed prompt leaves the others
                    said.append("{}")
            yield pdf.assign(said=said)[["domain", "prompt", "prompt_type", "said"]]

    rows = prompts.select("domain", "prompt", "prompt_type").mapInPandas(run, "domain string, prompt string, prompt_type string, said string")
    parsed = F.from_json("said", f"facts {shape.split('facts: ', 1)[1][:-1]}")
    return rows.select(F.lit(model).alias("model"), F.lit(name).alias("backend"), "domain", "prompt", "prompt_type", F.coalesce(parsed, F.from_json(F.lit('{"facts":[]}'), f"facts {shape.split('facts: ', 1)[1][:-1]}")).alias("structured_response"))


SUFFIXES = {"ORGANIZATION": "Company|Corp|Foundation|Group|Inc|Institute|LLC|Ltd|Organization|University", "LOCATION": "City|Country|Island|Lake|Mountain|Ocean|River|Sea|State"}
_MONTHS = "|".join("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split())
_CORP = r"[A-Z][A-Za-z&]*"
#: kinds of entity, the first wins where spans meet
ENTITIES = [
    ("ORGANIZATION", re.compile(rf"\b(?:{_CORP}\s)+(?:{SUFFIXES['ORGANIZATION']})\b|\b[A-Z]{{2,}}\b")),
    ("LOCATION", re.compile(rf"\b(?:{NAME} )+(?:{SUFFIXES['LOCATION']})\b")),
    ("DATE", re.compile(rf"\b\d\d?([/-])\d\d?\1\d{{2,4}}\b|\b\d\d? (?:{_MONTHS})[a-z]* \d{{2,4}}\b")),
    ("PERSON", re.compile(rf"\b{NAME} {NAME}\b")),
    ("ENTITY", re.compile(rf"\b{NAME}\b")),
]
#: what says each relation
RELATIONS = {
    name: re.compile(rf"\b(?:{says})\b", re.I)
    for name, says in {
        "acted_in": "appeared in|starred in|performed in|acted in", "born_in": "originated from|(?:was )?born in", "child_of": "is the (?:child|daughter|son) of", "died_in": "passed away in|deceased in|died in",
        "directed": "managed|oversaw|produced|directed", "discovered": "detected|identified|found|discovered", "founded": "started|created|established|founded", "invented": "developed|designed|created|invented",
        "located_in": "is (?:located |based |situated )?in", "married_to": "spouse of|wedded|wed|is married to", "owns": "maintains|has|possesses|owns", "parent_of": "is the (?:father|mother|parent) of",
        "part_of": "is a division of|belongs to|is part of", "works_for": "is a member of|is employed by|works for", "wrote": "penned|composed|authored|wrote",
    }.items()
}


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, text, kind) of named entities that don't overlap, in order."""
    kept: list[tuple[int, int, str, str]] = []
    for kind, exp in ENTITIES:
        for m in exp.finditer(text):
            if all(m.end() <= a or m.start() >= b for a, b, _, _ in kept):
                kept.append((*m.span(), m[0], kind))
    return sorted(kept)


def pattern_facts(sentence: str) -> Iterator[tuple[str, str, str, str, str]]:
    """(subject, its kind, predicate, object, its kind): the entities nearest to the words of a relation, or what follows them."""
    named = entities(sentence)
    for predicate, exp in RELATIONS.items():
        for m in exp.finditer(sentence):
            before, after = [e for e in named if e[1] <= m.start()], [e for e in named if e[0] >= m.end()]
            obj = after[0][2:] if after else (sentence[m.end() :].strip().rstrip(".!?,;:"), "CONCEPT")
            if before and obj[0]:
                yield (*before[-1][2:], predicate, *obj)


@F.arrow_udf(TRIPLES)
def by_patterns(text: pa.Array) -> pa.Array:
    split = re.compile(r"[^.?!]+[.?!]?")
    return in_slices(text, lambda rows: triples([[(s, sk, p, o, ok, x.strip()) for x in (split.findall(t) if t else []) for s, sk, p, o, ok in pattern_facts(x.strip())] for t in rows]))


EXTRACTORS["pattern"] = by_patterns


def category(subject_type: str = "subject_type", object_type: str = "object_type") -> Column:
    both = F.array_sort(F.array(subject_type, object_type))
    is_ = lambda *kinds: both == F.array(*map(F.lit, sorted(kinds)))
    return F.when(is_("PERSON", "ORGANIZATION"), "Employment").when(is_("PERSON", "LOCATION"), "Location").when(is_("ORGANIZATION", "LOCATION"), "Business").otherwise("General")


def tags() -> Column:
    return F.array_distinct(F.array(F.lower("subject_type"), F.lower("object_type"), F.col("predicate")))
