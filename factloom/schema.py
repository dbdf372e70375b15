"""Literal tables and schemas of the fact model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TIERS = "UNVERIFIED POSSIBLY_TRUE LIKELY_TRUE VERIFIED".split()
FACT = (
    "fact_id string, fact_statement string, category string, tags array<string>, date_recorded timestamp, last_updated timestamp, "
    "reliability_rating string, source_id string, source_title string, author_creator string, publication_date timestamp, "
    "url_reference string, related_facts array<string>, contextual_notes string, access_level string, usage_count int, "
    "quality_score double, subject string, predicate string, object string, question string, answer string"
)
TRIPLE = "subject string, subject_type string, predicate string, object string, object_type string, text string"

#: what models count for in a weighted agreement, in the order in which names are tried
WEIGHTS = [
    ("gemini-1.5-pro", 3.0), ("gpt-4", 3.0), ("claude-3-5-sonnet", 3.0), ("gemini-1.5-flash", 2.0), ("gpt-3.5-turbo", 1.5),
    ("qwen2.5-14b", 2.0), ("llama3-8b", 1.5), ("qwen2.5-3b", 1.0), ("qwen2.5-0.5b", 0.5),
]

NEGATIONS = sorted("can't cannot cant doesn't doesnt fails never no not".split())
PRONOUNS = sorted("he it she that them these they this those".split())
STOPWORDS = sorted(
    "a about across after all also although among an and another any as at because before between both but by chapter during each either "
    "every figure for from furthermore he here however if in instead into it meanwhile moreover neither nevertheless of on once one onto or "
    "over section she since so some table that the then there therefore these they this those though through thus to toward under unless "
    "until we when whenever whereas wherever while with within without you".split()
)
SIMILARITY_STOPWORDS = sorted("a an and are at but by for from in is of on or the to was were with".split())
#: predicate to the verb phrase that reads well
VERB_PHRASES = {p: f"{v} {p.replace('_', ' ')}".strip() for v, ps in {"is": ["located_in", "part_of", "married_to"], "was": ["born_in"], "is the": ["parent_of", "child_of"]}.items() for p in ps}
#: question form to predicates with the word that fills it
_QUESTIONS = {
    "What did {s} %s?": "founded=found|discovered=discover|invented=invent|wrote=write|directed=direct|acted_in=act in|developed=develop|graduated=graduate with|collaborated=collaborate on|provided=provide|told=tell",
    "Where was {s} %s?": "born_in=born",
    "Where did {s} %s?": "died_in=die",
    "Where is {s} %s?": "located_in=located",
    "Who or what does {s} %s?": "works_for=work for",
    "What does {s} %s?": "owns=own",
    "What is {s} %s?": "part_of=part of",
    "Who is {s} %s?": "married_to=married to|parent_of=a parent of|child_of=a child of",
    "What was {s} %s?": "president_of=president of|director_of=director of|founder_of=founder of|author_of=author of",
    "When or where was {s} %s?": "published=published",
    "What is {s}%s?": "is_a=",
}


def questions() -> dict[str, str]:
    out = {}
    for form, pairs in _QUESTIONS.items():
        for pair in pairs.split("|"):
            predicate, word = pair.split("=")
            out[predicate] = form % word
    return out


QUESTIONS = questions()
#: related terms of the query expansion
RELATED = {
    k: v.split()
    for k, v in {
        "cluster": "group category collection classification", "data": "information facts statistics records", "fact": "information truth datum statement",
        "graph": "network chart diagram structure", "knowledge": "information data wisdom understanding", "query": "question search inquiry request",
        "search": "find query lookup retrieve", "semantic": "meaning linguistic conceptual contextual", "similarity": "resemblance likeness comparison affinity",
        "vector": "embedding array direction magnitude",
    }.items()
}


def rank(column: str | Column) -> Column:
    """1 to 4 by tier; unknown and missing ratings rank lowest."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, TIERS)), c), F.lit(0)), F.lit(1)).cast("int")


def tier(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, TIERS)), number.cast("int"))
