"""Column expressions over texts, triples and facts; all stay inside whole-stage codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom import schema

ABBREVIATIONS = "Co. Corp. Dr. Inc. Jr. Ltd. Mr. Mrs. Ms. Prof. Sr. St. etc. vs. B.A. M.A. M.D. Ph.D. U.K. U.S.".split()


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _in(x: Column, words: list[str]) -> Column:
    return x.isin(*words)


def norm(x: str | Column) -> Column:
    """Lower case, white space collapsed; null is empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_c(x), F.lit(""))), r"(?U)\s+", " "))


def words(x: str | Column) -> Column:
    """White-space separated words in lower case."""
    return F.filter(F.split(norm(x), " "), lambda w: w != "")


def word_set(x: str | Column) -> Column:
    return F.array_distinct(words(x))


def jaccard(a: str | Column, b: str | Column) -> Column:
    """Share of common words; equal texts 1, else 0 where either has no word."""
    x, y = word_set(a), word_set(b)
    both = F.size(F.array_intersect(x, y))
    return F.when(_c(a).eqNullSafe(_c(b)), 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(both / (F.size(x) + F.size(y) - both))


def content_hash(x: str | Column) -> Column:
    return F.sha2(_c(x).cast("binary"), 256)


def block_id(s: str | Column, p: str | Column, o: str | Column, trim: bool = False) -> Column:
    """16 hexadecimal digits that name a triple."""
    parts = [F.coalesce(_c(x), F.lit("")) for x in (s, p, o)]
    parts = [F.trim(x) for x in parts] if trim else parts
    return F.substring(F.sha2(F.concat_ws("\0", *parts).cast("binary"), 256), 1, 16)


def capitalised(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), x.substr(F.lit(2), F.length(x)))


def terminated(x: Column) -> Column:
    return F.when(x.rlike(r"[.!?]$"), x).otherwise(F.concat(x, F.lit(".")))


def verbalize(s: str | Column, p: str | Column, o: str | Column) -> Column:
    """A triple as a sentence."""
    phrases = F.create_map(*[F.lit(x) for kv in schema.VERB_PHRASES.items() for x in kv])
    text = F.trim(F.concat_ws(" ", F.trim(_c(s)), F.coalesce(phrases[_c(p)], F.replace(_c(p), F.lit("_"), F.lit(" "))), F.trim(_c(o))))
    return F.when(text == "", text).otherwise(terminated(capitalised(text)))


def model_statement(s: str | Column, p: str | Column, o: str | Column, qualifier: str | Column) -> Column:
    """A probed triple as a sentence, its qualifier in parentheses."""
    parts = [F.trim(F.coalesce(_c(s), F.lit(""))), F.trim(F.regexp_replace(F.replace(F.coalesce(_c(p), F.lit("")), F.lit("_"), F.lit(" ")), r"\s+", " ")), F.trim(F.coalesce(_c(o), F.lit("")))]
    core = F.array_join(F.filter(F.array(*parts), lambda x: x != ""), " ")
    full = terminated(capitalised(core))
    q = F.rtrim(F.trim(F.coalesce(_c(qualifier), F.lit(""))), F.lit("."))
    return F.when(core == "", "").when(q == "", full).otherwise(F.concat(full.substr(F.lit(1), F.length(full) - 1), F.lit(" ("), q, F.lit(").")))


def question(s: str | Column, p: str | Column) -> Column:
    forms = F.create_map(*[F.lit(x) for kv in schema.QUESTIONS.items() for x in kv])
    subject, readable = F.trim(F.coalesce(_c(s), F.lit(""))), F.trim(F.replace(F.coalesce(_c(p), F.lit("")), F.lit("_"), F.lit(" ")))
    plain = F.when(readable == "", F.concat(F.lit("What is related to "), subject, F.lit("?"))).otherwise(F.concat(F.lit("What does "), subject, F.lit(" "), readable, F.lit("?")))
    return F.coalesce(F.replace(forms[_c(p)], F.lit("{s}"), subject), plain)


def confidence_quality(c: str | Column) -> Column:
    return F.lit(20.0) + 10.0 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(_c(c).try_cast("double"), F.lit(0.0))))


def token_estimate(x: str | Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(_c(x)) / 4)).cast("long")


def safe_name(x: str | Column) -> Column:
    return F.regexp_replace(_c(x), r"(?U)[^\p{Alnum}\-_.]", "_")


def coarse_type(x: str | Column) -> Column:
    return F.when(F.trim(_c(x)).rlike(r"^\p{Lu}"), "ENTITY").otherwise("CONCEPT")


def predicate_family(p: str | Column) -> Column:
    return F.substring_index(F.lower(F.coalesce(_c(p), F.lit(""))), "_", 1)


def is_acceptable(s: str | Column = "subject", o: str | Column = "object", kind: Column | None = None, longest: int = 80, shortest: int = 2) -> Column:
    """The seven gates of the fact quality filter; ``kind`` (a type column) turns strict mode on."""
    subject, obj = F.trim(F.coalesce(_c(s), F.lit(""))), F.trim(F.coalesce(_c(o), F.lit("")))
    parts = F.filter(F.split(subject, r"(?U)\s+"), lambda w: w != "")
    head = F.regexp_replace(F.lower(F.get(parts, F.lit(0))), r"^[.,'\"]+|[.,'\"]+$", "")
    ok = (subject != "") & (obj != "") & (F.length(subject) >= shortest) & ~_in(head, schema.STOPWORDS) & subject.rlike(r"^\p{Lu}")
    ok &= ~((F.size(parts) == 1) & subject.rlike(r"^\p{Upper}\p{Lower}+ing$")) & (F.length(obj) <= longest)
    if kind is not None:
        ok &= (kind.eqNullSafe(F.lit("ENTITY"))) | ((F.size(parts) >= 2) & F.forall(parts, lambda w: w.rlike(r"^\p{Lu}")))
    return F.coalesce(ok, F.lit(False))


def quality(s: str | Column = "subject", o: str | Column = "object", kind: Column | None = None, longest: int = 80) -> Column:
    """0 to 1: what passes the gates by brevity and type, the rest a trace for each part that would."""
    subject, obj = F.trim(F.coalesce(_c(s), F.lit(""))), F.trim(F.coalesce(_c(o), F.lit("")))
    first = F.lower(F.substring_index(subject, " ", 1))
    rest = F.when((subject != "") & ~_in(first, schema.STOPWORDS), 0.1).otherwise(0.0) + F.when((obj != "") & (F.length(obj) <= longest), 0.1).otherwise(0.0)
    bonus = F.when(kind == "ENTITY", 0.3).otherwise(0.0) if kind is not None else F.lit(0.0)
    good = F.least(F.lit(1.0), 0.5 + 0.2 * F.greatest(F.lit(0.0), 1 - F.length(obj) / max(1, longest)) + bonus)
    return F.when(is_acceptable(s, o, None, longest), good).otherwise(rest)


def critique(s: str = "subject", p: str = "predicate", o: str = "object", statement: str = "fact_statement") -> Column:
    """``struct(is_factual, reasoning, confidence_score)`` by rules in order."""
    subj, pred, obj = (F.lower(F.trim(F.coalesce(F.col(x), F.lit("")))) for x in (s, p, o))
    pronoun_s = _in(subj, schema.PRONOUNS)
    lead = F.lit("Rejected by heuristic: ")

    def verdict(ok: bool, why: Column, score: float) -> Column:
        return F.struct(F.lit(ok).alias("is_factual"), why.alias("reasoning"), F.lit(score).alias("confidence_score"))

    pronoun = F.concat(lead, F.lit("Pronoun "), F.when(pronoun_s, F.concat(F.lit("subject '"), F.col(s))).otherwise(F.concat(F.lit("object '"), F.col(o))), F.lit("' violates fact independence."))
    short = F.concat(lead, F.lit("Statement is too short or has empty SVO components."))
    same = F.concat(lead, F.lit("Redundant SVO components"), F.lit(" (subject, predicate, or object are identical)."))
    passed = F.concat(F.lit("Passed offline heuristic validations"), F.lit(" (non-pronoun subject, valid SVO length, distinct terms)."))
    return (
        F.when(pronoun_s | _in(obj, schema.PRONOUNS), verdict(False, pronoun, 0.95))
        .when((F.length(F.trim(F.coalesce(F.col(statement), F.lit("")))) < 5) | (subj == "") | (pred == "") | (obj == ""), verdict(False, short, 0.9))
        .when((subj == pred) | (pred == obj), verdict(False, same, 0.85))
        .otherwise(verdict(True, passed, 0.7))
    )


def degenerate(s: str | Column, o: str | Column, domain: str | Column) -> Column:
    """A probe's echo: its subject is the domain, or its object begins with the subject."""
    subject, obj, dom = norm(s), norm(o), norm(domain)
    return ((dom != "") & (subject == dom)) | ((subject != "") & ((obj == subject) | F.startswith(obj, F.concat(subject, F.lit(" ")))))


def sentences(text: str | Column) -> Column:
    """Sentences of a text; the points of common abbreviations don't end one."""
    masked = reduce(lambda t, a: F.replace(t, F.lit(a), F.lit(a.replace(".", "\x01"))), ABBREVIATIONS, F.coalesce(_c(text), F.lit("")))
    found = F.transform(F.regexp_extract_all(masked, F.lit(r"[^\n!.?]+[!.?]?"), F.lit(0)), lambda s: F.regexp_replace(F.replace(s, F.lit("\x01"), F.lit(".")), r"(?U)^\s+|\s+$", ""))
    return F.filter(found, lambda s: s != "")


def agreement_tier(n: Column) -> Column:
    return F.when(n >= 3, "VERIFIED").when(n == 2, "LIKELY_TRUE").when(n == 1, "POSSIBLY_TRUE").otherwise("UNVERIFIED")


def model_weight(model: str | Column) -> Column:
    """Of the first known name that equals or contains the model's, else 1."""
    low = F.lower(_c(model))
    tests = [F.when((low == name) | ((F.length(low) > 1) & F.contains(F.lit(name), low)), w) for name, w in schema.WEIGHTS]
    return F.coalesce(*tests, F.lit(1.0))


def weighted_tier(total: Column) -> Column:
    return F.when(total >= 3, "VERIFIED").when(total >= 1.5, "LIKELY_TRUE").when(total >= 0.5, "POSSIBLY_TRUE").otherwise("UNVERIFIED")


def split_words(text: str | None) -> list[str]:
    """What :func:`words` gives, for a single text."""
    return [w for w in " ".join((text or "").lower().split()).split(" ") if w]


def normal_predicate(p: str | Column) -> Column:
    """Lower case with underscores for white space."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(_c(p), F.lit("")))), r"(?U)\s+", "_")


def utc_now() -> Column:
    """The time of the query in ISO form."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def lenient_match(a: str | Column, b: str | Column) -> Column:
    x, y = norm(a), norm(b)
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))


def expand_query(text: str | Column, terms: int = 3) -> Column:
    """Terms of a query and, sorted, those related to them."""
    related = F.create_map(*[x for k, v in schema.RELATED.items() for x in (F.lit(k), F.array(*map(F.lit, v[:terms])))])
    own = F.regexp_extract_all(F.lower(_c(text)), F.lit(r"\b\w+\b"), F.lit(0))
    more = F.flatten(F.transform(own, lambda w: F.coalesce(related[w], F.expr("cast(array() as array<string>)"))))
    return F.concat(_c(text), F.lit(" "), F.array_join(F.array_sort(F.array_except(more, own)), " "))


def cosine(a: str | Column, b: str | Column) -> Column:
    """0 where a norm is 0."""
    def dot(x, y):
        return F.aggregate(F.zip_with(_c(x), _c(y), lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)

    scale = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(scale == 0, 0.0).otherwise(dot(a, b) / scale)
