"""Corpus preparation: documents to packed training sequences.

Every stage works on all rows of its predecessor and, but for the last, returns the columns of its input, whatever their
names. Defined results of all stages: an empty table gives an empty result with the same columns; texts of any length are
read whole; rows of a null id or text, repeated rows and ties have the results that each stage states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import mixing, ngram_join, packing, pii, toxicity
from factloom.session import stage_table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go; lexicon and language model come from this stage's own input.

    Null and empty texts score 0 and stay, rows of a null id stay, and all rows of an id go where one of its texts is toxic.
    Without labels nothing is toxic.
    """
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of smallest id stays.

    Rows of a null id and texts that are null or without words are in no group and stay; repeated rows of an id that stays
    all stay; of different texts under one id the one of the least set hash stands for it.
    """
    return ngram_join.keep_one(docs)


def redact_identifiers(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal identifiers become their kind in brackets; no document goes.

    Null and empty texts stay as they are; rows of one text are all changed alike, whatever their ids; ``n_chars`` follows a
    changed text and stays else.
    """
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's documents up to its exact token budget, repeated where the budget asks for it.

    A null source is a source of its own; null texts and those without tokens go; the document at a cut is shortened; rows
    that are alike in id, source and tokens are taken in the order of their text and of a hash of all columns.
    """
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: shard, sequence and position.

    Null texts and those without tokens go nowhere; repeated rows are packed once each; a null id is packed and kept; ties
    in size go by id and piece.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", keep_one_of_group),
    ("pii", redact_identifiers),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: the toxicity, PII and packing stages are iterative or sequential, which SQL doesn't express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, _ = stage_table(stage(spark, docs, sf_dir), name)
    return docs
