"""Hash-chained blocks of transactions: building, verification, replay, the history and state of facts.

A block holds ten transactions of its partition in order. Blocks of one ledger are a chain: each hash covers the hash
before, so building it is sequential by nature and is done for each ledger by itself.
"""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType


SIZE, ZEROS = 10, 2
BLOCK = "ledger string, index long, transactions array<string>, previous_hash string, nonce long, hash string"


def digest(index: int, transactions: list[str], previous: str, nonce: int) -> str:
    body = json.dumps({"index": int(index), "nonce": int(nonce), "previous_hash": previous, "transactions": list(transactions)}, sort_keys=True)
    return hashlib.sha256(body.encode()).hexdigest()


def build(transactions: DataFrame, ledger: str, order: list[str], body: str, size: int = SIZE, zeros: int = ZEROS, genesis: bool = False) -> DataFrame:
    """Blocks of ``size`` transactions of every ledger, each mined to a hash that begins with ``zeros`` zeros; with
    ``genesis`` block 0, without a transaction, comes before them."""
    at = (F.row_number().over(Window.partitionBy(ledger).orderBy(*order)) - 1)
    groups = transactions.withColumn("__at", at).withColumn("__i", F.floor(F.col("__at") / size) + 1).groupBy(F.col(ledger).cast("string").alias("ledger"), F.col("__i").alias("index")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("__at", body))), lambda x: x[body]).alias("transactions")
    )

    def mine(pdf: pd.DataFrame) -> pd.DataFrame:
        previous, out = "0", []
        if genesis:
            previous = digest(0, [], "0", 0)
            out.append((pdf["ledger"].iloc[0], 0, [], "0", 0, previous))
        for row in pdf.sort_values("index").itertuples(index=False):
            nonce = 0
            while not (found := digest(row.index, row.transactions, previous, nonce)).startswith("0" * zeros):
                nonce += 1
            out.append((row.ledger, row.index, list(row.transactions), previous, nonce, found))
            previous = found
        return pd.DataFrame(out, columns=["ledger", "index", "transactions", "previous_hash", "nonce", "hash"])

    return groups.groupBy("ledger").applyInPandas(mine, BLOCK)


def verify(blocks: DataFrame) -> DataFrame:
    """``ledger, index, linked, intact``: whether a block names the hash before it and has its own right."""
    @F.pandas_udf(BooleanType())
    def intact(i: pd.Series, t: pd.Series, p: pd.Series, n: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([digest(*row[:4]) == row[4] for row in zip(i, t, p, n, h)])

    before = F.lag("hash", 1, "0").over(Window.partitionBy("ledger").orderBy("index"))
    return blocks.select("ledger", "index", (F.col("previous_hash") == before).alias("linked"), intact("index", "transactions", "previous_hash", "nonce", "hash").alias("intact"))


def replay(changes: DataFrame, key: str, order: list[str], attributes: list[str], deleted: str | None = None) -> DataFrame:
    """The last value of every attribute that isn't null, for each key; keys whose last change is a deletion go."""
    at = F.struct(*order)
    last = [F.max_by(a, F.when(F.col(a).isNotNull(), at)).alias(a) for a in attributes]
    gone = [F.max_by(deleted, at).alias("__gone")] if deleted else []
    out = changes.groupBy(key).agg(*last, *gone)
    return out.where("NOT __gone").drop("__gone") if deleted else out


_ENTRY = "type string, timestamp string, fact_id string, data map<string, string>"


def transaction(kind: str, at: str, fact_id: str, data: str) -> Column:
    """A change of a fact as one line: ``add_fact`` with its attributes, ``update_fact`` with those that change."""
    if kind not in ("add_fact", "update_fact"):
        raise ValueError(f"unknown kind of transaction {kind!r}")
    return F.to_json(F.struct(F.lit(kind).alias("type"), F.col(at).cast("string").alias("timestamp"), F.col(fact_id).cast("string").alias("fact_id"), F.col(data).alias("data")))


def fact_transactions(blocks: DataFrame, pending: DataFrame | None = None) -> DataFrame:
    """``ledger, index, position, hash`` and type, timestamp, fact and data of all changes of facts, those that wait for a
    block (``ledger, position, transaction``) last, with a null index."""
    held = blocks.select("ledger", "index", F.posexplode("transactions").alias("position", "transaction"))
    if pending is not None:
        held = held.unionByName(pending.select(F.col("ledger").cast("string").alias("ledger"), F.lit(None).cast("long").alias("index"), F.col("position").cast("int").alias("position"), "transaction"))
    rows = held.select("ledger", "index", "position", F.sha2("transaction", 256).alias("hash"), F.from_json("transaction", _ENTRY).alias("t")).select("ledger", "index", "position", "hash", "t.*")
    return rows.where(F.col("type").isin("add_fact", "update_fact") & F.col("fact_id").isNotNull())


def _order() -> Column:
    return F.struct(F.coalesce("index", F.lit(1 << 62)).alias("i"), F.col("position").alias("p"))


def fact_history(transactions: DataFrame, fact_id: str) -> DataFrame:
    """The changes of one fact in order."""
    return transactions.where(F.col("fact_id") == fact_id).orderBy(_order())


def expected_state(transactions: DataFrame) -> DataFrame:
    """``fact_id, attribute, value`` after all changes: an add starts a fact anew, an update sets what it names."""
    rows = transactions.select("fact_id", "type", "data", _order().alias("at"))
    since = rows.groupBy("fact_id").agg(F.max(F.when(F.col("type") == "add_fact", F.col("at"))).alias("since"))
    live = rows.join(since, "fact_id").where("since IS NULL OR at >= since")
    return live.select("fact_id", "at", F.explode("data").alias("attribute", "value")).groupBy("fact_id", "attribute").agg(F.max_by("value", "at").alias("value"))


def verify_facts(facts: DataFrame, transactions: DataFrame) -> DataFrame:
    """``fact_id, verified, transactions, first_recorded, last_updated, mismatches`` of every fact: whether its attributes,
    those that the chain names, are what the chain says; a fact without a record isn't verified."""
    said = transactions.groupBy("fact_id").agg(F.count("*").alias("transactions"), F.min_by("timestamp", _order()).alias("first_recorded"), F.max_by("timestamp", _order()).alias("last_updated"))
    names = [c for c in facts.columns if c != "fact_id"]
    real = facts.select("fact_id", F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(c).cast("string") for c in names]))).alias("attribute", "real"))
    wrong = expected_state(transactions).join(real, ["fact_id", "attribute"]).where(~F.col("value").eqNullSafe(F.col("real")))
    wrong = wrong.groupBy("fact_id").agg(F.array_sort(F.collect_set("attribute")).alias("mismatches"))
    none = F.expr("cast(array() as array<string>)")
    out = facts.select("fact_id").join(said, "fact_id", "left").join(wrong, "fact_id", "left")
    return out.select("fact_id", (F.col("transactions").isNotNull() & F.col("mismatches").isNull()).alias("verified"), F.coalesce("transactions", F.lit(0)).alias("transactions"), "first_recorded", "last_updated", F.coalesce("mismatches", none).alias("mismatches"))


def rebuild(transactions: DataFrame, attributes: list[str]) -> DataFrame:
    """Facts with the given attributes (text, null where the chain has none), as the chain says."""
    state = expected_state(transactions)
    last = state.groupBy("fact_id").agg(*[F.max(F.when(F.col("attribute") == a, F.col("value"))).alias(a) for a in attributes])
    return transactions.select("fact_id").distinct().join(last, "fact_id", "left")
