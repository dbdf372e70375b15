"""Fact tables over the driver's relations, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators.facts import quality_score

TIER_SQL = "CASE k % 4 WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'LIKELY_TRUE' WHEN 2 THEN 'POSSIBLY_TRUE' ELSE 'UNVERIFIED' END"
RANK_SQL = "CASE {} WHEN 'VERIFIED' THEN 4 WHEN 'LIKELY_TRUE' THEN 3 WHEN 'POSSIBLY_TRUE' THEN 2 ELSE 1 END"
BLOCK_SQL = "substr(sha256(coalesce(subject,'') || chr(0) || coalesce(predicate,'') || chr(0) || coalesce(object,'')), 1, 16)"

#: WITH items: raw triples, then ``facts``
FACTS_SQL = f"""
g AS (SELECT 's' || s_suppkey AS fact_id, s_name AS subject, 'located_in' AS predicate, n_name AS object, 'Supply' AS category, s_suppkey AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey
 UNION ALL SELECT 'x' || s_suppkey, s_name, 'not located in', n_name, 'Supply', s_suppkey + 1 FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 6 = 0
 UNION ALL SELECT 'n' || n_nationkey, n_name, 'located_in', r_name, 'Geography', n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey
 UNION ALL SELECT 'r' || r_regionkey, r_name, 'is a', 'region', 'Geography', r_regionkey FROM region
 UNION ALL SELECT 'm' || n_nationkey, n_name, 'is a', 'nation', 'Geography', n_nationkey + 1 FROM nation
 UNION ALL SELECT 'c' || c_custkey, c_name, 'in_segment', c_mktsegment, 'Market', c_custkey FROM customer),
facts AS (SELECT fact_id, subject, predicate, object, category, {TIER_SQL} AS reliability_rating, (k % 7)::INTEGER AS usage_count,
  upper(substr(subject, 1, 1)) || substr(subject, 2) || ' ' || CASE predicate WHEN 'located_in' THEN 'is located in' ELSE replace(predicate, '_', ' ') END || ' ' || object || '.' AS fact_statement,
  'src' || (k % 5) AS source, 'drop' || (k % 9) AS drop_id, (1 + k % 3)::INTEGER AS agreement, {BLOCK_SQL} AS block_id,
  (({RANK_SQL.format('(' + TIER_SQL + ')')}) * 10 + (k % 7) * 2)::DOUBLE AS quality_score FROM g)"""

EDGES_SQL = """,
edges AS (SELECT a.block_id AS src, b.block_id AS dst, a.predicate || '_' || b.predicate AS predicate, 1.0::DOUBLE AS weight
  FROM facts a JOIN facts b ON lower(a.object) = lower(b.subject) WHERE a.block_id <> b.block_id)"""

CLAIMS_SQL = """
claims AS (SELECT 'part ' || l_partkey AS subject, 'supplied_by' AS predicate, 'supplier ' || l_suppkey AS object, 'm' || (l_linenumber % 5) AS model,
  l_quantity AS quality_score, l_orderkey * 10 + l_linenumber AS pos FROM lineitem)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)

    def part(df: DataFrame, mark: str, key: str, subject: str, predicate: str, obj: str | Column, category: str, shift: int = 0) -> DataFrame:
        return df.select(
            F.concat(F.lit(mark), F.col(key).cast("string")).alias("fact_id"), F.col(subject).alias("subject"), F.lit(predicate).alias("predicate"),
            (F.col(obj) if isinstance(obj, str) else obj).alias("object"), F.lit(category).alias("category"), (F.col(key) + shift).cast("long").alias("k"),
        )

    placed = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    nations = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = part(placed, "s", "s_suppkey", "s_name", "located_in", "n_name", "Supply")
    for more in (
        part(placed.where("s_suppkey % 6 = 0"), "x", "s_suppkey", "s_name", "not located in", "n_name", "Supply", 1),
        part(nations, "n", "n_nationkey", "n_name", "located_in", "r_name", "Geography"),
        part(t("region"), "r", "r_regionkey", "r_name", "is a", F.lit("region"), "Geography"),
        part(t("nation"), "m", "n_nationkey", "n_name", "is a", F.lit("nation"), "Geography", 1),
        part(t("customer"), "c", "c_custkey", "c_name", "in_segment", "c_mktsegment", "Market"),
    ):
        rows = rows.unionByName(more)
    rating = F.element_at(F.array(*map(F.lit, ["VERIFIED", "LIKELY_TRUE", "POSSIBLY_TRUE", "UNVERIFIED"])), (F.col("k") % 4 + 1).cast("int"))
    n = lambda m: (F.col("k") % m).cast("string")
    rows = rows.select(
        "fact_id", "subject", "predicate", "object", "category", rating.alias("reliability_rating"), (F.col("k") % 7).cast("int").alias("usage_count"),
        T.verbalize("subject", "predicate", "object").alias("fact_statement"), F.concat(F.lit("src"), n(5)).alias("source"), F.concat(F.lit("drop"), n(9)).alias("drop_id"),
        (1 + F.col("k") % 3).cast("int").alias("agreement"), T.block_id("subject", "predicate", "object").alias("block_id"),
    )
    return rows.withColumn("quality_score", quality_score())


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lambda a, c: F.concat(F.lit(a), F.col(c).cast("string"))
    return table(spark, sf_dir, "lineitem").select(
        s("part ", "l_partkey").alias("subject"), F.lit("supplied_by").alias("predicate"), s("supplier ", "l_suppkey").alias("object"),
        F.concat(F.lit("m"), (F.col("l_linenumber") % 5).cast("string")).alias("model"), F.col("l_quantity").alias("quality_score"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
    )


__all__ = ["BLOCK_SQL", "CLAIMS_SQL", "EDGES_SQL", "FACTS_SQL", "RANK_SQL", "claims", "facts", "table"]
