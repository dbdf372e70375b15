"""Drops, training records, graphs and chains as files."""

from __future__ import annotations

from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import schema
from factloom.operators import chain, extract
from factloom.operators.facts import body_hash
from factloom.session import stage_table

FACT_LINE = "record string, drop_id string, source string, fact_statement string, subject string, predicate string, object string, question string, answer string, reliability_rating string, quality_score double, category string"


def write_drops(facts: DataFrame, path: str, created: str) -> DataFrame:
    """Append facts (``source`` and a fact) as immutable drops: JSON lines partitioned by year and month, and a manifest.

    A drop is named by its content; a source whose content is in the manifest already is left out. ``created`` is
    the ISO time of all of them. Returns the manifest's new rows."""
    spark, facts = facts.sparkSession, facts.drop("drop_id", "year", "month")
    body = facts.groupBy("source").agg(F.count("*").alias("num_facts"), body_hash().alias("source_hash"))
    heads = body.select(F.substring("source_hash", 1, 16).alias("drop_id"), "source", "source_hash", "num_facts", F.lit(created).alias("created_at"), F.lit(created[:4]).alias("year"), F.lit(created[5:7]).alias("month"))
    old = read_manifest(spark, path)
    new = heads if old is None else heads.join(old.select("source_hash"), "source_hash", "left_anti")
    new, _ = stage_table(new, "drops")  # what is new is settled before the manifest grows
    kept = [c.split()[0] for c in FACT_LINE.split(", ") if c.split()[0] not in ("record", "drop_id", "source")]
    lines = facts.join(new.select("source", "drop_id", "year", "month"), "source").select("year", "month", "drop_id", F.lit("fact").alias("record"), "source", *[F.col(c) if c in facts.columns else F.lit(None).cast("string").alias(c) for c in kept])
    lines.write.mode("append").partitionBy("year", "month").json(f"{path}/shards")
    new.select("drop_id", "source", "source_hash", "num_facts", "created_at").coalesce(1).write.mode("append").json(f"{path}/manifest")  # last: a drop counts once it is listed
    return new


def write_texts(docs: DataFrame, drops: DataFrame, path: str) -> None:
    """Keep the texts (``source_id, text``) of new drops, so that they can be extracted anew."""
    kept = drops.select("drop_id", "source").join(docs.select(F.col("source_id").alias("source"), F.col("text").alias("source_text")), "source")
    kept.select("drop_id", "source_text").write.mode("append").parquet(f"{path}/texts")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``drop_id, source_text`` of the drops that kept their text."""
    if not exists(spark, f"{path}/texts"):
        return spark.createDataFrame([], "drop_id string, source_text string")
    return spark.read.schema("drop_id string, source_text string").parquet(f"{path}/texts")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_json(spark: SparkSession, path: str, kinds: str) -> DataFrame:
    """JSON lines of a folder; none where there is no folder yet."""
    return spark.read.schema(kinds).json(path) if exists(spark, path) else spark.createDataFrame([], kinds)


def read_manifest(spark: SparkSession, path: str) -> DataFrame | None:
    if not exists(spark, f"{path}/manifest"):
        return None
    return spark.read.schema("drop_id string, source string, source_hash string, num_facts long, created_at string").json(f"{path}/manifest")


def read_drops(spark: SparkSession, path: str) -> DataFrame:
    """Facts of all drops that the manifest lists, each once."""
    manifest = read_manifest(spark, path)
    if manifest is None:
        return spark.createDataFrame([], FACT_LINE)
    return spark.read.schema(FACT_LINE).json(f"{path}/shards").where("record = 'fact'").join(manifest.select("drop_id").distinct(), "drop_id", "left_semi")


def drop_summary(spark: SparkSession, path: str) -> DataFrame:
    """Headers of a store's drops, without their facts, the latest first."""
    manifest = read_manifest(spark, path)
    kinds = "drop_id string, source string, source_hash string, num_facts long, created_at string"
    return (spark.createDataFrame([], kinds) if manifest is None else manifest).orderBy(F.desc("created_at"), "drop_id")


def drop_records(spark: SparkSession, path: str) -> DataFrame:
    """``drop_id, record``: every drop as one JSON text, its header and its facts in order of their statements. A drop is what
    one source gave, so it is made whole; a store isn't."""
    facts = read_drops(spark, path)
    body = facts.groupBy("drop_id").agg(F.array_sort(F.collect_list(F.struct("fact_statement", "subject", "predicate", "object", "reliability_rating", "quality_score", "category"))).alias("facts"))
    heads = drop_summary(spark, path)
    return heads.join(body, "drop_id").select("drop_id", F.to_json(F.struct("drop_id", "source", "source_hash", "num_facts", "created_at", "facts")).alias("record"))


def rebuild_catalog(spark: SparkSession, store: str, path: str) -> DataFrame:
    """The catalog table of a store, written anew from its drops; returns it as read."""
    rows = read_drops(spark, store).withColumn("quality_score", F.round("quality_score").cast("int"))
    rows.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_training(facts: DataFrame, path: str, fmt: str, order: list | None = None) -> int:
    """Training records as text files, in rank order within and across them; returns how many."""
    lines = facts.orderBy(*(order or [F.desc("quality_score"), "fact_id"])).select(extract.record(fmt).alias("value")).where("trim(value) <> ''")
    lines.write.mode("overwrite").text(path)
    return facts.sparkSession.read.text(path).count()


def graph_xml(nodes: DataFrame, edges: DataFrame, kind: str = "graphml") -> str:
    """A small graph as GraphML or GEXF text; it is collected."""
    names = [r[0] for r in nodes.select("block_id").orderBy("block_id").collect()]
    pairs = [tuple(r) for r in edges.select("src", "dst").distinct().orderBy("src", "dst").collect()]
    if kind == "graphml":
        rows = [f"<node id={quoteattr(n)}/>" for n in names] + [f"<edge source={quoteattr(a)} target={quoteattr(b)}/>" for a, b in pairs]
        return '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">\n' + "\n".join(rows) + "\n</graph></graphml>\n"
    if kind == "gexf":
        dots = "".join(f"<node id={quoteattr(n)} label={quoteattr(n)}/>\n" for n in names)
        lines = "".join(f'<edge id="{i}" source={quoteattr(a)} target={quoteattr(b)}/>\n' for i, (a, b) in enumerate(pairs))
        return f'<?xml version="1.0" encoding="UTF-8"?>\n<gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="directed">\n<nodes>\n{dots}</nodes>\n<edges>\n{lines}</edges>\n</graph></gexf>\n'
    raise ValueError(f"unknown kind of graph file {kind!r}")


def write_snapshot(facts: DataFrame, edges: DataFrame, path: str) -> None:
    """A whole graph as two tables of JSON lines; written again it is replaced."""
    facts.write.mode("overwrite").json(f"{path}/facts")
    edges.write.mode("overwrite").json(f"{path}/edges")


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(facts, edges) of a snapshot; facts have all columns of the model and those that were written beside."""
    found = spark.read.json(f"{path}/facts")
    kinds = {f.name: f.dataType for f in spark.createDataFrame([], schema.FACT).schema.fields}
    facts = found.select(*[(F.col(c).cast(k) if c in found.columns else F.lit(None).cast(k)).alias(c) for c, k in kinds.items()], *[c for c in found.columns if c not in kinds])
    return facts, spark.read.schema("src string, dst string, predicate string, weight double").json(f"{path}/edges")


def write_facts_json(facts: DataFrame, path: str) -> None:
    """Facts as JSON lines of id and attributes, times in ISO form."""
    times = {c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") for c, k in facts.dtypes if k.startswith("timestamp")}
    facts.withColumns(times).write.mode("overwrite").json(path)


def write_chain(blocks: DataFrame, path: str) -> None:
    blocks.write.mode("overwrite").json(path)


def import_chain(spark: SparkSession, path: str, attributes: list[str]) -> tuple[DataFrame, DataFrame]:
    """(blocks, the facts that they say there are) of a chain that is whole."""
    blocks = read_chain(spark, path)
    return blocks, chain.rebuild(chain.fact_transactions(blocks), attributes)


def read_chain(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of a chain that is whole; else a ValueError."""
    blocks = spark.read.schema(chain.BLOCK).json(path)
    if bad := chain.verify(blocks).where("NOT linked OR NOT intact").count():
        raise ValueError(f"{bad} blocks are broken")
    return blocks
