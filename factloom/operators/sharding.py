"""A store in shards of bounded size: placing, finding, updating, deleting and rebalancing facts.

A store is a table with ``shard_id``; as files it is partitioned by it, so a scan of some shards reads no others, and a
small mapping (``fact_id, shard_id``) says which shard has a fact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.operators.facts import quality_score

CAPACITY = 1_000


def md5_mod(ident: str | Column, n: str | Column | int) -> Column:
    """The 128-bit number of an id's MD5 modulo ``n``, by its four 32-bit parts."""
    n = F.lit(n) if isinstance(n, int) else F.col(n) if isinstance(n, str) else n
    out = F.lit(0).cast("long")
    digest = F.md5(F.col(ident) if isinstance(ident, str) else ident)
    for k in range(4):
        out = (out * F.lit(1 << 32) + F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long")) % n
    return out


def name(number: Column) -> Column:
    return F.format_string("shard_%04d", number)


def number(shard: str = "shard_id") -> Column:
    return F.regexp_extract(shard, r"(\d+)$", 1).cast("long")


def place(new: DataFrame, store: DataFrame | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``new`` facts with ``shard_id``: each goes to the shard with room that its id's MD5 picks; what a shard has no room for
    goes to new shards, in order of id. Ids that the store has keep their shard."""
    spark = new.sparkSession
    sizes = (spark.createDataFrame([], "shard_id string, n long") if store is None else store.groupBy("shard_id").agg(F.count("*").alias("n"))).select("shard_id", "n")
    known = spark.createDataFrame([], "fact_id string, shard_id string") if store is None else store.select("fact_id", "shard_id")
    stay = new.join(known, "fact_id")
    rows = new.join(known.select("fact_id"), "fact_id", "left_anti")
    top = sizes.agg(F.coalesce(F.max(number()), F.lit(0)).alias("top"))
    free = sizes.where(F.col("n") < capacity).agg(F.array_sort(F.collect_list(F.struct("shard_id", (capacity - F.col("n")).alias("room")))).alias("free"))  # one row for each shard with room
    picked = rows.crossJoin(F.broadcast(free)).crossJoin(F.broadcast(top))  # one row each
    picked = picked.withColumn("__f", F.when(F.size("free") > 0, F.get("free", md5_mod("fact_id", F.greatest(F.size("free"), F.lit(1))).cast("int"))))
    at = F.row_number().over(Window.partitionBy("__f.shard_id").orderBy("fact_id"))
    picked = picked.withColumn("__s", F.when(at <= F.col("__f.room"), F.col("__f.shard_id")))
    inside = picked.where("__s IS NOT NULL").withColumn("shard_id", F.col("__s"))
    over = picked.where("__s IS NULL")
    more = over.withColumn("shard_id", name(F.col("top") + 1 + F.floor((numbered(over) - 1) / capacity)))
    columns = [*new.columns, "shard_id"]
    return stay.select(*columns).unionByName(inside.select(*columns)).unionByName(more.select(*columns))


def numbered(rows: DataFrame) -> Column:
    """A row's place in the order of (the first three signs of its id's MD5, id), by the counts of those 4096 ranges and its
    place within its own."""
    bucket = F.conv(F.substring(F.md5("fact_id"), 1, 3), 16, 10).cast("int")
    counts = rows.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).orderBy("b").collect()  # 4096 at most
    before, total = [], 0
    for b, n in counts:
        before += [F.lit(b), F.lit(total)]
        total += n
    start = F.create_map(*before)[bucket] if before else F.lit(0)
    return start + F.row_number().over(Window.partitionBy(bucket).orderBy("fact_id"))


def optimize(store: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """All facts placed again, in as few shards as hold them."""
    rows = store.drop("shard_id")
    return rows.withColumn("shard_id", name(1 + F.floor((numbered(rows) - 1) / capacity))).select(*store.columns)


def upsert(store: DataFrame, changes: DataFrame) -> DataFrame:
    """Attributes of ``changes`` (``fact_id`` and some columns, nulls for no change) put on the store's facts, in their shards."""
    new = [c for c in changes.columns if c != "fact_id"]
    if unknown := sorted(set(new) - set(store.columns)):
        raise ValueError(f"no such attribute: {', '.join(unknown)}")
    out = store.join(changes.select("fact_id", *[F.col(c).alias(f"__{c}") for c in new]), "fact_id", "left")
    out = out.withColumns({c: F.coalesce(f"__{c}", c) for c in new}).select(*store.columns)
    return out.withColumn("quality_score", quality_score()) if {"reliability_rating", "usage_count"} & set(new) and "quality_score" in store.columns else out


def remove(store: DataFrame, ids: DataFrame) -> DataFrame:
    return store.join(ids.select("fact_id"), "fact_id", "left_anti").select(*store.columns)


def write_store(store: DataFrame, path: str) -> None:
    """A partition a shard, and the mapping."""
    store.repartition("shard_id").write.mode("overwrite").partitionBy("shard_id").parquet(f"{path}/facts")
    store.select("fact_id", "shard_id").write.mode("overwrite").parquet(f"{path}/mapping")


def read_store(spark: SparkSession, path: str, shards: list[str] | None = None) -> DataFrame:
    """All facts, or those of some shards, whose files alone are read."""
    rows = spark.read.option("basePath", f"{path}/facts").parquet(f"{path}/facts")
    return rows if shards is None else rows.where(F.col("shard_id").isin(*shards))


def get_fact(spark: SparkSession, path: str, fact_id: str) -> DataFrame:
    """One fact, from its shard alone; ValueError where none has it."""
    where = spark.read.parquet(f"{path}/mapping").where(F.col("fact_id") == fact_id).first()
    if where is None:
        raise ValueError(f"no shard has the fact {fact_id!r}")
    return read_store(spark, path, [where["shard_id"]]).where(F.col("fact_id") == fact_id)


def find(store: DataFrame, **attributes) -> DataFrame:
    """Facts that equal all attributes, over all shards; their filters reach the scan."""
    for column, value in attributes.items():
        store = store.where(F.col(column) == value)
    return store


def statistics(store: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``shard_id, facts, full``."""
    return store.groupBy("shard_id").agg(F.count("*").alias("facts")).select("shard_id", "facts", (F.col("facts") >= capacity).alias("full"))
