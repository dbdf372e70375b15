"""Fact and event streams: windowed counts, history, keyed state and file watching."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.operators import chain
from factloom.operators.vectors import last_n
from factloom.session import stage_table

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """The events table as a stream of its files; ``ts`` as an event time."""
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums of each window and type; batch or stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    found = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return found.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", "total")


def history(events: DataFrame, n: int) -> DataFrame:
    """Each user's last n events."""
    return last_n(events, ["user_id"], [F.desc("ts"), F.desc("event_id")], n)


def state(events: DataFrame) -> DataFrame:
    """A user's state after all events in order of (ts, event_id): signup adds, error deletes, the others update. The last event wins."""
    e = events.select("user_id", "ts", "event_id", "event_type", "value", (F.col("event_type") == "error").alias("gone"))
    return chain.replay(e, "user_id", ["ts", "event_id"], ["event_type", "value"], "gone")


def dispatch(stream: DataFrame, processors: dict[str, Callable[[DataFrame, int], None]], checkpoint: str, kind: str = "event_type") -> StreamingQuery:
    """Each micro-batch's rows go to the processor of their type; one that fails doesn't stop the others."""

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        errors = []
        try:
            for name, process in processors.items():
                try:
                    process(batch.where(F.col(kind) == name), number)
                except Exception as e:
                    errors.append(f"{name}: {e}")
        finally:
            batch.unpersist()
        for e in errors:
            print("processor failed:", e)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_snapshots(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keyed state as numbered snapshots under ``path``: batch n is the state of n - 1 with its events applied. A batch that
    is run again writes the same snapshot."""
    spark = stream.sparkSession
    columns = ["user_id", "ts", "event_id", "event_type", "value"]

    def each(batch: DataFrame, number: int) -> None:
        new = batch.select(*columns)
        if number:
            new = spark.read.schema(new.schema).parquet(f"{path}/{number - 1}").unionByName(new)
        last_n(new, ["user_id"], [F.desc("ts"), F.desc("event_id")], 1).write.mode("overwrite").parquet(f"{path}/{number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watch_folder(spark: SparkSession, path: str, process: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """New text files of a folder, each once: ``path, modified, text`` to ``process``."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", "true").load(path)
    rows = files.select("path", F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("text"))
    return rows.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


CHANGE = "event_id string, ts timestamp, action string, fact_id string, data map<string, string>"
WATCHED = "path string, modified timestamp, state string, facts long, error string"


def event_id(*parts: str) -> Column:
    """A stable id of an event: a hash of what it says."""
    return F.sha2(F.concat_ws("\0", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in parts]), 256)


def change_events(rows: DataFrame, action: str, at: str = "ts") -> DataFrame:
    """Facts (``fact_id`` and attributes) as events that add, update or delete them, at a time of the rows."""
    if action not in ("add", "update", "delete"):
        raise ValueError(f"unknown action {action!r}; there are add, update, delete")
    names = [c for c in rows.columns if c not in ("fact_id", at)]
    held = F.filter(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in names]), lambda x: x["v"].isNotNull()) if names else F.expr("cast(array() as array<struct<k: string, v: string>>)")
    out = rows.select(F.lit(action).alias("action"), "fact_id", F.col(at).cast("timestamp").alias("ts"), F.map_from_entries(held).alias("data"))
    return out.select(event_id("action", "fact_id", "ts").alias("event_id"), "ts", "action", "fact_id", "data")


def export_events(events: DataFrame, path: str, checkpoint: str | None = None) -> StreamingQuery | None:
    """Events as JSON lines under ``path``, which other streams read: a batch is appended, a stream runs to its end."""
    if not events.isStreaming:
        events.write.mode("append").json(path)
        return None
    return events.writeStream.format("json").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()


def read_changes(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Events of changes that :func:`export_events` wrote, as a stream of its files."""
    return spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", files_per_trigger).json(path)


def apply_changes(state: DataFrame, changes: DataFrame) -> DataFrame:
    """``fact_id, ts, event_id, data, gone``: the state of facts after changes, in order of (ts, event id). An add sets all
    of a fact, an update what it names and only of a fact that is there, a delete ends it; deleted facts stay marked."""
    was = state.select("fact_id", "ts", "event_id", F.when(F.col("gone"), "delete").otherwise("add").alias("action"), "data")
    rows = was.unionByName(changes.where("fact_id IS NOT NULL").select("fact_id", "ts", "event_id", "action", "data")).dropDuplicates(["fact_id", "event_id"])
    at = F.struct("ts", "event_id")
    marks = rows.withColumn("at", at).groupBy("fact_id").agg(
        F.max("at").alias("last"), F.max(F.when(F.col("action") == "add", F.col("at"))).alias("since"), F.max(F.when(F.col("action") == "delete", F.col("at"))).alias("ended")
    )
    live = rows.withColumn("at", at).join(marks, "fact_id").where("since IS NOT NULL AND at >= since AND (ended IS NULL OR ended < since)")
    last = live.select("fact_id", "at", F.explode("data").alias("k", "v")).groupBy("fact_id", "k").agg(F.max_by("v", "at").alias("v"))
    data = last.groupBy("fact_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("data"))  # one entry an attribute
    gone = F.col("since").isNull() | F.coalesce(F.col("ended") > F.col("since"), F.lit(False))
    out = marks.join(data, "fact_id", "left")
    return out.select("fact_id", F.col("last.ts").alias("ts"), F.col("last.event_id").alias("event_id"), F.coalesce("data", F.expr("cast(map() as map<string, string>)")).alias("data"), gone.alias("gone"))


def upsert_facts(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Facts as numbered snapshots under ``path``, each the one before with a batch of changes applied."""
    spark = stream.sparkSession
    kind = "fact_id string, ts timestamp, event_id string, data map<string, string>, gone boolean"

    def each(batch: DataFrame, number: int) -> None:
        before = spark.read.schema(kind).parquet(f"{path}/{number - 1}") if number else spark.createDataFrame([], kind)
        apply_changes(before, batch).write.mode("overwrite").parquet(f"{path}/{number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watched(spark: SparkSession, path: str) -> DataFrame:
    """The last state of every watched file."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], WATCHED)
    rows = spark.read.schema(WATCHED + ", at timestamp").parquet(path)
    return last_n(rows, ["path"], [F.desc("at")], 1).drop("at")


def scan_folder(spark: SparkSession, files: DataFrame, store: str, process: Callable[[str, str], int]) -> DataFrame:
    """One pass of a watcher over ``files`` (``path, modified, text``): those that are new, changed since, or failed before
    go to ``process(path, text)``, which says how many facts it made. The state of each (PROCESSED, SKIPPED where it made
    none, FAILED with its error) is appended to ``store``, where the last one counts; a failure leaves the others alone."""
    old = watched(spark, store).select("path", F.col("modified").alias("seen"), F.col("state").alias("was"))
    todo = files.join(old, "path", "left").where("was IS NULL OR was = 'FAILED' OR modified > seen").select("path", "modified", "text")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for p, m, t in zip(pdf["path"], pdf["modified"], pdf["text"]):
                try:
                    n = int(process(p, t) or 0)
                    out.append((p, m, "PROCESSED" if n else "SKIPPED", n, None))
                except Exception as e:
                    out.append((p, m, "FAILED", 0, str(e)))
            yield pd.DataFrame(out, columns=["path", "modified", "state", "facts", "error"])

    done, _ = stage_table(todo.mapInPandas(run, WATCHED), "watched")
    done.withColumn("at", F.current_timestamp()).write.mode("append").parquet(store)
    return done
