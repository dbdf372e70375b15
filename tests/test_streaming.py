from pyspark.sql import functions as F

from factloom.streaming import events as E

SF = "/root/testdata/sf0.001"


def test_windows_as_a_stream(spark, tmp_path):
    batch = E.windowed(spark.read.parquet(f"{SF}/events.parquet"))
    src = tmp_path / "in"
    spark.read.parquet(f"{SF}/events.parquet").orderBy("ts").coalesce(1).write.parquet(str(src))
    q = E.windowed(E.read_events(spark, str(src))).writeStream.format("memory").queryName("win").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("win").collect())) == sorted(map(tuple, batch.collect()))


def test_snapshots_resume(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    src = str(tmp_path / "in")
    for part in (0, 1):
        rows.where(F.col("event_id") % 2 == part).coalesce(1).write.mode("append").parquet(src)
        E.upsert_snapshots(E.read_events(spark, src, 1), str(tmp_path / "s"), str(tmp_path / "c")).awaitTermination()
    last = max(int(p.name) for p in (tmp_path / "s").iterdir())
    got = {r.user_id: r.event_id for r in spark.read.parquet(f"{tmp_path}/s/{last}").collect()}
    assert got == {r.user_id: r.event_id for r in E.history(rows, 1).collect()} and last == 1


def test_dispatch_isolates_failures(spark, tmp_path):
    seen = []
    src = str(tmp_path / "in")
    spark.read.parquet(f"{SF}/events.parquet").coalesce(1).write.parquet(src)

    def fail(batch, n):
        raise RuntimeError("no")

    E.dispatch(E.read_events(spark, src), {"error": fail, "click": lambda b, n: seen.append(b.count())}, str(tmp_path / "c")).awaitTermination()
    assert sum(seen) == spark.read.parquet(src).where("event_type = 'click'").count()


def test_folder_watch(spark, tmp_path):
    seen = []
    folder = tmp_path / "docs"
    folder.mkdir()
    for name in ("a.txt", "b.txt"):
        (folder / name).write_text(name)
        E.watch_folder(spark, str(folder), lambda b, n: seen.extend(r.text for r in b.collect()), str(tmp_path / "c")).awaitTermination()
    assert seen == ["a.txt", "b.txt"]
