"""Session helpers: a local builder and tables that cut lineage in the cluster's shared folder."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8, app: str = "factloom") -> SparkSession:
    """A single-JVM session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("FACTLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only where that setting is absent and the session runs in one JVM is a folder of our own made; on a
    cluster a machine-local folder would lose data with its machine, so its absence there is an error.
    """
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return qualified(spark, path)
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="factloom-")
    atexit.register(shutil.rmtree, own, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of the file system that Spark finds it in."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return ("file://" + full[5:] if full.startswith("file:/") and not full.startswith("file://") else full).rstrip("/")


_made: list[str] = []


def clean(spark: SparkSession) -> None:
    """Delete every table that this process has left in the shared folder; nothing made from them can be read after."""
    drop_path(spark, *_made)
    _made.clear()


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def stage_table(df: DataFrame, name: str, partition_by: list[str] | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` as a Parquet table in the shared folder and read it again: short lineage, survives executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once a session, unless they find it where the driver's environment says."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = {os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p} | {os.getcwd()}
    if root in known or spark.sparkContext.applicationId in _shipped:
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as out:
        for folder, _, names in os.walk(os.path.join(root, "factloom")):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                out.write(path, os.path.relpath(path, root))
    path = fresh_path(spark, "code") + ".zip"
    _made.append(path)
    fs, where = pafs.FileSystem.from_uri(path)
    fs.create_dir(os.path.dirname(where), recursive=True)
    with fs.open_output_stream(where) as f:
        f.write(data.getvalue())
    spark.sparkContext.addPyFile(path)
    _shipped.add(spark.sparkContext.applicationId)


_shipped: set[str] = set()


def drop_path(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing reads any more."""
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
