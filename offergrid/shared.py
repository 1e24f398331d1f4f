"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """What the cluster names in spark.checkpoint.dir; where that is unset, a temporary folder, on a local master only."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return _own[app]


def aside(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, path: str | None = None, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back; it stays until the cluster clears its folder.

    Whoever knows when it isn't needed any more gives its ``path`` and erases it.
    """
    path = path or aside(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def erase(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote, wherever Spark's own file systems keep it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def listed(spark: SparkSession, folder: str) -> dict[str, int]:
    """Names in a folder with their modification times (ms); none if it isn't there."""
    where, fs = _at(spark, folder)
    return {s.getPath().getName(): s.getModificationTime() for s in fs.listStatus(where)} if fs.exists(where) else {}


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file."""
    where, fs = _at(spark, path)
    stream = fs.open(where)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file as a whole, by a rename that doesn't replace; False if there is one already.

    As for the checkpoints of streams, the file system has to rename atomically.
    """
    jvm, aside = spark.sparkContext._jvm, f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}.tmp"
    where, fs = _at(spark, aside)
    stream = fs.create(where)
    stream.write(bytearray(text.encode()))
    stream.close()
    there = jvm.org.apache.hadoop.fs.Path(path)
    keep = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    keep[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(where, there, keep)
    except Py4JJavaError:
        fs.delete(where, False)
        if fs.exists(there):
            return False
        raise
    return True
