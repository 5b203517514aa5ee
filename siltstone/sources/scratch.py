"""Files in the folder all executors share, and small files that are created once."""

from __future__ import annotations

import os
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only a single-machine session without it gets a folder of its own."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="siltstone-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the JVM ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    fs, target = hadoop_path(spark, path)
    fs.deleteOnExit(target)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and reread: it is computed once, and executors may be lost."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in order; none if it is not there."""
    fs, target = hadoop_path(spark, folder)
    if not fs.exists(target):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(target))


def _write(spark: SparkSession, path: str, text: str) -> None:
    fs, target = hadoop_path(spark, path)
    out = fs.create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def replace(spark: SparkSession, path: str, text: str) -> None:
    _write(spark, path, text)


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with its whole content, unless it is there; of several writers exactly one succeeds.

    A local file appears by a hard link, any other by a rename that does not overwrite; both are atomic.
    """
    fs, target = hadoop_path(spark, path)
    folder = target.getParent()
    fs.mkdirs(folder)
    temporary = f"{folder.toString()}/.{uuid.uuid4().hex}"
    _write(spark, temporary, text)
    source = hadoop_path(spark, temporary)[1]
    try:
        if fs.getScheme() == "file":
            os.link(source.toUri().getPath(), target.toUri().getPath())
        else:
            context = spark.sparkContext
            none = context._gateway.new_array(getattr(context._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            context._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), context._jsc.hadoopConfiguration()).rename(source, target, none)
        return True
    except FileExistsError:
        return False
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in e.java_exception.toString():
            return False
        raise
    finally:
        fs.delete(source, False)
