"""Small files and folders in any store that Spark can open."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    """Hadoop's file system and path."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(conf), target


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Sorted names of a folder's entries; none where there is no folder."""
    store, target = _at(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(target)) if store.exists(target) else []


def age_of(spark: SparkSession, path: str) -> float:
    """Seconds since a file or folder was changed."""
    store, target = _at(spark, path)
    return time.time() - store.getFileStatus(target).getModificationTime() / 1000


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as text."""
    store, target = _at(spark, path)
    stream = store.open(target)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_new_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that appears whole; a ``FileExistsError`` where there is one of that name."""
    jvm = spark.sparkContext._jvm
    store, target = _at(spark, path)
    draft = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    stream = store.create(draft, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    if store.exists(target):
        store.delete(draft, False)
        raise FileExistsError(path)
    files.rename(draft, target, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file, or a folder with all it holds."""
    store, target = _at(spark, path)
    store.delete(target, True)
