"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Where it is unset, a local run has a temporary folder; a cluster has to name one, as
    a machine's own folder is seen by no other machine.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _local.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="graphloom-"))


def own_dir(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables."""
    return f"{shared_dir(spark)}/graphloom/{spark.sparkContext.applicationId}"


def write_table(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a lost executor costs
    a re-read, never a recomputation."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file of any file system; None if there is none."""
    fs, p = _file_system(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str, append: bool = False) -> None:
    """Write a small text file beside its place and move it there; to append, the old text
    is written again before the new one."""
    old = (read_text(spark, path) or "") if append else ""
    fs, p = _file_system(spark, path)
    _, t = _file_system(spark, f"{path}.{uuid.uuid4().hex}.part")
    stream = fs.create(t, True)
    try:
        stream.write(bytearray((old + text).encode("utf-8")))
    finally:
        stream.close()
    if fs.exists(p):
        fs.delete(p, False)
    if not fs.rename(t, p):
        raise OSError(f"could not write {path}")


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Sorted names in a folder; none if it isn't there."""
    fs, p = _file_system(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a written table that nothing reads any more."""
    for folder in {os.path.dirname(x) for x in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def still_there(df: DataFrame) -> bool:
    """Whether the files of a written table exist."""
    return all(exists(df.sparkSession, f) for f in df.inputFiles()[:1])


def clean(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application, when no result is read any more."""
    _delete(spark, own_dir(spark))
