"""Small files on any file system that Spark can reach: manifests and catalogues beside the data."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession


class Taken(FileExistsError):
    """A file of that name is there already."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of what is in a folder, in order; none if it isn't there."""
    fs, p = _fs(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> None:
    """The whole text at once: it is written aside and renamed into place, so no reader sees half of it. Without overwrite
    a file that is there already stays, and Taken is raised: of two writers of a name one wins."""
    fs, p = _fs(spark, path)
    fs.mkdirs(p.getParent())
    _, aside = _fs(spark, f"{p.getParent().toString()}/.{p.getName()}-{uuid.uuid4().hex}")
    out = fs.create(aside, True)
    try:
        out.write(text.encode())
    finally:
        out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    rename = getattr(hadoop, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE if overwrite else rename.NONE
    try:
        hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(aside), fs.makeQualified(p), options)
    except Exception as e:  # the gateway's error has the class of the Java one in its text only
        fs.delete(aside, False)
        if "FileAlreadyExistsException" in str(e):
            raise Taken(path) from e
        raise


def delete(spark: SparkSession, path: str) -> None:
    """A file or a whole folder; nothing if it isn't there."""
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may go without."""
    try:
        folder = spark.conf.get("spark.checkpoint.dir", None)
    except PySparkException:
        folder = None
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="tidemark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder
