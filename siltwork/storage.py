"""Files and folders of any file system that Spark knows, by way of Hadoop; and the folder for temporary tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # Local files may be written by others as well: no checksum files beside them.
    return (fs.getRawFileSystem() if fs.getUri().getScheme() == "file" else fs), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where) and fs.getFileStatus(where).isDirectory()


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def make_folder(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.mkdirs(where)


def listing(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if there is no such folder."""
    fs, where = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename; what is at the target goes first."""
    fs, a = _at(spark, source)
    b = _at(spark, target)[1]
    fs.delete(b, True)
    if not fs.rename(a, b):
        raise OSError(f"{source} can't be renamed to {target}")


def read_bytes(spark: SparkSession, path: str) -> bytes:
    fs, where = _at(spark, path)
    if not fs.exists(where):
        raise FileNotFoundError(path)
    stream = fs.open(where)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a file anew and put it in its place in one step, where the file system can; readers see the old or the new one."""
    fs, where = _at(spark, path)
    beside = _at(spark, f"{path}.{uuid.uuid4().hex}.tmp")[1]
    stream = fs.create(beside, True)
    try:
        stream.write(data)
    finally:
        stream.close()
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(context.makeQualified(beside), context.makeQualified(where), options)


def create(spark: SparkSession, path: str, data: bytes) -> bool:
    """Write a file unless there is one; whether it was written."""
    fs, where = _at(spark, path)
    try:
        stream = fs.create(where, False)
    except Exception:
        if fs.exists(where):
            return False
        raise
    try:
        stream.write(data)
    finally:
        stream.close()
    return True


_temporary: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; in local mode, where it is unset, a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _temporary:
        _temporary.append((spark, tempfile.mkdtemp(prefix="siltwork-")))
        atexit.register(release)
    return _temporary[0][1]


def temporary(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that is removed when the session ends, or by :func:`release`."""
    path = f"{shared_folder(spark)}/siltwork/{what}-{uuid.uuid4().hex}"
    if not _temporary:
        atexit.register(release)
    _temporary.append((spark, path))
    return path


def cut(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a temporary table: it is computed once, however often it is read, also when executors are lost."""
    path = temporary(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    while _temporary:
        spark, path = _temporary.pop()
        try:
            delete(spark, path)
        except Exception:  # the session may be gone already; the folder is the cluster's to clean then
            return
