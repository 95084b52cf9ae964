"""Small calls to the file system that holds the tables, through Spark's Hadoop client."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def _names(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return sorted((s.getPath().getName(), s.isDirectory()) for s in fs.listStatus(p))


def folders(spark: SparkSession, path: str, prefix: str = "") -> list[str]:
    """Folders directly below ``path`` whose name starts with ``prefix``, by name."""
    return [f"{path.rstrip('/')}/{n}" for n, is_dir in _names(spark, path) if is_dir and n.startswith(prefix)]


def has_files(spark: SparkSession, path: str, suffix: str) -> bool:
    return any(n.endswith(suffix) for n, is_dir in _names(spark, path) if not is_dir)


def files(spark: SparkSession, path: str) -> list[str]:
    """Names of the files directly below ``path``, by name."""
    return [n for n, is_dir in _names(spark, path) if not is_dir]


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Write a new file whole, or not at all: False if ``path`` exists already. The text goes to
    a file beside it first, which is renamed; the file system has to refuse a name that is
    taken, as HDFS does."""
    fs, p = _fs(spark, path)
    if fs.exists(p):
        return False
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.draft")
    out = fs.create(draft)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(p) or not fs.rename(draft, p):
        fs.delete(draft, False)
        return False
    return True


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)
