"""Files of Parquet tables through Spark's file system layer: what a rewrite of parts of a table needs."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if it isn't there."""
    fs, p = _fs(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def data_files(spark: SparkSession, path: str) -> list[str]:
    """Paths of the Parquet files below a folder, relative to it, without those below names that readers skip."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    root, found, out = fs.makeQualified(p).toString().rstrip("/") + "/", fs.listFiles(p, True), []
    while found.hasNext():
        name = found.next().getPath().toString()[len(root) :]
        if name.endswith(".parquet") and not any(x[0] in "_." for x in name.split("/")):
            out.append(name)
    return sorted(out)


def qualified(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    return fs.makeQualified(p).toString().rstrip("/")


def move(spark: SparkSession, source: str, target: str) -> None:
    """Moves a file; one that is already there stays (the move ran before)."""
    fs, s = _fs(spark, source)
    _, t = _fs(spark, target)
    if not fs.exists(s) and fs.exists(t):
        return
    fs.mkdirs(t.getParent())
    if not fs.rename(s, t):
        raise OSError(f"can't move {source} to {target}")
