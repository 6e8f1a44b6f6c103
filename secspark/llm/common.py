"""What the operators of this subpackage share: tables in the shared folder, and null rules.

Intermediate results are written as Parquet under ``spark.checkpoint.dir`` and read again, so a lost
executor never costs more than the job that is running. Where that setting is absent a local folder is
used, on a local master only; on a cluster the setting is required.

Inside ``with scratch(spark):`` all tables go to one folder, which is deleted at the end. Operators that write
more than their result do their work in one. What a returned frame still reads belongs to the caller, who can
call the operator inside a ``scratch`` of their own and is rid of it at its end.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local: list[str] = []
_open: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="spark-llm-"))
    return _local[0]


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's file system layer."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Everything that :func:`save` writes inside goes to one folder, deleted at the end."""
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"
    _open.append(path)
    try:
        yield path
    finally:
        _open.remove(path)
        delete(spark, path)


def save(df: DataFrame, name: str, outlive: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; its shuffle files are freed at once.

    With ``outlive`` the table stays when the innermost :func:`scratch` ends: it belongs to what is around it.
    """
    spark = df.sparkSession
    folders = [shared_dir(spark), *_open]
    path = f"{folders[-2] if outlive and len(folders) > 1 else folders[-1]}/llm-{uuid.uuid4().hex}-{name}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_path = path  # for drop()
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by :func:`save` once nothing will read them again."""
    for df in tables:
        path = getattr(df, "_saved_path", None)
        if path:
            delete(df.sparkSession, path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
