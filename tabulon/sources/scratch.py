"""A folder that driver and executors share, for tables between jobs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Lists that are told of each table made, innermost last.
_WATCHING: list[list[DataFrame]] = []


@contextmanager
def tables_made() -> Iterator[list[DataFrame]]:
    """The tables that written() makes inside, in their order, so that they can be deleted when their reader is done."""
    _WATCHING.append([])
    try:
        yield _WATCHING[-1]
    finally:
        _WATCHING.pop()


def shared(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints. Where none is named, one of our own on a single machine; on a cluster that raises, as its executors wouldn't share one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='tabulon-')}"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: df as a Parquet table in the shared folder, read back."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._tabulon_path = path
    for made in _WATCHING:
        made.append(back)
    return back


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def forget(df: DataFrame) -> None:
    """Deletes a table made by written(), when no later job needs it."""
    path = getattr(df, "_tabulon_path", None)
    if path:
        delete(df.sparkSession, path)
