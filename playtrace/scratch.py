"""Intermediate tables in the cluster's shared folder.

A table saved here cuts the lineage: later jobs read files, so losing an
executor costs a re-read and never a different answer. The folder is the one the
session names in ``spark.checkpoint.dir``; where that is unset, a folder below
``spark.sql.warehouse.dir``, which executors share as well.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession) -> str:
    """A new, unused path below the shared folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return f"{root.rstrip('/')}/playtrace/{uuid.uuid4().hex}"


def saved(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder (or ``path``) and return the table read back."""
    spark = df.sparkSession
    path = path or scratch_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of this module that no result reads any more."""
    fs, where = _hadoop(spark, path)
    fs.delete(where, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a path within one file system."""
    fs, where = _hadoop(spark, source)
    if not fs.rename(where, spark._jvm.org.apache.hadoop.fs.Path(target)):
        raise OSError(f"cannot move {source} to {target}")


def listing(spark: SparkSession, folder: str) -> list[tuple[str, str, int, bool]]:
    """Full path, name, bytes and whether it is a folder, of all that is in ``folder``."""
    fs, where = _hadoop(spark, folder)
    return [
        (f.getPath().toString(), f.getPath().getName(), f.getLen(), f.isDirectory())
        for f in fs.listStatus(where)
    ]


def full_path(spark: SparkSession, path: str) -> str:
    fs, where = _hadoop(spark, path)
    return fs.makeQualified(where).toString()


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _hadoop(spark, path)
    return fs.exists(where)
