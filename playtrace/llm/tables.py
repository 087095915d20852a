"""Shared steps of the operators: sizes, row structs, Arrow columns."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule, for regular expressions of Spark and DuckDB.
WORD = "[^\\x20\\x09-\\x0D]+"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, as ``--py-files`` would."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    package = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="py-files-")) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    context.addPyFile(str(target))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``k`` (id), ``t`` (text) and ``row``: a struct of all other columns.

    The struct keeps columns of any name apart from those that an operator adds.
    """
    ship(docs.sparkSession)
    rest = [docs[f"`{c}`"] for c in docs.columns if c not in (id_col, text_col)]
    row = F.struct(*rest) if rest else F.struct(F.lit(True).alias("none"))
    return docs.select(
        docs[f"`{id_col}`"].cast("long").alias("k"),
        docs[f"`{text_col}`"].cast("string").alias("t"),
        row.alias("row"),
    )


def restored(df: DataFrame, like: DataFrame, id_col: str, text_col: str, text: str) -> DataFrame:
    """The columns of ``like`` from ``k``, ``row`` and the column ``text`` of ``df``."""
    kinds = dict(like.dtypes)
    parts: list[Column] = []
    for c in like.columns:
        source = F.col("k") if c == id_col else F.col(text) if c == text_col else None
        if source is None:
            source = F.col("row").getField(c)
        parts.append(source.cast(kinds[c]).alias(c))
    return df.select(*parts)


def text_bytes(docs: DataFrame, text: str = "t") -> int:
    """Bytes of all texts."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0]
    return int(total or 0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def blob(values: np.ndarray, kind) -> bytes:
    return np.ascontiguousarray(values, dtype=kind).tobytes()


def unblob(data: bytes | None, kind) -> np.ndarray:
    return np.frombuffer(data or b"", dtype=kind)


def record(columns: dict[str, list], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[n], type=t) for n, t in types.items()], names=list(types)
    )


def as_table(columns: dict[str, list], types: dict[str, pa.DataType]) -> pa.Table:
    return pa.Table.from_batches([record(columns, types)])
