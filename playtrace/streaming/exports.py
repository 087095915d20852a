"""Exports that arrive one after the other: each is read once, and copies of earlier events are left out.

The same rows as ``merge``, ``drop_invalid_ids`` and ``dedup`` over all files, without reading the
old ones again. What was seen is kept as state by key, and forgotten once the watermark has
passed an event's time, so the state is as large as the events of ``delay``, not as the log.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from playtrace.functions.names import column
from playtrace.operators.cleaning import drop_invalid_ids
from playtrace.scratch import exists
from playtrace.settings import DEDUP_KEYS, TIME
from playtrace.sources.csv_files import csv_lines

#: Column of the event time that the watermark follows.
_AT = "_at"
#: Name of the count of rows as they are read.
_READ = "rows_read"


@dataclass(frozen=True)
class Ingested:
    """What one run of ``ingest`` read: ``rows`` are all, and each is in one of the other four."""

    rows: int
    kept: int
    copies: int
    late: int
    invalid: int
    batches: int


def export_stream(
    spark: SparkSession,
    folder: str,
    *,
    files_per_batch: int | None = None,
    multi_line: bool = True,
    **read_options,
) -> DataFrame:
    """The rows of all ``*.csv`` files in ``folder`` and in tables there, now and later, each file once.

    Cells are read as by ``read_events_csv``, with its options. The header is taken from the files that are there;
    one that differs later is an error, as is a row with more cells. A file has to be complete when it appears
    (write it elsewhere and move it) and is never read again if it changes. Names that begin with ``_`` or ``.``
    are not files. ``multi_line`` gives a file to one task.
    """
    reader = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
    # By default Spark passes over files that are a week older than the newest.
    reader = reader.option("maxFileAge", "36500d")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return csv_lines(spark, reader, folder, multi_line=multi_line, **read_options)


def first_copies(
    stream: DataFrame,
    keys: Sequence[str] = DEDUP_KEYS,
    time: str = TIME,
    delay: str = "7 days",
    latest: datetime.datetime | None = None,
) -> DataFrame:
    """One row per key of a stream; ``time`` has to be among ``keys``. Nulls are equal.

    The row that came first stays (of those in the same batch, any). A row whose time is ``delay`` or more behind
    the latest time of the batches before is late: its copy may be forgotten, so it is left out, and Spark counts it.

    One wrong clock would make all other rows late: times after ``latest`` do not move the watermark. Such keys
    and those with an unreadable time are remembered for good. Keep ``latest`` the same between runs.
    """
    if time not in keys:
        raise ValueError(f"{time!r} has to be one of the keys {list(keys)}, or nothing could be forgotten")
    at = column(time).try_cast("timestamp_ntz")
    if latest is not None:
        at = F.when(at <= F.lit(latest).cast("timestamp_ntz"), at)
    # A watermark has to be on an instant; that it reads times in the session's zone cancels out.
    marked = stream.withColumn(_AT, at.cast("timestamp")).withWatermark(_AT, delay)
    return marked.dropDuplicates([*keys, _AT]).drop(_AT)


def ingest(
    spark: SparkSession,
    folder: str,
    out: str,
    checkpoint: str,
    keys: Sequence[str] = DEDUP_KEYS,
    time: str = TIME,
    delay: str = "7 days",
    latest: datetime.datetime | None = None,
    **read_options,
) -> Ingested:
    """Read the files that are new in ``folder``, append their valid first copies to the Parquet table ``out``, and stop.

    Each file's rows are in ``out`` once, also when a run fails and is started again: ``checkpoint`` (a shared folder,
    one per ``out``) holds the files read and the state. The number of state partitions is that of
    ``spark.sql.shuffle.partitions`` in the first run. Read ``out`` with ``spark.read.parquet``, which
    sees only the files of finished batches.
    """
    stream = export_stream(spark, folder, **read_options)
    if exists(spark, f"{out}/_spark_metadata") and (held := spark.read.parquet(out).columns) != stream.columns:
        raise ValueError(f"the header differs from that of earlier files: {stream.columns} and {held}")
    # Spark's own count of rows leaves out those that a filter in the scan drops.
    stream = stream.observe(_READ, F.count(F.lit(1)).alias("rows"))
    new = first_copies(drop_invalid_ids(stream), keys, time, delay, latest)
    writer = new.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return _counts(writer.trigger(availableNow=True).start(out))


def _counts(query: StreamingQuery) -> Ingested:
    """Wait for the end of ``query`` and add up what its batches report."""
    batches = {}
    done = False
    while not done:
        # Spark keeps the last hundred reports only.
        done = query.awaitTermination(1)
        batches.update({p.batchId: p for p in query.recentProgress})
    if batches and len(batches) != max(batches) - min(batches) + 1:
        raise RuntimeError("the rows are written, but the reports of some batches were missed")
    rows = sum(p.observedMetrics[_READ].rows for p in batches.values() if _READ in p.observedMetrics)
    states = [s for p in batches.values() for s in p.stateOperators]
    kept = sum(s.numRowsUpdated for s in states)
    late = sum(s.numRowsDroppedByWatermark for s in states)
    copies = sum(s.customMetrics["numDroppedDuplicateRows"] for s in states)
    return Ingested(rows, kept, copies, late, rows - kept - late - copies, len(batches))
