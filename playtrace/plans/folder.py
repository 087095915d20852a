"""The three steps from raw files to one table per event, one by one and together.

``merge_folder``, ``clean_table`` and ``split_table`` read CSV and write CSV, so
each can be run alone. ``process_folder`` runs all three with Parquet between.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from playtrace.functions.params import parse_params
from playtrace.operators.cleaning import (
    NullRules,
    clean_audit,
    drop_invalid_ids,
    null_handling,
    top_values,
)
from playtrace.operators.combine import dedup, dedup_counted
from playtrace.scratch import saved, scratch_path
from playtrace.settings import DEDUP_KEYS, ID, INVALID_IDS
from playtrace.sources.csv_files import read_events_csv, read_raw, read_table, write_events_csv
from playtrace.sources.split_files import stage_by_event, write_split


@dataclass(frozen=True)
class Step:
    """A written table and what was counted on the way."""

    path: str
    table: DataFrame
    counts: dict[str, Any]


def merge_folder(
    spark: SparkSession,
    folder: str,
    out: str = "output.csv",
    keys: Sequence[str] | None = None,
    **read_options,
) -> Step:
    """Stack ``folder/*.csv``, keep one row per ``keys`` (all columns if none), write ``out``.

    ``out`` itself is not read if it lies in ``folder``.
    """
    raw = read_raw(spark, folder, exclude=[out], **read_options)
    merged, counts = dedup_counted(raw, keys)
    write_events_csv(merged, out, replace=True)
    return Step(out, read_events_csv(spark, out), _merge_counts(raw, counts))


def _merge_counts(raw: DataFrame, counts: Observation) -> dict[str, Any]:
    found = counts.get
    removed = found["rows_before"] - found["rows_after"]
    return {**found, "rows_removed": removed, "columns": ", ".join(raw.columns)}


def clean_table(
    spark: SparkSession,
    path: str,
    out: str | None = "output.csv",
    bad: Sequence[str] = INVALID_IDS,
    top: int = 10,
) -> Step:
    """Drop rows with an invalid id and write ``out``, or ``path`` itself if ``None``.

    The counts hold the audit and the most frequent ids before and after.
    """
    rows = saved(read_table(spark, path))
    valid = drop_invalid_ids(rows, ID, bad)
    counts = clean_audit(rows, ID, bad).first().asDict()
    counts["top_before"] = [tuple(r) for r in top_values(rows, ID, top).collect()]
    counts["top_after"] = [tuple(r) for r in top_values(valid, ID, top).collect()]
    target = out or path
    write_events_csv(valid, target, replace=True)
    return Step(target, read_events_csv(spark, target), counts)


def split_table(
    spark: SparkSession, path: str, out_dir: str = "split_out", **parse_options
) -> dict[str, str]:
    """Parse the params and write ``<out_dir>/<event>.csv`` for every event.

    In this step an empty cell is a missing one, quoted or not.
    """
    rows = read_table(spark, path, empty_as_null=True)
    staged = stage_by_event(parse_params(rows, **parse_options), scratch_path(spark))
    return write_split(staged, out_dir)


def events_of(raw: DataFrame) -> DataFrame:
    """Merged raw rows to clean, parsed events; lazy.

    The id filter is on a dedup key, so Catalyst moves it below the dedup: rows
    without a real user never enter the shuffle.
    """
    return parse_params(drop_invalid_ids(dedup(raw, DEDUP_KEYS)))


@dataclass
class FolderResult:
    """Where the stages of ``process_folder`` are, and what they counted."""

    merged: str
    clean: str
    parsed: str
    events: dict[str, str] = field(default_factory=dict)
    counts: dict[str, Any] = field(default_factory=dict)


def process_folder(
    spark: SparkSession, in_dir: str, out_dir: str, **read_options
) -> FolderResult:
    """Read ``in_dir/*.csv`` and write every stage below ``out_dir``.

    Stages are Parquet; the per-event tables at the end are CSV. The raw files are
    read once. Counts come from the write itself and from the files written.
    """
    out = out_dir.rstrip("/")
    result = FolderResult(f"{out}/merged", f"{out}/clean", f"{out}/parsed")

    def stage(df: DataFrame, path: str) -> DataFrame:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    raw = read_raw(spark, in_dir, **read_options)
    unique, counts = dedup_counted(raw, DEDUP_KEYS)
    merged = stage(unique, result.merged)
    # An empty id is a missing one, and so is every empty cell further on.
    bad = (*INVALID_IDS, "")
    clean = stage(drop_invalid_ids(merged, ID, bad), result.clean)
    merge_counts = _merge_counts(raw, counts)
    result.counts = {**merge_counts, **clean_audit(merged, ID, bad).first().asDict()}
    rows = null_handling(clean, NullRules(null_tokens=("",)))
    staged = stage_by_event(parse_params(rows), result.parsed)
    seen = staged.rows.agg(
        F.count(F.lit(1)).alias("staged"), F.count_if(~F.col("params_ok")).alias("unreadable")
    ).first()
    result.counts["rows_without_event"] = result.counts["remaining_rows"] - seen["staged"]
    result.counts["unreadable_params"] = seen["unreadable"]
    result.events = write_split(staged, f"{out}/events")
    return result
