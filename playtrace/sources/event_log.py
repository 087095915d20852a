"""The typed event view that the metrics read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtrace.settings import EVENT, ID, PARAM, TIME


def typed_events(
    parsed: DataFrame,
    *,
    value: Column | None = None,
    event_id: Column | None = None,
) -> DataFrame:
    """``E(idfa, event, ts, d, value, params, event_id)`` from a parsed log.

    ``time`` text becomes ``ts``. A row whose time cannot be read has no place in any
    order, and a null id is no user: both are left out, and ``event_view_audit``
    counts them.
    ``value`` defaults to the ``value`` parameter. ``event_id`` breaks ties
    between events at the same instant; by default it is a hash of the row's
    text, so it is the same in every run.
    """
    if value is None:
        value = F.try_element_at("params", F.lit("value")).try_cast("double")
    if event_id is None:
        event_id = F.xxhash64(EVENT, TIME, PARAM)
    ts = F.col(TIME).try_cast("timestamp_ntz")
    return parsed.select(
        ID,
        EVENT,
        ts.alias("ts"),
        ts.cast("date").alias("d"),
        value.alias("value"),
        "params",
        event_id.alias("event_id"),
    ).filter(F.col("ts").isNotNull() & F.col(ID).isNotNull())


def event_view_audit(parsed: DataFrame) -> DataFrame:
    """One row: all rows, those with a null id, with an unreadable time, and those left."""
    no_id, no_time = F.col(ID).isNull(), F.col(TIME).try_cast("timestamp_ntz").isNull()
    return parsed.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(no_id).alias("null_ids"),
        F.count_if(no_time).alias("unreadable_times"),
        F.count_if(~no_id & ~no_time).alias("rows_in_view"),
    )
