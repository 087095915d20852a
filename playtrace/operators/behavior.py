"""Sessions, intervals, rounds and bets. Definitions are ours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtrace.functions.numbers import ratio
from playtrace.operators.quantiles import percentiles
from playtrace.operators.sequence import (
    Track,
    track,
    with_next,
    with_previous,
    with_running_sum,
)
from playtrace.settings import EVENT, ID, MAX_GROUP_ROWS, SESSION_GAP_S, Roles

ORDER = ("ts", "event_id")


def by_user(E: DataFrame, *columns: str, max_rows: int = MAX_GROUP_ROWS) -> Track:
    """``E`` in time order per user, with the named columns only."""
    return track(E.select(ID, *ORDER, *columns), (ID,), ORDER, max_rows)


def microseconds(start: Column | str, end: Column | str) -> Column:
    """``end - start``. An interval, not ``timestamp_diff``: that goes through the
    session's time zone, and moves times which a change to summer time skips."""
    start = F.col(start) if isinstance(start, str) else start
    end = F.col(end) if isinstance(end, str) else end

    def part(unit: str) -> Column:
        return F.extract(F.lit(unit), end - start)

    minutes = (part("DAY").cast("long") * 24 + part("HOUR")) * 60 + part("MINUTE")
    return minutes * 60_000_000 + (part("SECOND") * 1_000_000).cast("long")


def longer_than(gap_s: int, start: Column, end: Column) -> Column:
    return (end - start) > F.make_dt_interval(secs=F.lit(gap_s))


def sessions(
    E: DataFrame, gap_s: int = SESSION_GAP_S, max_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """One row per session; a pause of more than ``gap_s`` seconds starts a new one."""
    t = with_previous(by_user(E, max_rows=max_rows), "prev", F.col("ts"))
    prev = F.col("prev.ts")
    starts = prev.isNull() | longer_than(gap_s, prev, F.col("ts"))
    t = t.with_column("starts", starts.cast("long"))
    t = with_running_sum(t, "session_no", F.col("starts"))
    return (
        t.rows.groupBy(ID, "session_no")
        .agg(
            F.min("ts").alias("start_ts"),
            F.max("ts").alias("end_ts"),
            F.count(F.lit(1)).alias("n_events"),
        )
        .withColumn("duration_us", microseconds("start_ts", "end_ts"))
    )


def session_duration_dist(
    E: DataFrame,
    gap_s: int = SESSION_GAP_S,
    edges_s: Sequence[int] = (0, 60, 300, 600, 1800, 3600, 7200),
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Sessions and events per duration bucket ``[from_s, next edge)``."""
    duration = F.col("duration_us")
    start = F.lit(edges_s[0])
    for edge in edges_s[1:]:
        start = F.when(duration >= edge * 1_000_000, edge).otherwise(start)
    return (
        sessions(E, gap_s, max_rows)
        .groupBy(start.alias("from_s"))
        .agg(F.count(F.lit(1)).alias("sessions"), F.sum("n_events").alias("events"))
    )


def event_interval(E: DataFrame, max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Time since the user's previous event: median and 90th percentile per event."""
    t = with_previous(by_user(E, EVENT, max_rows=max_rows), "prev", F.col("ts"))
    gaps = t.rows.select(EVENT, microseconds(F.col("prev.ts"), F.col("ts")).alias("gap_us"))
    return percentiles(
        gaps,
        "gap_us",
        {"p50_us": 0.5, "p90_us": 0.9},
        by=(EVENT,),
        at_most=t.total,
        max_rows=max_rows,
    )


def rounds_in_order(
    E: DataFrame, roles: Roles, max_rows: int = MAX_GROUP_ROWS
) -> Track:
    """One row per round: a start that is directly followed by an end.

    "Directly" means among the user's round events. Columns: start ``ts`` and
    ``event_id``, ``duration_us`` and ``win``.
    """
    both = E.filter(F.col(EVENT).isin(roles.round_start, roles.round_end))
    both = both.withColumn("win", F.expr(roles.win))
    t = with_next(
        by_user(both, EVENT, "win", max_rows=max_rows),
        "next",
        F.col(EVENT),
        F.col("ts"),
        F.col("win"),
    )
    t = t.where(
        (F.col(EVENT) == roles.round_start) & (F.col(f"next.{EVENT}") == roles.round_end)
    )
    t = t.with_column("duration_us", microseconds(F.col("ts"), F.col("next.ts")))
    return t.with_column("win", F.coalesce(F.col("next.win"), F.lit(False)))


def round_stats(
    E: DataFrame, roles: Roles, max_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """One row: rounds, wins, win rate, and the mean, least and longest duration."""
    # A decimal total cannot overflow, and does not depend on the order of adding.
    total = F.sum(F.col("duration_us").cast("decimal(20,0)"))
    return (
        rounds_in_order(E, roles, max_rows)
        .rows.agg(
            F.count(F.lit(1)).alias("rounds"),
            F.count_if("win").alias("wins"),
            total.alias("total_us"),
            F.min("duration_us").alias("min_duration_us"),
            F.max("duration_us").alias("max_duration_us"),
        )
        .select(
            "rounds",
            "wins",
            ratio("wins", "rounds").alias("win_rate"),
            ratio("total_us", "rounds").alias("avg_duration_us"),
            "min_duration_us",
            "max_duration_us",
        )
    )


def bet_histogram(E: DataFrame, width: float) -> DataFrame:
    """Bets per bucket of fixed width; ``bucket`` is the lower bound."""
    bucket = F.floor(F.col("value") / F.lit(float(width))) * F.lit(float(width))
    return (
        E.filter(F.col("value").isNotNull())
        .groupBy(bucket.alias("bucket"))
        .agg(F.count(F.lit(1)).alias("bets"))
    )


def bet_percentiles(E: DataFrame, max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """One row: number of bets, quartiles and 95th percentile of the bet value."""
    points = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    return percentiles(E.select("value"), "value", points, max_rows=max_rows)
