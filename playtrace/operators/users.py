"""Active, new, churned and retained users, and user tiers. Definitions are ours.

``E`` is the typed event view. Everything about users and days starts from one
row per user and block of 64 days, which holds the active days as the bits of a
bigint. Spark combines these inside each map task, so what is shuffled grows with
the users and not with their events or active days, and a user with very many
events is one row per task.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playtrace.functions.numbers import ratio
from playtrace.settings import CHURN_DAYS, ID


def active_blocks(E: DataFrame) -> DataFrame:
    """``(idfa, block, days, first_day)``, one row per user and block of 64 days.

    Bit ``i`` of ``days`` is day ``64 * block + i`` since 1970; ``first_day`` counts
    from 1970, too.
    """
    return E.groupBy(ID, F.expr("shiftright(unix_date(d), 6) as block")).agg(
        F.expr("bit_or(shiftleft(1L, unix_date(d) & 63)) as days"),
        F.expr("min(unix_date(d)) as first_day"),
    )


def active_days(E: DataFrame) -> DataFrame:
    """Distinct ``(idfa, d)``."""
    # The outer form keeps Spark from inferring a filter that lists the bits twice.
    each = "explode_outer(filter(sequence(0, 63), i -> getbit(days, i) = 1)) as i"
    return (
        active_blocks(E)
        .selectExpr(ID, "block", each)
        .selectExpr(ID, "date_from_unix_date(64 * block + i) as d")
    )


def _active_per(E: DataFrame, period: Column, name: str, count: str) -> DataFrame:
    pairs = E.select(ID, period.alias(name)).distinct()
    return pairs.groupBy(name).agg(F.count(ID).alias(count))


def dau(E: DataFrame) -> DataFrame:
    """Distinct users per day."""
    return active_days(E).groupBy("d").agg(F.count(ID).alias("dau"))


def wau(E: DataFrame) -> DataFrame:
    """Distinct users per week; a week is named by its Monday."""
    return _active_per(E, F.trunc("d", "week"), "week", "wau")


def mau(E: DataFrame) -> DataFrame:
    """Distinct users per month, named by its first day."""
    return _active_per(E, F.trunc("d", "month"), "month", "mau")


def user_span(E: DataFrame) -> DataFrame:
    """First and last active day per user."""
    return E.groupBy(ID).agg(F.min("d").alias("first_d"), F.max("d").alias("last_d"))


def last_day(E: DataFrame, as_of: datetime.date | None = None) -> Column:
    """``as_of``, or the last day in the data as a scalar subquery."""
    return F.lit(as_of) if as_of else E.agg(F.max("d")).scalar()


def new_users(E: DataFrame) -> DataFrame:
    """Users per first active day."""
    return (
        user_span(E)
        .groupBy(F.col("first_d").alias("d"))
        .agg(F.count(F.lit(1)).alias("new_users"))
    )


def user_churn(
    E: DataFrame, days: int = CHURN_DAYS, as_of: datetime.date | None = None
) -> DataFrame:
    """Every user with the flag ``churned``: last active before ``as_of - days``."""
    limit = F.date_sub(last_day(E, as_of), days)
    return user_span(E).select(ID, "last_d", (F.col("last_d") < limit).alias("churned"))


def churned_users(
    E: DataFrame, days: int = CHURN_DAYS, as_of: datetime.date | None = None
) -> DataFrame:
    """The churned users and their last active day."""
    return user_churn(E, days, as_of).filter("churned").select(ID, "last_d")


def retention(
    E: DataFrame,
    offsets: Sequence[int] = (1, 3, 7, 14),
    as_of: datetime.date | None = None,
) -> DataFrame:
    """Per first day and offset: cohort size, users active on that later day, rate.

    Only offsets that the data reaches are listed.
    """
    # A user has one row per 64 days of the log, so this window stays small.
    first = F.min("first_day").over(Window.partitionBy(ID))
    blocks = active_blocks(E).withColumn("first_day", first)

    def active_on(offset: int) -> Column:
        day = f"first_day + {offset}"
        return F.expr(
            f"count_if(shiftright({day}, 6) = block and getbit(days, ({day}) & 63) = 1)"
        )

    cohorts = blocks.groupBy(F.expr("date_from_unix_date(first_day) as cohort_d")).agg(
        active_on(0).alias("cohort_users"),
        *[active_on(offset).alias(f"_on_{offset}") for offset in offsets],
    )
    per_offset = F.explode(
        F.array(
            *[
                F.struct(F.lit(o).alias("day_n"), F.col(f"_on_{o}").alias("retained_users"))
                for o in offsets
            ]
        )
    )
    return (
        cohorts.select("cohort_d", "cohort_users", per_offset.alias("r"))
        .select("cohort_d", "cohort_users", "r.*")
        .filter(F.date_add("cohort_d", F.col("day_n")) <= last_day(E, as_of))
        .withColumn("retention_rate", ratio("retained_users", "cohort_users"))
    )


def user_tiers(E: DataFrame) -> DataFrame:
    """Tier 1 to 4 per user: number of events against the quartiles of all users."""
    users = E.groupBy(ID).agg(F.count(F.lit(1)).alias("n_events"))
    # Distinct event counts: d different ones need at least d * d / 2 events, so
    # even 10^12 events leave the percentile buffer below 1.5 million entries.
    spread = users.groupBy("n_events").agg(F.count(F.lit(1)).alias("users"))
    quartiles = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    limits = spread.agg(F.percentile("n_events", quartiles, F.col("users"))).scalar()
    placed = users.withColumn("_limits", limits)
    above = [(F.col("n_events") > F.col("_limits")[i]).cast("int") for i in range(3)]
    return placed.select(ID, "n_events", (1 + above[0] + above[1] + above[2]).alias("tier"))


def user_levels(E: DataFrame, level: str) -> DataFrame:
    """The other reading of a user tier: highest in-game level per user.

    ``level`` is a SQL expression over ``E``, e.g. ``"int(params['level'])"``.
    """
    return E.groupBy(ID).agg(F.max(F.expr(level)).alias("level"))
