"""Button clicks, alone and against user tier and ad behaviour. Definitions are ours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrace.functions.numbers import ratio
from playtrace.operators.ads import ad_shows
from playtrace.operators.users import user_tiers
from playtrace.settings import EVENT, ID, MAX_GROUP_ROWS, Roles


def clicks_per_user(E: DataFrame, roles: Roles) -> DataFrame:
    """Clicks per (button, user). Joins start from here, never from single clicks."""
    return (
        E.filter(F.col(EVENT) == roles.button)
        .groupBy(F.expr(roles.button_id).alias("button"), ID)
        .agg(F.count(F.lit(1)).alias("clicks"))
    )


def button_clicks(E: DataFrame, roles: Roles) -> DataFrame:
    """Per button: clicks and distinct users."""
    return (
        clicks_per_user(E, roles)
        .groupBy("button")
        .agg(F.sum("clicks").alias("clicks"), F.count(ID).alias("users"))
    )


def _by_group(clicks: DataFrame, group: str) -> DataFrame:
    return (
        clicks.groupBy("button", group)
        .agg(F.sum("clicks").alias("clicks"), F.count(ID).alias("users"))
        .withColumn("clicks_per_user", ratio("clicks", "users"))
    )


def button_by_tier(E: DataFrame, roles: Roles) -> DataFrame:
    """Per button and user tier: clicks, users who clicked, clicks per such user."""
    tiers = user_tiers(E).select(ID, "tier")
    return _by_group(clicks_per_user(E, roles).join(tiers, ID), "tier")


def button_by_ad_group(
    E: DataFrame, roles: Roles, max_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Per button, for users who watched an ad to its end and for all others."""
    watchers = ad_shows(E, roles, max_rows).filter("completed").select(ID).distinct()
    watchers = watchers.withColumn("watched", F.lit(True))
    clicks = clicks_per_user(E, roles).join(watchers, ID, "left")
    return _by_group(
        clicks.withColumn("watched_ad", F.coalesce("watched", F.lit(False))), "watched_ad"
    )


def button_cube(E: DataFrame, roles: Roles, max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Clicks by button, user tier and ad group: all combinations and all totals, in one pass over the clicks.

    ``by_button``, ``by_tier`` and ``by_ad_group`` tell which of the three a row is grouped by; in the others it
    is a total and the column is null. ``users`` are distinct, in totals too.
    """
    clicks = clicks_per_user(E, roles).join(user_tiers(E).select(ID, "tier"), ID)
    watchers = ad_shows(E, roles, max_rows).filter("completed").select(ID).distinct()
    clicks = clicks.join(watchers.withColumn("watched", F.lit(True)), ID, "left")
    clicks = clicks.withColumn("watched_ad", F.coalesce("watched", F.lit(False)))
    groups = {"by_button": "button", "by_tier": "tier", "by_ad_group": "watched_ad"}
    return (
        clicks.cube(*groups.values())
        .agg(
            *[(F.grouping(column) == 0).alias(name) for name, column in groups.items()],
            F.sum("clicks").alias("clicks"),
            F.count_distinct(ID).alias("users"),
        )
        .withColumn("clicks_per_user", ratio("clicks", "users"))
    )
