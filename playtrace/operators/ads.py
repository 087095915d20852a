"""Full-screen ads and rewarded videos. Definitions are ours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrace.functions.numbers import ratio
from playtrace.operators.behavior import by_user, longer_than
from playtrace.operators.sequence import track, with_following, with_next, with_running_sum
from playtrace.operators.timejoin import interval_join
from playtrace.scratch import saved
from playtrace.settings import EVENT, ID, MAX_GROUP_ROWS, Roles


def ad_shows(E: DataFrame, roles: Roles, max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """One row per shown ad with ``completed``: the user's next ad event is a completion, at ``done_ts``."""
    ads = E.filter(F.col(EVENT).isin(roles.ad_show, roles.ad_done))
    ads = ads.withColumn("scene", F.expr(roles.scene))
    t = with_next(
        by_user(ads, EVENT, "d", "scene", max_rows=max_rows), "next", F.col(EVENT), F.col("ts")
    )
    completed = F.coalesce(F.col(f"next.{EVENT}") == roles.ad_done, F.lit(False))
    return t.rows.filter(F.col(EVENT) == roles.ad_show).select(
        ID, "ts", "event_id", "d", "scene", completed.alias("completed"),
        F.when(completed, F.col("next.ts")).alias("done_ts"),
    )


def ad_completion(
    E: DataFrame, roles: Roles, max_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Per day: ads shown, ads completed, completion rate."""
    return (
        ad_shows(E, roles, max_rows)
        .groupBy("d")
        .agg(F.count(F.lit(1)).alias("shows"), F.count_if("completed").alias("completed"))
        .withColumn("completion_rate", ratio("completed", "shows"))
    )


def reward_video_funnel(
    E: DataFrame, roles: Roles, max_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Per scene: shows, users, shows per active user, completions, completion rate."""
    # First per (scene, user), so that distinct users need no second look at the rows.
    per_user = (
        ad_shows(E, roles, max_rows)
        .groupBy("scene", ID)
        .agg(F.count(F.lit(1)).alias("shows"), F.count_if("completed").alias("completed"))
    )
    active = E.agg(F.count_distinct(ID)).scalar()
    return (
        per_user.groupBy("scene")
        .agg(
            F.sum("shows").alias("shows"),
            F.count(ID).alias("users"),
            F.sum("completed").alias("completed"),
        )
        .withColumn("shows_per_active_user", ratio(F.col("shows"), active))
        .withColumn("completion_rate", ratio("completed", "shows"))
    )


def reward_scene_rank(
    E: DataFrame, roles: Roles, max_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Scenes by completion rate, best first; equal rates share a rank."""
    scenes = saved(
        reward_video_funnel(E, roles, max_rows).select(
            "scene", "shows", "completed", "completion_rate"
        )
    )
    # A rank is one plus the number of scenes with a higher rate. The running
    # sum is checked for size like any other, so many scenes are no problem.
    rates = scenes.groupBy("completion_rate").agg(F.count(F.lit(1)).alias("scenes"))
    worst_last = rates.withColumn("key", -F.col("completion_rate"))
    t = with_running_sum(track(worst_last, (), ("key",), max_rows), "upto", F.col("scenes"))
    ranks = t.rows.select(
        "completion_rate", (F.col("upto") - F.col("scenes") + 1).alias("scene_rank")
    )
    return scenes.join(ranks, "completion_rate").select(
        "scene", "shows", "completed", "completion_rate", "scene_rank"
    )


def events_in_ads(
    E: DataFrame, roles: Roles, bin_s: int = 60, max_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Per scene and event: what users do between the show of an ad and its completion.

    ``events`` strictly within a completed ad of the same user, ``ads`` and ``users`` that have any.
    """
    shows = ad_shows(E, roles, max_rows).filter("completed")
    shows = shows.select(ID, F.col("ts").alias("start_ts"), F.col("done_ts").alias("end_ts"), "scene", F.col("event_id").alias("ad"))
    others = E.filter(~F.col(EVENT).isin(roles.ad_show, roles.ad_done)).select(ID, "ts", EVENT)
    inside = interval_join(others, shows, (ID,), bin_s=bin_s)
    # First per ad, so that a busy user's events are added up before they are counted by scene.
    per_ad = inside.groupBy("scene", EVENT, ID, "ad", "start_ts").agg(F.count(F.lit(1)).alias("events"))
    per_user = per_ad.groupBy("scene", EVENT, ID).agg(F.sum("events").alias("events"), F.count(F.lit(1)).alias("ads"))
    return per_user.groupBy("scene", EVENT).agg(
        F.sum("events").alias("events"), F.sum("ads").alias("ads"), F.count(F.lit(1)).alias("users")
    )


def funnel_steps(
    E: DataFrame, steps: Sequence[str], within_s: int, max_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Per step: how many occurrences of the first step reach it within ``within_s`` seconds.

    ``steps`` are event names; each has to follow the one before, other events may stand between. From every row the first
    following one of the next step is looked up, last step first, so each row knows the times of
    all that can follow it. Columns: ``step`` from 1, ``event``, ``reached``, ``rate`` of all starts.
    """
    t = by_user(E.filter(F.col(EVENT).isin(*steps)), EVENT, max_rows=max_rows)
    t = t.with_column("times", F.array("ts"))
    nothing = F.array().cast("array<timestamp_ntz>")
    for following in reversed(steps[1:]):
        t = with_following(t, "then", F.when(F.col(EVENT) == following, F.col("times")))
        t = t.with_column("times", F.concat(F.array("ts"), F.coalesce("then", nothing)))
    starts = t.rows.filter(F.col(EVENT) == steps[0])

    def reached(step: int):
        at = F.get("times", F.lit(step))
        return F.count_if(at.isNotNull() & ~longer_than(within_s, F.col("ts"), at))

    counts = starts.agg(*[reached(i).alias(f"n{i}") for i in range(len(steps))])
    rows = F.array(
        *[
            F.struct(F.lit(i + 1).alias("step"), F.lit(name).alias("event"), F.col(f"n{i}").alias("reached"))
            for i, name in enumerate(steps)
        ]
    )
    return counts.select("n0", F.inline(rows)).select("step", "event", "reached", ratio("reached", "n0").alias("rate"))
