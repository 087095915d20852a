"""What goes with leaving: last events, losing streaks, high bets. Definitions are ours."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playtrace.functions.numbers import ratio
from playtrace.operators.ads import ad_shows
from playtrace.operators.behavior import by_user, longer_than, rounds_in_order
from playtrace.operators.quantiles import percentiles
from playtrace.operators.sequence import with_next, with_running_sum
from playtrace.operators.timejoin import asof_join
from playtrace.operators.users import last_day, user_churn, user_span
from playtrace.settings import (
    CHURN_DAYS,
    EVENT,
    ID,
    MAX_GROUP_ROWS,
    SESSION_GAP_S,
    Roles,
)


def session_exits(
    E: DataFrame, gap_s: int = SESSION_GAP_S, max_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """The last event of every session."""
    # It is one that is followed by nothing or by a long pause; no session numbers are needed.
    t = with_next(by_user(E, EVENT, max_rows=max_rows), "next", F.col("ts"))
    after = F.col("next.ts")
    last = t.rows.filter(after.isNull() | longer_than(gap_s, F.col("ts"), after))
    return last.select(ID, "ts", "event_id", EVENT)


def exit_events(
    E: DataFrame, gap_s: int = SESSION_GAP_S, max_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Per event: how many sessions it ends, and its share of all sessions."""
    last = session_exits(E, gap_s, max_rows)
    exits = last.groupBy(EVENT).agg(F.count(F.lit(1)).alias("exits"))
    return exits.withColumn("share", ratio(F.col("exits"), exits.agg(F.sum("exits")).scalar()))


def exit_causes(
    E: DataFrame,
    roles: Roles,
    gap_s: int = SESSION_GAP_S,
    within_s: int = SESSION_GAP_S,
    high_bet: float = 0.0,
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Session exits by what went before: the user's last round, last ad and last bet.

    Each is the latest one that ended (round), was shown (ad) or made (bet) at most ``within_s`` seconds before the last
    event of the session, that event included. Columns: ``last_round`` (won, lost, none), ``last_ad`` (completed,
    broken_off, none), ``exits``, ``with_bet``, ``high_bets`` (last bet of ``high_bet`` or more), ``share``.
    """
    exits = session_exits(E, gap_s, max_rows)
    rounds = rounds_in_order(E, roles, max_rows).rows
    before = {
        "round": rounds.select(ID, F.col("next.ts").alias("ts"), "event_id", "win"),
        "ad": ad_shows(E, roles, max_rows).select(ID, "ts", "event_id", "completed"),
        "bet": E.filter(F.col("value").isNotNull()).select(ID, "ts", "event_id", "value"),
    }
    joined = asof_join(exits, before, (ID,), within_s=within_s, tie="event_id", max_rows=max_rows)
    last_round = F.when(F.col("round").isNull(), "none").when(F.col("round.win"), "won").otherwise("lost")
    last_ad = F.when(F.col("ad").isNull(), "none").when(F.col("ad.completed"), "completed").otherwise("broken_off")
    causes = joined.groupBy(last_round.alias("last_round"), last_ad.alias("last_ad")).agg(
        F.count(F.lit(1)).alias("exits"),
        F.count("bet").alias("with_bet"),
        F.count_if(F.col("bet.value") >= high_bet).alias("high_bets"),
    )
    everything = F.sum("exits").over(Window.partitionBy())
    # Nine rows at most.
    return causes.withColumn("share", ratio(F.col("exits"), everything))


def _churn_by(users: DataFrame, group: str, churn: DataFrame) -> DataFrame:
    return _churn_rate(users.join(churn.select(ID, "churned"), ID), group)


def _churn_rate(users: DataFrame, group: str) -> DataFrame:
    return (
        users.groupBy(group)
        .agg(F.count(F.lit(1)).alias("users"), F.count_if("churned").alias("churned"))
        .withColumn("churn_rate", ratio("churned", "users"))
    )


def longest_losses(E: DataFrame, roles: Roles, max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """The longest run of consecutive lost rounds of every user with a round."""
    t = with_running_sum(
        rounds_in_order(E, roles, max_rows), "wins_so_far", F.col("win").cast("long")
    )
    # Between two wins the count stands still, so it names the run of losses.
    runs = t.rows.groupBy(ID, "wins_so_far").agg(F.count_if(~F.col("win")).alias("losses"))
    return runs.groupBy(ID).agg(F.max("losses").alias("longest_streak"))


def loss_streak_churn(
    E: DataFrame,
    roles: Roles,
    days: int = CHURN_DAYS,
    as_of: datetime.date | None = None,
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Churn by the user's longest run of consecutive lost rounds."""
    return _churn_by(longest_losses(E, roles, max_rows), "longest_streak", user_churn(E, days, as_of))


def survival(users: DataFrame, group: str) -> DataFrame:
    """The product-limit estimate per ``group`` from one row per user: ``group``, ``days`` and ``churned``.

    A user who has not churned is censored at ``days``: at risk until then, and neither gone nor staying after it.
    Columns: ``days``, ``at_risk`` (users with as many days or more), ``churned``, ``censored`` and ``survival``,
    the share that is expected to stay beyond ``days``. Users are counted per day before the window, so its rows
    are the days of a group, whatever the number of users.
    """
    per_day = users.groupBy(group, "days").agg(
        F.count(F.lit(1)).alias("users"), F.count_if("churned").alias("churned")
    )
    on = Window.partitionBy(group).orderBy("days").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = Window.partitionBy(group).orderBy("days").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    at_risk = per_day.withColumn("at_risk", F.sum("users").over(later))
    # Where all at risk go, the product is zero and the day is the group's last.
    staying = F.exp(F.sum(F.log(1 - ratio("churned", "at_risk"))).over(on))
    return at_risk.select(
        group,
        "days",
        "at_risk",
        "churned",
        (F.col("users") - F.col("churned")).alias("censored"),
        F.when(F.col("churned") == F.col("at_risk"), 0.0).otherwise(staying).alias("survival"),
    )


def survival_by_streak(
    E: DataFrame,
    roles: Roles,
    days: int = CHURN_DAYS,
    as_of: datetime.date | None = None,
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Time from a user's first to last active day, by the longest run of lost rounds.

    Users who were active within ``days`` before ``as_of`` have not churned and are censored.
    """
    limit = F.date_sub(last_day(E, as_of), days)
    spans = user_span(E).select(
        ID,
        F.date_diff("last_d", "first_d").cast("long").alias("days"),
        (F.col("last_d") < limit).alias("churned"),
    )
    return survival(longest_losses(E, roles, max_rows).join(spans, ID), "longest_streak")


def bet_risk_churn(
    E: DataFrame,
    days: int = CHURN_DAYS,
    as_of: datetime.date | None = None,
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Churn by the share of a user's bets at or above the 90th percentile of all bets.

    ``risk_percent`` is the lower bound of a 5 % bucket.
    """
    seen = E.agg(F.count("value").alias("bets"), F.max("d").alias("last_d")).first()
    high = percentiles(E.select("value"), "value", {"p90": 0.9}, at_most=seen.bets, max_rows=max_rows)
    limit = high.select("p90").scalar()
    users = E.groupBy(ID).agg(
        F.count("value").alias("bets"),
        F.count_if(F.col("value") >= limit).alias("high_bets"),
        F.max("d").alias("last_d"),
    )
    left = F.col("last_d") < F.date_sub(F.lit(as_of or seen.last_d).cast("date"), days)
    risk = F.expr("5 * (20 * high_bets div bets)").alias("risk_percent")
    return _churn_rate(users.filter("bets > 0").select(risk, left.alias("churned")), "risk_percent")
