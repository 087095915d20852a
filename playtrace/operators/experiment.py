"""Assigning users to the arms of an experiment, and comparing the arms."""

from __future__ import annotations

import datetime
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playtrace.functions.numbers import ratio
from playtrace.operators.users import user_span
from playtrace.settings import CHURN_DAYS, ID


def arm_of(user: Column, salt: str, arms: int) -> Column:
    """First 32 bits of ``md5(salt:user)`` modulo the number of arms."""
    digest = F.md5(F.concat(F.lit(f"{salt}:"), user).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % arms).cast("int")


def ab_assign(E: DataFrame, salt: str, arms: int = 2) -> DataFrame:
    """The arm of every user; the same in every run and on every cluster."""
    return E.select(ID).distinct().withColumn("arm", arm_of(F.col(ID), salt, arms))


def ab_metrics(
    E: DataFrame,
    salt: str,
    arms: int = 2,
    days: int = CHURN_DAYS,
    as_of: datetime.date | None = None,
) -> DataFrame:
    """Per arm: users, churned, retained, churn rate, lift and z against arm 0.

    ``z`` is the two-proportion test with a pooled variance.
    """
    users = user_span(E).withColumn("arm", arm_of(F.col(ID), salt, arms))
    # One row per arm and day: few enough for windows over all of them, so E is read once.
    last_days = users.groupBy("arm", "last_d").agg(F.count(F.lit(1)).alias("users"))
    everything = Window.partitionBy()
    end = F.lit(as_of) if as_of else F.max("last_d").over(everything)
    last_days = last_days.withColumn("churned", F.col("last_d") < F.date_sub(end, days))
    per_arm = last_days.groupBy("arm").agg(
        F.sum("users").alias("users"),
        F.coalesce(F.sum(F.when(F.col("churned"), F.col("users"))), F.lit(0)).alias("churned"),
    )
    control = F.max(F.when(F.col("arm") == 0, F.struct("users", "churned"))).over(everything)
    n, x = F.col("users"), F.col("churned")
    n0, x0 = F.col("control.users"), F.col("control.churned")
    pooled = ratio(x + x0, n + n0)
    spread = F.sqrt(pooled * (1 - pooled) * (ratio(F.lit(1), n) + ratio(F.lit(1), n0)))
    rate, rate0 = ratio(x, n), ratio(x0, n0)
    return per_arm.withColumn("control", control).select(
        "arm",
        "users",
        "churned",
        (n - x).alias("retained"),
        rate.alias("churn_rate"),
        F.try_divide(rate - rate0, rate0).alias("lift"),
        F.try_divide(rate - rate0, spread).alias("z"),
    )


def poisson_steps(bits: int = 32) -> list[int]:
    """``floor(2**bits * P(X <= n))`` for n = 0, 1, ... of a Poisson variable of mean 1, while below ``2**bits``.

    The number of steps that a uniform draw of ``bits`` bits has reached is such a variable.
    """
    steps, total, n = [], 0.0, 0
    while True:
        total += math.exp(-1) / math.factorial(n)
        step = math.floor(total * 2**bits)
        if step >= 2**bits - 1:
            return steps
        steps.append(step)
        n += 1


#: Hex digits of a draw, and draws in a digest.
_DIGITS, _DRAWS = 8, 4


def bootstrap_weights(users: DataFrame, salt: str, replicates: int) -> DataFrame:
    """Each user in each replicate where the weight is not 0: ``replicate`` (from 1) and ``weight``.

    Replicate 0 holds every user once with weight 1. The weight is Poisson with mean 1 and comes from
    ``md5(salt:boot<block>:user)``, whose 32 hex digits are the draws of four replicates; so it is the same
    in every run, and users need not be brought together to be drawn.
    """
    blocks = F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-replicates // _DRAWS) - 1)))).alias("block")
    text = F.concat(F.lit(f"{salt}:boot"), F.col("block").cast("string"), F.lit(":"), F.col(ID))
    digest = F.md5(text.cast("binary"))
    steps = poisson_steps()

    def draw(at: int) -> Column:
        value = F.conv(F.substring("digest", 1 + _DIGITS * at, _DIGITS), 16, 10).cast("long")
        return F.struct((F.col("block") * _DRAWS + at + 1).alias("replicate"), value.alias("value"))

    drawn = users.select("*", blocks).withColumn("digest", digest)
    drawn = drawn.withColumn("draw", F.explode(F.array(*[draw(i) for i in range(_DRAWS)])))
    weight = sum((F.when(F.col("draw.value") >= step, 1).otherwise(0) for step in steps), F.lit(0))
    weighted = drawn.select(*users.columns, F.col("draw.replicate").alias("replicate"), weight.alias("weight"))
    weighted = weighted.filter((F.col("replicate") <= replicates) & (F.col("weight") > 0))
    return users.select("*", F.lit(0).alias("replicate"), F.lit(1).alias("weight")).unionByName(weighted)


def ab_intervals(
    E: DataFrame,
    salt: str,
    start: datetime.date,
    metric: Column | None = None,
    arms: int = 2,
    replicates: int = 200,
    bounds: Sequence[float] = (0.025, 0.975),
) -> DataFrame:
    """Per arm: the metric per user since ``start``, its difference to arm 0, and an interval of that difference.

    ``metric`` is summed over a user's events, by default it counts them (a null adds nothing). ``covariate`` is
    the mean of the same sum before ``start``; a user of only one period has 0 in the other. The ``adjusted``
    difference is freed of the arms' difference before the start: ``slope``, that of the outcome on the covariate
    over all users, times the difference of the covariates is taken off. Where all users have the same covariate
    there is nothing to adjust.

    Intervals are quantiles of the differences over ``replicates`` Poisson bootstrap replicates
    (``bootstrap_weights``). Only one row per arm and replicate is shuffled; the users themselves
    are brought together once, by the sum over their events.
    """
    amount = (F.lit(1) if metric is None else metric).cast("double")
    later = F.col("d") >= F.lit(start)
    zero = F.lit(0.0)
    users = E.groupBy(ID).agg(
        F.coalesce(F.sum(F.when(~later, amount)), zero).alias("before"),
        F.coalesce(F.sum(F.when(later, amount)), zero).alias("after"),
    )
    slope = users.agg(F.coalesce(F.regr_slope("after", "before"), zero)).scalar()
    users = users.withColumn("arm", arm_of(F.col(ID), salt, arms))
    w = F.col("weight")
    sums = bootstrap_weights(users, salt, replicates).groupBy("replicate", "arm")
    sums = sums.agg(
        F.sum(w).alias("users"), F.sum(w * F.col("before")).alias("before"), F.sum(w * F.col("after")).alias("after")
    )
    means = sums.select(
        "replicate", "arm", "users", ratio("before", "users").alias("covariate"), ratio("after", "users").alias("mean")
    )
    # One row per arm and replicate.
    control = F.max(F.when(F.col("arm") == 0, F.struct("covariate", "mean")))
    control = control.over(Window.partitionBy("replicate"))
    gaps = means.withColumn("control", control).select(
        "*",
        slope.alias("slope"),
        (F.col("mean") - F.col("control.mean")).alias("difference"),
        (F.col("covariate") - F.col("control.covariate")).alias("gap"),
    )
    gaps = gaps.withColumn("adjusted", F.col("difference") - F.col("slope") * F.col("gap"))

    def whole(name: str) -> Column:
        return F.max(F.when(F.col("replicate") == 0, F.col(name))).alias(name)

    def bound(name: str, at: float, ending: str) -> Column:
        return F.percentile(F.when(F.col("replicate") > 0, F.col(name)), at).alias(f"{name}_{ending}")

    low, high = bounds
    return gaps.groupBy("arm").agg(
        whole("users"),
        whole("covariate"),
        whole("mean"),
        whole("slope"),
        *[
            column
            for name in ("difference", "adjusted")
            for column in (whole(name), bound(name, low, "low"), bound(name, high, "high"))
        ],
    )
