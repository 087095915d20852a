"""Exact interpolated percentiles per group, for groups of any size.

Spark's ``percentile`` holds all distinct values of a group in one buffer. Here the distinct
values are counted. Where they are more than one task should rank, they are saved and range-partitioned; the slice
that holds each wanted rank follows from the slice totals, and only those slices are ranked. The formula is the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playtrace.operators.sequence import broadcast_up_to, same_keys, slice_count
from playtrace.scratch import saved
from playtrace.settings import MAX_GROUP_ROWS


def percentiles(
    df: DataFrame,
    value: str,
    points: dict[str, float],
    by: Sequence[str] = (),
    at_most: int | None = None,
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """One row per group: ``by``, ``n`` and one column per entry of ``points``.

    Null values are ignored. ``at_most`` is an upper bound on the number of rows
    of ``df``, if the caller has one; otherwise the rows are counted.
    """
    df, by = df.filter(F.col(value).isNotNull()), list(by)
    rows = df.count() if at_most is None else at_most
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_count"))
    if slice_count(rows, max_rows) > 1:
        counts = saved(counts)
        slices = slice_count(counts.count(), max_rows)
        if slices > 1:
            return _at_ranks(_wanted_slices(counts, value, points, by, slices), value, points, by)
    # All values of a group in one task, which is one slice.
    group = Window.partitionBy(*by)
    upto = F.sum("_count").over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    whole = counts.withColumn("n", F.sum("_count").over(group)).withColumn("_upto", upto)
    return _at_ranks(whole, value, points, by)


def _rank(p: float) -> Column:
    return F.lit(p) * (F.col("n") - 1)


def _wanted_slices(
    counts: DataFrame, value: str, points: dict[str, float], by: list[str], slices: int
) -> DataFrame:
    """The slices of ``counts`` that hold a wanted rank, with ``n`` and ``_upto``: rows up to each value."""
    ranked = saved(
        counts.repartitionByRange(slices, *by, value).withColumn(
            "_slice", F.spark_partition_id()
        )
    )
    # One row per (group, slice): rows before the slice, in it, and in the group.
    group = Window.partitionBy(*by)
    before = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        ranked.groupBy(*by, "_slice")
        .agg(F.sum("_count").alias("_in"))
        .withColumn("_before", F.coalesce(F.sum("_in").over(before), F.lit(0)))
        .withColumn("n", F.sum("_in").over(group))
    )

    def in_slice(position: Column) -> Column:
        return (position >= F.col("_before")) & (
            position < F.col("_before") + F.col("_in")
        )

    wanted = F.lit(False)
    for p in points.values():
        wanted = wanted | in_slice(F.floor(_rank(p))) | in_slice(F.ceil(_rank(p)))
    names = {name: f"_to_{name}" for name in (*by, "_slice")}
    targets = totals.filter(wanted).select(
        *[F.col(name).alias(to) for name, to in names.items()], "_before", "n"
    )
    # At most two slices per group and point.
    groups = ranked.select(*by).distinct().count() if by else 1
    targets = broadcast_up_to(targets, 2 * len(points) * groups)
    hits = ranked.join(targets, same_keys(ranked, targets, names))
    upto = (
        Window.partitionBy(*by, "_slice")
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return hits.withColumn("_upto", F.col("_before") + F.sum("_count").over(upto))


def _at_ranks(hits: DataFrame, value: str, points: dict[str, float], by: list[str]) -> DataFrame:
    def at(position: Column) -> Column:
        return F.min(F.when(F.col("_upto") > position, F.col(value))).cast("double")

    ends = []
    for i, p in enumerate(points.values()):
        ends += [at(F.floor(_rank(p))).alias(f"_lo{i}"), at(F.ceil(_rank(p))).alias(f"_hi{i}")]
    result = hits.groupBy(*by).agg(F.max("n").alias("n"), *ends)
    return result.select(
        *by,
        "n",
        *[
            (
                F.col(f"_lo{i}")
                + (_rank(p) - F.floor(_rank(p))) * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))
            ).alias(name)
            for i, (name, p) in enumerate(points.items())
        ],
    )
