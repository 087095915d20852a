"""Joins on time: the latest row before another one, and the rows within an interval."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtrace.operators.behavior import longer_than, microseconds
from playtrace.operators.sequence import track, with_latest
from playtrace.settings import MAX_GROUP_ROWS

#: Intervals are dealt by length into classes; each has time bins of this many times the width of the one before.
_STEP = 4


def asof_join(
    left: DataFrame,
    rights: Mapping[str, DataFrame],
    keys: Sequence[str],
    on: str = "ts",
    within_s: int | None = None,
    tie: str | None = None,
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """``left`` with one struct per entry of ``rights``: its latest row with the same keys, not later than ``left``'s.

    All tables are stacked and put in order once, and each takes what it last saw: there is
    no join on the keys, and a key of any size is cut into slices. ``within_s`` is the greatest age in seconds; where
    nothing is found the struct is null. Of rows with the same time the one with the largest
    ``tie`` counts. Rows of ``left`` with a null key or time find nothing, rows of ``rights`` with one are not found.
    """
    keys = tuple(keys)
    row = F.struct(*[left[f"`{c}`"] for c in left.columns])
    both = left.select(*keys, on, F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_tie"), row.alias("_row"))
    named = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*keys, on)])
    for name, right in rights.items():
        value = F.struct(*[right[f"`{c}`"] for c in right.columns if c not in keys])
        order = F.col(tie) if tie else F.lit(0)
        side = right.where(named).select(
            *keys, on, F.lit(0).alias("_side"), order.cast("long").alias("_tie"), value.alias(f"_of_{name}")
        )
        both = both.unionByName(side, allowMissingColumns=True)
    t = track(both, keys, (on, "_side", "_tie"), max_rows)
    for name in rights:
        t = with_latest(t, f"_at_{name}", F.col(f"_of_{name}"))
    found = t.rows.filter(F.col("_row").isNotNull())

    def recent(name: str) -> Column:
        at = F.col(f"_at_{name}")
        fresh = named
        if within_s is not None:
            fresh = fresh & ~longer_than(within_s, at[on], F.col(on))
        return F.when(fresh, at).alias(name)

    return found.select("_row", *[recent(name) for name in rights]).select("_row.*", *rights)


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    on: str = "ts",
    start: str = "start_ts",
    end: str = "end_ts",
    bin_s: int = 60,
) -> DataFrame:
    """Pairs of a point and an interval with the same keys and ``start < on < end``.

    Both sides are dealt to bins of time, and the exact condition follows the equi-join. An interval belongs to the
    class whose bins are just as wide as it is long, so it touches two bins at most, however long it is; a point has
    one bin in each class that occurs. A pair meets in exactly one bin. A key with very many
    rows is spread over its bins.

    Nulls in a key, a time or an end match nothing, nor do intervals that end before they start.
    Columns: those of ``points``, and of ``intervals`` without the keys.
    """
    keys = tuple(keys)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    width = bin_s * 1_000_000
    length = microseconds(F.col(start), F.col(end))
    # The first class whose bins are at least as wide as the interval is long.
    sizes = F.array(*[F.lit(width * _STEP**i) for i in range(30) if width * _STEP**i < 1 << 62])
    level = F.size(F.filter(sizes, lambda s: s < F.col("_length")))
    sized = intervals.where(F.col(start) < F.col(end)).withColumn("_length", length)
    sized = sized.withColumn("_level", level)

    def bin_of(time: str) -> Column:
        return F.floor(microseconds(epoch, F.col(time)) / (F.lit(width) * F.pow(F.lit(float(_STEP)), F.col("_level"))))

    dealt = sized.withColumn("_bin", F.explode(F.array_distinct(F.array(bin_of(start), bin_of(end)))))
    levels = sorted(r[0] for r in sized.select("_level").distinct().collect())
    spread = points.withColumn("_level", F.explode(F.array(*[F.lit(i) for i in levels]).cast("array<int>")))
    spread = spread.withColumn("_bin", bin_of(on))
    pairs = spread.join(dealt.drop("_length"), [*keys, "_level", "_bin"])
    return pairs.where((F.col(start) < F.col(on)) & (F.col(on) < F.col(end))).drop("_level", "_bin")
