"""Previous row, next row and running totals in per-key order, for keys of any size.

A window over ``partitionBy(key)`` gives each key to one task. That is the best
plan while keys are small, and it breaks down when one key holds a large part of
the table. ``track`` therefore counts the rows per key first (one narrow column,
combined before the shuffle). If every key is small, the operators below are
plain windows. Otherwise the rows of the large keys are range-partitioned by
key *and* order, which cuts such a key into consecutive slices, and are saved
with their slice number. Windows then run per (key, slice), and what has to
cross a slice border is carried in a table with one row per (key, slice).

The answer does not depend on where the cuts fall.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from playtrace.scratch import saved
from playtrace.settings import MAX_BROADCAST_KEYS, MAX_GROUP_ROWS

_SLICE = "_slice"


@dataclass(frozen=True)
class Track:
    """Rows with a per-key order. ``slices`` is zero when no key had to be cut."""

    rows: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    total: int
    slices: int = 0
    hot_keys: int = 0

    def where(self, condition: Column) -> Track:
        """Keep some rows. Slices stay consecutive, so the order still holds."""
        return replace(self, rows=self.rows.filter(condition))

    def with_column(self, name: str, value: Column) -> Track:
        return replace(self, rows=self.rows.withColumn(name, value))

    @property
    def cut(self) -> bool:
        return self.slices > 0

    @property
    def result(self) -> DataFrame:
        return self.rows.drop(_SLICE)

    @property
    def window(self) -> WindowSpec:
        slices = (_SLICE,) if self.cut else ()
        return Window.partitionBy(*self.keys, *slices).orderBy(*self.order)


def same_keys(left: DataFrame, right: DataFrame, keys: dict[str, str]) -> Column:
    """Null-safe equality of ``left`` columns with ``right`` columns."""
    return reduce(
        lambda a, b: a & b, [left[a].eqNullSafe(right[b]) for a, b in keys.items()]
    )


def broadcast_up_to(df: DataFrame, rows: int) -> DataFrame:
    """Ask for a broadcast of ``df`` if its row count, at most ``rows``, allows it."""
    return F.broadcast(df) if rows <= MAX_BROADCAST_KEYS else df


def slice_count(rows: int, max_rows: int) -> int:
    """Slices for ``rows`` rows: about half of ``max_rows`` each."""
    return 1 + 2 * rows // max_rows


def track(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], max_rows: int = MAX_GROUP_ROWS
) -> Track:
    """Put ``df`` in order per key. ``order`` must be total within a key."""
    keys, order = tuple(keys), tuple(order)
    loads = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_load"))
    large = F.col("_load") > max_rows
    total, hot_rows, hot_keys = loads.agg(
        F.coalesce(F.sum("_load"), F.lit(0)),
        F.coalesce(F.sum(F.when(large, F.col("_load"))), F.lit(0)),
        F.count_if(large),
    ).first()
    if not hot_keys:
        return Track(df, keys, order, total)

    if keys:
        names = {key: f"_hot_{key}" for key in keys}
        hot = saved(loads.filter(large).select(*[F.col(k).alias(h) for k, h in names.items()]))
        hot = broadcast_up_to(hot, hot_keys)
        is_hot = same_keys(df, hot, names)
        large_part = df.join(hot, is_hot, "left_semi")
        small_part = df.join(hot, is_hot, "left_anti").withColumn(_SLICE, F.lit(0))
    else:
        large_part, small_part = df, None
    slices = slice_count(hot_rows, max_rows)
    rows = saved(
        large_part.repartitionByRange(slices, *keys, *order).withColumn(
            _SLICE, F.spark_partition_id() + 1
        )
    )
    if small_part is not None:
        rows = rows.unionByName(small_part)
    return Track(rows, keys, order, total, slices, hot_keys)


def _carried(t: Track, edge: Column, carry: Column) -> DataFrame:
    """One row per (key, slice): ``edge`` of each slice, passed on by ``carry``.

    Every slice holds a run of consecutive keys, so this table has at most
    ``slices + hot_keys`` rows: small enough to order per key in one task.
    """
    edges = t.rows.filter(F.col(_SLICE) > 0).groupBy(*t.keys, _SLICE).agg(edge.alias("_edge"))
    names = {name: f"_to_{name}" for name in (*t.keys, _SLICE)}
    return edges.select(
        *[F.col(name).alias(to) for name, to in names.items()], carry.alias("_carry")
    ).filter(F.col("_carry").isNotNull())


def _join_carry(t: Track, rows: DataFrame, carried: DataFrame) -> DataFrame:
    names = {name: f"_to_{name}" for name in (*t.keys, _SLICE)}
    carried = broadcast_up_to(carried, t.slices + t.hot_keys)
    return rows.join(carried, same_keys(rows, carried, names), "left").drop(*names.values())


def _with_neighbour(t: Track, name: str, cols: Sequence[Column], forward: bool) -> Track:
    value = F.struct(*cols)
    step = F.lead if forward else F.lag
    rows = t.rows.withColumn(name, step(value).over(t.window))
    if t.cut:
        pick = F.min_by if forward else F.max_by
        slices = Window.partitionBy(*t.keys).orderBy(_SLICE)
        carried = _carried(
            t, pick(value, F.struct(*t.order)), step(F.col("_edge")).over(slices)
        )
        rows = _join_carry(t, rows, carried)
        # Inside a slice the neighbour is known; at its border it is carried.
        rows = rows.withColumn(name, F.coalesce(name, "_carry")).drop("_carry")
    return replace(t, rows=rows)


def with_previous(t: Track, name: str, *cols: Column) -> Track:
    """Add struct ``name`` of ``cols`` from the key's previous row; null on the first."""
    return _with_neighbour(t, name, cols, forward=False)


def with_next(t: Track, name: str, *cols: Column) -> Track:
    """Add struct ``name`` of ``cols`` from the key's next row; null on the last."""
    return _with_neighbour(t, name, cols, forward=True)


def with_running_sum(t: Track, name: str, value: Column) -> Track:
    """Add ``name``: the sum of ``value`` over the key's rows up to this one."""
    start = Window.unboundedPreceding
    rows = t.rows.withColumn(name, F.sum(value).over(t.window.rowsBetween(start, 0)))
    if t.cut:
        before = Window.partitionBy(*t.keys).orderBy(_SLICE).rowsBetween(start, -1)
        carried = _carried(t, F.sum(value), F.sum("_edge").over(before))
        rows = _join_carry(t, rows, carried)
        rows = rows.withColumn(name, F.col(name) + F.coalesce("_carry", F.lit(0))).drop(
            "_carry"
        )
    return replace(t, rows=rows)


def with_latest(t: Track, name: str, value: Column) -> Track:
    """Add ``name``: the last ``value`` that is not null, of the key's rows up to this one."""
    upto = t.window.rowsBetween(Window.unboundedPreceding, 0)
    rows = t.rows.withColumn(name, F.last(value, ignorenulls=True).over(upto))
    if t.cut:
        edge = F.max_by(value, F.when(value.isNotNull(), F.struct(*t.order)))
        before = Window.partitionBy(*t.keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
        rows = _join_carry(t, rows, _carried(t, edge, F.last("_edge", ignorenulls=True).over(before)))
        rows = rows.withColumn(name, F.coalesce(name, "_carry")).drop("_carry")
    return replace(t, rows=rows)


def with_following(t: Track, name: str, value: Column) -> Track:
    """Add ``name``: the first ``value`` that is not null, of the key's rows behind this one."""
    # In descending order this is a growing frame; a frame that shrinks is computed anew for each row.
    slices = (_SLICE,) if t.cut else ()
    behind = Window.partitionBy(*t.keys, *slices).orderBy(*[F.col(c).desc() for c in t.order])
    start = Window.unboundedPreceding
    rows = t.rows.withColumn(name, F.last(value, ignorenulls=True).over(behind.rowsBetween(start, -1)))
    if t.cut:
        edge = F.min_by(value, F.when(value.isNotNull(), F.struct(*t.order)))
        after = Window.partitionBy(*t.keys).orderBy(F.col(_SLICE).desc()).rowsBetween(start, -1)
        rows = _join_carry(t, rows, _carried(t, edge, F.last("_edge", ignorenulls=True).over(after)))
        rows = rows.withColumn(name, F.coalesce(name, "_carry")).drop("_carry")
    return replace(t, rows=rows)
