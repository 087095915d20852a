"""Stacking sources and removing duplicates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from playtrace.functions.names import column


def merge_sources(*sources: DataFrame) -> DataFrame:
    """UNION ALL of sources that have the same columns, in the same order and types."""
    if not sources:
        raise ValueError("nothing to merge: no source was given")
    first = sources[0]
    for other in sources[1:]:
        if other.dtypes != first.dtypes:
            raise ValueError(f"sources differ: {first.dtypes} and {other.dtypes}")
    return reduce(DataFrame.unionByName, sources)


def dedup(
    df: DataFrame,
    keys: Sequence[str] | None = None,
    order_by: Sequence[Column | str] | None = None,
) -> DataFrame:
    """Keep one row per key; nulls count as equal. Without ``keys``, all columns.

    Which row stays is open, unless ``order_by`` names the row to prefer. Both
    forms reduce the copies of a key inside each map task before the shuffle
    (a partial aggregate, or a partial window-group limit), so a key with very
    many copies is no bottleneck.
    """
    if keys is None:
        return df.distinct()
    if order_by is None:
        return df.dropDuplicates(list(keys))
    key_columns = [column(key) for key in keys]
    first = F.row_number().over(Window.partitionBy(*key_columns).orderBy(*order_by))
    return df.withColumn("_row", first).filter(F.col("_row") == 1).drop("_row")


def dedup_counted(
    df: DataFrame, keys: Sequence[str] | None = None
) -> tuple[DataFrame, Observation]:
    """``dedup(df, keys)`` that counts as it goes, so that no second pass is needed.

    The first action on the result fills the observation with ``rows_before`` and
    ``rows_after``. Both are added up behind the shuffle, in the tasks of the action
    itself, where Spark counts each task once even if it had to run again.
    """
    keys = list(keys or df.columns)
    rest = [name for name in df.columns if name not in keys]
    one = df.groupBy(*[column(key) for key in keys]).agg(
        *[F.any_value(column(name)).alias(name) for name in rest], F.count(F.lit(1)).alias("_copies")
    )
    counts = Observation()
    counted = one.observe(
        counts,
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("rows_before"),
        F.count(F.lit(1)).alias("rows_after"),
    )
    return counted.select(*[column(name) for name in df.columns]), counts


def merge_audit(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """One row: rows before, columns, rows after ``dedup(df, keys)``, rows removed."""
    copies = df.groupBy(*[column(key) for key in keys or df.columns]).agg(F.count(F.lit(1)).alias("_copies"))
    return copies.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("rows_before"),
        F.count(F.lit(1)).alias("rows_after"),
    ).select(
        "rows_before",
        F.lit(", ".join(df.columns)).alias("columns"),
        "rows_after",
        (F.col("rows_before") - F.col("rows_after")).alias("rows_removed"),
    )


def row_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every distinct row of two tables with ``n_left`` and ``n_right``: how often it stands in each.

    Nulls are equal. One aggregate over both, so copies are added up before the shuffle.
    """
    sides = [
        df.withColumn("_left", F.lit(a)).withColumn("_right", F.lit(b)) for df, a, b in ((left, 1, 0), (right, 0, 1))
    ]
    columns = [column(name) for name in left.columns]
    return merge_sources(*sides).groupBy(*columns).agg(F.sum("_left").alias("n_left"), F.sum("_right").alias("n_right"))


def export_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """The rows that two exports do not hold equally often, with ``n_left`` and ``n_right``."""
    return row_counts(left, right).filter(F.col("n_left") != F.col("n_right"))


def _repeated(counts: DataFrame, times: Column) -> DataFrame:
    rows = [column(name) for name in counts.columns if name not in ("n_left", "n_right")]
    return counts.select(*rows, times.alias("copies")).filter("copies > 0")


def common_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both tables with ``copies``: as often as they stand in both (INTERSECT ALL, not expanded)."""
    return _repeated(row_counts(left, right), F.least("n_left", "n_right"))


def rows_only_in(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` with ``copies``: how many more than in ``right`` (EXCEPT ALL, not expanded)."""
    return _repeated(row_counts(left, right), F.col("n_left") - F.col("n_right"))
