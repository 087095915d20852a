"""Removing invalid users, and looking at what the data holds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtrace.functions.names import column
from playtrace.settings import DEDUP_KEYS, ID, INVALID_IDS, TIME


def _valid_id(col: str, bad: Sequence[str]) -> Column:
    return ~F.col(col).isin(*bad)


def drop_invalid_ids(
    df: DataFrame, col: str = ID, bad: Sequence[str] = INVALID_IDS
) -> DataFrame:
    """Drop rows whose id is in ``bad`` or null. The match is exact."""
    return df.filter(_valid_id(col, bad))


def clean_audit(
    df: DataFrame, col: str = ID, bad: Sequence[str] = INVALID_IDS
) -> DataFrame:
    """One row: original, deleted and remaining rows, and percent deleted.

    Both counts come from the same scan. The percentage is null on empty input.
    """
    counts = df.agg(
        F.count(F.lit(1)).alias("original_rows"),
        F.count_if(_valid_id(col, bad)).alias("remaining_rows"),
    )
    deleted = F.col("original_rows") - F.col("remaining_rows")
    percent = F.try_divide(deleted * 100, F.col("original_rows"))
    return counts.select(
        "original_rows",
        deleted.alias("deleted_rows"),
        "remaining_rows",
        F.round(percent, 2).alias("deleted_percent"),
    )


def top_values(df: DataFrame, col: str, k: int = 10) -> DataFrame:
    """The ``k`` most frequent values; null counts as a value, ties go by value."""
    return (
        df.groupBy(col)
        .agg(F.count(F.lit(1)).alias("rows"))
        .orderBy(F.desc("rows"), F.asc_nulls_last(col))
        .limit(k)
    )


@dataclass(frozen=True)
class NullRules:
    """What to do about missing values.

    ``null_tokens`` are texts that mean null in any column, e.g. ``("NA", "null")``;
    in the columns ``blank_to_null`` blank text means null, too. Rows that are then
    null in a column of ``drop_if_null`` go; other nulls become the value in ``fill``.
    """

    null_tokens: tuple[str, ...] = ()
    blank_to_null: tuple[str, ...] = ()
    drop_if_null: tuple[str, ...] = ()
    fill: dict[str, str] = field(default_factory=dict)

    def present(self, name: str, is_text: bool) -> Column:
        """Whether a cell holds a value."""
        holds = column(name).isNotNull()
        if is_text and self.null_tokens:
            holds = holds & ~column(name).isin(*self.null_tokens)
        if is_text and name in self.blank_to_null:
            holds = holds & (F.trim(column(name)) != "")
        return holds


def null_handling(df: DataFrame, rules: NullRules) -> DataFrame:
    """Apply ``rules``; one filter and one projection."""
    kinds = dict(df.dtypes)
    for name in rules.drop_if_null:
        df = df.filter(rules.present(name, kinds[name] == "string"))
    changed = {}
    for name, kind in kinds.items():
        needs_rule = rules.null_tokens or name in rules.blank_to_null or name in rules.fill
        if kind == "string" and needs_rule:
            value = F.when(rules.present(name, True), column(name))
            changed[name] = value.otherwise(rules.fill.get(name))
    return df.withColumns(changed)


def quality_report(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    *,
    id_col: str = ID,
    time_col: str = TIME,
    keys: Sequence[str] = DEDUP_KEYS,
    bad: Sequence[str] = INVALID_IDS,
) -> DataFrame:
    """Long table ``(column_name, metric, value)``.

    Per column: rows, nulls, blanks and the exact number of distinct values.
    For the table (``column_name = '*'``): surplus copies of a key, rows with an
    invalid id, first and last time. Every value is text. Exact distinct counts
    shuffle every distinct cell once; leave wide text columns out of ``columns``
    where that is not wanted.
    """
    columns = list(columns or df.columns)
    # Columns to rows, then one count per distinct value: combined before the
    # shuffle, and spread over (column, value) so no task owns a whole column.
    cells = df.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("column_name"),
                        column(name).cast("string").alias("cell"),
                    )
                    for name in columns
                ]
            )
        ).alias("c")
    ).select("c.*")
    values = cells.groupBy("column_name", "cell").agg(F.count(F.lit(1)).alias("rows"))
    blank = F.trim("cell") == ""
    per_column = values.groupBy("column_name").agg(
        F.sum("rows").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("cell").isNull(), F.col("rows"))), F.lit(0)).alias("nulls"),
        F.coalesce(F.sum(F.when(blank, F.col("rows"))), F.lit(0)).alias("blanks"),
        F.count("cell").alias("distinct_values"),
    )
    copies = df.groupBy(*[column(key) for key in keys]).agg(F.count(F.lit(1)).alias("copies"))
    surplus = copies.agg(
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_key_rows")
    )
    whole = df.agg(
        F.count_if(F.coalesce(F.col(id_col).isin(*bad), F.lit(True))).alias("invalid_id_rows"),
        F.min(time_col).alias("min_time"),
        F.max(time_col).alias("max_time"),
    )
    table = F.lit("*").alias("column_name")
    parts = [
        _long(per_column, F.col("column_name")),
        _long(surplus, table),
        _long(whole, table),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _long(wide: DataFrame, column_name: Column) -> DataFrame:
    metrics = [name for name in wide.columns if name != "column_name"]
    pairs = [
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("string").alias("value"))
        for m in metrics
    ]
    return wide.select(column_name, F.explode(F.array(*pairs)).alias("m")).select(
        "column_name", "m.metric", "m.value"
    )
