"""One wide table per event, with one column per parameter found in the data.

The columns depend on the data, and Spark needs a schema before it plans. So
``param_profile`` runs first; its result has one row per (event, parameter) and
is the only thing that reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playtrace.functions.names import column
from playtrace.functions.params import parse_params
from playtrace.settings import EVENT, ID, PARAM, TIME

BASE_COLUMNS = (ID, EVENT, TIME)


def base_cols(df: DataFrame) -> DataFrame:
    return df.select(*BASE_COLUMNS)


def event_types(df: DataFrame) -> DataFrame:
    """Distinct event names; null is one of them."""
    return df.select(EVENT).distinct()


def event_counts(df: DataFrame) -> DataFrame:
    """Rows per event. Rows without an event belong to no group."""
    return (
        df.filter(F.col(EVENT).isNotNull())
        .groupBy(EVENT)
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def bad_params(df: DataFrame, col: str = PARAM, **options) -> DataFrame:
    """The rows whose param cell has text that cannot be read."""
    bad = parse_params(df, col, **options).filter(~F.col("params_ok"))
    return bad.select(*[column(name) for name in df.columns])


def _param_cells(parsed: DataFrame) -> DataFrame:
    """One row per (row, parameter) of the rows that have an event."""
    # The outer form: a plain explode lets Spark infer the filter "params is not
    # empty" and run it below the parse, that is, parse every cell twice.
    cells = parsed.filter(F.col(EVENT).isNotNull()).select(
        EVENT, F.explode_outer("params").alias("key", "value")
    )
    return cells.filter(F.col("key").isNotNull())


def param_profile(parsed: DataFrame) -> DataFrame:
    """Per (event, key): rows that have the key, and rows where it is an explicit null."""
    return (
        _param_cells(parsed)
        .groupBy(EVENT, "key")
        .agg(
            F.count(F.lit(1)).alias("rows_with_key"),
            F.count_if(F.col("value").isNull()).alias("null_rows"),
        )
    )


def discover_params(parsed: DataFrame) -> DataFrame:
    """Per event: the sorted list of parameter names seen."""
    keys = param_profile(parsed).select(EVENT, "key")
    return keys.groupBy(EVENT).agg(F.sort_array(F.collect_list("key")).alias("keys"))


def param_column_names(keys: Iterable[str]) -> dict[str, str]:
    """Column name per key, sorted. A key that would clash gets the prefix ``param_``.

    Names clash without regard to case, as column names do in Spark.
    """
    taken = {name.lower() for name in BASE_COLUMNS}
    names = {}
    for key in sorted(keys):
        name = key if key and key.lower() not in taken else f"param_{key}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        names[key] = name
    return names


def _param_value(key: str) -> Column:
    has = F.map_contains_key("params", F.lit(key))
    return F.when(has, F.try_element_at("params", F.lit(key))).otherwise("")


def widen(parsed: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Base columns plus one column per key.

    A missing key is ``''``; an explicit null stays null.
    """
    return parsed.select(
        *BASE_COLUMNS,
        *[_param_value(key).alias(name) for key, name in param_column_names(keys).items()],
    )


def drop_all_null(df: DataFrame) -> DataFrame:
    """Drop the columns that are null in every row; one aggregate over all columns."""
    filled = df.agg(*[F.count(column(c)).alias(f"c{i}") for i, c in enumerate(df.columns)])
    counts = filled.first()
    return df.select(*[column(c) for i, c in enumerate(df.columns) if counts[i]])


def split_by_event(
    parsed: DataFrame,
    rows_of: Callable[[str], DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """The wide table of every event, by event name, without its all-null columns.

    Two small aggregates decide all schemas, so no event costs a job of its own
    before it is used. ``rows_of`` gives the rows of one event when they are
    stored apart (``sources.stage_by_event``); otherwise ``parsed`` is filtered.
    """
    base = (
        parsed.filter(F.col(EVENT).isNotNull())
        .groupBy(EVENT)
        .agg(
            F.count(F.lit(1)).alias("rows"),
            *[F.count(name).alias(name + "_filled") for name in (ID, TIME)],
        )
    )
    seen = {row[EVENT]: row for row in base.collect()}
    all_null: dict[str, set[str]] = {event: set() for event in seen}
    keys: dict[str, list[str]] = {event: [] for event in seen}
    for row in param_profile(parsed).toLocalIterator():
        keys[row[EVENT]].append(row["key"])
        if row["null_rows"] == seen[row[EVENT]]["rows"]:
            all_null[row[EVENT]].add(row["key"])
    tables = {}
    for event in sorted(seen):
        names = param_column_names(keys[event])
        gone = {names[key] for key in all_null[event]}
        gone |= {name for name in (ID, TIME) if not seen[event][name + "_filled"]}
        rows = rows_of(event) if rows_of else parsed.filter(F.col(EVENT) == event)
        wide = widen(rows, keys[event])
        tables[event] = wide.select(*[column(c) for c in wide.columns if c not in gone])
    return tables


def split_long(parsed: DataFrame) -> DataFrame:
    """The whole split in long form: per (event, key), the rows with a filled value."""
    filled = F.coalesce(F.col("value"), F.lit("")) != ""
    cells = _param_cells(parsed)
    return cells.groupBy(EVENT, "key").agg(F.count_if(filled).alias("filled_rows"))


def preview(df: DataFrame, n: int = 5, order_by: Sequence[str] = (TIME,)) -> DataFrame:
    """The first ``n`` rows of one table; each task keeps ``n`` rows, nothing is sorted."""
    return df.orderBy(*order_by).limit(n)


def event_preview(
    df: DataFrame, n: int = 5, order_by: Sequence[str] = (TIME,)
) -> DataFrame:
    """The first ``n`` rows of every event, in one pass.

    Each map task passes on at most ``n`` rows per event (window-group limit).
    """
    rank = F.row_number().over(Window.partitionBy(EVENT).orderBy(*order_by))
    return (
        df.filter(F.col(EVENT).isNotNull())
        .withColumn("_row", rank)
        .filter(F.col("_row") <= n)
        .drop("_row")
    )


def stack(tables: Iterable[DataFrame]) -> DataFrame:
    """Union of tables with different columns; a column a table lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def param_types(df: DataFrame) -> DataFrame:
    """Per event and parameter: the JSON types of its values and the rows with each.

    ``df`` has the column ``typed`` (see ``functions.typed_params``). Types: integer, number, string, boolean,
    null, object, array.
    """
    each = df.select(EVENT, F.explode(F.map_entries("typed")).alias("e"))
    kind = F.schema_of_variant("e.value")
    name = (
        F.when(kind.startswith("OBJECT"), "object")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind == "BIGINT", "integer")
        .when(kind.isin("BOOLEAN", "STRING"), F.lower(kind))
        .when(kind.isNull() | (kind == "VOID"), "null")
        .otherwise("number")
    )
    return each.groupBy(EVENT, F.col("e.key").alias("key"), name.alias("type")).agg(F.count(F.lit(1)).alias("rows"))


def merged_types(types: DataFrame) -> DataFrame:
    """Per event and parameter the SQL type that holds all its values, from ``param_types``.

    Whole numbers give bigint, other numbers double, booleans boolean; objects, arrays and anything mixed stay
    string. Nulls do not count.
    """
    known = F.collect_set(F.when(F.col("type") != "null", F.col("type")))
    merged = types.groupBy(EVENT, "key").agg(known.alias("all"))

    def only(*names: str) -> Column:
        return (F.size("all") > 0) & (F.size(F.array_except("all", F.array(*[F.lit(n) for n in names]))) == 0)

    kind = F.when(only("integer"), "bigint").when(only("integer", "number"), "double").when(only("boolean"), "boolean")
    return merged.select(EVENT, "key", F.coalesce(kind, F.lit("string")).alias("type"))


def with_types(wide: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """A wide table whose parameter columns have the given SQL types; a cell that does not fit, or is missing, is null."""
    return wide.withColumns({name: column(name).try_cast(kind) for name, kind in types.items() if kind != "string"})
