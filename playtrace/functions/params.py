"""From the ``param`` text to a map of parameters.

A param cell is the inside of a JSON object whose quotes were doubled, often
several times, on the way through CSV files. All steps are native expressions,
so they run inside the scan's stage.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtrace.functions.names import quoted
from playtrace.settings import PARAM

# The literal replacements that repair quotes, in this order.
QUOTE_REPAIRS = (
    ('""""', '"'),
    ('"""', '"'),
    ('""', '"'),
    ('":""', '":"'),
    ('"","', '","'),
)

_PARAMS = "map<string,string>"
_TYPED = "map<string,variant>"
# The object is parsed as the first of two array items and the second one is a
# marker. Text that ends the array early, or adds items, changes that shape and
# is refused, just as a parser that allows nothing after the object refuses it.
_MARK = "␞"


# Every step reads the one before it once. Where Spark moves a filter on ``params``
# below the parse, it copies the steps into the filter, and steps that read the
# one before them several times would be copied as many times each.


def _once(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is evaluated once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _trimmed_blank(text: str) -> str:
    return rf"regexp_replace({text}, r'(?U)^[\s\x1c-\x1f]+$', '')"


def _unwrapped(text: str) -> str:
    return rf"regexp_replace({text}, r'(?s)^\s*\{{(.*)\}}\s*$', '$1')"


def _repaired(text: str) -> str:
    return reduce(lambda done, r: f"replace({done}, '{r[0]}', '{r[1]}')", QUOTE_REPAIRS, text)


def _json_items(inside: str, kind: str = _PARAMS) -> str:
    text = f"""concat('[{{', {inside}, '}},{{"{_MARK}":"."}}]')"""
    return f"from_json({text}, 'array<{kind}>', map('allowSingleQuotes', 'false'))"


def _only_object(items: str) -> str:
    shape = f"size(x) = 2 and map_contains_key(get(x, 1), '{_MARK}')"
    return _once(items, "x", f"case when {shape} then get(x, 0) end")


def _last_wins(params: str) -> str:
    """Keep the last value of a repeated key; ``from_json`` keeps every copy."""
    keys = "array_distinct(map_keys(m))"
    last = "element_at(filter(map_entries(m), e -> e.key = key), -1).value"
    unique = f"""case
        when size(m) <= 1 then m
        when size({keys}) < size(m)
        then map_from_arrays({keys}, transform({keys}, key -> {last}))
        else m end"""
    return _once(params, "m", unique)


def is_blank(col: str = PARAM) -> Column:
    """Null, empty or only white space."""
    return F.expr(f"coalesce({_trimmed_blank(quoted(col))}, '') = ''")


def unwrap_braces(col: str = PARAM) -> Column:
    """The text without one outer pair of braces, if there is one."""
    return F.expr(_unwrapped(quoted(col)))


def repair_quotes(col: str = PARAM, unwrap: bool = True) -> Column:
    """The text with doubled quotes collapsed, and unwrapped first."""
    return F.expr(_repaired(_unwrapped(quoted(col)) if unwrap else quoted(col)))


def parse_params(
    df: DataFrame, col: str = PARAM, *, mode: str = "compat", unwrap: bool = True
) -> DataFrame:
    """Add ``params`` (a map, never null) and ``params_ok``.

    A blank cell gives an empty map. An unreadable cell gives an empty map and
    ``params_ok = false``; the row stays. ``mode='compat'`` repairs quotes
    first, which makes a cell with an empty string value unreadable.
    ``mode='strict_json'`` takes a cell as it is when that is valid JSON and
    repairs it otherwise. ``unwrap`` accepts a cell that still has its outer
    braces; without it such a cell is unreadable.
    """
    if mode not in ("compat", "strict_json"):
        raise ValueError(f"unknown mode {mode!r}")
    cell = quoted(col)
    inside = _unwrapped(_trimmed_blank(cell)) if unwrap else _trimmed_blank(cell)
    found = _only_object(_json_items(_repaired("_inside")))
    if mode == "strict_json":
        found = f"coalesce({_only_object(_json_items('_inside'))}, {found})"
    # The object is a column of its own: Spark then parses a cell once per row and
    # does not copy the parse into both columns that read it.
    return (
        df.selectExpr("*", f"{inside} as _inside")
        .selectExpr("*", f"{found} as _object")
        .selectExpr(
            *[quoted(name) for name in df.columns],
            f"coalesce({_last_wins('_object')}, from_json('{{}}', '{_PARAMS}')) as params",
            f"{cell} is null or _object is not null as params_ok",
        )
    )


def typed_params(df: DataFrame, col: str = PARAM, *, unwrap: bool = True) -> DataFrame:
    """Add ``typed``: the parameters as a map of VARIANT values, which keep their JSON types.

    Reads cells as ``parse_params`` does in its compat mode: blank and unreadable cells give an empty map, the last of
    a repeated key counts.
    """
    cell = quoted(col)
    inside = _unwrapped(_trimmed_blank(cell)) if unwrap else _trimmed_blank(cell)
    found = _only_object(_json_items(_repaired("_inside"), _TYPED))
    return (
        df.selectExpr("*", f"{inside} as _inside")
        .selectExpr("*", f"{found} as _object")
        .selectExpr(
            *[quoted(name) for name in df.columns],
            f"coalesce({_last_wins('_object')}, from_json('{{}}', '{_TYPED}')) as typed",
        )
    )
