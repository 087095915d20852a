"""Param text against Python's own JSON parser."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from playtrace.functions.params import QUOTE_REPAIRS, parse_params, typed_params
from playtrace.operators.splitting import bad_params, merged_types, param_types, widen, with_types


def expected(text, repair=True):
    """What a cell means: a dict, or None if it cannot be read."""
    if text is None or not text.strip():
        return {}
    if repair:
        for old, new in QUOTE_REPAIRS:
            text = text.replace(old, new)
    try:
        return json.loads("{" + text + "}")
    except json.JSONDecodeError:
        return None


def as_text(value):
    """Values stay JSON text."""
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def run(rows, texts, **options):
    data = [(i, t) for i, t in enumerate(texts)]
    parsed = parse_params(rows("i int, param string", *data), **options)
    return {r.i: (r.params, r.params_ok) for r in parsed.collect()}


CASES = [
    None,
    "",
    "  \t ",
    " ",
    '"a":"1"',
    '""a"":""1""',
    '"""a"":""1"""',
    '""""a"""":""""1"""",""""b"""":2',
    '""""""a"":""1""',
    '"a":""',
    '"a":"","b":"1"',
    '""a"":""""',
    '"a":null',
    '"a":"x","a":"y"',
    '"a":"x","b":"1","a":null',
    '"a":1} x',
    '"a":1},{"b":2',
    '"a":1}] x [{"b":2',
    "'a':1",
    "broken",
    '"a":1,',
    '"a":01',
    '"a":"x\ny"',
    '"a":true,"b":false',
    '"a":{"z":[1,2]},"c":[]',
    '"a":"\\u00e9\\n\\"q"',
    '"a":"\\q"',
    '"a" : 1 , "b":2',
    '"a b.c":"1","":"2"',
    '"名":"值"',
    '"a":12345678901234567890',
    '"a":-1',
    '"␞":"1"',
] + ['"' * n + "a" + '"' * n + ":1" for n in range(1, 24)]


def test_like_python_json(rows):
    got = run(rows, CASES, unwrap=False)
    for i, text in enumerate(CASES):
        want = expected(text)
        params, ok = got[i]
        assert ok == (want is not None), repr(text)
        assert params == {k: as_text(v) for k, v in (want or {}).items()}, repr(text)


def test_braces_are_unwrapped_unless_switched_off(rows):
    assert run(rows, ['{"k": 1}', ' {""k"":""1""} '])[0] == ({"k": "1"}, True)
    assert run(rows, [' {""k"":""1""} '])[0] == ({"k": "1"}, True)
    assert run(rows, ['{"k": 1}'], unwrap=False)[0] == ({}, False)


def test_strict_json_keeps_empty_values(rows):
    got = run(rows, ['"a":"","b":"1"', '""a"":""2""'], mode="strict_json")
    assert got == {0: ({"a": "", "b": "1"}, True), 1: ({"a": "2"}, True)}
    with pytest.raises(ValueError):
        run(rows, ["x"], mode="loose")


def test_bad_params_keeps_all_columns(rows):
    df = rows("i int, param string", (1, '"a":""'), (2, None), (3, "x"), (4, '"a":1'))
    assert sorted(tuple(r) for r in bad_params(df).collect()) == [(1, '"a":""'), (3, "x")]


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet='ab1":,{}[] \\', max_size=12), min_size=40, max_size=120))
def test_random_text(spark, texts):
    data = [(i, t) for i, t in enumerate(texts)]
    df = parse_params(spark.createDataFrame(data, "i int, param string"), unwrap=False)
    for r in df.collect():
        want = expected(r.param)
        assert r.params_ok == (want is not None), repr(r.param)
        assert set(r.params) == set(want or {}), repr(r.param)


def test_types_of_params(rows):
    data = rows(
        "idfa string, event string, time string, param string",
        ("u", "e", "1", '"n":1,"x":1.5,"s":"t","b":true,"o":{"z":1},"l":[1],"nil":null'),
        ("u", "e", "2", '""n"":2,""x"":3,""s"":4,""b"":false'),
        ("u", "e", "3", '"n":null,"x":1e3,"n":7'),
        ("u", "e", "4", "broken"),
        ("u", "f", "5", None),
        ("u", "f", "6", '"n":123456789012345678901234567890'),
    )
    types = param_types(typed_params(data))
    got = {(r.event, r.key, r.type): r.rows for r in types.collect()}
    assert got == {
        ("e", "n", "integer"): 3, ("e", "x", "number"): 2, ("e", "x", "integer"): 1, ("e", "s", "string"): 1,
        ("e", "s", "integer"): 1, ("e", "b", "boolean"): 2, ("e", "o", "object"): 1, ("e", "l", "array"): 1,
        ("e", "nil", "null"): 1, ("f", "n", "number"): 1,
    }
    merged = {(r.event, r.key): r.type for r in merged_types(types).collect()}
    assert merged == {
        ("e", "n"): "bigint", ("e", "x"): "double", ("e", "s"): "string", ("e", "b"): "boolean",
        ("e", "o"): "string", ("e", "l"): "string", ("e", "nil"): "string", ("f", "n"): "double",
    }
    of_e = {key: kind for (event, key), kind in merged.items() if event == "e"}
    wide = with_types(widen(parse_params(data.where("event = 'e'")), of_e), of_e)
    assert dict(wide.dtypes)["n"] == "bigint" and dict(wide.dtypes)["b"] == "boolean"
    found = {r.time: (r.n, r.x, r.b, r.s) for r in wide.collect()}
    assert found == {"1": (1, 1.5, True, "t"), "2": (2, 3.0, False, "4"), "3": (7, 1000.0, None, ""), "4": (None, None, None, "")}
