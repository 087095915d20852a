"""Joins on time against plain Python, with keys of all sizes."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from playtrace.operators.sequence import track, with_following, with_latest
from playtrace.operators.timejoin import asof_join, interval_join

DAY = datetime.datetime(2024, 1, 1)


def at(seconds):
    return None if seconds is None else DAY + datetime.timedelta(seconds=seconds)


def events(n, seed, spread):
    """A hot key, a null key, null times and many equal times."""
    rng = random.Random(seed)
    keys = ["hot"] * 6 + [None, "a", "b", f"only{seed}"]
    return [
        (rng.choice(keys), at(rng.choice([None] + [rng.randrange(spread)] * 15)), i) for i in range(n)
    ]


@pytest.mark.parametrize("max_rows", [5, 40, 10_000])
def test_latest_and_following(rows, max_rows):
    rng = random.Random(2)
    data = [(rng.choice(["hot"] * 6 + [None, "a"]), rng.randrange(40), i, rng.choice([None, None, i])) for i in range(300)]
    t = track(rows("k string, t long, i long, v long", *data), ("k",), ("t", "i"), max_rows)
    t = with_latest(t, "latest", F.col("v"))
    t = with_following(t, "following", F.struct("i", "v").alias("x"))
    t = with_following(t, "next_v", F.col("v"))
    got = {r.i: (r.latest, r.following and r.following.i, r.next_v) for r in t.result.collect()}
    for k, time, i, v in data:
        mine = sorted((r for r in data if r[0] == k), key=lambda r: (r[1], r[2]))
        j = [r[2] for r in mine].index(i)
        before = [r[3] for r in mine[: j + 1] if r[3] is not None]
        after = [r[3] for r in mine[j + 1 :] if r[3] is not None]
        behind = mine[j + 1][2] if j + 1 < len(mine) else None
        assert got[i] == (before[-1] if before else None, behind, after[0] if after else None)


@pytest.mark.parametrize("max_rows", [6, 10_000])
@pytest.mark.parametrize("within", [None, 30])
def test_asof_join(rows, max_rows, within):
    left, first, second = events(150, 1, 300), events(120, 2, 300), events(5, 3, 300)
    schema = "k string, ts timestamp_ntz, n long"
    joined = asof_join(
        rows(schema, *left),
        {"one": rows(schema, *first), "two": rows(schema, *second)},
        ("k",), within_s=within, tie="n", max_rows=max_rows,
    )
    assert joined.columns == ["k", "ts", "n", "one", "two"]

    def latest(side, key, time):
        found = [
            (t, n)
            for k, t, n in side
            if None not in (k, t, key, time) and k == key and t <= time
        ]
        found = max(found, default=None)
        late = found and within is not None and time - found[0] > datetime.timedelta(seconds=within)
        return None if late else found

    got = sorted((r.n, r.k, r.ts, r.one and tuple(r.one), r.two and tuple(r.two)) for r in joined.collect() if r.n is not None)
    want = [(n, k, t, latest(first, k, t), latest(second, k, t)) for k, t, n in left]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_interval_join(rows):
    rng = random.Random(5)
    points = events(300, 4, 100_000)
    spans = []
    for i in range(120):
        start = rng.randrange(100_000)
        length = rng.choice([0, -5, 1, 59, 60, 61, 240, 5_000, 90_000, 10_000_000])
        spans.append((rng.choice(["hot"] * 4 + ["a", None]), at(start), at(start + length), i))
    spans += [("a", None, at(5), 900), ("a", at(5), None, 901)]
    left = rows("k string, ts timestamp_ntz, n long", *points)
    right = rows("k string, start_ts timestamp_ntz, end_ts timestamp_ntz, span long", *spans)
    joined = interval_join(left, right, ("k",))
    got = sorted((r.n, r.span) for r in joined.collect())
    want = sorted(
        (n, span)
        for k, t, n in points
        for key, start, end, span in spans
        if None not in (k, t, start, end) and k == key and start < t < end
    )
    assert got == want and len(want) > 1000
    assert set(joined.columns) == {"k", "ts", "n", "start_ts", "end_ts", "span"}
    plan = joined._sc._jvm.PythonSQLUtils.explainString(joined._jdf.queryExecution(), "formatted")
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty_sides(rows, spark):
    left = rows("k string, ts timestamp_ntz, n long", ("a", at(1), 1))
    none = spark.createDataFrame([], "k string, ts timestamp_ntz, n long")
    (row,) = asof_join(left, {"one": none}, ("k",)).collect()
    assert row.one is None
    assert asof_join(none, {"one": left}, ("k",)).collect() == []
    spans = spark.createDataFrame([], "k string, start_ts timestamp_ntz, end_ts timestamp_ntz")
    assert interval_join(left, spans, ("k",)).collect() == []
