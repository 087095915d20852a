"""Sequence operators with cut keys against a plain Python walk through the rows."""

import random

import pytest

from pyspark.sql import functions as F

from playtrace.operators.sequence import track, with_next, with_previous, with_running_sum

SCHEMA = "k string, t long, i long, v long"


def skewed(n=400, seed=1):
    """One key with two thirds of the rows, a null key, many equal times."""
    rng = random.Random(seed)
    keys = ["hot"] * 6 + [None, "a", "b"]
    return [
        (rng.choice(keys), rng.randrange(n // 8), i, rng.choice([0, 1, 2, None]))
        for i in range(n)
    ]


def walk(data, key):
    out = {}
    for k in {key(r) for r in data}:
        mine = sorted((r for r in data if key(r) == k), key=lambda r: (r[1], r[2]))
        total = 0
        for j, r in enumerate(mine):
            total += r[2]
            before = mine[j - 1] if j else None
            after = mine[j + 1] if j + 1 < len(mine) else None
            out[r[2]] = (
                (before[2], before[3]) if before else None,
                (after[2], after[3]) if after else None,
                total,
            )
    return out


@pytest.mark.parametrize("max_rows", [7, 60, 10_000])
@pytest.mark.parametrize("keys", [("k",), ()])
def test_neighbours_and_running_sum(rows, max_rows, keys):
    data = skewed()
    t = track(rows(SCHEMA, *data), keys, ("t", "i"), max_rows)
    assert t.cut == (max_rows < 400)
    t = with_previous(t, "prev", F.col("i"), F.col("v"))
    t = with_next(t, "next", F.col("i"), F.col("v"))
    t = with_running_sum(t, "total", F.col("i"))
    got = {
        r.i: (r.prev and tuple(r.prev), r.next and tuple(r.next), r.total)
        for r in t.result.collect()
    }
    assert got == walk(data, (lambda r: r[0]) if keys else (lambda r: 0))


def test_only_large_keys_are_cut(rows):
    data = skewed()
    t = track(rows(SCHEMA, *data), ("k",), ("t", "i"), max_rows=100)
    sliced = t.rows.groupBy("k").agg(F.count_distinct("_slice").alias("n")).collect()
    counts = {r.k: r.n for r in sliced}
    assert counts["hot"] > 2
    assert counts["a"] == counts["b"] == counts[None] == 1
    largest = t.rows.filter("_slice > 0").groupBy("_slice").count().agg(F.max("count")).first()[0]
    assert largest <= 100
    assert t.total == len(data)


def test_filter_after_cutting_keeps_the_order(rows):
    data = skewed()
    t = track(rows(SCHEMA, *data), ("k",), ("t", "i"), max_rows=20)
    t = with_previous(t.where(F.col("i") % 2 == 0), "prev", F.col("i"))
    got = {r.i: r.prev and r.prev.i for r in t.result.collect()}
    want = walk([r for r in data if r[2] % 2 == 0], lambda r: r[0])
    assert got == {i: w[0] and w[0][0] for i, w in want.items()}


def test_empty_input(rows, spark):
    empty = spark.createDataFrame([], SCHEMA)
    t = track(empty, ("k",), ("t", "i"))
    assert with_next(t, "next", F.col("i")).result.count() == 0
    assert t.total == 0
