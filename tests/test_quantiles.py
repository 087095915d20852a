import random

import numpy as np
import pytest

from playtrace.operators.quantiles import percentiles

POINTS = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p100": 1.0}


def data(n, distinct, seed=3):
    rng = random.Random(seed)
    groups = ["big"] * 8 + ["small", None]
    return [
        (rng.choice(groups), None if rng.random() < 0.05 else rng.randrange(distinct) / 8)
        for _ in range(n)
    ]


@pytest.mark.parametrize("distinct", [3, 5000])
@pytest.mark.parametrize("max_rows", [25, 100_000])
@pytest.mark.parametrize("by", [("g",), ()])
def test_like_numpy(rows, distinct, max_rows, by):
    sample = data(600, distinct)
    df = rows("g string, v double", *sample)
    got = percentiles(df, "v", POINTS, by=by, max_rows=max_rows).collect()
    groups = {g for g, v in sample} if by else {0}
    assert len(got) == len(groups)
    for r in got:
        values = [v for g, v in sample if v is not None and (not by or g == r.g)]
        assert r.n == len(values)
        for name, p in POINTS.items():
            assert r[name] == pytest.approx(np.percentile(values, p * 100), rel=1e-12)


def test_a_bound_saves_the_count(rows):
    df = rows("v double", (1.0,), (2.0,), (4.0,))
    assert percentiles(df, "v", {"p": 0.5}, at_most=3).first().p == 2.0
    assert percentiles(df, "v", {"p": 0.75}, at_most=10**9).first().p == 3.0
