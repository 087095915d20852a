import numpy as np
import pytest
from pyspark.sql import functions as F

from playtrace.llm import adaptive_scan
from playtrace.llm.adaptive_scan import nearest_neighbours

K = 10


def brute(x, query, k=K):
    score = np.array([x[v] @ x[query] if v != query else -np.inf for v in sorted(x)])
    order = np.lexsort((np.array(sorted(x)), -score))
    return [sorted(x)[i] for i in order[: min(k, len(x) - 1)]]


@pytest.mark.parametrize("part, asked", [(4096, 8192), (40, 8192), (300, 9)])
def test_recall_and_exact_scores(spark, monkeypatch, part, asked):
    monkeypatch.setattr(adaptive_scan, "PART_ROWS", part)
    monkeypatch.setattr(adaptive_scan, "PART_QUERIES", asked)
    rng = np.random.default_rng(3)
    x = {i: rng.normal(size=16) * (1 + i % 3) for i in range(1500)}
    x |= {i: x[40].copy() for i in range(2000, 2050)}
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in x.items()], "vec_id long, embedding array<double>")
    got = nearest_neighbours(vectors.repartition(4), F.col("vec_id") % 20 == 0, k=K).collect()
    hits = total = 0
    for query in [i for i in x if i % 20 == 0]:
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == query)
        assert [r for r, *_ in mine] == list(range(1, K + 1))
        assert all(abs(s - x[v] @ x[query]) < 1e-9 for _, v, s in mine)
        assert [(-s, v) for _, v, s in mine] == sorted((-s, v) for _, v, s in mine)
        hits += len({v for _, v, _ in mine} & set(brute(x, query)))
        total += K
    assert hits / total >= 0.9


def test_edges(spark):
    rows = [
        (0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 0.5], 1), (3, None, 1), (4, [0.0, 0.0], 1),
        (5, [float("nan"), 1.0], 1), (6, [1.0], 1), (7, [None, 1.0], 1), (None, [1.0, 0.0], 1), (20, [], 1),
        (1, [1.0, 0.0], 1), (40, [float("inf"), 0.0], 1),
    ]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, list int")
    got = nearest_neighbours(vectors, F.col("vec_id") % 20 == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(got)] == [(0, 1, 1, 1.0), (0, 2, 2, 0.5)]
    assert nearest_neighbours(vectors.limit(0), F.lit(True)).collect() == []
