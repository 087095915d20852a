import random

import pytest

from playtrace.llm import tensor_minhash
from playtrace.llm.graph import components


def shingles(text, size):
    words = (text or "").encode().lower().split()
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def brute(rows, size):
    sets = [(doc, shingles(text, size)) for doc, text in rows]
    low = {doc: doc for doc, _ in sets}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((root(a), root(b)))
                low[q] = p
    return {doc: (len(x), root(doc)) for doc, x in sets}


def make(n=120):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        if i and rng.random() < 0.6:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(0, 4)):
                if words:
                    words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
        else:
            words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 120))]
        rows.append((i, " ".join(words)))
    return rows + [(500, "One"), (501, "one"), (502, "ONE two"), (503, None), (504, ""), (505, " \n")]


@pytest.mark.parametrize("tile", [256, 3])
def test_equals_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(tensor_minhash, "TILE_ROWS", tile)
    rows = make()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = tensor_minhash.near_duplicates(docs, shingle=4).collect()
    assert {r.k: (r.n, r.component_id) for r in got} == brute(rows, 4)


@pytest.mark.parametrize("tile, rest", [(256, 1024), (8, 4), (8, 10_000)])
def test_a_footer_that_many_share(spark, monkeypatch, tile, rest):
    """Texts with two fifths in common form one block and are not alike, but for some copies."""
    monkeypatch.setattr(tensor_minhash, "TILE_ROWS", tile)
    monkeypatch.setattr(tensor_minhash, "REST_ROWS", rest)
    rng = random.Random(5)
    footer = [f"f{i}" for i in range(80)]
    rows = []
    for i in range(150):
        if i % 10 == 9:
            words = rng.choice(rows)[1].split()
            words[rng.randrange(100)] = f"n{i}"
        else:
            words = [f"w{rng.randrange(10**6)}" for _ in range(120)] + footer
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = tensor_minhash.near_duplicates(docs, shingle=4).collect()
    assert {r.k: (r.n, r.component_id) for r in got} == brute(rows, 4)


def test_edges(spark):
    rows = [(None, "a b c d e", 1), (3, "a b c d e", 1), (3, "a b c d e", 2), (2, "A b c D e", 1), (9, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = tensor_minhash.near_duplicates(docs).collect()
    assert sorted((r.k or -1, r.component_id) for r in got if r.k) == [(2, 2), (3, 2), (3, 2), (9, 9)]
    assert [r.component_id for r in got if r.k is None] == [None]
    assert tensor_minhash.near_duplicates(docs.limit(0)).collect() == []


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)], "a long, b long")
    got = {r.v: r.c for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}
