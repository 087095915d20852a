import random

import pytest

from playtrace.llm import reply_trees

SAID = "</s>[INST] ok [/INST]"


def told(spark, rows):
    return spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")


def test_paths_and_ranks(spark):
    rows = [
        (1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 0.9), (1, 3, 1, "assistant", "b", 0.1),
        (1, 4, 2, "user", "c", 0.9), (1, 5, 4, "assistant", None, None), (2, 6, 99, None, "lost", 1.0),
        (3, 7, 8, "user", "x", 1.0), (3, 8, 7, "user", "y", 1.0),
    ]
    best = {r.tree: r for r in reply_trees.conversations(told(spark, rows)).collect()}
    assert [(t.role, t.text) for t in best[1].turns] == [("user", "q"), ("assistant", "a"), ("user", "c"), ("assistant", "")]
    assert [(t.role, t.text) for t in best[2].turns] == [("", "lost")] and 3 not in best
    every = reply_trees.conversations(told(spark, rows), branches=None).collect()
    assert sorted((r.tree, r.rank, r.leaf) for r in every) == [(1, 1, 5), (1, 2, 3), (2, 1, 6)]


def test_random_trees_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(0, i, rng.randrange(max(0, i - 3), i) if i else None, "user", str(i), 0.0) for i in range(80)]
    parent = {r[1]: r[2] for r in rows}
    leaves = set(parent) - set(parent.values())
    want = set()
    for leaf in leaves:
        node, depth = leaf, 0
        while node is not None:
            want.add((leaf, node, depth))
            node, depth = parent[node], depth + 1
    got = reply_trees.paths(told(spark, rows).select("node", "parent")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("text", ["", SAID, "[\\INST]", "<\\<[[\\\\", "é[INST]\n</s>", "\\"])
def test_round_trip(spark, text):
    rows = [(1, 1, None, "user", text, 0.0), (1, 2, 1, "assistant", text, 0.0), (1, 3, 2, SAID, text, 0.0)]
    done = reply_trees.formatted(reply_trees.conversations(told(spark, rows)))
    back = reply_trees.read_back(done.select("tree", "formatted", "loss_spans")).first()
    assert [(t.role, t.text) for t in back.turns] == [("user", text), ("assistant", text), (SAID, text)]
    assert back.learned == text
    assert back.formatted.count("[INST]") == 3 and back.formatted.count("</s>") == 3


def test_linear_edges(spark):
    rows = [(1, 1, "user", "b", 9), (1, 1, "user", "a", 9), (1, None, None, None, 9), (None, 1, "user", "n", 9)]
    rows = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node int")
    got = {r.tree: [t.text for t in r.turns] for r in reply_trees.conversations(reply_trees.linear_messages(rows)).collect()}
    assert got[1] == ["", "a", "b"]
    assert reply_trees.conversations(reply_trees.linear_messages(rows.limit(0))).collect() == []


def test_broken_text_is_refused():
    with pytest.raises(ValueError):
        reply_trees.parse("<s>[INST]user[/INST]no end")
