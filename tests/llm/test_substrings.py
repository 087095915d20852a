import random

from pyspark.sql import functions as F

from playtrace.llm.substrings import dedup_substrings


def brute(rows, size):
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - size + 1):
            window = tuple(words[i : i + size])
            if window in seen:
                gone[i : i + size] = [True] * size
            seen.add(window)
        kept = b" ".join(w for w, g in zip(words, gone) if not g).decode()
        out[doc] = (len(words), sum(gone), kept)
    return out


def make(n=60):
    rng = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = []
    for i in range(n):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(0, 80))]
        if i % 3 == 0:
            words.insert(len(words) // 2, passage)
        if i % 10 == 0:
            words += ["same"] * 40
        rows.append((i * 7 - 20, "\n ".join(words)))
    rows += [(900, rows[3][1]), (901, rows[3][1]), (902, None), (903, ""), (904, " \t ")]
    return rows


def test_equals_brute_force(spark):
    rows = make()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for options in ({}, {"slice_bytes": 500, "bucket_bytes": 300}):
        got = dedup_substrings(docs, size=8, **options).collect()
        assert {r.k: (r.n_words, r.n_removed, r.kept) for r in got} == brute(rows, 8)


def test_intervals_are_maximal_and_layout_is_kept(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "x\ny  a b\tc d\n z")], "doc_id long, text string")
    got = {r.k: r for r in dedup_substrings(docs, size=3, layout=True).collect()}
    assert got[1].kept == "a b c d" and got[1].spans == []
    assert got[2].kept == "x\ny  z"
    assert [(s.start, s.end) for s in got[2].spans] == [(2, 6)]


def test_edges(spark):
    schema = "doc_id long, text string, kept string, k int, slice string, row int"
    rows = [(None, "a b c", "x", 1, "s", 2), (5, "a b c", "x", 1, "s", 2), (5, "a b c", "y", 1, "s", 2)]
    got = dedup_substrings(spark.createDataFrame(rows, schema), size=3).collect()
    assert sorted((r.k is None, r.n_removed) for r in got) == [(False, 0), (False, 3), (True, 3)]
    assert {r.row.kept for r in got} == {"x", "y"}
    none = spark.createDataFrame([], "doc_id long, text string")
    assert dedup_substrings(none, size=3).collect() == []
    assert dedup_substrings(none, size=3).select(F.col("spans")).columns == ["spans"]
