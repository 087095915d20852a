import random

import pytest

from playtrace.llm import decontaminate
from playtrace.llm.decontaminate import find_passages, without_contaminated

RNG = random.Random(2)
ITEM = [f"item{i}" for i in range(30)]


def noise(n):
    return [f"w{RNG.randrange(10**6)}" for _ in range(n)]


@pytest.fixture(scope="module")
def tables(spark):
    swapped = list(ITEM)
    for i in (4, 11, 19, 26):
        swapped[i] = "other"
    docs = [
        (1, " ".join(noise(50) + ITEM + noise(50))),
        (2, " ".join(noise(20) + swapped + noise(20))),
        (3, " ".join(w.upper() + "!!" for w in ITEM)),
        (4, " ".join(noise(60))),
        (5, " ".join(ITEM[:10] + noise(40))),
        (6, None),
        (7, ""),
        (8, "x " + " ".join(ITEM[:20])),
        (9, "say the short phrase now"),
        (None, " ".join(ITEM)),
        (1, " ".join(ITEM)),
    ]
    bench = [(10, " ".join(ITEM)), (10, " ".join(ITEM)), (11, None), (12, " ... "), (13, "The short phrase")]
    return (
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
        spark.createDataFrame(bench, "item_id long, text string"),
    )


def brute(docs, bench):
    """The best stretch of every item over every alignment with every document."""
    found = []
    for doc, text in docs:
        words = decontaminate.plain_words(text).split()
        for item, item_text in {tuple(b) for b in bench if b[1] is not None}:
            want = decontaminate.plain_words(item_text).split()
            best = (0, 0)
            for shift in range(-len(want), len(words) + 1):
                run = [0 <= shift + i < len(words) and words[shift + i] == w for i, w in enumerate(want)]
                for a in range(len(want)):
                    for b in range(a + 1, len(want) + 1):
                        if shift + a >= 0 and shift + b <= len(words):
                            equal = sum(run[a:b])
                            score = equal - 2 * (b - a - equal)
                            best = max(best, (score, b - a, equal))
            if best[1] >= 0.6 * len(want) and best[0] > 0 and best[2] >= 0.75 * best[1]:
                found.append((doc, item))
    return sorted(found, key=str)


@pytest.mark.parametrize("max_seeds", [1_000_000, 20])
def test_equals_brute_force(tables, max_seeds):
    docs, bench = tables
    got = find_passages(docs, bench, max_seeds=max_seeds).collect()
    want = brute([tuple(r) for r in docs.collect()], [tuple(r) for r in bench.collect()])
    assert sorted(((r.k, r.item_id) for r in got), key=str) == want
    assert (5, 10) not in want and (2, 10) in want and (9, 13) in want


def test_clean_documents_stay_as_they_are(spark, tables):
    docs, bench = tables
    extra = docs.withColumnRenamed("doc_id", "k").selectExpr("k", "text", "'x' as item_id")
    kept = without_contaminated(extra, bench)
    assert kept.columns == extra.columns
    assert sorted(r.k for r in kept.collect()) == [4, 5, 6, 7]


def test_empty_tables(spark, tables):
    docs, bench = tables
    assert find_passages(docs.limit(0), bench).collect() == []
    assert find_passages(docs, bench.limit(0)).collect() == []
    assert without_contaminated(docs, bench.limit(0)).count() == docs.count()


def test_long_passages_of_longer_items(spark):
    long = [f"long{i}" for i in range(200)]
    some = [f"some{i}" for i in range(59)]
    # 13 words in a row, then 5 of every 7: as one stretch less than three quarters are equal.
    diluted = long[:13] + [w if i % 7 not in (0, 4) else "other" for i, w in enumerate(long[13:153])]
    docs = [
        (1, " ".join(noise(9) + some[:35] + noise(9))),
        (2, " ".join(noise(9) + long[40:159] + noise(9))),
        (3, " ".join(noise(9) + some[:24] + noise(9))),
        (4, " ".join(noise(9) + long[100:113] + noise(9))),
        (5, " ".join(noise(9) + long[100:112] + noise(9))),
        (6, " ".join(diluted)),
    ]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(some)), (2, " ".join(long))], "item_id long, text string")
    got = {(r.k, r.item_id): r for r in find_passages(docs, bench).collect()}
    assert set(got) == {(1, 1), (2, 2), (3, 1), (4, 2), (6, 2)}
    assert (got[4, 2].start, got[4, 2].n_words, got[4, 2].n_equal) == (9, 13, 13)
    assert got[6, 2].n_equal >= 0.75 * got[6, 2].n_words >= 9
    assert [r.doc_id for r in without_contaminated(docs, bench).collect()] == [5]


@pytest.mark.parametrize("length", [6, 8, 9, 10, 12, 15])
def test_short_items_with_substitutions(spark, length):
    """Items with as many substituted words as may differ, the first and the last word equal."""
    rng = random.Random(length)
    bench, docs = [], []
    for i in range(60):
        words = [f"i{i}x{j}" for j in range(length)]
        bench.append((i, " ".join(words)))
        for j in rng.sample(range(1, length - 1), length // 4):
            words[j] = "other"
        docs.append((i, " ".join(noise(20) + words + noise(20))))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    found = find_passages(docs, spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert all(r.k == r.item_id for r in found)
    # By the masks one fifth of the words may be lost anywhere; 0.95 of these.
    assert len(found) >= 57


def test_short_items_count_as_a_whole(spark):
    docs = [(1, "a say the short phrase now b"), (2, "say the short other thing"), (3, "the short"), (4, "one word")]
    bench = [(1, "say the short phrase now"), (2, "the long"), (3, "the short"), (4, "one")]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    found = find_passages(docs, spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert sorted((r.k, r.item_id) for r in found) == [(1, 1), (1, 3), (2, 3), (3, 3), (4, 4)]


def test_an_instruction_that_all_items_share(spark):
    order = [f"order{i}" for i in range(12)]
    bench = [(i, " ".join(order + [f"q{i}x{j}" for j in range(20)])) for i in range(300)]
    docs = [(i, " ".join(order + noise(30))) for i in range(300)] + [(1000, "see " + bench[17][1])]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(bench, "item_id long, text string")
    assert [(r.k, r.item_id, r.n_equal) for r in find_passages(docs, bench).collect()] == [(1000, 17, 32)]
    assert without_contaminated(docs, bench).count() == 300


def test_a_very_long_text(spark):
    docs = [(1, " ".join(noise(300_000) + ITEM + noise(10)))]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    found = find_passages(docs, spark.createDataFrame([(1, " ".join(ITEM))], "item_id long, text string")).collect()
    assert [(r.start, r.n_equal) for r in found] == [(300_000, 30)]
