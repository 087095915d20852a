import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from playtrace.llm import ecoc_lang, pairwise_quality

WORDS = {
    "aa": ["banana", "papaya", "mango", "lama"],
    "bb": ["xyzzy", "quux", "fjord", "krypt"],
    "cc": ["olé", "ñandú", "señor", "año"],
}


def corpus(spark, n=240):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        rows.append((i, " ".join(rng.choices(WORDS[lang], k=rng.randrange(3, 40))), lang, 0.0))
    rows += [(900, None, "aa", 1.0), (901, "", "aa", 1.0), (902, "12 345 !!", None, 1.0), (None, "banana mango", None, 1.0)]
    rows += [(903, "señor " * 100_000, "cc", 0.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double").repartition(3)


@pytest.mark.parametrize("n", range(1, 13))
def test_codewords_differ(n):
    table = ecoc_lang.codewords(n)
    for i in range(n):
        for j in range(i):
            assert (table[i] != table[j]).sum() >= max(1, table.shape[1] // 4)


def test_languages_held_out(spark):
    docs = corpus(spark)
    out = ecoc_lang.identify(docs, F.col("doc_id") % 4 != 2)
    rows = {r.k: r for r in out.collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert all(rows[i].lang_pred == truth[i] for i in range(240) if i % 4 == 2)
    for i in (900, 901, 902):
        assert (rows[i].lang_pred, rows[i].score) == ("und", 0.0)
    assert rows[903].lang_pred == "cc" and rows[None].lang_pred == "aa"
    assert rows[5].row.score == 0.0


def test_nothing_to_learn_from(spark):
    docs = corpus(spark, 5)
    assert {r.lang_pred for r in ecoc_lang.identify(docs, F.lit(False)).collect()} == {"und"}
    assert ecoc_lang.identify(docs.limit(0), F.lit(True)).collect() == []
    one = ecoc_lang.identify(docs.where("lang = 'cc'"), F.lit(True)).collect()
    assert {r.lang_pred for r in one} == {"cc"}


def test_quality_held_out(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(300):
        good = i % 5 != 0
        words = [f"word{rng.randrange(500)}" for _ in range(rng.randrange(5, 60))]
        rows.append((i, " ".join(words if good else [w.upper() + "###" for w in words]), 1))
        labels.append((i, int(good)))
    rows += [(800, None, 1), (801, "", 1), (None, "word1", 1), (3, rows[3][1], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(3)
    marks = spark.createDataFrame([x for x in labels if x[0] % 3] + [(None, 1), (5, 7)], "doc_id long, label int")
    out = pairwise_quality.rank_quality(docs, marks).collect()
    held = [(r.predicted, labels[r.k][1]) for r in out if r.k is not None and r.k < 300 and r.k % 3 == 0]
    assert np.mean([p == q for p, q in held]) > 0.97
    assert all((r.score >= 0.3) == (r.predicted == 1) and 0 <= r.score <= 1 for r in out)
    assert len(out) == 304 and len({r.score for r in out if r.k == 3}) == 1
    blank = pairwise_quality.rank_quality(docs, marks.limit(0)).collect()
    assert all(r.predicted == 1 and abs(r.score - 0.3) < 1e-9 for r in blank)
    assert pairwise_quality.rank_quality(docs.limit(0), marks).collect() == []


def test_quantile_counts_weights():
    values, weights = np.array([3.0, 1.0, 2.0]), np.array([1.0, 8.0, 1.0])
    assert pairwise_quality.weighted_quantile(values, weights, 0.8) == 2.0


def test_threshold_is_the_quantile_of_all_labelled_rows(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(1500):
        good = rng.random() < 0.6
        words = [f"word{rng.randrange(400)}" for _ in range(rng.randrange(2, 30))]
        noisy = [w.upper() if rng.random() < (0.3 if good else 0.5) else w for w in words]
        rows.append((i, " ".join(noisy)))
        labels.append((i, int(good)))
    docs = spark.createDataFrame(rows + rows[:200], "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame(labels + labels[:50] + [(9999, 1)], "doc_id long, label int")
    out = {r.k: r for r in pairwise_quality.rank_quality(docs, marks, sample=100, pairs=500).collect()}
    good = sum(label for _, label in labels)
    assert sum(r.predicted for r in out.values()) == good
    scores = np.array([r.score for r in out.values()])
    cut = pairwise_quality.weighted_quantile(scores, np.ones(len(scores)), 1 - good / len(scores))
    assert all((r.score >= cut) == (r.predicted == 1) for r in out.values())
