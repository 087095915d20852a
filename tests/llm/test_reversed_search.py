import math
import re
from collections import Counter

import pytest

from playtrace.llm.reversed_search import ranked_documents, term_lists

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    counts = [(doc, Counter(terms(text))) for doc, text in docs]
    held = [c for _, c in counts if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for c in held)
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, own in asked.items():
        found = []
        for doc, c in counts:
            if not c:
                continue
            m = 10 + (90 * sum(c.values()) * n_docs) // n_terms
            score = 0
            for t in own & set(c):
                df = sum(t in other for other in held)
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        for rank, (score, null, doc) in enumerate(sorted(found)[:k], 1):
            out.append((item, rank, None if null else doc, -score))
    return sorted(out, key=str)


DOCS = (
    [(i, f"common w{i % 7} w{i % 3} É{i % 5} x{i}" + " pad" * (i % 11)) for i in range(60)]
    + [(100 + i, "the very same text common") for i in range(30)]
    + [(None, "common w1 w2"), (5, "common w5 again"), (5, "common w5 again"), (70, None), (71, ""), (72, "!?"), (73, "W1-w1_W1,w2")]
)
ITEMS = [(1, "Common É1 w1"), (2, "the SAME text"), (2, "w6"), (3, None), (4, "absent"), (None, "common"), (5, "w1 w1 w2 w3 w4"), (1, "Common É1 w1")]


@pytest.mark.parametrize("postings", [1_000_000, 3])
def test_equals_brute_force(spark, postings):
    docs = spark.createDataFrame([(d, t, 1, "y") for d, t in DOCS], "doc_id long, text string, score int, item_id string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = ranked_documents(docs.repartition(5), items, k=10, max_postings=postings).collect()
    assert sorted(((r.item_id, r["rank"], r.k, r.score) for r in got), key=str) == brute(DOCS, ITEMS, 10)


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked_documents(docs.limit(0), items).collect() == []
    assert ranked_documents(docs, items.limit(0)).collect() == []


def test_terms_of_a_long_text():
    text = " ".join(f"W{i % 1000}É" for i in range(400_000)).encode()
    lists = list(term_lists(text))
    assert len(lists) > 1 and sum(map(len, lists)) == 400_000
    assert Counter(t for some in lists for t in some)["w7É".encode()] == 400
    assert list(term_lists(None)) == []
    assert list(term_lists(b"x" * (3 << 20))) == [[b"x" * (3 << 20)]]
