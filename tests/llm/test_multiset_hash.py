import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from playtrace.llm import multiset_hash as mh

SCHEMA = "doc_id long, text string"


def brute(rows):
    """Rows in order, repeated ones once; hashes of equal ids decide as in the module, so ids differ here."""
    once = sorted({(k is not None, k or 0, t or "") for k, t in rows})
    out = {}
    for i, (named, k, text) in enumerate(once):
        after = once[(i + 1) % len(once)][2]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = (mh.vector(x.encode()) for x in (text, edited, after))
        out[k if named else None] = (
            len(text), hashlib.sha256(edited.encode()).hexdigest(), mh.to_text(a), mh.to_text(b),
            mh.likeness(a, b), mh.likeness(a, c),
        )
    return out


def make(n):
    rng = random.Random(3)
    lines = ["line %d of some length. And é a sentence %d!" % (i, i * 7) for i in range(50)]
    rows = [(i * 3, "\n".join(rng.choice(lines) for _ in range(rng.randrange(0, 12)))) for i in range(n)]
    return rows + [(None, "no id\nat all"), (5, None), (8, ""), (11, "\n"), (14, "x"), (17, "𝔘é" * 5000)]


@pytest.mark.parametrize("size", [1 << 26, 500])
def test_equals_brute_force(spark, size):
    rows = make(80)
    # Repeated rows are one document in the order.
    docs = spark.createDataFrame(rows + [rows[4]] * 30, SCHEMA).withColumn("fingerprint", F.lit(1)).repartition(4)
    got = mh.edited_fingerprints(docs, range_bytes=size).collect()
    want = brute(rows)
    assert len(got) == len(rows) + 30
    for r in got:
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) == want[r.k]
    assert {r.k for r in got} == set(want)


def test_several_texts_with_one_id(spark):
    docs = spark.createDataFrame([(1, f"text {i}\nof one id") for i in range(40)], SCHEMA).repartition(3)
    got = mh.edited_fingerprints(docs, range_bytes=100).collect()
    assert len(got) == 40 and len({r.fingerprint for r in got}) == 40
    # Each text follows exactly one other.
    assert len({r.edited_sha256 for r in got}) == 40


def test_one_document_and_none(spark):
    one = spark.createDataFrame([(1, "abcdef")], SCHEMA)
    (row,) = mh.edited_fingerprints(one).collect()
    assert row.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and row.near_next == 1.0
    assert mh.edited_fingerprints(one.limit(0)).collect() == []


def test_sums_of_paragraphs():
    text = "first one. Second sentence\nsecond\n\nthird é".encode()
    parts = text.split(b"\n")
    assert np.array_equal(mh.vector(text), sum((mh.vector(p) for p in parts), np.zeros(mh.LANES, np.uint32)))
    assert np.array_equal(mh.vector(text), mh.vector(b"\n".join(reversed(parts))))
    assert not np.array_equal(mh.vector(b"a\nb"), mh.vector(b"a\nb\n"))
    assert np.array_equal(mh.vector(b"a\nb") - mh.vector(b"b"), mh.vector(b"a"))
    long = b"some line\nother line\n" * 120_000
    assert np.array_equal(mh.from_text(mh.to_text(mh.vector(long))), mh.vector(b"some line\nother line\n") * 120_000 - mh.vector(b"") * 119_999)


def test_likeness_follows_what_is_shared():
    rng = random.Random(1)
    lines = [f"a line of text number {rng.random()}" for _ in range(400)]
    a = mh.vector("\n".join(lines[:200]).encode())
    for shared in (0, 50, 100, 150, 200):
        b = mh.vector("\n".join(lines[200 - shared : 400 - shared]).encode())
        assert abs(mh.likeness(a, b) - shared / 200) < 0.3
    assert mh.likeness(a, a) == 1.0 and mh.likeness(mh.vector(b""), mh.vector(b"\n")) == 0.0


def test_updates_and_groups(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc"), (2, "x"), (3, None)], SCHEMA)
    changes = spark.createDataFrame(
        [(1, "d", True), (1, "b", False), (2, "x", False), (2, "y", None), (2, "y", True), (9, "z", True), (None, "q", True)],
        "k long, paragraph string, added boolean",
    ).repartition(3)
    got = {r.k: r.fingerprint for r in mh.updated(mh.fingerprints(docs), changes).collect()}
    assert got == {1: mh.to_text(mh.vector(b"d\na\nc")), 2: mh.to_text(mh.vector(b"y\ny")), 3: mh.to_text(mh.vector(b""))}
    groups = docs.withColumn("source", F.when(F.col("doc_id") < 3, F.lit("s")))
    found = {r.g: r.fingerprint for r in mh.group_fingerprints(groups, F.col("source")).collect()}
    assert found == {"s": mh.to_text(mh.vector(b"x\nc\nb\na")), None: mh.to_text(mh.vector(b""))}
    assert mh.group_fingerprints(groups.limit(0), F.col("source")).collect() == []
