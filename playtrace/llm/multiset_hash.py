"""Fingerprints of documents as multisets of paragraphs, by a homomorphic hash.

A paragraph is a line of the text, byte for byte. It is hashed to a wide vector of 32-bit
lanes, and a text's fingerprint is the sum of its paragraphs' vectors modulo 2**32. The order of
paragraphs does not matter, a paragraph is inserted or deleted by adding or subtracting its
vector, and fingerprints of parts add up to that of the whole, in any grouping.

* ``EQUAL`` lanes hold uniform 32-bit values: 1,024 bits that differ unless the multisets are equal.
* ``LIKE`` lanes hold the sum over the paragraph's sentences of +w or -w, where w is the root of the sentence's
  length in bytes. Their products estimate how much two multisets of sentences share: the likeness of a
  and b is ``2 a.b / (a.a + b.b)``, at least 0. It is 1 for equal multisets, and otherwise has an
  error of about ``1 / sqrt(LIKE)``.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtrace.llm.tables import keyed, partitions, record
from playtrace.operators.sequence import track, with_running_sum
from playtrace.scratch import saved

EQUAL, LIKE = 32, 128
LANES = EQUAL + LIKE
_SENTENCE_END = re.compile(rb"(?<=[.!?]) ")
#: Bytes of a text whose paragraphs are hashed at once.
_STRETCH = 1 << 20
#: Bytes of texts in one range of ids, at most (or one text).
RANGE_BYTES = 64 << 20


def _stretches(text: bytes):
    """Lists of consecutive paragraphs; a text has one more than line breaks."""
    begin = 0
    while True:
        end = text.find(b"\n", begin + _STRETCH)
        if end < 0:
            yield text[begin:].split(b"\n")
            return
        yield text[begin:end].split(b"\n")
        begin = end + 1


def vector(text: bytes) -> np.ndarray:
    """The sum of the vectors of all paragraphs."""
    total = np.zeros(LANES, np.uint32)
    for some in _stretches(text):
        digests = b"".join([hashlib.shake_128(p).digest(4 * EQUAL) for p in some])
        uniform = np.frombuffer(digests, "<u4").reshape(len(some), EQUAL)
        total[:EQUAL] += np.add.reduce(uniform, axis=0, dtype=np.uint32)
        sentences = [s for p in some for s in _SENTENCE_END.split(p)]
        digests = b"".join([hashlib.blake2b(s, digest_size=LIKE // 8).digest() for s in sentences])
        signs = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(len(sentences), LIKE // 8), axis=1)
        roots = np.array([math.isqrt(len(s)) for s in sentences], np.int64)
        signed = 2 * (roots @ signs) - roots.sum()
        total[EQUAL:] += (signed & 0xFFFFFFFF).astype(np.uint32)
    return total


def to_text(lanes: np.ndarray) -> str:
    """Lanes as 8 hexadecimal digits each, the lowest byte first."""
    return lanes.astype("<u4").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), "<u4").astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """How much two fingerprints share, 0 to 1; 1 if they are equal."""
    if np.array_equal(a, b):
        return 1.0
    x, y = (v[EQUAL:].view(np.int32).astype(np.float64) for v in (a, b))
    norms = float(x @ x + y @ y)
    return min(1.0, max(0.0, float(2 * (x @ y)) / norms)) if norms else 0.0


# --- sums over tables -----------------------------------------------------------


def _partial_sums(group: str, sign: str | None):
    """Per batch and group the sum of its texts' vectors."""

    def run(batches):
        for batch in batches:
            names = batch.column(group).to_pylist()
            signs = batch.column(sign).to_pylist() if sign else [True] * len(names)
            sums: dict = {}
            for name, plus, text in zip(names, signs, batch.column("t").to_pylist()):
                lanes = vector((text or "").encode())
                total = sums.setdefault(name, np.zeros(LANES, np.uint32))
                total += lanes if plus else -lanes
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(sums), batch.column(group).type),
                    pa.array([v.astype(np.int64) for v in sums.values()], pa.list_(pa.int64())),
                ],
                names=["g", "lanes"],
            )

    return run


def _lane_sums(parts: DataFrame) -> DataFrame:
    """``(g, fingerprint)`` from the vectors ``(g, lanes)``, combined before the shuffle."""
    each = parts.select("g", F.posexplode("lanes").alias("lane", "value"))
    sums = each.groupBy("g", "lane").agg(F.sum("value").alias("value"))
    # A lane of 32 bits, lowest byte first.
    word = F.lpad(F.hex(F.col("value").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")
    turned = F.lower(F.concat(*[F.substring(word, i, 2) for i in (7, 5, 3, 1)]))
    lanes = F.sort_array(F.collect_list(F.struct("lane", turned.alias("word"))))
    return sums.groupBy("g").agg(F.array_join(F.transform(lanes, lambda x: x["word"]), "").alias("fingerprint"))


def group_fingerprints(docs: DataFrame, by: Column, text_col: str = "text") -> DataFrame:
    """``(g, fingerprint)``: of all paragraphs of all documents in each group ``by``.

    Equal for two versions of a collection that hold the same paragraphs, in whatever documents and order.
    Null texts are empty ones; a group may be null.
    """
    work = docs.select(by.alias("g"), F.col(text_col).cast("string").alias("t"))
    kind = work.schema["g"].dataType.simpleString()
    return _lane_sums(work.mapInArrow(_partial_sums("g", None), f"g {kind}, lanes array<bigint>"))


def updated(fingerprints: DataFrame, changes: DataFrame) -> DataFrame:
    """``fingerprints(k, fingerprint)`` after ``changes(k, paragraph, added)``, texts unread.

    ``added`` is false for a deleted paragraph, null counts as added. Ids without changes stay as they are;
    changes to other ids, and those with a null id, are left out. Many changes of one id are summed before the shuffle.
    """
    work = changes.select(
        F.col("k").cast("long").alias("g"),
        F.col("paragraph").cast("string").alias("t"),
        F.coalesce("added", F.lit(True)).alias("plus"),
    ).where("g is not null")
    delta = _lane_sums(work.mapInArrow(_partial_sums("g", "plus"), "g long, lanes array<bigint>"))
    both = fingerprints.join(delta.toDF("k", "delta"), "k", "left")

    def run(batches):
        for batch in batches:
            old = batch.column("fingerprint").to_pylist()
            new = [
                to_text(from_text(a) + from_text(b)) if a is not None and b is not None else a
                for a, b in zip(old, batch.column("delta").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("k"), pa.array(new, pa.string())], names=["k", "fingerprint"]
            )

    return both.select("k", "fingerprint", "delta").mapInArrow(run, "k long, fingerprint string")


# --- documents next to each other ------------------------------------------------


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(k, fingerprint)`` of every document. Null texts are empty; an empty text is one empty paragraph."""

    def run(batches):
        for batch in batches:
            texts = batch.column("t").to_pylist()
            found = [to_text(vector((t or "").encode())) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("k"), pa.array(found, pa.string())], names=["k", "fingerprint"]
            )

    return keyed(docs, id_col, text_col).select("k", "t").mapInArrow(run, "k long, fingerprint string")


def _ranges(docs: DataFrame, most: int) -> list[tuple]:
    """First ``(k is not null, k, h)`` of each range of documents in order, with about ``most`` bytes each."""
    heads = docs.groupBy("k", "h").agg(F.max(F.octet_length("t")).alias("bytes"))
    heads = heads.select(F.col("k").isNotNull().alias("named"), "k", "h", (F.coalesce("bytes", F.lit(0)) + 64).alias("bytes"))
    order = ("named", "k", "h")
    # The running sum goes over slices of ids: never all of them in one task.
    heads = saved(heads)
    total = heads.agg(F.sum("bytes")).first()[0] or 0
    most = max(1, min(most, total // (4 * partitions(docs.sparkSession)) + 1))
    t = with_running_sum(track(heads, (), order, max_rows=100_000), "upto", F.col("bytes"))
    part = F.floor((F.col("upto") - F.col("bytes")) / most)
    low = t.rows.groupBy(part.alias("part")).agg(F.min(F.struct(*order)).alias("low"))
    return sorted(((r["named"], r["k"] or 0, r["h"]) for (r,) in low.select("low").collect()))


def _dealt(lows: list[tuple]):
    """Each row to its range, and the first row of a range also behind the range before it."""
    count = len(lows)
    firsts_of = set(lows)

    def run(batches):
        for batch in batches:
            ids, hashes = batch.column("k").to_pylist(), batch.column("h").to_pylist()
            places = [(k is not None, k or 0, h) for k, h in zip(ids, hashes)]
            ranges = [bisect_right(lows, p) - 1 for p in places]
            firsts = [i for i, p in enumerate(places) if p in firsts_of]
            before = [(ranges[i] - 1) % count for i in firsts]
            rows = pa.array([*range(len(ids)), *firsts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(n).take(rows) for n in ("k", "h", "t")],
                    pa.array([*ranges, *before], pa.int32()),
                    pa.array([False] * len(ids) + [True] * len(firsts), pa.bool_()),
                ],
                names=["k", "h", "t", "range", "behind"],
            )

    return run


_EDITED = {
    "k": pa.int64(), "h": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(),
    "fingerprint": pa.string(), "edited_fingerprint": pa.string(),
    "near_edited": pa.float64(), "near_next": pa.float64(),
}
_EDITED_SQL = (
    "k long, h long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def edited_text(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the beginning of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compare(batches):
    """Each row of a range against the row behind it; rows come in order."""
    last = None
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("k", "h", "t", "range", "behind")]
        found = []
        for k, h, text, number, behind in zip(*columns):
            text = text or ""
            lanes = vector(text.encode())
            if last is not None and last[3] == number:
                was_k, was_h, before, _, own = last
                edited = edited_text(before, text).encode()
                other = vector(edited)
                found.append(
                    (was_k, was_h, len(before), hashlib.sha256(edited).hexdigest(), to_text(own),
                     to_text(other), likeness(own, other), likeness(own, lanes))
                )
            last = None if behind else (k, h, text, number, lanes)
        rows = list(zip(*found)) or [()] * len(_EDITED)
        yield record(dict(zip(_EDITED, map(list, rows))), _EDITED)


def edited_fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """Every document against an edited text: its last half replaced by the beginning of the next document.

    Columns: ``k`` (id), ``n_chars`` (code points), ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited`` and ``near_next``: likeness of the document's fingerprint
    to that of the edited text and to that of the next document.

    Documents are in the order of their ids, null ids first; several with one id in the order
    of a hash of their texts. Repeated rows are one document in this order and are returned as often as they
    come. The last document is followed by the first; a single one by itself. Null texts are
    empty. An empty table gives an empty result. Other columns are not read.

    Texts are shuffled once, to ranges of ids of about ``range_bytes``; a range's bounds follow from the sizes
    of the texts. The first document of a range is also sent to the end of the one before.
    """
    work = keyed(docs, id_col, text_col).select("k", F.coalesce("t", F.lit("")).alias("t"))
    work = work.withColumn("h", F.xxhash64("t"))
    lows = _ranges(work, range_bytes)
    times = saved(work.groupBy("k", "h").agg(F.count(F.lit(1)).alias("times")).where("times > 1").toDF("k2", "h2", "times"))
    same = F.col("k").eqNullSafe(F.col("k2")) & (F.col("h") == F.col("h2"))
    rows = work.select("k", "h")
    repeated = times.limit(1).count() > 0
    if repeated:
        once = work.join(times, same, "left_semi").dropDuplicates(["k", "h", "t"])
        work = work.join(times, same, "left_anti").union(once)
    dealt = work.mapInArrow(_dealt(lows), "k long, h long, t string, range int, behind boolean")
    n = partitions(docs.sparkSession)
    dealt = dealt.repartition(n, "range").sortWithinPartitions("range", "behind", "k", "h")
    found = dealt.mapInArrow(_compare, _EDITED_SQL)
    if repeated:
        found = saved(found)
        copies = rows.join(times, same, "left_semi").toDF("k2", "h2")
        copies = copies.join(found, same).select(found.columns)
        found = found.join(times, same, "left_anti").union(copies)
    return found.drop("h")
