"""Removal of passages that occur earlier in the corpus.

Every window of ``size`` words has a Rabin-Karp hash. Documents are dealt into slices
of a few MB by a hash of their id, hashes into buckets by their own value, and
a bucket sees of each slice one packed array, so that a window costs four bytes in the
first shuffle, however many machines there are:

1. each slice sends each bucket its distinct 32-bit window fingerprints (and those that
   it holds twice);
2. a bucket counts them and answers each slice with those that occur more than once;
3. each slice sends, for windows with such a fingerprint, an independent 64-bit hash with
   document and position, only the earliest of equal windows of the slice;
4. a bucket finds the earliest of each hash and answers with all others;
5. each slice merges the answered windows into maximal intervals and removes them.

The bits of the bucket and both hashes make an identity of over 100 bits. A passage in a
third of all documents is one entry per slice, so no key is hot. The exchange of
the documents by slice is the same in steps 1, 3 and 5 and runs once.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playtrace.llm.hashing import Batch, in_pieces, utf8, window_hashes, word_spans
from playtrace.llm.tables import blob, keyed, partitions, text_bytes, unblob

#: Bytes of text in a slice and in a bucket of windows.
SLICE_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20

_FOUND = "bucket int, slice long, once binary, more binary"
_ASKED = "slice long, bucket int, again binary"
_FLAGGED = "bucket int, slice long, hash binary, doc binary, start binary, at binary, local binary"
_ANSWER = "slice long, at binary"


def _arrow(**columns) -> pa.Table:
    return pa.table(columns)


class _Slice:
    """The documents of one slice in order of id, then text; null ids come last."""

    def __init__(self, table: pa.Table):
        self.table = table
        ids = table["k"].to_pylist()
        texts = utf8(table["t"].combine_chunks())
        order = sorted(
            range(len(ids)),
            key=lambda i: (ids[i] is None, ids[i] or 0, texts[i] is None, texts[i] or b""),
        )
        self.order = order
        self.ids = [ids[i] for i in order]
        self.texts = [texts[i] for i in order]

    def windows(self, size: int, salts: tuple[int, ...]):
        """Per salt the hashes of all windows, their word position, document, start."""
        hashes = [[np.zeros(0, np.uint64)] for _ in salts]
        at, doc, start = ([np.zeros(0, np.int64)] for _ in range(3))
        base = 0
        for a, b in in_pieces(self.texts):
            batch = Batch(self.texts[a:b])
            where = batch.window_starts(size)
            for out, salt in zip(hashes, salts):
                values = window_hashes(batch.words, size, salt)
                out.append(values[where] if len(where) else values[:0])
            which = np.searchsorted(batch.first, where, side="right") - 1
            at.append(where + base)
            doc.append(which + a)
            start.append(where - batch.first[which])
            base += int(batch.first[-1])
        joined = [np.concatenate(x) for x in (at, doc, start)]
        return [np.concatenate(x) for x in hashes], *joined


def _by_bucket(bucket: np.ndarray):
    """(bucket, range) of a sorted array of buckets."""
    edges = np.flatnonzero(np.diff(bucket)) + 1
    edges = np.concatenate(([0], edges, [len(bucket)]))
    for a, b in zip(edges[:-1], edges[1:]):
        if b > a:
            yield int(bucket[a]), slice(int(a), int(b))


def _keys(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in the upper, fingerprint in the lower 32 bits."""
    bucket = (hashes >> np.uint64(32)) % np.uint64(buckets)
    return (bucket << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))


def _send_fingerprints(size: int, buckets: int):
    def send(key, table):
        (hashes,), *_ = _Slice(table).windows(size, (1,))
        keys, counts = np.unique(_keys(hashes, buckets), return_counts=True)
        rows = {"bucket": [], "slice": [], "once": [], "more": []}
        more = counts > 1
        for bucket, part in _by_bucket(keys >> np.uint64(32)):
            values, twice = keys[part].astype(np.uint32), more[part]
            rows["bucket"].append(bucket)
            rows["slice"].append(key[0].as_py())
            rows["once"].append(blob(values[~twice], np.uint32))
            rows["more"].append(blob(values[twice], np.uint32))
        return _arrow(
            bucket=pa.array(rows["bucket"], pa.int32()),
            slice=pa.array(rows["slice"], pa.int64()),
            once=pa.array(rows["once"], pa.binary()),
            more=pa.array(rows["more"], pa.binary()),
        )

    return send


def _count_fingerprints(key, table):
    once = [unblob(x, np.uint32) for x in table["once"].to_pylist()]
    more = [unblob(x, np.uint32) for x in table["more"].to_pylist()]
    values = np.concatenate([*once, *more, *more])
    values.sort()
    same = values[1:] == values[:-1]
    repeated = np.unique(values[1:][same])
    del values
    slices, again = [], []
    for of, a, b in zip(table["slice"].to_pylist(), once, more):
        both = np.concatenate((a, b))
        if len(repeated):
            where = np.minimum(np.searchsorted(repeated, both), len(repeated) - 1)
            both = both[repeated[where] == both]
        else:
            both = both[:0]
        if len(both):
            slices.append(of)
            again.append(blob(both, np.uint32))
    return _arrow(
        slice=pa.array(slices, pa.int64()),
        bucket=pa.array([key[0].as_py()] * len(slices), pa.int32()),
        again=pa.array(again, pa.binary()),
    )


def _send_flagged(size: int, buckets: int):
    names = ("hash", "doc", "start", "at", "local")
    kinds = (np.uint64, np.int64, np.uint32, np.uint32, np.uint32)

    def send(docs, asked):
        out: dict[str, list] = {n: [] for n in ("bucket", "slice", *names)}
        if docs.num_rows and asked.num_rows:
            part = _Slice(docs)
            (first, second), at, doc, start = part.windows(size, (1, 2))
            keys = _keys(first, buckets)
            wanted = np.concatenate(
                [
                    unblob(x, np.uint32).astype(np.uint64) | np.uint64(b << 32)
                    for b, x in zip(asked["bucket"].to_pylist(), asked["again"].to_pylist())
                ]
            )
            wanted.sort()
            where = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
            hit = np.flatnonzero(wanted[where] == keys)
            # Windows are in order of document and start: the first of a hash is the earliest.
            bucket = (keys[hit] >> np.uint64(32)).astype(np.int64)
            order = np.lexsort((hit, second[hit], bucket))
            hit, bucket = hit[order], bucket[order]
            fresh = np.ones(len(hit), dtype=bool)
            fresh[1:] = (second[hit][1:] != second[hit][:-1]) | (bucket[1:] != bucket[:-1])
            last = np.iinfo(np.int64).max
            ids = np.array([last if i is None else i for i in part.ids], dtype=np.int64)
            # Later copies within the slice are settled; they go back over all buckets alike,
            # not over that of their hash, where a common passage would meet itself.
            spans = list(_by_bucket(bucket))
            settled = np.array_split(at[hit[~fresh]], len(spans) or 1)
            for (b, span), old in zip(spans, settled):
                new = hit[span][fresh[span]]
                out["bucket"].append(b)
                out["slice"].append(docs["slice"][0].as_py())
                values = (second[new], ids[doc[new]], start[new], at[new], old)
                for name, value, kind in zip(names, values, kinds):
                    out[name].append(blob(value, kind))
        return _arrow(
            bucket=pa.array(out["bucket"], pa.int32()),
            slice=pa.array(out["slice"], pa.int64()),
            **{n: pa.array(out[n], pa.binary()) for n in names},
        )

    return send


def _answer(key, table):
    def column(name, kind):
        return [unblob(x, kind) for x in table[name].to_pylist()]

    hashes, docs = column("hash", np.uint64), column("doc", np.int64)
    starts, at = column("start", np.uint32), column("at", np.uint32)
    local = column("local", np.uint32)
    lengths = [len(x) for x in hashes]
    hashes, docs, starts = (np.concatenate(x) for x in (hashes, docs, starts))
    order = np.lexsort((starts, docs, hashes))
    first = np.ones(len(order), dtype=bool)
    first[1:] = hashes[order][1:] != hashes[order][:-1]
    later = np.ones(len(order), dtype=bool)
    later[order[first]] = False
    slices, answer, begin = [], [], 0
    for of, n, where, more in zip(table["slice"].to_pylist(), lengths, at, local):
        both = np.concatenate((where[later[begin : begin + n]], more))
        begin += n
        if len(both):
            slices.append(of)
            answer.append(blob(both, np.uint32))
    return _arrow(slice=pa.array(slices, pa.int64()), at=pa.array(answer, pa.binary()))


def _cut(text: bytes, left: np.ndarray, right: np.ndarray) -> bytes:
    """``text`` without the words of the intervals and the white space behind them."""
    starts, _ = word_spans(np.frombuffer(text, np.uint8))
    edges = np.append(starts, len(text))
    parts, at = [], 0
    for a, b in zip(edges[left].tolist(), edges[right].tolist()):
        parts.append(text[at:a])
        at = b
    return b"".join(parts) + text[at:]


def _remove(size: int, layout: bool):
    def cut(docs, answer):
        n_words, n_removed, kept, spans = [], [], [], []
        part = _Slice(docs)
        gone = [unblob(x, np.uint32) for x in answer["at"].to_pylist()]
        gone = np.sort(np.concatenate([np.zeros(0, np.uint32), *gone])).astype(np.int64)
        base = 0
        for text in part.texts:
            text = text or b""
            words = text.split()  # splits at exactly the white space of the word rule
            n = len(words)
            low, high = np.searchsorted(gone, (base, base + n))
            n_words.append(n)
            if high > low:
                begins = gone[low:high] - base
                new = np.ones(len(begins), dtype=bool)
                new[1:] = begins[1:] > begins[:-1] + size
                left = begins[new]
                right = begins[np.append(np.flatnonzero(new)[1:] - 1, len(begins) - 1)] + size
                keep = np.ones(n, dtype=bool)
                for a, b in zip(left.tolist(), right.tolist()):
                    keep[a:b] = False
                n_removed.append(int(n - keep.sum()))
                if layout:
                    text = _cut(text, left, right)
                else:
                    words = compress(words, keep.tolist())
                spans.append([{"start": a, "end": b} for a, b in zip(left.tolist(), right.tolist())])
            else:
                n_removed.append(0)
                spans.append([])
            kept.append((text if layout else b" ".join(words)).decode("utf-8", "replace"))
            base += n
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return _arrow(
            k=pa.array(part.ids, pa.int64()),
            row=docs["row"].take(pa.array(part.order, pa.int64())),
            n_words=pa.array(n_words, pa.int64()),
            n_removed=pa.array(n_removed, pa.int64()),
            kept=pa.array(kept, pa.string()),
            spans=pa.array(spans, kind),
        )

    return cut


def dedup_substrings(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 20,
    layout: bool = False,
    slice_bytes: int = SLICE_BYTES,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """Texts without the words of any ``size``-word window that starts earlier elsewhere.

    Earlier: in a document with a smaller id, or in the same one further left. Windows
    are those of the input. Returns ``k`` (the id), ``row`` (a struct of the other input
    columns), ``n_words``, ``n_removed``, ``kept`` (the words left, joined by one space, or with
    ``layout`` in their own white space) and ``spans`` (maximal removed intervals, in words).

    Null and empty texts have no words and give an empty ``kept``; texts shorter than a
    window stay whole. A null id counts as the largest. Of rows with the same id, those
    whose text sorts first are the earlier ones, so of repeated rows one stays. Other
    columns may have any name. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    work = keyed(docs, id_col, text_col)
    total = text_bytes(work)
    buckets = max(partitions(spark), -(-total // bucket_bytes))
    slices = max(2 * partitions(spark), -(-total // slice_bytes))
    number = F.pmod(F.xxhash64(F.coalesce("k", F.lit(-1))), F.lit(slices))
    work = work.select("k", "t", "row", number.alias("slice"))
    by_slice = work.groupBy("slice")
    found = by_slice.applyInArrow(_send_fingerprints(size, buckets), _FOUND)
    asked = found.groupBy("bucket").applyInArrow(_count_fingerprints, _ASKED)
    flagged = by_slice.cogroup(asked.groupBy("slice")).applyInArrow(
        _send_flagged(size, buckets), _FLAGGED
    )
    answer = flagged.groupBy("bucket").applyInArrow(_answer, _ANSWER)
    fields = [
        T.StructField("k", T.LongType()),
        T.StructField("row", work.schema["row"].dataType),
        T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("kept", T.StringType()),
        T.StructField("spans", T._parse_datatype_string("array<struct<start:long,end:long>>")),
    ]
    return by_slice.cogroup(answer.groupBy("slice")).applyInArrow(
        _remove(size, layout), T.StructType(fields)
    )
