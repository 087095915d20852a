"""Best documents for each of many items: the items are indexed, the documents stream by.

In a search the documents are indexed and a query is looked up. Here the items' terms are the index: it
goes to all tasks, in blocks of bounded size, and each document's term counts are
looked up in it. A task adds up a document's score for all items that share a term with
it, and keeps a heap of the best ``k`` documents for each item. The heaps of all tasks are merged in two
steps, so that no task gets the heaps of one item from all others.

Scores need counts over all documents (documents, terms, documents that hold a term), so the texts are
read once, for their counts of the items' terms, which are saved. The counts over all documents and the scores are
then made from that table.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playtrace.llm.hashing import utf8
from playtrace.llm.tables import keyed
from playtrace.scratch import saved

#: (item, term) pairs in one block of items.
MAX_POSTINGS = 1_000_000
#: Scores that a task adds up at once.
_SCORES = 1 << 21
#: Bytes of a text that are split at once.
_STRETCH = 1 << 20
#: Parts in which the heaps of an item are merged first.
_MERGES = 64

#: Letters and digits of ASCII, A-Z as a-z, and all bytes of other characters; anything else separates.
_TERMS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def term_lists(text: bytes | None):
    """All terms of a text, in lists of bounded size (a long run without a separator is one term)."""
    plain = (text or b"").translate(_TERMS)
    begin = 0
    while begin < len(plain):
        end = plain.find(b" ", begin + _STRETCH)
        end = len(plain) if end < 0 else end
        yield plain[begin:end].split()
        begin = end


def _item_terms(batches):
    for batch in batches:
        ids, terms = [], []
        for k, text in zip(batch.column("k").to_pylist(), utf8(batch.column("t"))):
            own = set().union(*term_lists(text))
            ids += [k] * len(own)
            terms += own
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(terms, pa.binary())], names=["item", "term"]
        )


def _counts(numbers: dict[bytes, int]):
    """Number of terms of each document, and its counts of the terms in ``numbers``."""

    def run(batches):
        for batch in batches:
            sizes, terms, times = [], [], []
            for text in utf8(batch.column("t")):
                n, held = 0, Counter()
                for some in term_lists(text):
                    n += len(some)
                    held.update(map(numbers.get, some))
                held.pop(None, None)
                sizes.append(n)
                terms.append(list(held))
                times.append(list(held.values()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("k"),
                    pa.array(sizes, pa.int64()),
                    pa.array(terms, pa.list_(pa.int32())),
                    pa.array(times, pa.list_(pa.int32())),
                ],
                names=["k", "n", "terms", "times"],
            )

    return run


class Heaps:
    """The best ``k`` documents of each item. An entry is (score, has an id, -id): the smallest goes first."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.held: list[list[tuple]] = [[] for _ in range(items)]
        #: Scores below this cannot come in.
        self.floor = np.ones(items, np.int64)

    def offer(self, scores: np.ndarray, ids: list) -> None:
        """``scores``: one row per document, one column per item."""
        k = self.k
        floor = self.floor
        if len(scores) > k:
            floor = np.maximum(floor, np.partition(scores, len(scores) - k, axis=0)[len(scores) - k])
        docs, items = np.nonzero(scores >= floor)
        for doc, item, score in zip(docs.tolist(), items.tolist(), scores[docs, items].tolist()):
            entry = (score, ids[doc] is not None, -(ids[doc] or 0))
            heap = self.held[item]
            if len(heap) < k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            else:
                continue
            if len(heap) == k:
                self.floor[item] = heap[0][0]


class Index:
    """The items of each term, with the term's weight."""

    def __init__(self, item_numbers: np.ndarray, term_numbers: np.ndarray, weights: np.ndarray, n_items: int):
        order = np.argsort(term_numbers, kind="stable")
        self.items = item_numbers[order]
        self.first = np.searchsorted(term_numbers[order], np.arange(len(weights) + 1))
        self.weights, self.n_items = weights, n_items

    def scores(self, doc: np.ndarray, term: np.ndarray, part: np.ndarray, docs: int) -> np.ndarray:
        """Sum of weight times ``part`` over the terms (``doc[i]``, ``term[i]``), for each document and item."""
        total = np.zeros(docs * self.n_items, np.int64)
        held = self.first[term + 1] - self.first[term]
        ends = np.cumsum(held)
        value = self.weights[term] * part
        begin = 0
        while begin < len(term):
            before = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + _SCORES, side="right")))
            n = held[begin:end]
            at = np.arange(n.sum()) + np.repeat(self.first[term[begin:end]] - (ends[begin:end] - n - before), n)
            np.add.at(
                total,
                np.repeat(doc[begin:end] * self.n_items, n) + self.items[at],
                np.repeat(value[begin:end], n),
            )
            begin = end
        return total.reshape(docs, self.n_items)


def _search(index: Index, item_ids: list[int], documents: int, all_terms: int, k: int):
    """One heap for each item and task."""

    def run(batches):
        heaps = Heaps(index.n_items, k)
        step = max(1, _SCORES // max(1, index.n_items))
        for batch in batches:
            ids = batch.column("k").to_pylist()
            # Whole numbers of Python: n * N may have more than 64 bits.
            m = np.array([10 + 90 * n * documents // all_terms for n in batch.column("n").to_pylist()], np.int64)
            lists = batch.column("terms")
            first = np.asarray(lists.offsets, np.int64) - lists.offsets[0].as_py()
            terms = np.asarray(lists.flatten(), np.int64)
            times = np.asarray(batch.column("times").flatten(), np.int64)
            doc = np.repeat(np.arange(len(ids)), np.diff(first))
            part = (1_000_000_000 * times) // (1000 * times + 8 * m[doc])
            for a in range(0, len(ids), step):
                b = min(len(ids), a + step)
                mine = slice(first[a], first[b])
                if first[b] > first[a]:
                    heaps.offer(index.scores(doc[mine] - a, terms[mine], part[mine], b - a), ids[a:b])
        rows = [
            (item_ids[item], -less if named else None, score)
            for item, heap in enumerate(heaps.held)
            for score, named, less in heap
        ]
        columns = zip(*rows) if rows else [()] * 3
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), pa.int64()) for c in columns], names=["item_id", "k", "score"]
        )

    return run


def _merged(heaps: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each item, ranked; first in ``_MERGES`` parts of it."""
    order = [F.col("score").desc(), F.col("k").asc_nulls_last()]
    part = F.pmod(F.xxhash64("k"), F.lit(_MERGES)).alias("part")
    some = heaps.select("*", part)
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order)))
    best = some.where(F.col("rank") <= k).drop("part", "rank")
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)))
    return best.where(F.col("rank") <= k).select("item_id", "rank", "k", "score")


def _blocks(items: DataFrame, id_col: str, text_col: str, most: int):
    """Per block of items: (item id, term) arrays. A block has about ``most`` pairs, or one item."""
    work = keyed(items, id_col, text_col).select("k", "t").where("k is not null")
    pairs = saved(work.mapInArrow(_item_terms, "item long, term binary").distinct())
    n = max(1, -(-pairs.count() // most))
    for b in range(n):
        found = pairs.where(F.pmod(F.xxhash64("item"), F.lit(n)) == b).toArrow()
        if found.num_rows:
            yield found.column("item").to_numpy(), found.column("term").to_pylist()


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _ranked(docs: DataFrame, items: np.ndarray, terms: list[bytes], k: int) -> DataFrame:
    """The heaps of one block of items over all documents."""
    numbers: dict[bytes, int] = {}
    term_numbers = np.array([numbers.setdefault(t, len(numbers)) for t in terms], np.int64)
    item_ids, item_numbers = np.unique(items, return_inverse=True)
    counts = saved(docs.mapInArrow(_counts(numbers), "k long, n long, terms array<int>, times array<int>"))
    documents, all_terms = counts.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    holding = np.zeros(len(numbers), np.int64)
    held = counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    held = held.toArrow()
    holding[held.column("term").to_numpy()] = held.column("df").to_numpy()
    weights = np.array([weight(documents, n) for n in holding.tolist()], np.int64)
    index = Index(item_numbers, term_numbers, weights, len(item_ids))
    search = _search(index, item_ids.tolist(), documents, all_terms, k)
    found = counts.where(F.size("terms") > 0).mapInArrow(search, "item_id long, k long, score long")
    return _merged(found, k)


def ranked_documents(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    k: int = 10,
    max_postings: int = MAX_POSTINGS,
) -> DataFrame:
    """``(item_id, rank, k, score)``: the ``k`` highest-scoring documents of each item, scores above 0.

    A term is a run of ASCII letters and digits and of all characters beyond ASCII; only A-Z are lower-cased. With N
    documents that have a term, L terms in all, n in the document, a term's weight is
    ``floor(1000 * ln((2N + 2) / (2 df + 1)))``, a document's m ``10 + (90 n N) div L``, and its
    score the sum of ``weight * ((10**9 tf) div (1000 tf + 8 m))`` over the item's distinct terms.

    Equal scores are ranked by ascending id, null ids last. Repeated rows are documents of their own,
    each with a rank. Null and empty texts have no terms and no rank. Items with one id are
    one item with the terms of all; items without id or terms have no rows. Empty tables give
    an empty result. Long texts are split in stretches. Other columns are not read.

    Items go to the tasks in blocks of ``max_postings`` (item, term) pairs; with several, each block's
    result is saved before the next one is collected, and each reads the texts again.
    """
    work = keyed(docs, id_col, text_col).select("k", "t")
    out, waiting = None, None
    for items_of, terms in _blocks(items, item_id, item_text, max_postings):
        if waiting is not None:
            waiting = saved(waiting)
            out = waiting if out is None else out.union(waiting)
        waiting = _ranked(work, items_of, terms, k)
    if waiting is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, k long, score long")
    return waiting if out is None else out.union(waiting)
