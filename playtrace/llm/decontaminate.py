"""Benchmark passages in training texts, found by spaced seeds.

A seed is a mask over ``span`` consecutive words of which ``weight`` are looked at; the
others may differ. Seeds of the benchmark items and of every position of every text are
joined on their hash. A hit gives an item and an alignment; the aligned words are then
compared one by one, so that substituted words cost only themselves, and the best
scoring stretch around the hit is kept. Alignments are looked at many at a time, as rows of one matrix; only those
with a stretch that counts are scored one by one, so a seed that very many items share costs a row for each of them.

Words are compared after lower-casing and without anything but letters and digits.

The benchmark is the small side. Its seeds go to the tasks in blocks of at most
``max_seeds``, one pass over the texts per block, so that what a task holds is bounded
whatever the size of the benchmark.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrace.llm.hashing import Batch, in_pieces, mix, random_values, utf8
from playtrace.llm.tables import keyed
from playtrace.scratch import saved

#: 1: the word counts. Any two masks differ in what they ignore.
MASKS = ("1101100111", "1110010111", "1011110011", "1111001101")
#: Also for items of fewer than ``SHORT_WORDS`` words: one substituted word in five leaves one of them equal.
SHORT_MASKS = ("111", "1101", "1011")
SHORT_WORDS = 16
#: Items of fewer words count only as a whole.
WHOLE_WORDS = 10
#: Seeds in one block of benchmark items.
MAX_SEEDS = 1_000_000
#: A stretch of the item's words is reported if it has this many words ...
MIN_WORDS = 13
#: ... or, of items for which that is less, covers this share of the item ...
MIN_COVER = 0.6
#: ... with this share of its words equal.
MIN_EQUAL = 0.75
_TABLE_BITS = 20
#: Words of alignments that are compared at once.
_COMPARED = 1 << 20

_OTHER = re.compile(r"[^\w\x20\x09-\x0D]+|_+")


def plain_words(text: str | None) -> bytes:
    """Lower-case text of letters, digits and white space."""
    return _OTHER.sub("", (text or "").lower()).encode()


def _plain_batch(texts: list) -> list[bytes]:
    return [plain_words(None if t is None else t.decode("utf-8", "replace")) for t in texts]


def _seed_hashes(words: np.ndarray, masks: tuple[str, ...]):
    """Per mask the hash at each position where the mask fits."""
    factors = random_values(64, 303) | np.uint64(1)
    for m, mask in enumerate(masks):
        n = len(words) - len(mask) + 1
        if n <= 0:
            yield m, np.zeros(0, np.uint64)
            continue
        total = np.full(n, m + 1, dtype=np.uint64)
        for p, bit in enumerate(mask):
            if bit == "1":
                total += words[p : p + n] * factors[p]
        yield m, mix(total)


class Benchmark:
    """The seeds of a block of items, sorted by hash, and the words of the items."""

    def __init__(self, items: list[tuple[int, bytes]], masks: tuple[str, ...] = MASKS):
        self.ids = [i for i, _ in items]
        self.item_words = [Batch([text]).words for _, text in items]
        self.length = np.array([len(w) for w in self.item_words], np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.length))).astype(np.int64)
        self.words = np.concatenate([np.zeros(0, np.uint64), *self.item_words])
        shorter = tuple(m for m in SHORT_MASKS if m not in masks)
        self.tables = [self._table(masks, lambda n: True), self._table(shorter, lambda n: n < SHORT_WORDS)]
        #: Items too short for any mask, by their number of words and the hash of all.
        self.short: dict[int, dict[int, list[int]]] = {}
        least = min(map(len, (*masks, *shorter)))
        for number, words in enumerate(self.item_words):
            if 0 < len(words) < least:
                whole = int(_whole(words, len(words))[0])
                self.short.setdefault(len(words), {}).setdefault(whole, []).append(number)

    def _table(self, masks: tuple[str, ...], takes):
        hashes, owners, offsets = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for number, words in enumerate(self.item_words):
            if takes(len(words)):
                for _, found in _seed_hashes(words, masks):
                    hashes.append(found)
                    owners.append(np.full(len(found), number, np.int64))
                    offsets.append(np.arange(len(found)))
        hashes = np.concatenate(hashes)
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        present = np.zeros(1 << _TABLE_BITS, dtype=bool)
        present[hashes >> np.uint64(64 - _TABLE_BITS)] = True
        return masks, hashes, np.concatenate(owners)[order], np.concatenate(offsets)[order], present

    def hits(self, words: np.ndarray):
        """Arrays (position, item, offset) of the equal seeds in a run of words, of bounded size."""
        for masks, hashes, owners, offsets, present in self.tables:
            if not len(hashes):
                continue
            for _, found in _seed_hashes(words, masks):
                maybe = np.flatnonzero(present[found >> np.uint64(64 - _TABLE_BITS)])
                low = np.searchsorted(hashes, found[maybe], "left")
                count = np.searchsorted(hashes, found[maybe], "right") - low
                some = count > 0
                maybe, low, count = maybe[some], low[some], count[some]
                for a, b in _bounded(count, _COMPARED):
                    n = count[a:b]
                    ends = np.cumsum(n)
                    at = np.repeat(low[a:b] - (ends - n), n) + np.arange(ends[-1])
                    yield np.repeat(maybe[a:b], n), owners[at], offsets[at]
        for length, table in self.short.items():
            whole = _whole(words, length)
            for value, numbers in table.items():
                for number in numbers:
                    at = np.flatnonzero(whole == np.uint64(value))
                    yield at, np.full(len(at), number), np.zeros(len(at), np.int64)


def _bounded(sizes: np.ndarray, most: int):
    """Ranges of consecutive entries with about ``most`` in all."""
    ends = np.cumsum(sizes)
    begin = 0
    while begin < len(sizes):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield begin, end
        begin = end


def _whole(words: np.ndarray, length: int) -> np.ndarray:
    return next(_seed_hashes(words, ("1" * length,)))[1]


def best_stretch(equal: np.ndarray) -> tuple[int, int, int]:
    """Start, end and equal words of the stretch with the highest score: +1, or -2 if unequal."""
    sums = np.concatenate(([0], np.cumsum(np.where(equal, 1, -2))))
    lowest = np.minimum.accumulate(sums)
    end = int(np.argmax(sums - lowest))
    start = int(np.flatnonzero(sums[: end + 1] == lowest[end])[-1])
    return start, end, int(equal[start:end].sum())


def long_stretch(equal: np.ndarray, least: float, share: float) -> tuple[int, int, int] | None:
    """Start, end and equal words of a stretch of ``least`` words or more, ``share`` of them equal, if there is one.

    It begins and ends with equal words, so that a shorter one is not padded out.
    """
    least = max(1, math.ceil(least))
    if len(equal) < least or equal.sum() < share * least:
        return None
    sums = np.concatenate(([0.0], np.cumsum(np.where(equal, 1 - share, -share))))
    begins = np.where(equal, sums[:-1], np.inf)
    lowest = np.minimum.accumulate(begins)[: len(equal) - least + 1]
    gain = np.where(equal[least - 1 :], sums[least:] - lowest, -np.inf)
    at = int(np.argmax(gain))
    if gain[at] < -1e-9:
        return None
    start = int(np.flatnonzero(begins[: at + 1] == lowest[at])[-1])
    return start, at + least, int(equal[start : at + least].sum())


def _least_words(length: int, min_words: int, min_cover: float) -> float:
    """Words that a stretch of an item of ``length`` words has to have."""
    return length if length < WHOLE_WORDS else min(min_words, min_cover * length)


def _with_stretch(equal: np.ndarray, least: int, share: float) -> np.ndarray:
    """For each row whether it has a ``long_stretch``; ``equal`` is false beyond a row's end."""
    if equal.shape[1] < least:
        return np.zeros(len(equal), bool)
    sums = np.zeros((len(equal), equal.shape[1] + 1))
    np.cumsum(np.where(equal, 1 - share, -share), axis=1, out=sums[:, 1:])
    begins = np.where(equal, sums[:, :-1], np.inf)
    lowest = np.minimum.accumulate(begins, axis=1)[:, : equal.shape[1] - least + 1]
    gain = np.where(equal[:, least - 1 :], sums[:, least:] - lowest, -np.inf)
    return gain.max(axis=1) >= -1e-9


def _candidates(bench: Benchmark, batch: Batch, min_words: int, min_cover: float, min_equal: float):
    """(text, item, first word of the item in the batch) of alignments that hold a stretch that counts."""
    seen = []
    longest = int(bench.length.max(initial=0))
    span = len(batch.words) + longest + 1
    for position, number, offset in bench.hits(batch.words):
        text = np.searchsorted(batch.first, position, side="right") - 1
        # As one number, which is faster to sort; an alignment may begin before the first word.
        rows = np.unique((text * len(bench.ids) + number) * span + position - offset + longest)
        pair, begin = rows // span, rows % span - longest
        rows = np.stack((pair // len(bench.ids), pair % len(bench.ids), begin))
        for a, b in _bounded(bench.length[rows[1]], _COMPARED):
            seen.append(_checked(bench, batch, rows[:, a:b], min_words, min_cover, min_equal))
    if seen:
        yield from np.unique(np.concatenate(seen, axis=1), axis=1).T.tolist()


def _checked(bench: Benchmark, batch: Batch, rows: np.ndarray, min_words: int, min_cover: float, min_equal: float):
    """Those of the alignments ``rows`` that hold a stretch that counts."""
    kept = [rows[:, :0]]
    for length in np.unique(bench.length[rows[1]]).tolist():
        text, number, begin = mine = rows[:, bench.length[rows[1]] == length]
        at = begin[:, None] + np.arange(length)
        inside = (at >= batch.first[text][:, None]) & (at < batch.first[text + 1][:, None])
        words = bench.words[bench.first[number][:, None] + np.arange(length)]
        equal = inside & (batch.words[np.where(inside, at, 0)] == words)
        least = max(1, math.ceil(_least_words(length, min_words, min_cover)))
        kept.append(mine[:, _with_stretch(equal, least, min_equal)])
    return np.concatenate(kept, axis=1)


def _found_in(bench: Benchmark, texts: list, min_words: int, min_cover: float, min_equal: float):
    """(number of the text, first word, item id, words, equal words, words of the item)."""
    for a, b in in_pieces(texts):
        batch = Batch(_plain_batch(texts[a:b]))
        for number, begin, hit in _verified(bench, batch, min_words, min_cover, min_equal):
            yield a + number, begin, *hit


def _scan(items: list[tuple[int, bytes]], masks, min_words: int, min_cover: float, min_equal: float):
    names = ("k", "start", "item_id", "n_words", "n_equal", "item_words")

    def run(batches):
        bench = Benchmark(items, masks)
        for batch in batches:
            ids = batch.column("k").to_pylist()
            found = _found_in(bench, utf8(batch.column("t")), min_words, min_cover, min_equal)
            rows = [(ids[number], *rest) for number, *rest in found]
            columns = zip(*rows) if rows else [()] * len(names)
            arrays = [pa.array(list(c), pa.int64()) for c in columns]
            yield pa.RecordBatch.from_arrays(arrays, names=list(names))

    return run


def _keep_clean(items, masks, min_words: int, min_cover: float, min_equal: float, text_col: str):
    def run(batches):
        bench = Benchmark(items, masks)
        for batch in batches:
            texts, hit = utf8(batch.column(text_col)), set()
            for a, b in in_pieces(texts):
                pieces = Batch(_plain_batch(texts[a:b]))
                found = _candidates(bench, pieces, min_words, min_cover, min_equal)
                hit.update(a + text for text, *_ in found)
            yield batch.filter(pa.array([i not in hit for i in range(len(texts))], pa.bool_()))

    return run


def _verified(bench: Benchmark, batch: Batch, min_words: int, min_cover: float, min_equal: float):
    """(text, first word, (item id, words, equal words, words of the item)), best per item."""
    best: dict[tuple[int, int], tuple] = {}
    for text, number, begin in _candidates(bench, batch, min_words, min_cover, min_equal):
        item = bench.item_words[number]
        low, high = int(batch.first[text]), int(batch.first[text + 1])
        a, b = max(begin, low), min(begin + len(item), high)
        same = batch.words[a:b] == item[a - begin : b - begin]
        least = _least_words(len(item), min_words, min_cover)
        start, end, equal = best_stretch(same)
        if end - start < least or equal < min_equal * (end - start):
            # The best stretch may be diluted; a part of it, or another, may do.
            if (stretch := long_stretch(same, least, min_equal)) is None:
                continue
            start, end, equal = stretch
        row = (equal, -(a + start - low), end - start, len(item))
        if row > best.get((text, number), (0,)):
            best[text, number] = row
    for (text, number), (equal, begin, n, length) in best.items():
        yield text, -begin, (bench.ids[number], n, equal, length)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, max_seeds: int, seeds_per_word: int):
    """The items with text in blocks of bounded size, each as a small list."""
    items = keyed(benchmark, id_col, text_col).select("k", "t").where("k is not null and t is not null")
    # Every word begins at most one seed per mask; it takes two bytes at least.
    room = max(1, 2 * max_seeds // seeds_per_word)
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total // room))
    block = F.pmod(F.xxhash64("k", "t"), F.lit(n))
    items = items.select("k", "t", block.alias("block"))
    if n > 1:
        items = saved(items)
    for b in range(n):
        rows = items.where(F.col("block") == b).select("k", "t").distinct().collect()
        if rows:
            yield sorted((r[0], plain_words(r[1])) for r in rows)


_FOUND = "k long, start long, item_id long, n_words long, n_equal long, item_words long"


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    masks: tuple[str, ...] = MASKS,
    max_seeds: int = MAX_SEEDS,
    min_cover: float = MIN_COVER,
    min_equal: float = MIN_EQUAL,
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """One row per document and benchmark item found in it, with the best stretch.

    Columns: ``k`` (document), ``item_id``, ``start`` (word of the document, counted without
    words of punctuation), ``n_words`` (length of the stretch), ``n_equal``, ``item_words``.
    A stretch counts with at least ``min_words`` words or ``min_cover`` of the item's, whichever
    is less, ``min_equal`` of them equal. Of an item of fewer than ``WHOLE_WORDS`` words the stretch is the whole item;
    items of one or two words have to occur word for word.

    Null and empty texts, and items without letters or digits or without an id, match
    nothing; a document with a null id is reported under null. Repeated rows are reported
    as often as they come, repeated items once. An empty table gives an empty result. Other
    columns are not read.
    """
    work = keyed(docs, id_col, text_col).select("k", "t")
    out = None
    for items in _blocks(benchmark, item_id, item_text, max_seeds, len(masks) + len(SHORT_MASKS)):
        found = work.mapInArrow(_scan(items, masks, min_words, min_cover, min_equal), _FOUND)
        out = found if out is None else out.union(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], _FOUND)
    return out


def without_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    masks: tuple[str, ...] = MASKS,
    max_seeds: int = MAX_SEEDS,
    min_cover: float = MIN_COVER,
    min_equal: float = MIN_EQUAL,
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """The rows of ``docs`` in which ``find_passages`` finds nothing, in one pass, no shuffle."""
    for items in _blocks(benchmark, item_id, item_text, max_seeds, len(masks) + len(SHORT_MASKS)):
        docs = docs.mapInArrow(_keep_clean(items, masks, min_words, min_cover, min_equal, text_col), docs.schema)
    return docs
