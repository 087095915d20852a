"""Links between the tokens of two tokenizers over the same texts, by lockstep merging.

Both tokenizers cover the same bytes. Their tokens are merged by their byte ends, as two sorted
lists are. One NumPy state vector holds the two pointers of every document of a batch;
each step compares the ends that all pointers stand on and advances the smaller one, or
both where they are equal: there the tokens are linked and a group is cut. Documents that
are through leave the vector. A long document takes several lanes of it, so that the others do not wait.

A text is cut at every single space between two characters that are not white space. Byte-level BPE
splits words there, and the other vocabulary has no piece with a space behind another character (checked when it is
loaded), so no token of either crosses such a cut, and each part is encoded like a text of its own. A task
encodes each distinct part once; what it holds does not grow with the length of a text. A run without
such a space is encoded whole.

Texts are encoded once. The distinct linked id pairs of each document are saved; the pairs are counted over
all documents, and the counts of up to ``MAX_PAIRS`` common pairs go back to the documents as a
sorted array. Only links of rarer pairs are joined by a shuffle, on the pair.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrace.llm.hashing import in_pieces, utf8
from playtrace.llm.tables import keyed
from playtrace.scratch import saved

FOLDER = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pairs whose counts go to every task: 17 bytes each.
MAX_PAIRS = 1_000_000
#: Parts that are encoded in one call.
_ROW = 512
#: Distinct parts a task remembers with their tokens.
MAX_PARTS = 800_000
#: Bytes of texts that are merged at once.
PIECE = 1 << 21
#: Tokens of A in a lane; a longer text has several.
LANE = 1024

#: A space between two characters that are not white space.
_CUT = re.compile(r" (?<=\S )(?=\S)")
_SPACE = "▁"


def _byte_of_character() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary, by the public rule:
    printable bytes are themselves, the others follow from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokens:
    """The tokens of distinct parts under both tokenizers, and the bytes of every token."""

    def __init__(self, a_json: bytes, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_buffer(a_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        bytes_of = _byte_of_character()
        vocabulary = self.a.get_vocab()
        self.a_bytes: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            plain = all(c in bytes_of for c in token)
            self.a_bytes[i] = bytes(bytes_of[c] for c in token) if plain else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        if any(re.search(f"[^{_SPACE}]{_SPACE}", p) for p in pieces):
            raise ValueError("a piece has a space behind another character: texts cannot be cut at spaces")
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode()
            for i, p in enumerate(pieces)
        ]
        if not all(self.b_bytes):
            raise ValueError("a piece without bytes")
        self.a_length = np.array([len(t) for t in self.a_bytes], np.int64)
        self.b_length = np.array([len(t) for t in self.b_bytes], np.int64)
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        #: Whether both tokenizers spell a part; in pieces, like all that follows.
        self.spelled = [np.zeros(0, bool)]
        #: Token ids of all parts, under A and B, and where each part begins in them.
        self.ids = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        self.first = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        self.sizes = [0, 0]

    def learn(self, parts: Iterable[str]) -> None:
        """Encode parts that are not known yet."""
        new = [p for p in dict.fromkeys(parts) if p not in self.number]
        # With white space at an end, a part cannot stand in a row with others.
        plain = [p for p in new if not (p[0].isspace() or p[-1].isspace() or _SPACE in p)]
        for at in range(0, len(plain), _ROW):
            self._learn_row(plain[at : at + _ROW])
        for part in new:
            if part not in self.number:
                self._learn_row([part])

    def _learn_row(self, parts: list[str]) -> None:
        """Encode parts in a row, with a space between them, and cut the tokens at their ends."""
        row = " ".join(parts)
        raw = b" " + row.encode()
        both = (
            self.a.encode(" " + row, add_special_tokens=False).ids,
            self.b.encode(row, num_threads=1),
        )
        part_ends = np.cumsum([len(p.encode()) + 1 for p in parts])
        found = []
        for ids, names, length in zip(both, (self.a_bytes, self.b_bytes), (self.a_length, self.b_length)):
            spelled = b"".join([names[i] for i in ids]) == raw
            ids = np.array(ids if spelled else [], np.int32)
            ends = np.cumsum(length[ids])
            stops = np.searchsorted(ends, part_ends, side="right")
            found.append((ids, stops, spelled and bool((ends[stops - 1] == part_ends).all())))
        spelled = all(fits for *_, fits in found)
        if not spelled and len(parts) > 1:
            for part in parts:
                self._learn_row([part])
            return
        for side, (ids, stops, _) in enumerate(found):
            ids, stops = (ids, stops) if spelled else (ids[:0], np.zeros_like(stops))
            self.ids[side].append(ids)
            self.first[side].append(stops + self.sizes[side])
            self.sizes[side] += len(ids)
        self.spelled.append(np.full(len(parts), spelled))
        self.number.update(zip(parts, range(len(self.number), len(self.number) + len(parts))))

    def table(self):
        """Whether each known part is spelled, and for A and B the ids and where each part begins."""
        for kept in (self.spelled, *self.ids, *self.first):
            kept[:] = [np.concatenate(kept)]
        return self.spelled[0], zip((x[0] for x in self.ids), (x[0] for x in self.first))


_loaded: dict[str, Tokens] = {}


def _tokens(a_json: bytes, b_model: bytes) -> Tokens:
    """One for each pair of vocabularies and Python worker."""
    name = hashlib.sha256(a_json + b_model).hexdigest()
    if name not in _loaded:
        _loaded[name] = Tokens(a_json, b_model)
    return _loaded[name]


def _running(counts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts))).astype(np.int64)


def encode(tokens: Tokens, texts: list[str | None]):
    """Token ids of all texts, the first token of each text and of each lane: for A, then for B.

    A lane is a text, or of a longer one, parts with about ``LANE`` tokens of A. Texts without
    tokens (null, empty, or not spelled by both) have none.
    """
    if len(tokens.number) > MAX_PARTS:
        tokens.clear()
    parts = [_CUT.split(t) if t else [] for t in texts]
    tokens.learn(chain.from_iterable(parts))
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    get = tokens.number.__getitem__
    part = np.fromiter(map(get, chain.from_iterable(parts)), np.int64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(texts)), sizes)
    lost = np.zeros(len(texts), bool)
    spelled, sides = tokens.table()
    lost[doc[~spelled[part]]] = True
    part, doc = part[~lost[doc]], doc[~lost[doc]]
    begins = np.searchsorted(doc, np.arange(len(texts) + 1))
    out, lane = [], None
    for ids, first in sides:
        length = (first[1:] - first[:-1])[part]
        at = _running(length)
        if lane is None:
            # Of a text, the parts that begin in the same stretch of LANE tokens.
            stretch = (at[:-1] - at[begins[doc]]) // LANE
            lane = np.flatnonzero(np.diff(doc, prepend=-1) | np.diff(stretch, prepend=-1))
            lane = np.append(lane, len(part))
        place = np.repeat(first[part] - at[:-1], length) + np.arange(at[-1])
        out += [ids[place], at[begins], at[lane]]
    return tuple(out)


def merge(a_end: np.ndarray, a_first: np.ndarray, b_end: np.ndarray, b_first: np.ndarray):
    """(tokens of A, tokens of B) that end together, in the order of lanes and tokens.

    ``a_end`` and ``b_end`` are byte ends; lane ``i`` has the tokens ``a_first[i]`` to
    ``a_first[i + 1]`` of A. Both sides of a lane begin and end at the same byte.
    """
    live = np.flatnonzero((np.diff(a_first) > 0) & (np.diff(b_first) > 0))
    #: Pointers into A and B, and where the pointer into A has to stop.
    state = np.stack((a_first[live], b_first[live], a_first[live + 1]))
    found = []
    while state.shape[1]:
        x, y = a_end[state[0]], b_end[state[1]]
        found.append(state[:2, x == y])
        state[0] += x <= y
        state[1] += y <= x
        going = state[0] < state[2]
        if not going.all():
            state = state[:, going]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Tokens are numbered in the order of lanes, and links of a lane follow its tokens.
    links = np.concatenate(found, axis=1)
    return np.sort(links[0]), np.sort(links[1])


def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 to n-1 as the first bytes of a little-endian word, and their bits."""
    text = np.arange(n).astype("S7").view(np.uint8).reshape(n, 7)
    word = np.zeros((n, 8), np.uint8)
    word[:, :7] = text
    return word.view("<u8").ravel(), (8 * (word != 0).sum(axis=1)).astype(np.uint64)


def group_texts(a_ids, a_first, b_ids, b_first, link_a, link_b) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each document: ids of A and B by group."""
    # Ahead of a token of A stand the tokens of B of all earlier groups; of one of B, those of A up to its own.
    before = np.repeat(np.append(0, link_b[:-1] + 1)[: len(link_a)], np.diff(link_a, prepend=-1))
    upto = np.repeat(link_a + 1, np.diff(link_b, prepend=-1))
    a_place = np.arange(len(a_ids)) + before
    b_place = np.arange(len(b_ids)) + upto
    ids = np.empty(len(a_ids) + len(b_ids), np.int32)
    ids[a_place], ids[b_place] = a_ids, b_ids
    behind = np.full(len(ids), ord(","), np.uint64)
    behind[a_place[link_a]], behind[b_place[link_b]] = ord("|"), ord(";")
    word, bits = _digits(int(ids.max(initial=0)) + 1)
    bits = bits[ids]
    flat = (word[ids] | (behind << bits)).astype("<u8").tobytes().translate(None, b"\0")
    ends = _running((bits >> np.uint64(3)) + np.uint64(1))[a_first + b_first]
    return [flat[x : max(x, y - 1)] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]


def align(tokens: Tokens, texts: list[str | None]):
    """Per text: tokens of A, of B, links, text of the groups, and where its pairs begin; then the
    distinct linked pairs of all texts: ids of A, ids of B, times."""
    a_ids, a_first, a_lane, b_ids, b_first, b_lane = encode(tokens, texts)
    a_end, b_end = np.cumsum(tokens.a_length[a_ids]), np.cumsum(tokens.b_length[b_ids])
    link_a, link_b = merge(a_end, a_lane, b_end, b_lane)
    groups = group_texts(a_ids, a_first, b_ids, b_first, link_a, link_b)
    cuts = np.searchsorted(link_a, a_first)
    doc = np.repeat(np.arange(len(texts)), np.diff(cuts))
    # Ids have at most 20 bits each, so document, A and B fit into one number.
    key = (doc << 40) | (a_ids[link_a].astype(np.int64) << 20) | b_ids[link_b]
    key, times = np.unique(key, return_counts=True)
    place = np.searchsorted(key >> 40, np.arange(len(texts) + 1))
    low = (1 << 20) - 1
    pairs = (key >> 20) & low, key & low, times
    return np.diff(a_first), np.diff(b_first), np.diff(cuts), groups, place, *pairs


_ALIGNED = "n_a", "n_b", "n_links", "groups_sha256", "a", "b", "times"
_ALIGNED_SQL = (
    "r long, k long, n_a long, n_b long, n_links long, groups_sha256 string, "
    "a array<int>, b array<int>, times array<int>"
)


def _scan(a_json: bytes, b_model: bytes):
    def run(batches):
        tokens = _tokens(a_json, b_model)
        for batch in batches:
            raw = utf8(batch.column("t"))
            for x, y in in_pieces(raw, PIECE):
                texts = [None if t is None else t.decode("utf-8", "replace") for t in raw[x:y]]
                n_a, n_b, n, groups, place, *pairs = align(tokens, texts)
                digests = [hashlib.sha256(g).hexdigest() if g else "" for g in groups]
                place = pa.array(place, pa.int32())
                columns = [
                    *[pa.array(c, pa.int64()) for c in (n_a, n_b, n)],
                    pa.array(digests, pa.string()),
                    *[pa.ListArray.from_arrays(place, pa.array(c, pa.int32())) for c in pairs],
                ]
                own = [batch.column(n).slice(x, y - x) for n in ("r", "k")]
                yield pa.RecordBatch.from_arrays([*own, *columns], names=["r", "k", *_ALIGNED])

    return run


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = FOLDER) -> DataFrame:
    """One row per document: ``r`` (number of the row), ``k`` (id), ``n_a``, ``n_b``, ``n_links``,
    ``groups_sha256`` and its distinct linked pairs as arrays ``a``, ``b``, ``times``.

    The two vocabulary files (2 MB) are read on the driver and sent to the tasks.
    """
    with open(os.path.join(folder, A_FILE), "rb") as a, open(os.path.join(folder, B_FILE), "rb") as b:
        scan = _scan(a.read(), b.read())
    work = keyed(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("r"), "k", "t")
    return work.mapInArrow(scan, _ALIGNED_SQL)


def pair_counts(rows: DataFrame) -> DataFrame:
    """``(pair, held, best)`` over all of ``aligned``: links of the pair, and whether no pair with its B id has more."""
    each = rows.select(F.inline(F.arrays_zip("a", "b", "times")))
    pair = F.shiftleft(F.col("a").cast("long"), 20).bitwiseOR(F.col("b").cast("long"))
    held = saved(each.groupBy(pair.alias("pair")).agg(F.sum("times").alias("held")))
    b = F.col("pair").bitwiseAND(F.lit((1 << 20) - 1))
    # One row for each id of the vocabulary at most.
    top = held.groupBy(b.alias("b")).agg(F.max("held").alias("top"))
    joined = held.withColumn("b", b).join(F.broadcast(top), "b")
    return saved(joined.select("pair", "held", (F.col("held") == F.col("top")).alias("best")))


def _least_common(counts: DataFrame, most: int) -> int:
    """The smallest power of two that at most ``most`` pairs reach."""
    power = F.floor(F.log2("held")).cast("int").alias("power")
    sizes = dict(counts.groupBy(power).agg(F.count(F.lit(1))).collect())
    left, least = most, max(sizes, default=-1) + 1
    while least > 0 and sizes.get(least - 1, 0) <= left:
        least -= 1
        left -= sizes.get(least, 0)
    return 1 << least


_TOTALS = "r long, n_best long, count_sum long, rest array<struct<pair:bigint,times:int>>"


def _totals(pairs: np.ndarray, held: np.ndarray, best: np.ndarray):
    """``n_best`` and ``count_sum`` of each document over the given pairs, and its other pairs."""
    kind = pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int32())]))

    def run(batches):
        for batch in batches:
            a, b, times = (batch.column(n) for n in ("a", "b", "times"))
            first = np.asarray(a.offsets, np.int64)
            lo, hi = first[0], first[-1]
            doc = np.repeat(np.arange(len(a)), np.diff(first))
            key = np.asarray(a.values[lo:hi], np.int64) << 20 | np.asarray(b.flatten(), np.int64)
            n = np.asarray(times.flatten(), np.int64)
            at = np.searchsorted(pairs, key)
            known = at < len(pairs)
            known[known] = pairs[at[known]] == key[known]
            at, d, m = at[known], doc[known], n[known]
            n_best, total = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
            np.add.at(n_best, d, m * best[at])
            np.add.at(total, d, m * held[at])
            rest = np.bincount(doc[~known], minlength=len(a))
            rest = np.concatenate(([0], np.cumsum(rest))).astype(np.int32)
            inner = pa.StructArray.from_arrays(
                [pa.array(key[~known], pa.int64()), pa.array(n[~known], pa.int32())], names=["pair", "times"]
            )
            rest = pa.ListArray.from_arrays(pa.array(rest, pa.int32()), inner).cast(kind)
            yield pa.RecordBatch.from_arrays(
                [batch.column("r"), pa.array(n_best), pa.array(total), rest],
                names=["r", "n_best", "count_sum", "rest"],
            )

    return run


def link_totals(rows: DataFrame, counts: DataFrame, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """``(r, n_best, count_sum)`` of each row of ``aligned``: links whose pair is the most common one
    with its B id, and the sum of the counts of all links."""
    least = _least_common(counts, max_pairs)
    common = counts.where(F.col("held") >= least).toArrow().sort_by("pair")
    arrays = [common[n].to_numpy() for n in ("pair", "held", "best")]
    found = rows.select("r", "a", "b", "times").mapInArrow(_totals(*arrays), _TOTALS)
    if least == 1:
        return found.drop("rest")
    found = saved(found)
    each = found.select("r", F.inline("rest")).join(counts.where(F.col("held") < least), "pair")
    more = each.groupBy("r").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
        F.sum(F.col("times") * F.col("held")).alias("more_sum"),
    )
    return found.join(more, "r", "left").select(
        "r",
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"),
    )


def token_links(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    folder: str = FOLDER,
    max_pairs: int = MAX_PAIRS,
) -> DataFrame:
    """One row per document: ``k`` (id), ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``,
    ``count_sum``, ``groups_sha256``.

    A encodes a space and the text, B the text, before which it puts a space itself; strings of special tokens
    are plain text. Null and empty texts, and texts that A or B does not spell (a literal U+2581 becomes a
    space), have no tokens: zeros and an empty digest. Tokens have at least one byte, so at a byte
    where both sides end there is one link and one cut: ``n_groups`` equals ``n_links``. ``n_best``
    counts ties. Repeated rows are documents of their own and count as often as they come; rows with a
    null id as well. Texts of any length are encoded in parts (see above). An empty table gives an
    empty result. Other columns are not read.
    """
    rows = saved(aligned(docs, id_col, text_col, folder))
    totals = link_totals(rows, pair_counts(rows), max_pairs)
    return rows.join(totals, "r").select(
        "k", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "n_best", "count_sum", "groups_sha256"
    )


def vocabulary_links(counts: DataFrame) -> DataFrame:
    """``(b, a, held)``: for every id of B its most common id of A (the smallest, of equals), from ``pair_counts``."""
    a = F.shiftright("pair", 20)
    best = counts.where("best").groupBy(F.col("pair").bitwiseAND(F.lit((1 << 20) - 1)).alias("b"))
    return best.agg(F.min(a).alias("a"), F.max("held").alias("held"))
