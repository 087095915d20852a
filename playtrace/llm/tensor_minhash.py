"""Near duplicates by MinHash with tensored banding.

Two collections of ``bands`` short bands (``rows`` minhashes each) are computed; every pair of
a band of the first and one of the second makes a table key. ``bands ** 2`` tables of
``2 * rows`` minhashes so need ``2 * bands * rows`` minhashes instead of
``2 * bands ** 2 * rows``. A pair of similarity s shares a key with probability
``(1 - (1 - s**rows)**bands)**2``; with the defaults a pair at exactly 0.8 is missed
four times in 10,000, at 0.85 once in 70,000, and of pairs at 0.25 three in 1,000 share one.

* Documents with equal shingle sets are one class, represented by the smallest id.
* A key can only be shared if both of its bands are, so bands that occur once go
  before pairs of bands are formed; of most documents nothing is left then.
* Documents that share keys, directly or over others, form a block. Blocks of up to
  ``TILE_ROWS`` documents are one group, in which every pair that shares a key is compared
  unless it is already linked. Larger blocks are dealt into tiles. Each tile meets
  the first one; that links a group of copies in proportion to its size. Documents
  outside the block's largest component then meet all tiles, as long as they are at most ``REST_ROWS``.
* More than that are texts that have something in common (a footer, a license) and are not alike. Their block is
  taken apart by keys of its own: ``FINE_BANDS`` and ``FINE_ROWS`` longer bands from new minhashes, of which a pair at 0.8
  misses all once in 10,000 times, and of pairs at 0.25 one in 15,000 shares one.
* Every link is confirmed on the full shingle sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrace.llm.graph import components
from playtrace.llm.hashing import (
    BYTES,
    FOLDED,
    Batch,
    in_pieces,
    mix,
    random_values,
    utf8,
    window_hashes,
)
from playtrace.llm.tables import blob, keyed, partitions, unblob
from playtrace.scratch import saved

BANDS, ROWS = 16, 4
#: Of blocks that have to be taken apart.
FINE_BANDS, FINE_ROWS = 33, 6
#: Minhash products held at once.
_PRODUCTS = 1 << 16
#: Documents in a tile; a group of a task has two tiles at most.
TILE_ROWS = 256
#: Documents outside the largest component of a block that may meet all of its tiles.
REST_ROWS = 4096


def shingle_sets(texts: list, size: int, fold_case: bool):
    """Sorted distinct shingle hashes of each text; a shorter text is one shingle."""
    values = FOLDED if fold_case else BYTES
    for a, b in in_pieces(texts):
        batch = Batch(texts[a:b], values)
        all_windows = window_hashes(batch.words, size)
        for lo, hi in zip(batch.first[:-1].tolist(), batch.first[1:].tolist()):
            if hi - lo >= size:
                yield np.unique(all_windows[lo : hi - size + 1])
            elif hi > lo:
                yield window_hashes(batch.words[lo:hi], hi - lo) ^ np.uint64(hi - lo)
            else:
                yield np.zeros(0, np.uint64)


def _banding(bands: int, rows: int, seed: int):
    """From a set of shingle hashes to its hashed bands, those of the first collection first."""
    factors = random_values(2 * bands * rows, seed) | np.uint64(1)
    band_salt = random_values(2 * bands, seed + 101)

    def of(found: np.ndarray) -> np.ndarray:
        if not len(found):
            return np.zeros(0, np.int64)
        low = np.empty(len(factors), np.uint64)
        step = max(1, min(len(factors), _PRODUCTS // len(found)))
        for begin in range(0, len(factors), step):
            some = factors[begin : begin + step]
            low[begin : begin + step] = (found[None, :] * some[:, None]).min(axis=1)
        low = mix(low).reshape(2 * bands, rows)
        key = band_salt.copy()
        for r in range(rows):
            key = mix(key ^ low[:, r])
        return key.view(np.int64)

    return of


def _sketch(size: int, fold_case: bool, bands: int, rows: int):
    """Set size, set digest and hashed bands of each text."""
    banded = _banding(bands, rows, 101)

    def run(batches):
        for batch in batches:
            texts = utf8(batch.column("t"))
            n, d1, d2, halves = [], [], [], []
            for found in shingle_sets(texts, size, fold_case):
                n.append(len(found))
                other = mix(found + np.uint64(977))
                d1.append(int(np.add.reduce(found).view(np.int64)) if len(found) else 0)
                d2.append(int(np.add.reduce(other).view(np.int64)) if len(found) else 0)
                halves.append(banded(found))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("k"),
                    pa.array(n, pa.int64()),
                    pa.array(d1, pa.int64()),
                    pa.array(d2, pa.int64()),
                    pa.array(halves, pa.list_(pa.int64())),
                ],
                names=["k", "n", "d1", "d2", "halves"],
            )

    return run


def _sets(size: int, fold_case: bool):
    def run(batches):
        for batch in batches:
            found = [blob(x, np.uint64) for x in shingle_sets(utf8(batch.column("t")), size, fold_case)]
            names = [n for n in batch.schema.names if n != "t"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(found, pa.binary())],
                names=[*names, "shingles"],
            )

    return run


def _fine(batches):
    """The bands of documents from their shingle sets, by other minhashes."""
    banded = _banding(FINE_BANDS, FINE_ROWS, 707)
    for batch in batches:
        halves = [banded(unblob(x, np.uint64)) for x in batch.column("shingles").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(n) for n in ("k", "c", "shingles")],
                pa.array(halves, pa.list_(pa.int64())),
            ],
            names=["k", "c", "shingles", "halves"],
        )


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have at least ``percent`` of their union in common."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate((x, y))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def _compare(bands: int, percent: int):
    """Links of one group: ``side`` 0 rows meet all rows, ``side`` 1 rows only those of side 0.

    Two documents are compared if they share a band of both collections and their components
    ``c`` differ. Returned is each component that reaches a smaller one here, with the smallest.
    """

    def run(key, table):
        # A document may be there on both sides; it then counts for side 0.
        order = np.lexsort((table["side"].to_numpy(), table["k"].to_numpy()))
        ids = table["k"].to_numpy()[order]
        new = np.append(True, ids[1:] != ids[:-1]) if len(ids) else np.zeros(0, bool)
        order = order[new]
        order = order[np.argsort(table["side"].to_numpy()[order], kind="stable")]
        ids, side = table["k"].to_numpy()[order], table["side"].to_numpy()[order]
        known = table["c"].to_numpy()[order]
        sets = [unblob(table["shingles"][int(i)].as_py(), np.uint64) for i in order]
        halves = np.array([table["halves"][int(i)].as_py() for i in order], dtype=np.int64)
        root = known.copy()
        for i in range(int((side == 0).sum())):
            rest = halves[i + 1 :] == halves[i]
            share = rest[:, :bands].any(axis=1) & rest[:, bands:].any(axis=1)
            for j in (np.flatnonzero(share) + i + 1).tolist():
                if root[i] != root[j] and similar(sets[i], sets[j], percent):
                    low, high = sorted((root[i], root[j]))
                    root[root == high] = low
        rows = sorted({(c, r) for c, r in zip(known.tolist(), root.tolist()) if r < c})
        a, b = zip(*rows) if rows else ((), ())
        whole = [key[-1].as_py() == 1] * len(rows)
        return pa.table(
            {
                "a": pa.array(a, pa.int64()),
                "b": pa.array(b, pa.int64()),
                "whole": pa.array(whole, pa.bool_()),
            }
        )

    return run


def _stars(keys: DataFrame) -> DataFrame:
    """``(a, b)``: each holder of a key with the smallest one."""
    held = keys.groupBy("key").agg(F.min("v").alias("a"), F.count(F.lit(1)).alias("held"))
    held = held.where("held > 1").select("key", "a")
    return keys.join(held, "key").select("a", F.col("v").alias("b")).distinct()


def _key_edges(reps: DataFrame, bands: int) -> DataFrame:
    """``(a, b)``: each document with the smallest one that shares a tensored key."""
    half = reps.select("v", F.posexplode("halves").alias("band", "half"))
    shared = half.groupBy("band", "half").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    live = saved(half.join(shared, ["band", "half"]).select("v", "band", "half"))
    first = live.where(F.col("band") < bands)
    second = live.where(F.col("band") >= bands).select(
        "v", F.col("band").alias("band2"), F.col("half").alias("half2")
    )
    keys = first.join(second, "v").select(
        F.xxhash64("band", "half", "band2", "half2").alias("key"), "v"
    )
    return _stars(keys)


def _blocks(edges: DataFrame) -> DataFrame:
    """``(k, block, tiles, tile)``: the blocks of documents over shared keys, dealt into tiles."""
    block = components(edges).select(F.col("v").alias("k"), F.col("c").alias("block"))
    size = block.groupBy("block").agg(F.count(F.lit(1)).alias("held"))
    size = size.select("block", F.ceil(F.col("held") / TILE_ROWS).cast("int").alias("tiles"))
    tile = F.pmod(F.xxhash64("k"), F.col("tiles")).cast("int").alias("tile")
    return block.join(size, "block").select("k", "block", "tiles", tile)


def _groups(met: DataFrame, keys: list[str], compare) -> DataFrame:
    """``compare`` on each group; small rows are much work, so they stay in many tasks."""
    dealt = met.repartition(partitions(met.sparkSession), *keys)
    return saved(dealt.groupBy(*keys).applyInArrow(compare, "a long, b long, whole boolean"))


def _first_links(members: DataFrame, bands: int, percent: int) -> DataFrame:
    """``(a, b, whole)``: links within each tile, and of every tile with the first of its block."""
    own = members.withColumn("place", F.col("tile"))
    hub = members.where("tiles > 1 and tile = 0")
    hub = hub.withColumn("place", F.explode(F.sequence(F.lit(1), F.col("tiles") - 1)))
    columns = ["block", "place", "tiles", F.lit(0).alias("side"), "k", "c", "halves", "shingles"]
    met = own.select(*columns).unionByName(hub.select(*columns))
    return _groups(met, ["block", "place", "tiles"], _compare(bands, percent))


def _rest_links(large: DataFrame, rest: DataFrame, bands: int, percent: int) -> DataFrame:
    """``(a, b, whole)``: links of the documents in ``rest`` with all of their blocks."""
    size = rest.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / TILE_ROWS).cast("int").alias("rests"))
    each_tile = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    each_rest = F.explode(F.sequence(F.lit(0), F.col("rests") - 1))
    part = F.pmod(F.xxhash64("k", F.lit(1)), F.col("rests")).cast("int")
    what = ["k", "c", "halves", "shingles"]
    asked = rest.join(size, "block").withColumn("part", part).withColumn("place", each_tile)
    asked = asked.select("block", "part", "place", F.lit(0).alias("side"), *what)
    held = large.join(size, "block").withColumn("part", each_rest)
    held = held.select("block", "part", F.col("tile").alias("place"), F.lit(1).alias("side"), *what)
    met = asked.unionByName(held).withColumn("tiles", F.lit(0))
    return _groups(met, ["block", "part", "place", "tiles"], _compare(bands, percent))


def _with_components(members: DataFrame, comp: DataFrame) -> DataFrame:
    """``members`` with their components so far (``comp(v, c)``)."""
    known = comp.select(F.col("v").alias("k"), F.col("c").alias("_low"))
    joined = members.join(known, "k", "left").withColumn("c", F.coalesce("_low", "c"))
    return saved(joined.drop("_low"))


def _outside(members: DataFrame) -> DataFrame:
    """The documents outside their block's largest component, and how many (``outside``)."""
    held = members.groupBy("block", "c").agg(F.count(F.lit(1)).alias("held"))
    main = held.groupBy("block").agg(
        F.max_by("c", F.struct("held", "c")).alias("main"), (F.sum("held") - F.max("held")).alias("outside")
    )
    return members.join(main, "block").where("c != main").drop("main")


def _joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """``comp(v, c)`` after more links between components: their rounds run on those only."""
    low = saved(components(links))
    moved = low.select(F.col("v").alias("c"), F.col("c").alias("low"))
    first = comp.join(moved, "c", "left").select("v", F.coalesce("low", "c").alias("c"))
    return saved(first.union(low.join(comp, "v", "left_anti")))


def _taken_apart(members: DataFrame, percent: int) -> DataFrame:
    """``(a, b, whole)``: links of ``members(k, c, shingles)``, in blocks by longer bands."""
    fine = saved(members.select("k", "c", "shingles").mapInArrow(_fine, "k long, c long, shingles binary, halves array<bigint>"))
    place = _blocks(_key_edges(fine.select(F.col("k").alias("v"), "halves"), FINE_BANDS))
    placed = saved(fine.join(place, "k"))
    links = _first_links(placed, FINE_BANDS, percent)
    large = placed.where("tiles > 1")
    if not large.limit(1).count():
        return links
    large = _with_components(large, components(links.select("a", "b")))
    return links.union(_rest_links(large, _outside(large).drop("outside"), FINE_BANDS, percent))


def _linked(members: DataFrame, bands: int, percent: int) -> DataFrame:
    """Components ``(v, c)`` of all confirmed links of ``members(k, block, tiles, tile, halves, shingles)``."""
    members = members.withColumn("c", F.col("k"))
    found = _first_links(members, bands, percent)
    # In a block of one tile every document already has its smallest.
    done = found.where("whole").select(F.col("a").alias("v"), F.col("b").alias("c"))
    large = members.where("tiles > 1")
    if not large.limit(1).count():
        return done
    comp = saved(components(found.where("not whole").select("a", "b")))
    large = _with_components(large, comp)
    rest = saved(_outside(large))
    few = rest.where(F.col("outside") <= REST_ROWS).drop("outside")
    comp = _joined(comp, _rest_links(large, few, bands, percent).select("a", "b"))
    mixed = rest.where(F.col("outside") > REST_ROWS).select("block").distinct()
    if mixed.limit(1).count():
        apart = _taken_apart(large.join(mixed, "block", "left_semi"), percent)
        comp = _joined(comp, apart.select("a", "b"))
    return done.union(comp)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
    fold_case: bool = True,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row per document: ``k`` (id), ``n`` (distinct shingles), ``class_id``, ``component_id``.

    Documents are linked when ``100 * intersection >= percent * union`` of their sets of
    ``shingle``-word shingles (a shorter text is one shingle). ``class_id`` is the smallest id
    with the same set, ``component_id`` the smallest id reachable over links.

    Null and empty texts, and texts of white space, have no shingles and are linked with
    nothing. Rows with a null id are returned with null for both ids and link nothing.
    Repeated rows are returned as often as they come. Other columns are not read. An empty
    table gives an empty result.
    """
    work = keyed(docs, id_col, text_col).select("k", "t")
    sketch = saved(
        work.mapInArrow(
            _sketch(shingle, fold_case, bands, rows),
            "k long, n long, d1 long, d2 long, halves array<bigint>",
        )
    )
    same = ["d1", "d2", "n"]
    usable = sketch.where("n > 0 and k is not null")
    low = usable.groupBy(*same).agg(F.min("k").alias("rep"))
    reps = usable.join(low, same).where("k = rep").dropDuplicates(["k"])
    reps = reps.select(F.col("k").alias("v"), "halves")
    place = saved(_blocks(_key_edges(reps, bands)))
    signed = place.join(reps, F.col("k") == F.col("v")).drop("v")
    picked = work.join(signed, "k").dropDuplicates(["k"])
    schema = "k long, block long, tiles int, tile int, halves array<bigint>, shingles binary"
    picked = picked.select("k", "block", "tiles", "tile", "halves", "t")
    members = saved(picked.mapInArrow(_sets(shingle, fold_case), schema))
    comp = _linked(members, bands, percent)
    classes = low.join(comp, F.col("rep") == F.col("v"), "left").select(
        *same, "rep", F.coalesce("c", "rep").alias("c")
    )
    out = sketch.select("k", "n", "d1", "d2").join(classes, same, "left")
    own = F.when(F.col("n") == 0, F.col("k"))
    named = F.col("k").isNotNull()
    return out.select(
        "k",
        "n",
        F.when(named, F.coalesce("rep", own)).alias("class_id"),
        F.when(named, F.coalesce("c", own)).alias("component_id"),
    )
