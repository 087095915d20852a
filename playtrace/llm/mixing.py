"""Mixing sources to target weights by drawing fixed-length blocks.

The words of each source are laid out one document after the other and cut into blocks
of ``block`` words. Every output shard draws how many blocks it takes from each source from a
multinomial distribution over what the sources still owe, so shards vary but the totals
are met. The slots of a source are numbered through all shards; slot ``j`` takes the block at
``j`` under a pseudorandom permutation of the source's blocks, which starts again with
other keys after every full round. Slots and blocks are joined by index.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playtrace.llm.hashing import mix
from playtrace.llm.tables import WORD, keyed
from playtrace.scratch import saved

BLOCK_WORDS = 32
SHARDS = 200
MAX_REPEAT = 3
#: Repeated over the sources in order of their names.
WEIGHTS = (5, 2, 1)
_ROWS_PER_BIN = 20_000
_ROUNDS = 4
#: Slots of a source in a shard that are made from one row.
SLOTS_PER_RUN = 10_000
#: Sources whose draws are made together in a task.
SOURCES_PER_GROUP = 1_000


def fill_level(sources: DataFrame, total: float, most: float) -> float:
    """Words per unit of weight of the sources (``weight, source_size``) that stay below ``most`` times their size.

    Sources that would get more are held there, and what they leave is shared by the rest; a
    turn is one aggregate. The level only rises, so a source that is held stays held.
    """
    cap = F.col("source_size") * float(most)
    level, held = None, 0
    while True:
        full = F.lit(False) if level is None else cap < F.col("weight") * level
        seen = sources.where("source_size > 0").agg(
            F.count_if(full).alias("held"),
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)).alias("given"),
            F.sum(F.when(~full, F.col("weight"))).alias("open"),
        ).first()
        if seen["open"] is None:
            return float("inf")
        if level is not None and seen["held"] == held:
            return level
        held = seen["held"]
        level = (total - seen["given"]) / seen["open"]


def draw_counts(slots, wants, rng):
    """For each number of ``wants`` so many slots of the sources, as an array of counts.

    Each is a multinomial draw over the slots still owed; what a source cannot give any more
    is drawn again from the others.
    """
    owed = np.array(slots, dtype=np.int64)
    for want in wants:
        take = np.zeros(len(owed), dtype=np.int64)
        left = int(want)
        while left > 0:
            rest = owed - take
            take += np.minimum(rng.multinomial(left, rest / rest.sum()), rest)
            left = int(want) - int(take.sum())
        owed -= take
        yield take


def _within_groups(seed: int):
    """What a group of sources gives to each shard, drawn over the sources of the group."""

    def run(key, members: pa.Table, draws: pa.Table) -> pa.Table:
        members, draws = members.sort_by("source_no"), draws.sort_by("shard")
        shard = draws.column("shard").to_numpy()
        rng = np.random.default_rng([seed, 1, key[0].as_py()])
        wants = draws.column("want").to_numpy()
        drawn = list(draw_counts(members.column("n_slots").to_numpy(), wants, rng))
        counts = np.array(drawn, dtype=np.int64).reshape(len(drawn), members.num_rows)
        upto = counts.cumsum(axis=0)
        i, s = np.nonzero(counts)
        return pa.table(
            {
                "shard": pa.array(shard[i], pa.int32()),
                "source_no": pa.array(members.column("source_no").to_numpy()[s], pa.int64()),
                "lo": pa.array(upto[i, s] - counts[i, s], pa.int64()),
                "hi": pa.array(upto[i, s] - 1, pa.int64()),
                "n_blocks": pa.array(members.column("n_blocks").to_numpy()[s], pa.int64()),
            }
        )

    return run


def draw_slots(sources: DataFrame, shards: int, seed: int, width: int) -> DataFrame:
    """``shard, source_no, lo, hi, n_blocks``: the slots of each source that a shard takes.

    The draw is made in two steps, which together are one multinomial draw: on the driver over groups of
    ``width`` sources, one number per shard and group, and in a task per group over its sources.
    """
    spark = sources.sparkSession
    group = F.floor(F.col("source_no") / width).cast("long").alias("group")
    members = sources.where("n_slots > 0").select(group, "source_no", "n_slots", "n_blocks")
    owed = members.groupBy("group").agg(F.sum("n_slots").alias("n")).orderBy("group").collect()
    total = sum(r["n"] for r in owed)
    per_shard = -(-total // shards) or 1
    wants = [min(per_shard, total - at) for at in range(0, total, per_shard)]
    draws = [
        (owed[g]["group"], shard, int(take[g]))
        for shard, take in enumerate(draw_counts([r["n"] for r in owed], wants, np.random.default_rng(seed)))
        for g in np.flatnonzero(take)
    ]
    draws = spark.createDataFrame(draws, "group long, shard int, want long")
    return members.groupBy("group").cogroup(draws.groupBy("group")).applyInArrow(
        _within_groups(seed), "shard int, source_no long, lo long, hi long, n_blocks long"
    )


def source_table(work: DataFrame, weights, share: float, block: int, most: float, per_part: int) -> DataFrame:
    """``source_no, source, source_size, rows, weight, target, n_blocks, n_slots``, numbered by name."""
    spark = work.sparkSession
    sizes = saved(work.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")))
    seen = sizes.agg(F.count(F.lit(1)).alias("n"), F.sum("source_size").alias("total")).first()
    # Parts in order of the names; what stands before a part is one number per part.
    name = F.col("source").asc_nulls_last()
    ranged = saved(
        sizes.repartitionByRange(max(1, -(-seen["n"] // per_part)), name).withColumn("part", F.spark_partition_id())
    )
    base, before = [], 0
    for part, n in ranged.groupBy("part").count().orderBy("part").collect():
        base.append((part, before))
        before += n
    base = spark.createDataFrame(base, "part int, base long")
    nth = F.row_number().over(Window.partitionBy("part").orderBy(name))
    numbered = ranged.join(F.broadcast(base), "part").withColumn("source_no", F.col("base") + nth - 1)
    turn = F.pmod("source_no", F.lit(len(weights))).cast("int")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)
    numbered = saved(numbered.select("source_no", "source", "source_size", "rows", weight.alias("weight")))
    level = fill_level(numbered, share * (seen["total"] or 0), most)
    target = F.when(
        F.col("source_size") > 0, F.least(F.col("source_size") * float(most), F.col("weight") * F.lit(level))
    ).otherwise(0.0)
    n_blocks = F.ceil(F.col("source_size") / block)
    n_slots = F.when(F.col("source_size") > 0, F.round(target / F.col("source_size") * n_blocks)).otherwise(0)
    return saved(
        numbered.select(
            "source_no", "source", "source_size", "rows", "weight",
            target.alias("target"), n_blocks.cast("long").alias("n_blocks"), n_slots.cast("long").alias("n_slots"),
        )
    )


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Each ``index`` under a pseudorandom permutation of ``0 .. n - 1`` that ``key`` selects.

    A Feistel network over the smallest even number of bits that holds ``n``; what falls
    outside the range goes through it again until it is inside.
    """
    bits = np.ones(len(n), dtype=np.uint64)
    while (short := (np.uint64(1) << (2 * bits)) < n).any():
        bits[short] += np.uint64(1)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> bits[todo], out[todo] & mask[todo]
        for turn in range(_ROUNDS):
            salt = key[todo] + np.uint64(turn * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            left, right = right, left ^ (mix(mix(right + salt) ^ salt) & mask[todo])
        out[todo] = (left << bits[todo]) | right
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def _place(seed: int):
    def run(batches):
        for batch in batches:
            source = batch.column("source_no").to_numpy().astype(np.uint64)
            slot = batch.column("slot").to_numpy().astype(np.uint64)
            n = batch.column("n_blocks").to_numpy().astype(np.uint64)
            key = mix(mix(source + np.uint64(seed)) + slot // n)
            block = permuted(slot % n, n, key)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("shard", "source_no", "slot")] + [pa.array(block)],
                names=["shard", "source_no", "slot", "block"],
            )

    return run


class Mix:
    """The tables of one mix: ``rows``, ``sources``, ``slots`` and ``pieces``.

    * ``sources``: ``source_no, source, source_size, rows, weight, target, n_blocks, n_slots``
    * ``rows``: ``k, source_no, bin, nth, size, offset`` - where each document lies in its source
    * ``slots``: ``shard, source_no, slot, block`` - what each output shard takes
    * ``pieces``: ``source_no, block, k, bin, nth, start, words`` - documents in blocks
    """

    def __init__(self, rows, sources, slots, pieces):
        self.rows, self.sources, self.slots, self.pieces = rows, sources, slots, pieces


def plan_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.0,
    block: int = BLOCK_WORDS,
    shards: int = SHARDS,
    most: float = MAX_REPEAT,
    seed: int = 7,
    slots_per_run: int = SLOTS_PER_RUN,
    group: int = SOURCES_PER_GROUP,
) -> Mix:
    """Draw a mix of ``share`` times all words.

    Sources are a table of any size. What is collected is one number per shard and ``group`` of
    sources, and one per ``group * 100`` sources.
    """
    work = keyed(docs, id_col, text_col)
    size = F.coalesce(F.regexp_count("t", F.lit(WORD)), F.lit(0)).cast("long")
    source = F.col("row").getField(source_col).cast("string")
    work = saved(work.select("k", source.alias("source"), size.alias("size"), F.xxhash64("t").alias("h")))
    sources = source_table(work, weights, share, block, most, 100 * group)
    totals = sources.agg(F.sum("n_slots").alias("slots"), F.sum("rows").alias("rows")).first()
    drawn = saved(draw_slots(sources, shards, seed, group))
    # First to runs of bounded length: a source may have very many slots in a shard.
    run = F.explode(F.sequence(F.col("lo"), F.col("hi"), F.lit(slots_per_run)))
    runs = drawn.withColumn("begin", run).withColumn("end", F.least("hi", F.col("begin") + slots_per_run - 1))
    runs = runs.repartition(max(1, -(-(totals["slots"] or 0) // 200_000)), "shard", "source_no", "begin")
    each = runs.select("shard", "source_no", F.explode(F.sequence("begin", "end")).alias("slot"), "n_blocks")
    placed = each.mapInArrow(_place(seed), "shard int, source_no long, slot long, block long")

    bins = max(1, -(-(totals["rows"] or 0) // _ROWS_PER_BIN))
    number = sources.select("source_no", "source")
    # A source can hold a third of all rows: adaptive execution splits it, small tables are sent along.
    rows = work.join(number, work["source"].eqNullSafe(number["source"])).select(
        "k", "source_no", "size", "h", F.pmod(F.xxhash64("k"), F.lit(bins)).alias("bin")
    )
    place = ["source_no", "bin"]
    before = Window.partitionBy("source_no").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    held = rows.groupBy(*place).agg(F.sum("size").alias("held"))
    base = held.select(*place, F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    in_bin = Window.partitionBy(*place).orderBy("k", "size", "h")
    running = F.sum("size").over(in_bin.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"nth": F.row_number().over(in_bin), "upto": running})
    rows = rows.join(base, place).select(
        "k", *place, "nth", "size", (F.col("base") + F.col("upto") - F.col("size")).alias("offset")
    )
    low = F.floor(F.col("offset") / block).cast("long")
    high = F.floor((F.col("offset") + F.col("size") - 1) / block).cast("long")
    reach = F.when(F.col("size") > 0, F.sequence(low, high))
    begin = F.greatest("offset", F.col("block") * block)
    end = F.least(F.col("offset") + F.col("size"), (F.col("block") + 1) * block)
    pieces = rows.withColumn("block", F.explode_outer(reach)).select(
        *place, "block", "k", "nth", "size",
        (begin - F.col("offset")).alias("start"),
        (end - begin).alias("words"),
    )
    return Mix(rows, sources, placed, pieces)


def mix_counts(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Per document: ``k, source, size, source_size, target, taken`` (words, repeats counted).

    Size is the number of words; null texts have none. A null source is a source of its own
    and the last. Repeated rows lie one after the other in their source and are each
    returned; a null id is an id like others. No document is taken more than ``most`` times.
    Sources without words, and an empty table, take nothing.
    """
    mix_ = plan_mix(docs, id_col, **options)
    times = mix_.slots.groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("times"))
    # Slots come from a small table of draws, which Spark would take for a small table itself.
    taken = F.sum(F.coalesce(F.col("words") * F.col("times"), F.lit(0)))
    counts = (
        mix_.pieces.join(times.hint("merge"), ["source_no", "block"], "left")
        .groupBy("source_no", "bin", "nth", "k", "size")
        .agg(taken.cast("long").alias("taken"))
    )
    return counts.join(mix_.sources, "source_no").select(
        "k", "source", "size", "source_size", "target", "taken"
    )


def mixed_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The mix itself: ``shard, slot, source, text``, one row per slot.

    For tables whose ids are unique: the words of a piece are read from the text by id.
    """
    mix_ = plan_mix(docs, id_col, text_col, **options)
    texts = keyed(docs, id_col, text_col).select("k", "t")
    words = F.regexp_extract_all("t", F.lit(WORD), F.lit(0))
    part = F.slice(words, (F.col("start") + 1).cast("int"), F.col("words").cast("int"))
    cut = mix_.pieces.where("words > 0").join(texts, "k").select(
        "source_no", "block", F.struct("bin", "nth", F.array_join(part, " ").alias("text")).alias("piece")
    )
    blocks = cut.groupBy("source_no", "block").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))
    text = F.array_join(F.transform("pieces", lambda p: p["text"]), " ")
    return (
        mix_.slots.hint("merge").join(blocks.select("source_no", "block", text.alias("text")), ["source_no", "block"])
        .join(mix_.sources, "source_no")
        .select("shard", "slot", "source", "text")
    )
