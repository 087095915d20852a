import numpy as np
import pytest
from pyspark.sql import functions as F

from playtrace.llm.mixing import (
    draw_counts,
    draw_slots,
    mix_counts,
    mixed_blocks,
    permuted,
    plan_mix,
    source_table,
)


def plain_targets(sizes, weights, total, most):
    """Shares by weight, those above ``most`` times their size held there, again until none is."""
    out, left = {}, total
    while open_ := [i for i, s in enumerate(sizes) if s and i not in out]:
        share = {i: left * weights[i % len(weights)] / sum(weights[j % len(weights)] for j in open_) for i in open_}
        full = [i for i in open_ if share[i] > most * sizes[i]]
        if not full:
            out |= share
        out |= {i: most * sizes[i] for i in full}
        left -= sum(out[i] for i in full)
    return [out.get(i, 0) for i in range(len(sizes))]


def sized(spark, sizes):
    rows = [(f"s{i:06d}" if i + 1 < len(sizes) else None, s) for i, s in enumerate(sizes)]
    return spark.createDataFrame(rows, "source string, size long").repartition(3)


@pytest.mark.parametrize("sizes", [[10, 1000, 1000], [0, 5], [1, 2, 4, 8, 16, 32, 64, 128, 2000], [7], [0, 0]])
@pytest.mark.parametrize("share, per_part", [(1.0, 2), (1.0, 100), (2.9, 100)])
def test_targets_are_reshared(spark, sizes, share, per_part):
    got = source_table(sized(spark, sizes), (5, 2, 1), share, 4, 3, per_part).orderBy("source_no").collect()
    assert [r.source_size for r in got] == sizes
    assert [r.source_no for r in got] == list(range(len(sizes)))
    assert [r.target for r in got] == pytest.approx(plain_targets(sizes, (5, 2, 1), share * sum(sizes), 3))


def test_draws_meet_the_totals():
    slots = [1000, 10, 0, 333]
    drawn = list(draw_counts(slots, [100] * 13 + [43], np.random.default_rng(1)))
    assert np.sum(drawn, axis=0).tolist() == slots
    assert [int(d.sum()) for d in drawn] == [100] * 13 + [43]


@pytest.mark.parametrize("width", [2, 1000])
def test_slots_of_a_source_follow_each_other(spark, width):
    sources = source_table(sized(spark, [40, 4000, 4, 0, 700]), (5, 2, 1), 1.0, 4, 3, 100)
    drawn = draw_slots(sources, 20, 7, width).orderBy("shard").collect()
    for row in sources.collect():
        mine = [(r.lo, r.hi) for r in drawn if r.source_no == row.source_no]
        assert [lo for lo, _ in mine] == [0, *[hi + 1 for _, hi in mine[:-1]]][: len(mine)]
        assert sum(hi - lo + 1 for lo, hi in mine) == row.n_slots
    total = sum(r.hi - r.lo + 1 for r in drawn)
    by_shard = {}
    for r in drawn:
        by_shard[r.shard] = by_shard.get(r.shard, 0) + r.hi - r.lo + 1
    assert len(by_shard) == 20 and max(by_shard.values()) == -(-total // 20)


def test_many_sources(spark):
    """30,000 sources of 0 to 99 words: sources and draws are tables, and the totals are met."""
    n = 30_000
    text = F.array_join(F.array_repeat(F.lit("w"), (F.col("id") % 100).cast("int")), " ")
    many = spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text"), F.format_string("s%06d", "id").alias("source"))
    got = mix_counts(many, block=1).orderBy("k").toPandas()
    assert len(got) == n and (got.taken <= 3 * got["size"]).all()
    want = plain_targets([i % 100 for i in range(n)], (5, 2, 1), int(got["size"].sum()), 3)
    assert got.target.tolist() == pytest.approx(want)
    assert (abs(got.taken - got.target) <= 0.5 + 1e-6).all()


def test_counts_of_documents_follow_from_the_tables(spark):
    """Taken words of each document, recomputed slot by slot from the draws and the words laid out."""
    mix = plan_mix(docs(spark), block=4)
    slots, rows = mix.slots.toPandas(), mix.rows.toPandas()
    times = slots.groupby(["source_no", "block"]).size()
    for r in rows.itertuples():
        taken = sum(times.get((r.source_no, (r.offset + w) // 4), 0) for w in range(r.size))
        rows.loc[r.Index, "taken"] = taken
    got = mix_counts(docs(spark), block=4).toPandas()
    assert sorted(zip(got.k, got.taken)) == sorted(zip(rows.k, rows.taken.astype(int)))
    for number, mine in slots.groupby("source_no"):
        n = mix.sources.where(f"source_no = {number}").first().n_blocks
        counted = np.bincount(mine.block, minlength=n)
        assert len(counted) == n and counted.max() - counted.min() <= 1


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000])
def test_permutations(n):
    size = np.full(n, n, np.uint64)
    for key in (1, 2):
        got = permuted(np.arange(n, dtype=np.uint64), size, np.full(n, key, np.uint64))
        assert sorted(got.tolist()) == list(range(n))


def docs(spark):
    rows = [(i, " ".join(["w"] * (i % 50)), "ab"[i % 2] if i % 7 else None, 1) for i in range(300)]
    rows += [(1000, None, "a", 1), (1001, "", "empty", 1), (1002, "q " * 9000, "c", 1), (1002, "q " * 9000, "c", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int").repartition(4)


def test_contract(spark):
    got = mix_counts(docs(spark)).toPandas()
    assert len(got) == 304
    assert (got.taken <= 3 * got["size"]).all()
    by = got.groupby("source", dropna=False).agg(size=("size", "sum"), target=("target", "max"), taken=("taken", "sum"))
    assert (abs(by.taken - by.target) <= np.maximum(64, 0.02 * by.target)).all()
    assert got.taken.sum() == pytest.approx(got["size"].sum(), rel=0.02)
    again = mix_counts(docs(spark).repartition(7)).toPandas()
    assert sorted(map(tuple, got.astype(str).values)) == sorted(map(tuple, again.astype(str).values))


def test_runs_of_slots_make_no_difference(spark):
    whole = mix_counts(docs(spark), block=1).toPandas()
    runs = mix_counts(docs(spark), block=1, slots_per_run=7).toPandas()
    assert sorted(map(tuple, whole.astype(str).values)) == sorted(map(tuple, runs.astype(str).values))


def test_blocks_hold_the_words(spark):
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(40)), "s") for i in range(10)]
    mixed = mixed_blocks(spark.createDataFrame(rows, "doc_id long, text string, source string"), share=2.0)
    words = [w for r in mixed.collect() for w in r.text.split()]
    assert len(words) == 800 and {words.count(w) for w in set(words)} <= {1, 2, 3}


def test_empty(spark):
    assert mix_counts(docs(spark).limit(0)).collect() == []
