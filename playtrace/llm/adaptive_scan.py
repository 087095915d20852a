"""Nearest neighbours by inner product: inverted lists scanned with adaptive dimensions.

Vectors get one more component that makes all norms equal, so that the largest inner
product is the smallest distance, and are turned by a random rotation, after which the
first d of D components are a fair sample of a distance. Within each probed list the
components are read in blocks of columns. After each block a test rejects the
candidates whose distance so far, scaled to D, is too large for the query's bound at the
chosen error level; only the others go on. What is left is scored on the
original vectors in double precision.

* Centroids come from k-means on a bounded sample (``SAMPLE`` rows). Every row is indexed.
* A query's bound is its k-th best distance to the sample's rows in its probed lists, which
  is never too small. Those k rows are candidates whatever the test says, so that every query
  has k neighbours if there are so many.
* How many lists to probe is measured: for ``CALIBRATION`` queries the true neighbours
  are found by brute force over all rows, and the fewest lists that reach
  ``target_recall`` are taken.
* Lists of any size are dealt into parts of at most about ``PART_ROWS`` rows; a query
  goes to every part of its lists, so a list with a third of all rows is many tasks. The queries of
  a list are dealt in the same way, ``PART_QUERIES`` to a part, and every part of rows meets every part of queries.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playtrace.llm.hashing import random_values
from playtrace.llm.tables import partitions, ship, unblob
from playtrace.scratch import saved

SAMPLE = 4_096
CALIBRATION = 64
TARGET_RECALL = 0.97
PART_ROWS = 4_096
PART_QUERIES = 8_192
#: Columns in a block.
COLUMNS = 13
#: Error level of the rejection test: larger rejects later.
EPSILON = 2.1
_MAX_LISTS = SAMPLE // 16
_QUERIES_AT_ONCE = 128


@dataclass
class Index:
    """What the tasks need: centroids and rotation of the lengthened space, and the sample."""

    radius: float
    rotation: np.ndarray
    k: int
    ids: np.ndarray
    vectors: np.ndarray
    sample: np.ndarray | None = None
    centroids: np.ndarray | None = None
    sample_lists: np.ndarray | None = None

    def lengthen(self, x: np.ndarray) -> np.ndarray:
        """Rotated rows of norm ``radius``."""
        rest = np.sqrt(np.maximum(0.0, self.radius**2 - (x * x).sum(axis=1)))
        return np.concatenate((x, rest[:, None]), axis=1) @ self.rotation

    def aim(self, q: np.ndarray) -> np.ndarray:
        """Rotated queries, scaled to norm ``radius``; scaling leaves their order of rows."""
        q = q * (self.radius / np.sqrt((q * q).sum(axis=1)))[:, None]
        return np.concatenate((q, np.zeros((len(q), 1))), axis=1) @ self.rotation

    def lists(self, turned: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest lists of each row, nearest first."""
        return np.argsort(_distances(turned, self.centroids), axis=1, kind="stable")[:, :n]

    def known(self, turned: np.ndarray, probed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An upper bound of the squared distance to the k-th neighbour in the probed lists,
        and the nearest rows of the sample there, one more than k as the query may be one."""
        far = _distances(turned, self.sample)
        far[~probed[:, self.sample_lists]] = np.inf
        some = min(self.k + 1, far.shape[1])
        near = np.argpartition(far, some - 1, axis=1)[:, :some]
        bound = np.take_along_axis(far, near, axis=1).max(axis=1)
        if some <= self.k:
            bound[:] = np.inf
        return bound * (1 + 1e-9) + 1e-9 * self.radius**2, near


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T))


def k_means(x: np.ndarray, n: int, turns: int = 10) -> np.ndarray:
    """``n`` centroids; an empty one stays where it was."""
    rng = np.random.default_rng(17)
    centroids = x[rng.choice(len(x), n, replace=False)].copy()
    for _ in range(turns):
        own = np.concatenate(
            [_distances(x[a : a + 2048], centroids).argmin(axis=1) for a in range(0, len(x), 2048)]
        )
        held = np.bincount(own, minlength=n)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        centroids[held > 0] = sums[held > 0] / held[held > 0][:, None]
    return centroids


def adaptive_scan(x: np.ndarray, q: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of ``q``, row of ``x``) of the pairs that no block of columns rejects."""
    dims = x.shape[1]
    edges = [*range(0, dims, COLUMNS), dims]
    own = np.zeros((len(q), len(x)))
    first = True
    at_q = at_x = far = None
    for a, b in zip(edges[:-1], edges[1:]):
        if first:
            own = _distances(q[:, a:b], x[:, a:b])
        else:
            gap = q[at_q, a:b] - x[at_x, a:b]
            far = far + np.einsum("ij,ij->i", gap, gap)
        scale = b / dims * (1 + EPSILON / np.sqrt(b)) ** 2 if b < dims else 1.0
        if first:
            at_q, at_x = np.nonzero(own <= (bound * scale)[:, None])
            far = own[at_q, at_x]
            first = False
        else:
            keep = far <= bound[at_q] * scale
            at_q, at_x, far = at_q[keep], at_x[keep], far[keep]
    return at_q, at_x


def _read(batch, dims: int):
    """Ids and vectors in double precision of a batch with ``id`` and ``vec`` (bytes)."""
    vectors = batch.column("vec").to_pylist()
    x = np.frombuffer(b"".join(vectors), np.float64).reshape(-1, dims) if vectors else np.zeros((0, dims))
    return batch.column("id").to_numpy(zero_copy_only=False), x


def _pack(batches):
    """Vectors as bytes; those that take no part get an empty value."""
    for batch in batches:
        packed = []
        for vector in batch.column("vec").to_pylist():
            x = None
            if vector and None not in vector:
                x = np.array(vector, dtype=np.float64)
                if not np.isfinite(x).all() or not x.any() or not np.isfinite(x @ x):
                    x = None
            packed.append(b"" if x is None else x.tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("query"), pa.array(packed, pa.binary())],
            names=["id", "query", "vec"],
        )


def _assign(index: Index, dims: int):
    def run(batches):
        for batch in batches:
            ids, x = _read(batch, dims)
            near = index.lists(index.lengthen(x), 1)[:, 0] if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("vec"), pa.array(near.astype(np.int32))],
                names=["id", "vec", "list"],
            )

    return run


def _probe(index: Index, dims: int, probes: int, held: np.ndarray):
    """Bound, lists and known neighbours of each query; as many lists more as k rows need."""

    def ask(query_ids: np.ndarray, q: np.ndarray):
        turned = index.aim(q)
        order = index.lists(turned, len(held))
        enough = (np.cumsum(held[order], axis=1) <= index.k).sum(axis=1) + 1
        take = np.minimum(np.maximum(enough, probes), len(held))
        lists = [row[:n].astype(np.int32) for row, n in zip(order, take)]
        probed = np.zeros((len(q), len(held)), dtype=bool)
        for i, row in enumerate(lists):
            probed[i, row] = True
        bound, near = index.known(turned, probed)
        seen, scores = [], []
        for i, some in enumerate(near):
            some = some[probed[i, index.sample_lists[some]]]
            found, score = _nearest(index.ids[some], index.vectors[some], query_ids[i], q[i], index.k)
            seen.append(found)
            scores.append(score)
        return bound, lists, seen, scores

    def run(batches):
        for batch in batches:
            ids, q = _read(batch, dims)
            out: list[list] = [[], [], [], []]
            for at in range(0, len(q), _QUERIES_AT_ONCE):
                part = slice(at, at + _QUERIES_AT_ONCE)
                for column, values in zip(out, ask(ids[part], q[part])):
                    column.extend(values)
            kinds = (pa.float64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("vec"), *map(pa.array, out, kinds)],
                names=["id", "vec", "bound", "lists", "seen", "scores"],
            )

    return run


def _nearest(ids: np.ndarray, x: np.ndarray, query_id: int, q: np.ndarray, k: int):
    """Ids and exact scores of the k best rows, ties to the smaller id."""
    other = ids != query_id
    ids, score = ids[other], np.einsum("ij,j->i", x[other], q)
    if len(ids) > 4 * k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        keep = score >= least
        ids, score = ids[keep], score[keep]
    order = np.lexsort((ids, -score))[:k]
    return ids[order], score[order]


_HIT = "query_id long, vec_id long, score double"


def _hits(rows: list) -> pa.Table:
    q, v, s = (np.concatenate([np.zeros(0), *c]) for c in zip(*rows)) if rows else [np.zeros(0)] * 3
    return pa.table(
        {
            "query_id": pa.array(q.astype(np.int64)),
            "vec_id": pa.array(v.astype(np.int64)),
            "score": pa.array(s.astype(np.float64)),
        }
    )


def _scan(index: Index, dims: int):
    def run(held, asked):
        if not held.num_rows or not asked.num_rows:
            return _hits([])
        ids, x = _read(held.combine_chunks(), dims)
        query_ids, q = _read(asked.combine_chunks(), dims)
        bound = asked["bound"].to_numpy()
        turned_x, turned_q = index.lengthen(x), index.aim(q)
        rows = []
        for at in range(0, len(q), _QUERIES_AT_ONCE):
            end = at + _QUERIES_AT_ONCE
            at_q, at_x = adaptive_scan(turned_x, turned_q[at:end], bound[at:end])
            edges = np.searchsorted(at_q, np.arange(len(turned_q[at:end]) + 1))
            for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                if b > a:
                    some = at_x[a:b]
                    found, score = _nearest(ids[some], x[some], query_ids[at + i], q[at + i], index.k)
                    rows.append((np.full(len(found), query_ids[at + i]), found, score))
        return _hits(rows)

    return run


def _brute(query_ids: np.ndarray, q: np.ndarray, dims: int, k: int):
    def run(batches):
        for batch in batches:
            ids, x = _read(batch, dims)
            own = batch.column("list").to_numpy()
            for i, query in enumerate(query_ids):
                found, score = _nearest(ids, x, query, q[i], k)
                where = {v: n for v, n in zip(ids.tolist(), own.tolist())}
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(found), i, np.int32)),
                        pa.array(found.astype(np.int64)),
                        pa.array(score),
                        pa.array([where[v] for v in found.tolist()], pa.int32()),
                    ],
                    names=["query_no", "vec_id", "score", "list"],
                )

    return run


def _top(hits: DataFrame, key: str, k: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _probes_needed(held: DataFrame, index: Index, dims: int, sample, target: float) -> int:
    """The fewest lists with which the calibration queries reach the target recall."""
    ids, x = sample
    n_lists = len(index.centroids)
    if n_lists == 1 or len(ids) <= 1:
        return n_lists
    ids, x = ids[:CALIBRATION], x[:CALIBRATION]
    hits = held.mapInArrow(
        _brute(ids, x, dims, index.k), "query_no int, vec_id long, score double, list int"
    )
    true = _top(hits, "query_no", index.k).select("query_no", "list").collect()
    order = index.lists(index.aim(x), n_lists)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(n_lists), order.shape), axis=1)
    rank = np.sort([place[r["query_no"], r["list"]] for r in true])
    return int(rank[min(len(rank) - 1, int(np.ceil(target * len(rank))) - 1)]) + 1


def nearest_neighbours(
    vectors: DataFrame,
    queries: Column,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 20,
    target_recall: float = TARGET_RECALL,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows of largest inner product for each query.

    ``queries`` is a condition on the rows of ``vectors``. A row is no neighbour of a query
    with its own id. Ranks start at 1; ties go to the smaller id. With fewer than k other
    rows a query has fewer neighbours.

    Vectors that are null, empty, zero, or hold null or non-finite components take no part,
    nor do rows with a null id and, if lengths differ, vectors that do not have the most
    common length (of equally common ones the longest). Of rows with the same id
    one is a neighbour, the best, and one is asked. Other columns are not read. An empty table gives
    an empty result.
    """
    spark = vectors.sparkSession
    ship(spark)
    found = vectors.select(
        vectors[f"`{id_col}`"].cast("long").alias("id"),
        F.coalesce(queries, F.lit(False)).alias("query"),
        vectors[f"`{vec_col}`"].cast("array<double>").alias("vec"),
    ).where("id is not null")
    packed = saved(found.mapInArrow(_pack, "id long, query boolean, vec binary"))
    size = F.octet_length("vec")
    lengths = packed.where(size > 0).groupBy(size.alias("bytes")).agg(F.count(F.lit(1)).alias("n"))
    common = lengths.orderBy(F.desc("n"), F.desc("bytes")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if common is None:
        return empty
    dims, n = common["bytes"] // 8, common["n"]
    rows = packed.where(size == common["bytes"])

    spread = 1 << 30
    dice = F.pmod(F.xxhash64("id"), F.lit(spread))
    picked = rows.where(dice < min(spread, spread * SAMPLE // n)).select("id", "vec").toArrow()
    sample = sorted(zip(picked["id"].to_pylist(), picked["vec"].to_pylist()))
    if len(sample) < min(n, 2):
        return empty
    ids = np.array([i for i, _ in sample], dtype=np.int64)
    x = np.stack([unblob(v, np.float64) for _, v in sample])
    mixed = np.argsort(random_values(len(ids), 29))
    ids, x = ids[mixed], x[mixed]

    norms = rows.mapInArrow(_norms(dims), "norm double").agg(F.max("norm")).first()[0]
    rotation, _ = np.linalg.qr(np.random.default_rng(23).standard_normal((dims + 1, dims + 1)))
    index = Index(float(norms), rotation, k, ids, x)
    index.sample = index.lengthen(x)
    n_lists = max(1, min(int(np.sqrt(n)), _MAX_LISTS, len(np.unique(x, axis=0))))
    index.centroids = k_means(index.sample, n_lists)
    index.sample_lists = index.lists(index.sample, 1)[:, 0]

    held = saved(rows.mapInArrow(_assign(index, dims), "id long, vec binary, list int"))
    counts = np.zeros(n_lists, dtype=np.int64)
    for row in held.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[row["list"]] = row["n"]
    probes = _probes_needed(held, index, dims, (ids, x), target_recall)
    # One row per list: bounded by the number of centroids.
    parts = spark.createDataFrame(
        [(i, int(-(-c // PART_ROWS))) for i, c in enumerate(counts.tolist()) if c], "list int, parts int"
    )
    parts = F.broadcast(parts)
    dealt = held.join(parts, "list").select(
        "list", F.pmod(F.xxhash64("id", "vec"), F.col("parts")).cast("int").alias("part"), "id", "vec"
    )
    asked = rows.where("query").select("id", "vec").dropDuplicates(["id"])
    asked = asked.repartition(partitions(spark), "id")
    aimed = asked.mapInArrow(
        _probe(index, dims, probes, counts),
        "id long, vec binary, bound double, lists array<int>, seen array<long>, scores array<double>",
    )
    aimed = saved(aimed)
    known = aimed.select(F.col("id").alias("query_id"), F.explode(F.arrays_zip("seen", "scores")).alias("hit"))
    known = known.select("query_id", F.col("hit.seen").alias("vec_id"), F.col("hit.scores").alias("score"))
    aimed = aimed.select("id", "vec", "bound", F.explode("lists").alias("list")).join(parts, "list")
    asking = aimed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PART_QUERIES).cast("int").alias("askers"))
    # One row per list as well.
    asking = F.broadcast(saved(asking))
    each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    asker = F.pmod(F.xxhash64("id", F.lit(3)), F.col("askers")).cast("int")
    aimed = aimed.join(asking, "list").select("list", each.alias("part"), asker.alias("asker"), "id", "vec", "bound")
    to_each = F.explode(F.sequence(F.lit(0), F.col("askers") - 1))
    dealt = dealt.join(asking, "list").select("list", "part", to_each.alias("asker"), "id", "vec")
    place = ["list", "part", "asker"]
    hits = dealt.groupBy(*place).cogroup(aimed.groupBy(*place)).applyInArrow(_scan(index, dims), _HIT)
    hits = hits.union(known).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return _top(hits, "query_id", k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _norms(dims: int):
    def run(batches):
        for batch in batches:
            _, x = _read(batch, dims)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array([float(np.sqrt((x * x).sum(1)).max())])], names=["norm"])

    return run
