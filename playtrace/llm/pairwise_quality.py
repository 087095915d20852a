"""Quality scores learned from preference pairs (Bradley-Terry).

Every pair of a good and a bad document says that the good one should score higher; the
chance of that is the logistic function of the difference of their linear scores. The
weights minimise the logistic loss over differences of feature vectors: hashed
character n-grams and a few shares (distinct words, repeated neighbours, capitals, signs).

A document passes if its raw score is above the quantile of the labelled documents' scores
that leaves the share of good documents; the score returned is the logistic function of
the distance to that quantile, shifted so that the quantile itself is at ``pass_score``.
Only the weights come from a sample; the quantile is exact over all labelled documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrace.llm.grams import gram_vector
from playtrace.llm.hashing import Batch
from playtrace.llm.tables import keyed
from playtrace.operators.quantiles import percentiles
from playtrace.scratch import saved

ORDERS = (1, 2, 3)
BITS = 11
#: Labelled rows that the model is fitted on, and pairs drawn from them.
SAMPLE = 6_000
PAIRS = 40_000
#: The score at the quantile.
PASS_SCORE = 0.3
#: Scores that one task ranks for the quantile.
MAX_RANKED = 50_000
_SHARES = 8
_CAPITALS = list(range(ord("A"), ord("Z") + 1))
_SIGNS = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]


def features(text: str | None) -> np.ndarray:
    """N-gram cells, then shares between 0 and 1; all zero but the first share if empty."""
    text = text or ""
    out = np.zeros((1 << BITS) + _SHARES, dtype=np.float32)
    out[: 1 << BITS] = gram_vector(text, ORDERS, BITS, False)
    batch = Batch([text.encode("utf-8", "replace")])
    words = batch.words
    n, size = len(words), max(1, len(batch.buf) - 1)
    cells = np.bincount(batch.buf, minlength=256)
    shares = out[1 << BITS :]
    if not n:
        shares[0] = 1.0
        return out
    pairs = words[1:] * np.uint64(3) + words[:-1]
    shares[1] = min(1.0, np.log1p(n) / 12)
    shares[2] = len(np.unique(words)) / n
    shares[3] = (words[1:] == words[:-1]).mean() if n > 1 else 0.0
    shares[4] = 1 - len(np.unique(pairs)) / max(1, len(pairs)) if n > 1 else 0.0
    shares[5] = cells[_CAPITALS].sum() / size
    shares[6] = cells[_SIGNS].sum() / size
    shares[7] = min(1.0, size / n / 20)
    return out


def fit_pairs(x: np.ndarray, better: np.ndarray, worse: np.ndarray, steps: int = 300) -> np.ndarray:
    """Weights that minimise ``mean(log(1 + exp(-(x[better] - x[worse]) @ w)))``."""
    w = np.zeros(x.shape[1], dtype=np.float32)
    dw = np.zeros_like(w)
    for _ in range(steps):
        s = x @ w
        pull = 1 / (1 + np.exp(np.clip(s[better] - s[worse], -30, 30)))
        on = np.bincount(better, pull, len(x)) - np.bincount(worse, pull, len(x))
        gradient = -(x.T @ (on / len(better)).astype(np.float32)) + 1e-5 * w
        dw = 0.9 * dw - 4.0 * gradient
        w = w + dw
    return w


def weighted_quantile(values: np.ndarray, weights: np.ndarray, below: float) -> float:
    """The smallest value that has at least ``below`` of the weight beneath it.

    What ``threshold`` finds in Spark, for values in memory.
    """
    order = np.argsort(values, kind="stable")
    beneath = np.cumsum(weights[order]) - weights[order]
    at = int(np.searchsorted(beneath, below * weights.sum(), side="left"))
    return float(values[order][min(at, len(order) - 1)])


def _vectors(batches):
    for batch in batches:
        found = [features(t).astype(np.float16).tobytes() for t in batch.column("t").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("label"), pa.array(found, pa.binary())], names=["label", "x"]
        )


def train(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, pairs: int = PAIRS, seed: int = 3
) -> np.ndarray | None:
    """Weights fitted on about ``sample`` rows of ``labels`` (``k``, ``label`` 0 or 1); None without both labels.

    Both labels give up to half of the sample, picked by a hash of the id. The sample is
    what is broadcast.
    """
    counts = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return None
    spread = 1 << 30
    limits = {k: min(spread, spread * (sample // 2) // n) for k, n in counts.items()}
    limit = F.when(F.col("label") == 1, limits[1]).otherwise(limits[0])
    chosen = labels.where(F.pmod(F.xxhash64("k"), F.lit(spread)) < limit)
    picked = docs.select("k", "t").join(F.broadcast(chosen), "k").select("t", "label")
    rows = picked.mapInArrow(_vectors, "label int, x binary").toArrow()
    data = sorted(zip(rows["label"].to_pylist(), rows["x"].to_pylist()))
    y = np.array([label for label, _ in data], dtype=np.int64)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return None
    x = np.stack([np.frombuffer(b, np.float16) for _, b in data]).astype(np.float32)
    rng = np.random.default_rng(seed)
    return fit_pairs(x, rng.choice(good, pairs), rng.choice(bad, pairs))


def _raw(w: np.ndarray):
    def run(batches):
        for batch in batches:
            # Rounded as in training, so that equal rows give equal scores.
            found = [features(t).astype(np.float16).astype(np.float32) @ w for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("k"), batch.column("row"), pa.array(found, pa.float64())], names=["k", "row", "raw"]
            )

    return run


def threshold(scored: DataFrame, labels: DataFrame) -> float:
    """The raw score that as many labelled documents are below as have label 0.

    It lies between two neighbouring scores, so no rounding moves a document across. Every
    pair of a labelled document and its label counts once, however often the row comes.
    """
    judged = saved(scored.select("k", "raw").distinct().join(labels, "k").select("label", "raw"))
    n, bad = judged.agg(F.count(F.lit(1)), F.count_if(F.col("label") == 0)).first()
    if not 0 < bad < n:
        return judged.agg(F.min("raw")).first()[0] if n else 0.0
    point = {"limit": (bad - 0.5) / (n - 1)}
    return percentiles(judged, "raw", point, at_most=n, max_rows=MAX_RANKED).first()["limit"]


def _score(limit: float, pass_score: float):
    shift = np.log(pass_score / (1 - pass_score))

    def run(batches):
        for batch in batches:
            raw = batch.column("raw").to_numpy(zero_copy_only=False) - limit
            passed = raw >= 0
            score = 1 / (1 + np.exp(-np.clip(raw, -30, 30) - shift))
            score = np.where(passed, np.maximum(score, pass_score), np.minimum(score, np.nextafter(pass_score, 0)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("k"),
                    batch.column("row"),
                    pa.array(score, pa.float64()),
                    pa.array(passed.astype(np.int32), pa.int32()),
                ],
                names=["k", "row", "score", "predicted"],
            )

    return run


def rank_quality(
    docs: DataFrame,
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample: int = SAMPLE,
    pairs: int = PAIRS,
    pass_score: float = PASS_SCORE,
) -> DataFrame:
    """``k`` (id), ``row`` (struct of the other columns), ``score`` (0 to 1), ``predicted`` (0 or 1).

    ``labelled`` has ``id_col`` and ``label``; labels other than 0 and 1, null ids, and rows
    whose id is not in ``docs`` are not learned from. Every text of ``docs`` is read whole and
    scored from its text alone; null counts as empty, and empty texts are scored like
    others. Without rows of both labels every score is ``pass_score``. Repeated rows
    get equal scores.
    """
    work = keyed(docs, id_col, text_col)
    names = labelled.select(F.col(id_col).cast("long").alias("k"), F.col("label").cast("int").alias("label"))
    names = names.where("label in (0, 1) and k is not null").distinct()
    w = train(work, names, sample, pairs)
    schema = work.select("k", "row").schema
    if w is None:
        scored, limit = work.select("k", "row", F.lit(0.0).alias("raw")), 0.0
    else:
        # Texts are read once for all scores; what is saved has no text.
        scored = saved(work.mapInArrow(_raw(w), work.select("k", "row").schema.add("raw", "double")))
        limit = threshold(scored, names)
    return scored.mapInArrow(_score(limit, pass_score), schema.add("score", "double").add("predicted", "integer"))
