"""Language ID by error-correcting output codes.

Every language has a codeword of +1 and -1. For each bit a binary classifier (logistic
regression over hashed character n-grams) learns to tell the languages with +1 from
those with -1. A text's margins are compared with all codewords by the logistic loss,
each bit weighted by how well its classifier did on that language in training; the nearest
codeword wins, and a small lead over the second is flagged as ambiguous.

The model is fitted on a bounded sample (``sample`` rows, dealt over the languages). Every
text is then read whole and predicted in one pass without a shuffle.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtrace.llm.grams import gram_vector, has_letter
from playtrace.llm.tables import keyed

ORDERS = (1, 2, 3)
BITS = 11
#: Labelled rows that the model is fitted on.
SAMPLE = 6_000
UNKNOWN = "und"
#: A lead of the best probability over the second below this is ambiguous.
MIN_LEAD = 0.2
_BATCH = 256


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """``n`` rows of +1 and -1 that differ in many places.

    Up to 5 languages: every way to split them in two. More: of many random tables with
    10 bits for each doubling, the one whose nearest rows are furthest apart.
    """
    if n <= 1:
        return np.ones((n, 1), dtype=np.int8)
    if n <= 5:
        rest = list(itertools.product((1, -1), repeat=n - 1))[1:]
        return np.array([(1, *bits) for bits in rest], dtype=np.int8).T
    rng = np.random.default_rng(seed)
    length = int(np.ceil(10 * np.log2(n)))
    best, apart = None, -1
    for _ in range(200):
        table = rng.choice(np.array([-1, 1], dtype=np.int8), size=(n, length))
        if (np.abs(table.sum(axis=0)) == n).any():
            continue
        product = table.astype(np.int32) @ table.T
        np.fill_diagonal(product, -length)
        distance = (length - int(product.max())) // 2
        if distance > apart:
            best, apart = table, distance
    return best


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 150) -> tuple:
    """Weights and bias of one classifier per column of ``y`` (+1, -1), by momentum descent."""
    w = np.zeros((x.shape[1], y.shape[1]), dtype=np.float32)
    bias = np.zeros(y.shape[1], dtype=np.float32)
    dw, db = np.zeros_like(w), np.zeros_like(bias)
    share = (weight / weight.sum()).astype(np.float32)[:, None]
    for _ in range(steps):
        margin = np.clip(y * (x @ w + bias), -30, 30)
        pull = -y * share / (1 + np.exp(margin))
        dw = 0.9 * dw - 8.0 * (x.T @ pull + 1e-5 * w)
        db = 0.9 * db - 8.0 * pull.sum(axis=0)
        w, bias = w + dw, bias + db
    return w, bias


@dataclass
class LanguageModel:
    languages: list[str]
    codes: np.ndarray
    trust: np.ndarray
    w: np.ndarray
    bias: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Softmax of the weighted losses: rows of ``x`` by languages."""
        margin = x @ self.w + self.bias
        agree = margin[:, None, :] * self.codes[None, :, :]
        loss = (np.logaddexp(0, -agree) * self.trust[None, :, :]).sum(axis=2)
        loss = loss - loss.min(axis=1, keepdims=True)
        share = np.exp(-loss * self.codes.shape[1])
        return share / share.sum(axis=1, keepdims=True)


def fit(x: np.ndarray, names: list[str]) -> LanguageModel:
    """A model from vectors and their languages; every language weighs the same."""
    languages = sorted(set(names))
    codes = codewords(len(languages))
    number = np.array([languages.index(n) for n in names], dtype=np.int64)
    y = codes[number].astype(np.float32)
    weight = 1.0 / np.bincount(number)[number]
    w, bias = fit_logistic(x, y, weight)
    right = ((x @ w + bias) * y > 0).astype(np.float64)
    trust = np.array([right[number == c].mean(axis=0) for c in range(len(languages))])
    trust = np.maximum(trust, 1e-6)
    return LanguageModel(languages, codes, trust / trust.sum(axis=1, keepdims=True), w, bias)


def _vectors(orders, bits):
    def run(batches):
        for batch in batches:
            found = [
                gram_vector(t or "", orders, bits, True).astype(np.float16).tobytes()
                for t in batch.column("t").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), pa.array(found, pa.binary())], names=["lang", "x"]
            )

    return run


def train(labelled: DataFrame, sample: int = SAMPLE, orders=ORDERS, bits: int = BITS) -> LanguageModel | None:
    """Fit on about ``sample`` of the rows of ``labelled`` (``k``, ``t``, ``lang``); None without any.

    Every language gives up to its equal share, picked by a hash of the id.
    """
    labelled = labelled.where("lang is not null and t is not null")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    share = max(1, sample // len(counts))
    spread = 1 << 30
    limit = F.create_map(
        *itertools.chain.from_iterable(
            (F.lit(lang), F.lit(min(spread, spread * share // n))) for lang, n in counts.items()
        )
    )
    dice = F.pmod(F.xxhash64("k", "t"), F.lit(spread))
    picked = labelled.where(dice < F.element_at(limit, F.col("lang"))).select("t", "lang")
    rows = picked.mapInArrow(_vectors(orders, bits), "lang string, x binary").toArrow()
    if not rows.num_rows:
        return None
    data = sorted(zip(rows["lang"].to_pylist(), rows["x"].to_pylist()))
    x = np.stack([np.frombuffer(b, np.float16) for _, b in data]).astype(np.float32)
    return fit(x, [lang for lang, _ in data])


def _predict(model: LanguageModel | None, orders, bits, min_lead: float):
    def run(batches):
        for batch in batches:
            texts = batch.column("t").to_pylist()
            names, scores, unsure = [], [], []
            for at in range(0, len(texts), _BATCH):
                part = texts[at : at + _BATCH]
                known = [model is not None and has_letter(t) for t in part]
                x = np.zeros((len(part), 1 << bits), dtype=np.float32)
                for i, text in enumerate(part):
                    if known[i]:
                        x[i] = gram_vector(text, orders, bits, True)
                if model is not None:
                    share = model.probabilities(x)
                    best = share.argmax(axis=1)
                    top = np.sort(share, axis=1)[:, ::-1]
                    lead = top[:, 0] - (top[:, 1] if share.shape[1] > 1 else 0.0)
                for i in range(len(part)):
                    names.append(model.languages[best[i]] if known[i] else UNKNOWN)
                    scores.append(float(top[i, 0]) if known[i] else 0.0)
                    unsure.append(bool(lead[i] < min_lead) if known[i] else True)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in ("k", "row")],
                    batch.column("t"),
                    pa.array(names, pa.string()),
                    pa.array(scores, pa.float64()),
                    pa.array(unsure, pa.bool_()),
                ],
                names=["k", "row", "t", "lang_pred", "score", "ambiguous"],
            )

    return run


def identify(
    docs: DataFrame,
    labelled: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample: int = SAMPLE,
    orders: tuple[int, ...] = ORDERS,
    bits: int = BITS,
    min_lead: float = MIN_LEAD,
    keep_text: bool = False,
) -> DataFrame:
    """``k`` (id), ``row`` (struct of the other columns), ``lang_pred``, ``score``, ``ambiguous``.

    The model learns from text and ``lang_col`` of the rows where ``labelled`` holds, and
    predicts every row from its text alone. Null texts and texts without a letter are
    ``und`` with score 0, and so is everything if there is nothing to learn from. Repeated
    rows are predicted alike. With ``keep_text`` the text is returned as ``t``.
    """
    source = docs.where(labelled).select(
        docs[f"`{id_col}`"].cast("long").alias("k"),
        docs[f"`{text_col}`"].cast("string").alias("t"),
        docs[f"`{lang_col}`"].cast("string").alias("lang"),
    )
    model = train(source, sample, orders, bits)
    work = keyed(docs, id_col, text_col)
    schema = work.select("k", "row", "t").schema.add("lang_pred", "string").add("score", "double")
    out = work.mapInArrow(_predict(model, orders, bits, min_lead), schema.add("ambiguous", "boolean"))
    return out if keep_text else out.drop("t")
