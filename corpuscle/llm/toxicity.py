"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Presence of hashed runs of ``ORDER`` characters (word edges included) is multiplied by the
log ratio of their rates in toxic and other texts, and the features of a text are divided by
their norm; a logistic regression on these features is trained with averaged steps and
calibrated by Platt's method.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import doc_view, gram_ids, labelled_sample, map_texts, platt, sigmoid

ORDER = 7


def grams(text: str | None, bits: int, order: int = ORDER) -> np.ndarray:
    """Sorted distinct buckets of the whole text: lower case, white space as one blank, a blank at either end."""
    s = " ".join((text or "").lower().split())
    ids = gram_ids(np.frombuffer(f" {s} ".encode("utf-32-le", "replace"), np.uint32), order, bits)
    if len(ids) <= 20_000:
        return np.unique(ids)
    seen = np.zeros(1 << bits, bool)
    seen[ids] = True
    return np.flatnonzero(seen)


@dataclass
class Model:
    ratio: np.ndarray  # log-count ratio, by bucket
    weights: np.ndarray  # learned weight of the scaled feature
    bias: float
    slope: float
    offset: float
    bits: int
    order: int = ORDER

    def raw(self, ids: np.ndarray) -> float:
        x = self.ratio[ids]
        return float(self.weights[ids] @ x / (np.sqrt(x @ x) + 1.0) + self.bias)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return sigmoid(self.slope * np.array([self.raw(grams(t, self.bits, self.order)) for t in texts]) + self.offset)


def train(rows: list[tuple[np.ndarray, int]], bits: int = 18, smooth: float = 1.0, epochs: int = 12, rate: float = 0.5, decay: float = 1e-3, seed: int = 11, order: int = ORDER) -> Model:
    """rows: distinct buckets of a text, label. Every fifth row calibrates only."""
    size = 1 << bits
    fit = [r for k, r in enumerate(rows) if k % 5] or rows
    held = [r for k, r in enumerate(rows) if k % 5 == 0]
    if len({r[1] for r in fit}) < 2:
        rate_ = float(np.mean([r[1] for r in rows])) if rows else 0.0
        return Model(np.zeros(size, np.float32), np.zeros(size, np.float32), float(np.log((rate_ + 1e-3) / (1 - rate_ + 1e-3))), 1.0, 0.0, bits, order)
    pos, neg = np.full(size, smooth), np.full(size, smooth)
    for ids, y in fit:
        (pos if y else neg)[ids] += 1
    n_pos, n_neg = sum(r[1] for r in fit), sum(1 - r[1] for r in fit)
    ratio = np.log((pos / (n_pos + 2 * smooth)) / (neg / (n_neg + 2 * smooth)))
    # Buckets seen a few times say little: their ratio is drawn to nought.
    ratio *= (pos + neg - 2 * smooth) / (pos + neg - 2 * smooth + 5.0)
    weights, bias, mean, mean_bias, steps = np.zeros(size), 0.0, np.zeros(size), 0.0, 0
    rng, g2, b2 = np.random.default_rng(seed), np.full(size, 1e-2), 1e-2
    places = np.arange(len(fit))
    for epoch in range(epochs):
        rng.shuffle(places)
        for k in places:
            ids, y = fit[k]
            x = ratio[ids]
            x = x / (np.sqrt(x @ x) + 1.0)
            g = sigmoid(weights[ids] @ x + bias) - y
            grad = g * x + decay * weights[ids]
            g2[ids] += grad * grad
            weights[ids] -= rate * grad / np.sqrt(g2[ids])
            b2 += g * g
            bias -= rate * g / np.sqrt(b2)
        if epoch >= epochs // 2:
            mean, mean_bias, steps = mean + weights, mean_bias + bias, steps + 1
    model = Model(ratio.astype(np.float32), (mean / steps).astype(np.float32), mean_bias / steps, 1.0, 0.0, bits, order)
    model.slope, model.offset = platt(np.array([model.raw(ids) for ids, _ in held]), np.array([y for _, y in held], float))
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", rows: int = 6000, bits: int = 18, max_chars: int = 200_000) -> Model:
    """Trains on a bounded sample: the ``rows`` lowest id hashes among labelled texts up to ``max_chars``, one text an id.

    Labels without an id or a label, and null texts, do not train; without rows of both labels the score is constant.
    """
    sample = labelled_sample(doc_view(docs, id_col, text_col), labels, label, rows, max_chars)

    def work(texts):
        return {"ids": [grams(t, bits).tolist() for t in texts]}

    got = map_texts(sample, work, [T.StructField("ids", T.ArrayType(T.IntegerType()))], keep=("doc_id", "label")).toArrow().sort_by("doc_id")
    return train([(np.asarray(i.values.to_numpy(), np.int64), int(y > 0)) for i, y in zip(got["ids"], got["label"].to_pylist(), strict=True)], bits)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted; one row for each input row, from the whole text.

    A null text scores as the empty one. Rows that repeat a text score alike, null ids stay null, an empty table gives an
    empty one, and other columns are left out, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts):
        p = shared.value.scores(texts)
        return {"score": p.tolist(), "predicted": (p >= threshold).astype(int).tolist()}

    return map_texts(doc_view(docs, id_col, text_col), work, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
