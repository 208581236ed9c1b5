"""Language identification: averaged hashed subword embeddings with a linear softmax.

Subwords are runs of 2 to 4 bytes of the lower-cased text, with word edges.
Trained by stochastic gradient descent in numpy; a temperature and a rejection
threshold are set on training rows that the descent did not see.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, doc_view, gram_ids, map_texts, text_bytes

ORDERS = (2, 3, 4)


def counts(text: str | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    data = text_bytes(text)
    ids = np.concatenate([gram_ids(data, n, bits) for n in ORDERS])
    return np.unique(ids, return_counts=True)


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


@dataclass
class Model:
    """Languages, the logit of each bucket (embedding times output weights), bias, temperature, least probability."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    bits: int
    temperature: float
    reject_below: float

    def probabilities(self, text: str) -> np.ndarray:
        data = text_bytes(text)
        total, n = np.zeros(len(self.languages)), 0
        for order in ORDERS:
            ids = gram_ids(data, order, self.bits)
            n += len(ids)
            for a in range(0, len(ids), 1 << 16):
                total += self.table[ids[a : a + (1 << 16)]].sum(0)
        return softmax((total / max(n, 1) + self.bias) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, str]], bits: int = 15, dim: int = 16, epochs: int = 6, rate: float = 3.0, batch: int = 32, seed: int = 7, recall: float = 0.99) -> Model:
    """rows: bucket ids, their counts, language. Every fifth row is kept for calibration."""
    languages = sorted({r[2] for r in rows})
    if not languages:
        return Model(["und"], np.zeros((1 << bits, 1), np.float32), np.zeros(1), bits, 1.0, 0.0)
    rng, size = np.random.default_rng(seed), 1 << bits
    emb, out, bias = rng.normal(0, 0.1, (size, dim)).astype(np.float32), np.zeros((dim, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    out += rng.normal(0, 0.1, out.shape).astype(np.float32)
    y = np.array([languages.index(r[2]) for r in rows])
    fit = [k for k in range(len(rows)) if k % 5] or list(range(len(rows)))
    held = [k for k in range(len(rows)) if k % 5 == 0]

    def dense(ks):
        x = np.zeros((len(ks), size), np.float32)
        for j, k in enumerate(ks):
            x[j, rows[k][0]] = rows[k][1] / max(1, rows[k][1].sum())
        return x

    for epoch in range(epochs):
        step = rate / (1 + epoch)
        order = rng.permutation(fit)
        for a in range(0, len(order), batch):
            ks = order[a : a + batch]
            x = dense(ks)
            h = x @ emb
            p = softmax(h @ out + bias)
            p[np.arange(len(ks)), y[ks]] -= 1
            p /= len(ks)
            back = p @ out.T
            out -= step * (h.T @ p)
            bias -= step * p.sum(0)
            used = np.unique(np.concatenate([rows[k][0] for k in ks]))
            emb[used] -= step * 20 * (x[:, used].T @ back)
    table = emb @ out
    logits = np.concatenate([dense(held[a : a + 64]) @ table + bias for a in range(0, len(held), 64)])
    grid = np.geomspace(0.05, 5, 60)
    loss = [-np.log(softmax(logits / t)[np.arange(len(held)), y[held]] + 1e-12).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    p = softmax(logits / temperature)
    right = p.argmax(1) == y[held]
    reject = float(np.quantile(p.max(1)[right], 1 - recall)) if right.any() else 0.0
    return Model(languages, table.astype(np.float32), bias.astype(np.float64), bits, temperature, reject)


def fit(docs: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = 1500, bits: int = 15, max_chars: int = 200_000) -> Model:
    """Trains on the ``rows`` lowest id hashes among rows for which ``learn`` holds, lang is known and the text is up to ``max_chars``, one text an id.

    That bound is the model's documented sample; counts are made on the executors, so that the
    driver gets at most 2 ** bits numbers a row.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), learn.alias("learn"))
    d = bounded_sample(d.filter(F.col("learn") & F.col("lang").isNotNull()).drop("learn"), rows, max_chars)

    def work(texts):
        made = [counts(t, bits) for t in texts]
        return {"ids": [m[0].tolist() for m in made], "n": [m[1].tolist() for m in made]}

    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n", T.ArrayType(T.IntegerType()))]
    got = map_texts(d, work, fields, keep=("doc_id", "lang")).toArrow()
    rows_ = sorted(zip(got["doc_id"].to_pylist(), got["ids"].to_pylist(), got["n"].to_pylist(), got["lang"].to_pylist(), strict=True), key=lambda r: (r[0], r[3]))
    return train([(np.array(i, np.int64), np.array(n, np.float32), lang) for _, i, n, lang in rows_ if i], bits)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected; one row for each input row, from the whole text alone.

    A null text and one without a letter are ``und`` with score 0 and count as rejected. score is the
    calibrated probability of lang_pred, of equals the first by name; rejected: it is below the calibrated threshold.
    Rows that repeat a text are predicted alike, null ids stay null, an empty table gives an empty one, and other columns
    are left out, whatever their names.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def work(texts):
        m = shared.value
        out = {"lang_pred": [], "score": [], "rejected": []}
        for t in texts:
            if not has_letter(t):
                p, lang = 0.0, "und"
            else:
                probs = m.probabilities(t)
                k = int(probs.argmax())
                p, lang = float(probs[k]), m.languages[k]
            out["lang_pred"].append(lang)
            out["score"].append(min(1.0, p))
            out["rejected"].append(p < m.reject_below or lang == "und")
        return out

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return map_texts(doc_view(docs, id_col, text_col), work, fields)
