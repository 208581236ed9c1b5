"""Quality classifier: attention-based multiple-instance learning over passages.

A text is a bag of passages of 64 words. A passage is encoded from the mean of
hashed byte-gram embeddings and a few dense traits; gated attention, learned
from document labels only, weighs the passages; the weighted representation is
scored. Trained in numpy, calibrated by Platt's method on rows kept aside.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import doc_view, gram_ids, labelled_sample, map_texts, platt, sigmoid, small_batches

PASSAGE, ORDER, TRAITS = 64, 3, 5


def passages(text: str | None) -> list[list[str]]:
    words = (text or "").split()
    return [words[a : a + PASSAGE] for a in range(0, len(words), PASSAGE)] or [[]]


@lru_cache
def kinds() -> np.ndarray:
    """1 for letters, 2 for digits, 4 for upper case, added, by code point."""
    return np.fromiter((c.isalpha() + 2 * c.isdigit() + 4 * c.isupper() for c in map(chr, range(0x110000))), np.uint8, 0x110000)


def traits(words: list[str], joined: str) -> list[float]:
    """Length, distinct share, and shares of upper-case, digit and other characters."""
    n, c = len(words), max(1, len(joined) - len(words) + 1)
    kind = kinds()[np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)]
    letters, digits, upper = (int(np.count_nonzero(kind & bit)) for bit in (1, 2, 4))
    return [n / PASSAGE, len(set(words)) / n if n else 0.0, upper / c, digits / c, max(0.0, (c - letters - digits)) / c]


def featurize(text: str | None, bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each passage its gram buckets, and the dense traits."""
    ids, dense = [], []
    for words in passages(text):
        joined = " ".join(words)
        ids.append(gram_ids(np.frombuffer(f" {joined} ".encode("utf-8", "replace"), np.uint8), ORDER, bits))
        dense.append(traits(words, joined))
    return ids, np.array(dense, np.float32)


@dataclass
class Model:
    emb: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    v: np.ndarray
    u: np.ndarray
    a: np.ndarray
    c: np.ndarray
    b: float
    bits: int
    slope: float = 1.0
    offset: float = 0.0

    def raw(self, text: str | None) -> float:
        ids, dense = featurize(text, self.bits)
        mean = self.means(ids)
        z = np.tanh(np.hstack([mean, dense]) @ self.w1 + self.b1)
        s = (np.tanh(z @ self.v) * sigmoid(z @ self.u)) @ self.a
        w = np.exp(s - s.max())
        return float((w / w.sum()) @ z @ self.c + self.b)

    def means(self, ids: list[np.ndarray], chunk: int = 1 << 15) -> np.ndarray:
        """The mean embedding of each passage's grams, about ``chunk`` of them at a time: one word may be as long as its text."""
        out, sizes, a = np.zeros((len(ids), self.emb.shape[1]), np.float32), np.array([len(i) for i in ids]), 0
        while a < len(ids):
            b = max(a + 1, a + int(np.searchsorted(np.cumsum(sizes[a : a + chunk]), chunk, "right")))
            some = a + np.flatnonzero(sizes[a:b])
            if b == a + 1:
                for k in range(0, sizes[a], chunk):
                    out[a] += self.emb[ids[a][k : k + chunk]].sum(0)
            elif len(some):
                out[some] = np.add.reduceat(self.emb[np.concatenate(ids[a:b])], np.cumsum(sizes[some]) - sizes[some], axis=0)
            a = b
        return out / np.maximum(sizes, 1)[:, None]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return sigmoid(self.slope * np.array([self.raw(t) for t in texts]) + self.offset)


def train(rows: list[tuple[list[np.ndarray], list[np.ndarray], np.ndarray, int]], bits: int = 12, dim: int = 16, hidden: int = 16, gate: int = 8, epochs: int = 10, batch: int = 32, rate: float = 0.01, seed: int = 5) -> Model:
    """rows: for each document its passages' buckets and counts, traits, and label. Every fifth row calibrates only."""
    rng, size = np.random.default_rng(seed), 1 << bits
    init = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
    p = {"emb": rng.normal(0, 0.3, (size, dim)).astype(np.float32), "w1": init(dim + TRAITS, hidden), "b1": np.zeros(hidden, np.float32), "v": init(hidden, gate), "u": init(hidden, gate), "a": init(gate), "c": init(hidden), "b": np.zeros(1, np.float32)}
    fit, held = [r for k, r in enumerate(rows) if k % 5], [r for k, r in enumerate(rows) if k % 5 == 0]
    if len({r[3] for r in fit}) < 2 or not held:
        share = float(np.mean([r[3] for r in rows])) if rows else 0.5
        p["c"][:] = 0
        return Model(**{k: x for k, x in p.items() if k != "b"}, b=float(np.log((share + 1e-3) / (1 - share + 1e-3))), bits=bits)
    m = {k: np.zeros_like(x) for k, x in p.items()}
    v2 = {k: np.zeros_like(x) for k, x in p.items()}
    step = 0

    def bag_matrix(bags):
        seg = np.repeat(np.arange(len(bags)), [len(r[0]) for r in bags])
        x = np.zeros((len(seg), size), np.float32)
        k = 0
        for r in bags:
            for ids, n in zip(r[0], r[1], strict=True):
                if len(ids):
                    x[k, ids] = n / n.sum()
                k += 1
        return seg, x, np.concatenate([r[2] for r in bags])

    def forward(seg, x, dense, n):
        f = np.hstack([x @ p["emb"], dense])
        z = np.tanh(f @ p["w1"] + p["b1"])
        t, g = np.tanh(z @ p["v"]), sigmoid(z @ p["u"])
        s = (t * g) @ p["a"]
        top = np.full(n, -np.inf)
        np.maximum.at(top, seg, s)
        e = np.exp(s - top[seg])
        w = e / np.bincount(seg, e, n)[seg]
        bag = np.zeros((n, z.shape[1]))
        np.add.at(bag, seg, w[:, None] * z)
        return f, z, t, g, w, bag, bag @ p["c"] + p["b"][0]

    for epoch in range(epochs):
        for some in np.array_split(rng.permutation(len(fit)), max(1, len(fit) // batch)):
            bags = [fit[k] for k in some]
            seg, x, dense = bag_matrix(bags)
            n, y = len(bags), np.array([r[3] for r in bags], float)
            f, z, t, g, w, bag, out = forward(seg, x, dense, n)
            d = (sigmoid(out) - y) / n
            grad = {"c": bag.T @ d, "b": np.array([d.sum()])}
            dbag = d[:, None] * p["c"]
            dw = (z * dbag[seg]).sum(1)
            ds = w * (dw - np.bincount(seg, w * dw, n)[seg])
            dz = w[:, None] * dbag[seg]
            grad["a"] = (t * g).T @ ds
            dtg = ds[:, None] * p["a"]
            dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
            grad["v"], grad["u"] = z.T @ dt, z.T @ dg
            dz = dz + dt @ p["v"].T + dg @ p["u"].T
            dpre = dz * (1 - z * z)
            grad["w1"], grad["b1"] = f.T @ dpre, dpre.sum(0)
            grad["emb"] = x.T @ (dpre @ p["w1"].T)[:, :dim].astype(np.float32)
            step += 1
            lr = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step) / (1 + epoch / 4)
            for k, gk in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * gk
                v2[k] = 0.999 * v2[k] + 0.001 * gk * gk
                p[k] = (p[k] - lr * m[k] / (np.sqrt(v2[k]) + 1e-8)).astype(np.float32)
    raw = np.concatenate([forward(*bag_matrix(held[a : a + 64]), len(held[a : a + 64]))[-1] for a in range(0, len(held), 64)])
    slope, offset = platt(raw, np.array([r[3] for r in held], float))
    return Model(**{k: x for k, x in p.items() if k != "b"}, b=float(p["b"][0]), bits=bits, slope=slope, offset=offset)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", rows: int = 2000, bits: int = 12, max_chars: int = 50_000) -> Model:
    """Trains on a bounded sample: the ``rows`` lowest id hashes among labelled texts up to ``max_chars``, one text an id.

    Labels without an id or a label, and null texts, do not train; without rows of both labels the score is constant.
    """
    sample = labelled_sample(doc_view(docs, id_col, text_col), labels, label, rows, max_chars)

    def work(texts):
        out = {"ids": [], "n": [], "traits": []}
        for t in texts:
            ids, dense = featurize(t, bits)
            pairs = [np.unique(i, return_counts=True) for i in ids]
            out["ids"].append([a.tolist() for a, _ in pairs])
            out["n"].append([b.tolist() for _, b in pairs])
            out["traits"].append(dense.tolist())
        return out

    nested = lambda kind: T.ArrayType(T.ArrayType(kind))
    fields = [T.StructField("ids", nested(T.ShortType())), T.StructField("n", nested(T.IntegerType())), T.StructField("traits", nested(T.FloatType()))]
    got = map_texts(sample, work, fields, keep=("doc_id", "label")).toArrow().sort_by("doc_id")
    rows_ = []
    for i, n, t, y in zip(got["ids"], got["n"], got["traits"], got["label"].to_pylist(), strict=True):
        parts = lambda a, kind: [np.asarray(x.values.to_numpy(), kind) for x in a]
        rows_.append((parts(i, np.int64), parts(n, np.float32), np.array([x.values.to_numpy() for x in t], np.float32).reshape(-1, TRAITS), int(y > 0)))
    return train(rows_, bits)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted; one row for each input row, from the whole text.

    A null text scores as the empty one: a single passage without words. Rows that repeat a text score alike, null ids
    stay null, an empty table gives an empty one, and other columns are left out, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts):
        s = shared.value.scores(texts)
        return {"score": s.tolist(), "predicted": (s >= threshold).astype(int).tolist()}

    return map_texts(doc_view(docs, id_col, text_col), work, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def accepted(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores at or above the threshold."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(shared.value.scores(batch.column(text_col).to_pylist()) >= threshold))

    return docs.mapInArrow(run, docs.schema)
