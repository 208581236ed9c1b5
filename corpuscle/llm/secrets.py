"""Secret scan: fixed rules, and a character convolutional network over every candidate and its context.

Candidates are runs of key characters, of any length. A small network (embedding,
convolution, max pooling over the whole candidate and over the characters on
either side of it) in numpy is trained on labelled findings that are generated
here from a seed: keys of many formats against words, numbers, paths, versions
and identifiers, each in a context. Its scores are calibrated by Platt's method,
and the threshold is the highest that keeps the wanted recall on findings kept aside.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import doc_view, map_texts, platt, sigmoid

#: Letters of the names in either case, ASCII only.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: The leftmost match starts where its run does, so asking for 16 or more equals dropping the shorter runs.
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "neural")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{8,}")

#: Characters that are seen on either side, and characters of a candidate that are convolved at a time.
SIDE, SEGMENT, WIDTH = 24, 48, 5


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's place, end) of the fixed rules, in order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs of eight key characters or more, without marks at their ends, that mix at least two of: lower case, upper case after the first letter, digits."""
    out = []
    for m in CANDIDATE.finditer(text):
        s = m.group().strip(".=-/_+")
        if len(s) < 8 or s.isalpha() and s[1:].islower():
            continue
        if (any(c.isdigit() for c in s) + any(c.islower() for c in s) + any(c.isupper() for c in s[1:])) >= 2:
            at = m.start() + len(m.group()) - len(m.group().lstrip(".=-/_+"))
            out.append((at, at + len(s)))
    return out


def codes(text: str) -> np.ndarray:
    """0 pads; ASCII characters have codes of their own, the rest share one."""
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32), 127).astype(np.int64)


def sides(text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The characters before and after a candidate, the nearest ones at the end and at the start."""
    return codes(text[max(0, start - SIDE) : start].rjust(SIDE, "\0")), codes(text[end : end + SIDE].ljust(SIDE, "\0"))


def segments(text: str, start: int, end: int, size: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """The whole candidate as rows of ``size`` places of the convolution, and how many of each row's places it has."""
    places = max(1, end - start - WIDTH + 1)
    rows = -(-places // size)
    padded = np.zeros(rows * size + WIDTH - 1, np.int64)
    padded[: end - start] = codes(text[start:end])
    x = np.lib.stride_tricks.sliding_window_view(padded, size + WIDTH - 1)[::size]
    return x, np.minimum(size, places - size * np.arange(rows))


@dataclass
class Network:
    emb: np.ndarray  # 128 x e
    conv: np.ndarray  # (WIDTH * e) x f
    bias: np.ndarray
    out: np.ndarray  # 4f + 2
    out_bias: float
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 0.5

    def raw(self, found: list[tuple[str, int, int]]) -> np.ndarray:
        """The score of each candidate, from all of its characters and both sides."""
        p = vars(self)
        left, right = (np.stack(x) for x in zip(*(sides(*f) for f in found), strict=True))
        parts = [segments(*f) for f in found]
        x, size = (np.concatenate(y) for y in zip(*parts, strict=True))
        first = np.concatenate([[0], np.cumsum([len(s) for _, s in parts])[:-1]])
        peak, total = [], []
        for a in range(0, len(x), 512):
            h = convolve(p, x[a : a + 512])[1] * (np.arange(SEGMENT) < size[a : a + 512, None])[:, :, None]
            peak.append(h.max(1))
            total.append(h.sum(1))
        peak, total = np.maximum.reduceat(np.concatenate(peak), first), np.add.reduceat(np.concatenate(total), first)
        around = [convolve(p, s)[1].max(1) for s in (left, right)]
        pooled = np.hstack([peak, *around, total / np.add.reduceat(size, first)[:, None], np.stack([shape(*f) for f in found])])
        return pooled @ self.out + self.out_bias

    def probability(self, found: list[tuple[str, int, int]], batch: int = 256) -> np.ndarray:
        got = [self.raw(found[a : a + batch]) for a in range(0, len(found), batch)]
        return sigmoid(self.slope * np.concatenate(got) + self.offset) if got else np.zeros(0)


def shape(text: str, start: int, end: int) -> np.ndarray:
    """Length, and bits of entropy a character."""
    _, n = np.unique(codes(text[start:end]), return_counts=True)
    q = n / n.sum()
    return np.array([min(end - start, 100) / 50.0, float(-(q * np.log2(q)).sum()) / 4.0])


def convolve(p: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows of the embedded characters, and the filters' answers at each place."""
    e = p["emb"][x]
    n, length, d = e.shape
    cols = np.lib.stride_tricks.sliding_window_view(e, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(n, length - WIDTH + 1, WIDTH * d)
    return cols, np.maximum(cols @ p["conv"] + p["bias"], 0)


def findings(n: int, seed: int) -> list[tuple[str, int, int, int]]:
    """Labelled findings from a seed: (text, start, end, label), as many secrets as others; start and end are those of the candidate that the scan would see."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    syllables = "an be chi de er fa gen ho in ka le mo nu on pre re sta ti un ver wa zu tion ing ment keit ción aux ness able".split()
    hexa, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    run = lambda alphabet, a, b: "".join(pick(alphabet) for _ in range(int(rng.integers(a, b))))
    word = lambda a=1, b=4: "".join(pick(syllables) for _ in range(int(rng.integers(a, b))))
    prose = lambda: " ".join(word() for _ in range(int(rng.integers(1, 6))))

    def secret():
        value = pick([
            lambda: run(hexa, 32, 65), lambda: run(alnum, 20, 50), lambda: run(alnum, 10, 20), lambda: run(alnum, 60, 140), lambda: run(alnum + "+/", 40, 41) + pick(["", "="]),
            lambda: "ghp_" + run(alnum, 36, 37), lambda: "sk_live_" + run(alnum, 24, 25), lambda: "xoxb-" + run("0123456789", 11, 13) + "-" + run(alnum, 24, 25),
            lambda: "eyJ" + run(alnum + "_-", 20, 40) + "." + run(alnum + "_-", 30, 60), lambda: "AKIA" + run(alnum[:26] + "0123456789", 16, 17), lambda: "AIza" + run(alnum + "_-", 35, 36),
        ])()
        before = pick(["password = \"", "token: ", "api_key=", "Authorization: Bearer ", "secret=", "key = '", "export KEY=", prose() + " ", "pass ", "auth ", "client_secret: ", "token = \""])
        return before, value

    def other():
        value = pick([
            lambda: "".join(pick(syllables) for _ in range(int(rng.integers(6, 12)))), lambda: "".join(word().capitalize() for _ in range(int(rng.integers(3, 7)))),
            lambda: run("0123456789", 8, 20), lambda: word(1, 3) + run("0123456789", 2, 5), lambda: word(2, 3).capitalize() + "-" + word(2, 3).capitalize(), lambda: "/".join(word(1, 3) for _ in range(int(rng.integers(3, 8)))) + pick([".html", "/2024", ".py", "/v2"]),
            lambda: f"{word()}.{run('0123456789', 2, 3)}.mail{run('0123456789', 1, 2)}.example.com", lambda: "_".join(word() for _ in range(int(rng.integers(2, 6)))) + pick(["", "_2", "_id"]),
            lambda: "-".join([run("0123456789", 4, 5), run("0123456789", 2, 3), run("0123456789", 2, 3), run("0123456789", 6, 9)]), lambda: "v" + ".".join(run("0123456789", 1, 4) for _ in range(6)) + "-beta.release",
            lambda: word(3, 6) + run("0123456789", 1, 5) + word(2, 4), lambda: "=" * 3 + word(3, 6).upper() + "-" + word(2, 4),
        ])()
        before = pick([prose() + " ", prose() + " ", "see ", "https://", "id ", "page: ", "ref=", "the ", "", "file = ", "title: "])
        return before, value

    after = lambda: pick(["", "\"", "'", " ", "\n", ", ", "."]) + pick([" ", "\n"]) + prose()
    out = []
    while len(out) < n:
        label = len(out) % 2
        before, value = secret() if label else other()
        lead = prose() + pick([" ", "\n", ". "])
        text, at = lead + before + value + after(), len(lead + before)
        seen = [c for c in candidates(text) if c[0] < at + len(value) and at < c[1]]
        if len(seen) == 1:
            out.append((text, *seen[0], label))
    return out


def train(rows: list[tuple[str, int, int, int]], dim: int = 8, filters: int = 24, epochs: int = 6, batch: int = 64, rate: float = 0.01, recall: float = 0.99, seed: int = 3) -> Network:
    """Every fourth finding is kept aside: half of these calibrate the score, half set the threshold."""
    rng, longest = np.random.default_rng(seed), max(r[2] - r[1] for r in rows)
    left, right = (np.stack(x) for x in zip(*(sides(*r[:3]) for r in rows), strict=True))
    inner, size = (np.concatenate(x) for x in zip(*(segments(*r[:3], size=longest) for r in rows), strict=True))
    extra, y = np.stack([shape(*r[:3]) for r in rows]), np.array([r[3] for r in rows], float)
    place = np.arange(len(rows)) // 2
    fit, cal, held = np.flatnonzero(place % 4 > 0), np.flatnonzero(place % 8 == 0), np.flatnonzero(place % 8 == 4)
    p = {"emb": rng.normal(0, 0.3, (128, dim)), "conv": rng.normal(0, 1 / np.sqrt(WIDTH * dim), (WIDTH * dim, filters)), "bias": np.zeros(filters), "out": rng.normal(0, 0.1, 4 * filters + 2), "out_bias": np.zeros(1)}
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    f = filters
    for _ in range(epochs):
        order = rng.permutation(fit)
        for a in range(0, len(order), batch):
            k = order[a : a + batch]
            n, ks = len(k), np.arange(f)[None]
            rows_ = np.arange(n)[:, None]
            sets = [inner[k][:, : max(SIDE, int(size[k].max()) + WIDTH - 1)], left[k], right[k]]
            cols, h = map(list, zip(*(convolve(p, x) for x in sets), strict=True))
            inside = np.arange(h[0].shape[1]) < size[k, None]
            h[0] = h[0] * inside[:, :, None]
            tops = [x.argmax(1) for x in h]
            pooled = np.hstack([*(x[rows_, t, ks] for x, t in zip(h, tops, strict=True)), h[0].sum(1) / size[k, None], extra[k]])
            d = (sigmoid(pooled @ p["out"] + p["out_bias"]) - y[k]) / n
            back = d[:, None] * p["out"]
            grad = {"out": pooled.T @ d, "out_bias": np.array([d.sum()]), "emb": np.zeros_like(p["emb"]), "conv": np.zeros_like(p["conv"]), "bias": np.zeros(f)}
            for j, x in enumerate(sets):
                dh = np.zeros_like(h[j])
                dh[rows_, tops[j], ks] = back[:, j * f : (j + 1) * f]
                if j == 0:
                    dh += (back[:, 3 * f : 4 * f] / size[k, None])[:, None, :] * inside[:, :, None]
                dh *= h[j] > 0
                flat = dh.reshape(-1, f)
                grad["conv"] += cols[j].reshape(len(flat), -1).T @ flat
                grad["bias"] += flat.sum(0)
                dcols = (flat @ p["conv"].T).reshape(n, dh.shape[1], WIDTH, dim)
                for w in range(WIDTH):
                    np.add.at(grad["emb"], x[:, w : w + dh.shape[1]].ravel(), dcols[:, :, w].reshape(-1, dim))
            step += 1
            for name, g in grad.items():
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.999 * v[name] + 0.001 * g * g
                p[name] = p[name] - rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step) * m[name] / (np.sqrt(v[name]) + 1e-8)
    net = Network(p["emb"], p["conv"], p["bias"], p["out"], float(p["out_bias"][0]))
    net.slope, net.offset = platt(net.raw([rows[i][:3] for i in cal]), y[cal])
    score = net.probability([rows[i][:3] for i in held if y[i] > 0])
    # The highest threshold that keeps the recall.
    net.threshold = float(np.sort(score)[int((1 - recall) * len(score))]) if len(score) else 0.5
    return net


def scan(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans: for each input row the found spans as an array of (start, kind, end, score), by start, then kind.

    Places are code points, the end is exclusive. Every candidate is scored by the network, whole and with its context.
    A base span has the score of the candidates that it touches, the highest, or 1 where it touches none; a neural
    span is a candidate at or above the threshold that no base span covers. A null text is the empty text. Rows that
    repeat a text give the same spans, null ids stay null, an empty table gives an empty one, and other columns are left
    out, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def work(texts):
        net = shared.value
        texts = [t or "" for t in texts]
        runs = [candidates(t) for t in texts]
        scores = iter(net.probability([(t, a, b) for t, r in zip(texts, runs, strict=True) for a, b in r]))
        return {"spans": [merged(base_spans(t), [(a, b, float(next(scores))) for a, b in r], net.threshold) for t, r in zip(texts, runs, strict=True)]}

    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])
    return map_texts(doc_view(docs, id_col, text_col), work, [T.StructField("spans", T.ArrayType(span))])


def merged(base: list[tuple[int, int, int]], scored: list[tuple[int, int, float]], threshold: float) -> list[dict]:
    """Base spans with their scores, and the scored runs (apart from each other) that are neural spans; both lists are in order."""
    starts, ends = [a for a, _, _ in scored], [b for _, b, _ in scored]
    touched = [scored[bisect_right(ends, a) : bisect_left(starts, b)] for a, _, b in base]
    out = [(a, kind, b, max((p for _, _, p in t), default=1.0)) for (a, kind, b), t in zip(base, touched, strict=True)]
    first, reach = [a for a, _, _ in base], [0, *accumulate((b for _, _, b in base), max)]
    out += [(a, 3, b, p) for a, b, p in scored if p >= threshold and reach[bisect_right(first, a)] < b]
    return [{"start": a, "kind": KINDS[kind], "end": b, "score": p} for a, kind, b, p in sorted(out)]


def joined(spans):
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def digest(found: DataFrame) -> DataFrame:
    """The counts, the digest of the base spans and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"] != "neural")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


@lru_cache
def production_network() -> Network:
    """The network of the query: trained once in a process, always on the same findings."""
    return train(findings(4000, seed=1))
