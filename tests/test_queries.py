"""Every query of the library against its DuckDB form."""

from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
import regex

from corpuscle.functions import text as X
from corpuscle.functions.text import byte_alphabet
from corpuscle.operators import bpe
from corpuscle.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return f"[{', '.join(map(plain, v))}]"
    return "null" if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(plain, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, duck, name):
    assert rows(catalog.queries()[name](spark, SF).toPandas()) == rows(duck.sql(catalog.oracle_sql()[name]).df())


def merges_of(texts, pattern, n, known=(), rules=False):
    """A naive trainer: every round counts all pairs anew."""
    names = sorted(byte_alphabet().values())
    ids = {c: k for k, c in enumerate(names)}
    for a, b in known:
        ids.setdefault(a + b, len(ids))
    words = Counter(m for t in texts for m in isolated(pattern, t))
    words = [(bpe.encode_symbols(bpe.to_symbols(w), {m: k for k, m in enumerate(known)}), f) for w, f in words.items()]
    out, banned, aim = [], set(), len(ids) + n
    while len(ids) < aim:
        counts = Counter()
        for s, f in words:
            for pair in zip(s, s[1:], strict=False):
                counts[pair] += f
        left = [p for p in counts if p not in banned]
        if not left:
            break
        best = min(left, key=lambda p: (-counts[p], ids[p[0]], ids[p[1]]))
        token = "".join(best)
        if rules and (":Ġ" in token or sum(map(bool, token.split("Ġ"))) > 4):
            banned.add(best)
            continue
        out.append(best)
        ids.setdefault(token, len(ids))
        words = [(bpe.merge_list(s, *best, token), f) for s, f in words]
    return ids, out


def isolated(pattern, text):
    at = 0
    for m in regex.finditer(pattern, text):
        yield from [text[at : m.start()]] * (m.start() > at) + [m.group()] * (m.end() > m.start())
        at = m.end()
    yield from [text[at:]] * (at < len(text))


@pytest.fixture(scope="module")
def learnt():
    return merges_of(TEXTS, X.STAGE1, 60)


TEXTS = [t or "" for t in pd.read_parquet(f"{SF}/documents.parquet")["text"]]
LINES = [line for t in TEXTS for line in t.split("\n")]


def got(spark, name):
    return catalog.queries()[name](spark, SF).toPandas()


def table(merges, first=0):
    return [(first + k, a, b) for k, (a, b) in enumerate(merges)]


def sorted_rows(df):
    return sorted(df.itertuples(index=False, name=None))


def test_trainers(spark, learnt):
    assert sorted_rows(got(spark, "bpe_train")) == table(learnt[1])
    ids, merges = learnt[0], learnt[1][:40]
    assert sorted_rows(got(spark, "superbpe_train")) == table(merges_of(LINES, X.STAGE2, 20, merges, rules=True)[1], 40)
    first = learnt[1][: round(0.9 * 316) - 256]
    assert sorted_rows(got(spark, "super_train")) == sorted(merges_of(LINES, X.STAGE2, 316 - 256 - len(first), first, rules=True)[0].items())
    runs = [r for t in TEXTS for r in regex.findall(X.WORD_RUN, t)]
    assert sorted_rows(got(spark, "retrofit_learn")) == table(merges_of(runs, X.WORD_RUN, 20, merges)[1], 40)


def test_encoders(spark, learnt):
    rank = {m: k for k, m in enumerate(learnt[1])}
    seen = {}

    def encode(text, rank=rank):
        pieces = [*isolated(X.STAGE1, text)]
        return [s for p in pieces for s in seen.setdefault((p, len(rank)), bpe.encode_symbols(bpe.to_symbols(p), rank))]

    d = pd.read_parquet(f"{SF}/documents.parquet")
    tokens = {k: encode(t or "") for k, t in zip(d["doc_id"], d["text"], strict=True)}
    assert dict(sorted_rows(got(spark, "bpe_encode"))) == {k: len(t) for k, t in tokens.items()}
    assert got(spark, "roundtrip")["same"].all() and len(got(spark, "roundtrip")) == len(d)
    base = {m: k for m, k in rank.items() if k < 30}
    pieces = {r.token: list(r.pieces) for r in got(spark, "token_pieces").itertuples()}
    assert set(pieces) == {a + b for a, b in learnt[1][30:]} and all("".join(p) == t and bpe.encode_symbols(list(t), base) == p for t, p in pieces.items())
    uses = Counter(t for ts in tokens.values() for t in ts)
    new = got(spark, "retrofit_tokens").set_index("token")
    assert dict(new["uses"]) == {a + b: uses[a + b] for a, b in learnt[1][30:]} and (new["whole"] | ~new["reachable"]).all()
    report = got(spark, "retrofit_report").set_index("lang")
    for lang, part in d.groupby("lang"):
        n_base, n_new = (sum(len(encode(t, r)) for t in part["text"]) for r in (base, rank))
        assert report.loc[lang, "token_change"] == pytest.approx(n_new / n_base - 1, abs=1e-6)
        assert report.loc[lang, "round_trips"] == len(part)


def report_of_new(d, merges):
    """lang -> docs, chars, new_tokens, whole, partial, reachable, used, by encoding every text."""
    rank, back, seen = {m: k for k, m in enumerate(merges)}, {c: b for b, c in byte_alphabet().items()}, {}

    def encode(text):
        return [s for p in isolated(X.STAGE1, text) for s in seen.setdefault(p, bpe.encode_symbols(bpe.to_symbols(p), rank))]

    new, whole = {a + b for a, b in merges} - {*back, *(a + b for a, b in merges[:30])}, {}
    for t in new:
        try:
            whole[t] = bytes(back[c] for c in t).decode()
        except UnicodeDecodeError:
            pass
    reachable = sum(encode(text) == [t] for t, text in whole.items())
    out = {}
    for lang, part in d.groupby("lang", dropna=False):
        texts = [t or "" for t in part["text"]]
        out[lang if isinstance(lang, str) else None] = (len(texts), sum(map(len, texts)), len(new), len(whole), len(new) - len(whole), reachable, len(new & {t for x in texts for t in encode(x)}))
    return out


REPORT = ["docs", "chars", "new_tokens", "whole", "partial", "reachable", "used"]


def test_retrofit_report_counts_new_tokens(spark, learnt):
    report = got(spark, "retrofit_report")
    want = report_of_new(pd.read_parquet(f"{SF}/documents.parquet"), learnt[1])
    assert dict(zip(report["lang"], map(tuple, report[REPORT].astype(int).to_numpy().tolist()), strict=True)) == want


def test_retrofit_report_of_odd_texts(spark, tmp_path):
    # Common words take the base's merges; then come parts of characters and a token that the split would cut.
    texts = [("a", "abcdefghijklmnopqrstuvwxyzabcdefg " * 40), ("a", "xx.\n/yy.\n/ " * 15), ("a", "ệ ở ữ 🎉 " * 9), ("b", "ệ"), ("b", "xx.\n/"), ("b", ""), ("none", ""), (None, "defg ở\n/"), ("b", "\n/" * 5)]
    d = pd.DataFrame(texts, columns=["lang", "text"]).assign(doc_id=range(len(texts)))
    d.to_parquet(tmp_path / "documents.parquet")
    rows = {r["lang"]: r for r in catalog.queries()["retrofit_report"](spark, f"file://{tmp_path}").collect()}
    want = report_of_new(d, merges_of([t for _, t in texts], X.STAGE1, 60)[1])
    assert {k: tuple(r[c] for c in REPORT) for k, r in rows.items()} == want
    _, _, new, whole, partial, reachable, used = want["a"]
    assert 0 < partial < new and 0 < reachable < whole and want["b"][-1] < used
    assert rows["none"]["token_change"] is None and rows["none"]["round_trips"] == rows["none"]["identical"] == 1


@pytest.mark.parametrize("name,pattern", [("pretokenize", X.STAGE1), ("pretokenize_super", X.STAGE2)])
def test_pieces(spark, name, pattern):
    d = pd.read_parquet(f"{SF}/documents.parquet")
    assert dict(sorted_rows(got(spark, name))) == {k: len([*isolated(pattern, t)]) for k, t in zip(d["doc_id"], d["text"], strict=True)}


def test_every_query_has_sql_or_a_test_here():
    tested = {"bpe_train", "superbpe_train", "super_train", "retrofit_learn", "bpe_encode", "roundtrip", "token_pieces", "retrofit_tokens", "retrofit_report", "pretokenize", "pretokenize_super"}
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == tested
