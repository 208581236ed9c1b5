"""The pipeline's stages on small fixtures, against brute force: null and repeated ids, ties, long and empty texts, clashing columns."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from corpuscle.llm import bagminhash, bpe, mixing, pii, quality_mil
from corpuscle.llm.common import id_remainder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, body string, kept string, row string, text_hash_ string"


def docs(spark, rows):
    return spark.createDataFrame([(k, t, "en", f"s{(k or 0) % 2}", len(t or ""), "x", "x", "x", "x") for k, t in rows], SCHEMA)


def long(name, n=60):
    return " ".join(f"{name}{k}" for k in range(n))


def test_near_duplicates_lose_no_text(spark):
    a, b = long("a"), long("b")
    near = b.replace("b30", "changed")
    rows = [(3, a), (5, a), (5, b), (7, near), (3, a), (None, near), (None, long("c")), (None, long("c")), (8, None), (8, None), (9, ""), (4, "x" * 100_000)]
    out = P.near_duplicates(spark, docs(spark, rows), None)
    assert out.columns == list(P.COLUMNS)
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert got == Counter({(3, a): 1, (5, b): 1, (None, long("c")): 1, (8, None): 2, (9, ""): 1, (4, "x" * 100_000): 1})


def test_personal_data_masks_whole_texts(spark):
    mails = [f"write to p{k}@site{k}.example.com now" for k in range(4)]
    rows = [(k, t) for k, t in enumerate([*mails, "write to MB445566 now", None, "", "at 10.0.0.1 " * 3000])]
    got = {r["doc_id"]: r for r in P.personal_data(spark, docs(spark, rows), None).collect()}
    assert [got[k]["text"] for k in range(5)] == ["write to [EMAIL] now"] * 4 + ["write to [CONTEXT] now"]
    assert [got[k]["text"] for k in (5, 6)] == ["", ""] and got[7]["text"] == "at [IP] " * 3000
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


@pytest.mark.parametrize("name,stage", P.STAGES)
def test_stages_of_no_rows(spark, name, stage):
    assert stage(spark, docs(spark, []), "/root/testdata/sf0.001").count() == 0


def test_run_against_brute_force(spark):
    """Each stage's decisions, from plain Python over collected rows."""
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    rows = table.collect()
    model = quality_mil.fit(table, spark.read.parquet(f"{sf}/labels.parquet").filter(id_remainder("doc_id", 5) != 0))
    rows = [r for r, s in zip(rows, model.scores([r["text"] for r in rows]), strict=True) if s >= 0.3]
    bags = [bagminhash.bag(bagminhash.words_of(r["text"])) for r in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bagminhash.similarity(bags[i], bags[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    best = {}
    for i, r in enumerate(rows):
        best[root[i]] = min(best.get(root[i], r["doc_id"]), r["doc_id"])
    rows = [r for i, r in enumerate(rows) if not len(bags[i][0]) or best[root[i]] == r["doc_id"]]
    kept = spark.createDataFrame(rows, table.schema)
    spans = {r["doc_id"]: r["spans"] for r in pii.find(kept).collect()}
    wanted = {}
    for r in rows:
        text, at = "", 0
        for s in spans[r["doc_id"]]:
            if s["start"] >= at:
                text += r["text"][at : s["start"]] + f"[{pii.KINDS[s['kind']].upper()}]"
            at = max(at, s["end"])
        wanted[r["doc_id"]] = text + (r["text"] or "")[at:]
    clean = spark.createDataFrame([(r["doc_id"], wanted[r["doc_id"]], r["lang"], r["source"]) for r in rows], "doc_id long, text string, lang string, source string")
    drawn = {r["doc_id"] for r in mixing.mix(clean).filter("mix_sampled").collect()}
    tok = bpe.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = {(k, len(i := tok.encode_ordinary(wanted[k])), digest(",".join(map(str, i)).encode()), digest(wanted[k].encode())) for k in drawn}
    got = P.run(spark, sf).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 50
    assert table.filter(F.col("doc_id").isin(sorted(drawn))).count() == len(drawn)
