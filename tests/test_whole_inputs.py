"""Queries over whole inputs, against brute force."""

import math
import re

import duckdb
import numpy as np
import pandas as pd
import pytest

from corpuscle.operators import stats
from corpuscle.plans import catalog, measure_queries, stats_queries

SF = "/root/testdata/sf0.001"


def table(name):
    return pd.read_parquet(f"{SF}/{name}.parquet")


def test_token_chars_of_whole_texts(spark):
    wanted = []
    for doc_id, text in table("documents")[["doc_id", "text"]].itertuples(index=False):
        total = seen = 0
        for k, w in enumerate(re.findall(r"\S+", text or "", re.ASCII)):
            total += len(w)
            end = total - k % 3 * 2
            wanted.append((doc_id, k, max(0, end - seen)))
            seen = max(seen, end)
    got = catalog.queries()["token_chars"](spark, SF).toPandas()
    assert sorted(got[["doc_id", "pos", "chars"]].itertuples(index=False, name=None)) == sorted(wanted)


def test_mcnemar_of_all_labels(spark):
    labels = table("labels")
    a = int(((labels["quality"] == 1) & (labels["toxic"] == 1)).sum())
    b = int(((labels["quality"] == 0) & (labels["toxic"] == 0)).sum())
    exact = lambda a, b: min(1.0, 2 * (sum(math.comb(a + b, i) for i in range(min(a, b) + 1)) / 2 ** (a + b)))
    got = catalog.queries()["mcnemar"](spark, SF).first()
    assert (got["a_only"], got["b_only"], got["p_value"]) == (a, b, pytest.approx(exact(a, b), abs=1e-9))
    assert stats.mcnemar(1500, 1600) == pytest.approx(exact(1500, 1600), rel=1e-9)


def test_bootstraps_of_10000_resamples(spark):
    p = measure_queries.both(spark, SF).select("i", "chars", "nats_a", "nats_b").toPandas()
    domains = table("documents").groupby("lang").size().to_dict()
    got = stats_queries.by_domain(spark, SF).toPandas()
    assert got.groupby("domain").size().to_dict() == dict.fromkeys(domains, 10_000)
    assert got.groupby("domain")["b"].nunique().eq(10_000).all()
    # Every resample takes as many rows as there are, also from several buckets.
    ones = stats.resampled(spark.createDataFrame(p.assign(one=1.0)), [], 10_000, {"one": "n"}, bucket_rows=30).toPandas()
    assert len(ones) == 10_000 and ones["n"].eq(len(p)).all()
    # A bootstrap by another generator has the same interval, up to the draw.
    rng = np.random.default_rng(1)
    a, b, c = (p[x].to_numpy(float) for x in ("nats_a", "nats_b", "chars"))
    i = rng.integers(0, len(p), (10_000, len(p)))
    brute = np.percentile((a[i].sum(1) - b[i].sum(1)) / c[i].sum(1) / math.log(2), [2.5, 50, 97.5])
    several = stats.resampled(spark.createDataFrame(p), [], 10_000, {"nats_a": "a", "nats_b": "b_", "chars": "c"}, bucket_rows=30).toPandas()
    parts = np.percentile((several["a"] - several["b_"]) / several["c"] / math.log(2), [2.5, 50, 97.5])
    whole = catalog.queries()["paired_bootstrap"](spark, SF).first()
    for x in (parts, (whole["lo"], whole["median"], whole["hi"])):
        assert x == pytest.approx(brute, abs=0.05 * (brute[2] - brute[0]))


def test_clean_markers_of_whole_texts(spark):
    def clean(t):
        t = ("  " + t.replace(" ", "  ") + " [title] x [a] [b]c ").strip(" ").replace(" [title]", ". ")
        return re.sub(r"\[.*?\]", "", t).replace("  ", " ").strip(" ")

    got = dict(catalog.queries()["clean_markers"](spark, SF).select("doc_id", "text").collect())
    wanted = {k: None if t is None else clean(t) for k, t in table("documents")[["doc_id", "text"]].itertuples(index=False)}
    assert got == wanted


def test_html_to_text_of_odd_pages(spark, tmp_path):
    pages = [
        "<p>a &amp;&amp &ampx; b&amp</p>", "&eacute; &#233; &AMP; &amp;lt; &nbsp;&nbsp x", "a\u00a0\u2003b\x0b c\x1c<p>\u3000d\x85 </p>", '<a title="x<p>y">z</a> <a title="<br>', "<!-- open <p>x</p> y", "<!--a--><!-- b > c",
        "<SCRIPT a='>'>x</script >y<style>never <p>closed", "<p\x0bclass=a>v</p><x\x0by>w", "<\u017fcript>k</\u017fcript>l<\u212a>m", "1 < 2 <b\nc>\r\n<li/>t<br / >u", "", " ", None, "<>< p></ p><!x><?y>",
    ]
    d = pd.DataFrame({"page_id": range(len(pages)), "html": pages})
    d.to_parquet(tmp_path / "pages.parquet")
    got = dict(map(tuple, catalog.queries()["html_to_text"](spark, f"file://{tmp_path}").collect()))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet'")
    assert got == dict(c.sql(catalog.oracle_sql()["html_to_text"]).fetchall())
