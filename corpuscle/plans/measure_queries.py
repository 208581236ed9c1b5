"""Queries of measures, pairing, multiple choice and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import text as X
from corpuscle.operators import measure as M
from corpuscle.operators import scoring as S
from corpuscle.sources import io

from .catalog import query

#: Two deterministic runs over the documents, as DuckDB sees them.
SCORES = r"""sc AS (SELECT run, doc_id AS i, lang AS domain, sha256(text) AS digest, CAST(length(text) AS BIGINT) AS chars, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS BIGINT) AS tokens FROM documents, (VALUES ('a'), ('b')) r(run)),
s AS (SELECT *, CASE WHEN run = 'a' THEN (chars * 7 + tokens * 2) / CAST(10 AS DOUBLE) ELSE (chars * 69 + tokens * 25 + (i % 5) * 150) / CAST(100 AS DOUBLE) END AS nats FROM sc)"""


def scores(spark, sf_dir) -> DataFrame:
    d = io.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("i"), F.col("lang").alias("domain"), X.digest(F.col("text")).alias("digest"), F.length("text").cast("long").alias("chars"), X.count_matches(F.col("text"), X.WORDS).alias("tokens"))
    a = (F.col("chars") * 7 + F.col("tokens") * 2) / 10
    b = (F.col("chars") * 69 + F.col("tokens") * 25 + F.col("i") % 5 * 150) / 100
    run = F.explode(F.array(F.struct(F.lit("a").alias("run"), a.alias("nats")), F.struct(F.lit("b").alias("run"), b.alias("nats"))))
    return d.select("*", run.alias("r")).select("r.run", "i", "domain", "digest", "chars", "tokens", "r.nats")


def both(spark, sf_dir) -> DataFrame:
    """Runs a and b paired by document."""
    s = scores(spark, sf_dir)
    return M.paired(s.filter("run = 'a'"), s.filter("run = 'b'").drop("domain"))


PAIRS = SCORES + ", p AS (SELECT x.i, x.domain, x.digest, x.chars, x.nats AS nats_a, y.nats AS nats_b FROM s x JOIN s y ON x.i = y.i AND x.run = 'a' AND y.run = 'b')"


@query(f"WITH {SCORES} SELECT run, domain, round(sum(nats) / (ln(CAST(2 AS DOUBLE)) * sum(chars)), 6) AS bpc FROM s GROUP BY run, domain")
def bpc_by_group(spark, sf_dir):
    return scores(spark, sf_dir).groupBy("run", "domain").agg(F.round(X.bpc(F.col("nats"), F.col("chars")), 6).alias("bpc"))


@query(f"WITH {SCORES} SELECT run, domain, round(sum(nats) / (ln(CAST(2 AS DOUBLE)) * sum(chars)), 6) AS bpc, round(sum(chars) / sum(tokens), 6) AS chars_per_token FROM s GROUP BY run, domain")
def lm_summary(spark, sf_dir):
    return M.lm_summary(scores(spark, sf_dir), "run", "domain").select("run", "domain", F.round("bpc", 6).alias("bpc"), F.round("chars_per_token", 6).alias("chars_per_token"))


@query(f"WITH {PAIRS} SELECT i, digest, chars, nats_a, nats_b FROM p")
def paired_docs(spark, sf_dir):
    return both(spark, sf_dir)


@query(f"WITH {SCORES}, n AS (SELECT i, run, CASE WHEN (i + CASE WHEN run = 'a' THEN 0 ELSE 3 END) % 7 = 0 THEN NULL ELSE nats END AS nats FROM s) SELECT i FROM n GROUP BY i HAVING count(nats) = 2")
def common_docs(spark, sf_dir):
    hole = (F.col("i") + F.when(F.col("run") == "a", 0).otherwise(3)) % 7 == 0
    return M.common_docs(scores(spark, sf_dir).withColumn("nats", F.when(~hole, F.col("nats"))), "run", "i", "nats")


@query(f"WITH {PAIRS} SELECT domain, round(sum(nats_a) / (ln(CAST(2 AS DOUBLE)) * sum(chars)) - sum(nats_b) / (ln(CAST(2 AS DOUBLE)) * sum(chars)), 6) AS diff FROM p GROUP BY domain")
def pairwise_diff(spark, sf_dir):
    wide = scores(spark, sf_dir).groupBy("domain").pivot("run", ["a", "b"]).agg(X.bpc(F.col("nats"), F.col("chars")))
    return wide.select("domain", F.round(F.col("a") - F.col("b"), 6).alias("diff"))


@query("""WITH r AS (SELECT lang, CAST(sum(n_chars) AS DOUBLE) + CASE WHEN lang = 'de' THEN 1 ELSE 0 END AS recorded FROM documents GROUP BY lang), g AS (SELECT lang, CAST(sum(length(text)) AS DOUBLE) AS made FROM documents GROUP BY lang)
SELECT lang, abs(made - recorded) <= CAST(1e-12 AS DOUBLE) * greatest(abs(made), abs(recorded)) AS holds FROM g JOIN r USING (lang)""")
def verify_aggregates(spark, sf_dir):
    # The recorded sums are those of the stored column, wrong by one character for one language; the texts are measured anew.
    d = io.table(spark, sf_dir, "documents")
    recorded = d.groupBy("lang").agg((F.sum("n_chars").cast("double") + F.when(F.col("lang") == "de", 1).otherwise(0)).alias("chars"))
    return M.verify(d.groupBy("lang").agg(F.sum(F.length("text")).cast("double").alias("chars")), recorded, "lang", "chars")


GOLD = "o AS (SELECT item_id AS i, CAST(item_id % 3 AS BIGINT) AS gold, length(text) % 3 = item_id % 3 AS a, item_id % 2 = 0 AS b FROM benchmark)"


@query(f"WITH {GOLD} SELECT i, gold, a AS correct_a, b AS correct_b FROM o")
def paired_labels(spark, sf_dir):
    # Two sets of outcomes over the same items, each with the gold answers that it was scored against.
    items = io.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("i"), (F.col("item_id") % 3).cast("long").alias("gold"), F.length("text").alias("n"))
    a, b = items.select("i", "gold", (F.col("n") % 3 == F.col("gold")).alias("correct")), items.select("i", "gold", (F.col("i") % 2 == 0).alias("correct"))
    return M.paired(a, b, check=("gold",), value="correct")


LOG = "l AS (SELECT event_id - 1 AS step, value AS loss, sum(CAST(round(abs(value)) AS BIGINT)) OVER (ORDER BY event_id) AS tokens FROM events)"


def log(spark, sf_dir) -> DataFrame:
    from corpuscle.operators.corpus import running_sum

    e = io.table(spark, sf_dir, "events")
    return running_sum(e, "event_id", F.round(F.abs("value")).cast("long"), "tokens").select((F.col("event_id") - 1).alias("step"), F.col("value").alias("loss"), "tokens")


@query(f"WITH {LOG}, d AS (SELECT step AS done FROM l WHERE step % 100 = 0) SELECT done, CAST(coalesce(l.tokens, 0) AS BIGINT) AS tokens FROM d LEFT JOIN l ON d.done = l.step + 1")
def curve_join(spark, sf_dir):
    train = log(spark, sf_dir)
    dev = train.filter("step % 100 = 0").select(F.col("step").alias("done"))
    return dev.join(train.withColumn("done", F.col("step") + 1), "done", "left").select("done", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))


@query(f"WITH {LOG} SELECT max(tokens)::BIGINT AS tokens, arg_min(loss, step) AS first_loss, arg_max(loss, step) AS last_loss, max(step) + 1 AS steps, count(*) FILTER (NOT isfinite(loss)) AS bad FROM l")
def log_summary(spark, sf_dir):
    bad = F.col("loss").isNull() | F.isnan("loss") | (F.abs("loss") == float("inf"))
    return log(spark, sf_dir).agg(F.max("tokens").alias("tokens"), F.min_by("loss", "step").alias("first_loss"), F.max_by("loss", "step").alias("last_loss"), (F.max("step") + 1).alias("steps"), F.count_if(bad).alias("bad"))


@query("SELECT event_type, round(sum(value * (user_id % 9 + 1)) / (ln(CAST(2 AS DOUBLE)) * nullif(sum(user_id % 4), 0)), 6) AS bpc FROM events GROUP BY event_type")
def train_bpc(spark, sf_dir):
    e = io.table(spark, sf_dir, "events")
    nats = F.sum(F.col("value") * (F.col("user_id") % 9 + 1))
    return e.groupBy("event_type").agg(F.round(M.relative(nats, F.ln(F.lit(2.0)) * F.sum(F.col("user_id") % 4)), 6).alias("bpc"))


@query("SELECT event_type, round(avg(CASE WHEN value > t THEN 1 ELSE 0 END), 6) AS above, round(max(t), 6) AS chance FROM events JOIN (VALUES ('click', CAST(5 AS DOUBLE)), ('view', CAST(10 AS DOUBLE)), ('purchase', CAST(20 AS DOUBLE))) c(event_type, t) USING (event_type) GROUP BY event_type")
def chance_join(spark, sf_dir):
    chance = spark.createDataFrame([("click", 5.0), ("view", 10.0), ("purchase", 20.0)], "event_type string, t double")
    j = io.table(spark, sf_dir, "events").join(F.broadcast(chance), "event_type")
    return j.groupBy("event_type").agg(F.round(F.avg((F.col("value") > F.col("t")).cast("int")), 6).alias("above"), F.round(F.max("t"), 6).alias("chance"))


@query("SELECT 'quality' AS measure, round(avg(quality), 6) AS accuracy FROM labels UNION ALL SELECT 'toxic', round(avg(toxic), 6) FROM labels")
def accuracy(spark, sf_dir):
    l = io.table(spark, sf_dir, "labels").select(F.explode(F.create_map(F.lit("quality"), "quality", F.lit("toxic"), "toxic")).alias("measure", "v"))  # noqa: E741
    return l.groupBy("measure").agg(F.round(F.avg("v"), 6).alias("accuracy"))


@query("SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS best FROM embeddings")
def argmax_choice(spark, sf_dir):
    return io.table(spark, sf_dir, "embeddings").select("vec_id", X.first_max(F.col("embedding")).cast("int").alias("best"))


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents),
g AS (SELECT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM w))
SELECT w.doc_id, round(coalesce(1 - d / CAST(n AS DOUBLE), 0), 6) AS repetition FROM w LEFT JOIN (SELECT doc_id, count(*) AS n, count(DISTINCT g) AS d FROM g GROUP BY doc_id) USING (doc_id)""")
def repetition_4(spark, sf_dir):
    return io.table(spark, sf_dir, "documents").select("doc_id", F.round(X.repetition(F.col("text")), 6).alias("repetition"))


GEN = "g AS (SELECT c_mktsegment AS model, c_custkey % 50 + 2 AS new_tokens, c_custkey % 200 + 5 AS new_chars, c_nationkey + 10 AS prompt_chars, (c_custkey % 7 + 1) / CAST(4 AS DOUBLE) AS decode_seconds, (c_custkey % 3 + 1) / CAST(8 AS DOUBLE) AS prefill_seconds, CAST(c_nationkey % 3 AS DOUBLE) AS memory, c_custkey % 5 / CAST(8 AS DOUBLE) AS repetition FROM customer)"


def generations(spark, sf_dir) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    return io.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("model"), (k % 50 + 2).alias("new_tokens"), (k % 200 + 5).alias("new_chars"), (n + 10).alias("prompt_chars"), ((k % 7 + 1) / 4).alias("decode_seconds"), ((k % 3 + 1) / 8).alias("prefill_seconds"), (n % 3).cast("double").alias("memory"), (k % 5 / 8).alias("repetition"))


RATES = "SELECT model, round(sum(new_chars) / sum(decode_seconds), 6) AS decode_chars_per_second, round(sum(new_tokens - 1) / sum(decode_seconds), 6) AS decode_tokens_per_second, round(sum(prompt_chars) / sum(prefill_seconds), 6) AS prefill_chars_per_second, round(sum(new_chars) / sum(new_tokens), 6) AS chars_per_token, round(avg(repetition), 6) AS repetition, nullif(max(memory), 0) AS max_memory FROM g GROUP BY model"


@query(f"WITH {GEN} {RATES}")
def rate_ratios(spark, sf_dir):
    r = M.rates(generations(spark, sf_dir), "model")
    return r.select("model", *[F.round(c, 6).alias(c) for c in r.columns[1:-1]], F.col("max_memory"))


@query(f"WITH {GEN}, r AS ({RATES}) SELECT r.model, round(r.decode_chars_per_second / nullif(b.decode_chars_per_second, 0), 6) AS ratio FROM r, r b WHERE b.model = 'BUILDING'")
def ratio_vs_reference(spark, sf_dir):
    r = rate_ratios(spark, sf_dir).select("model", "decode_chars_per_second")
    base = r.filter("model = 'BUILDING'").select(F.col("decode_chars_per_second").alias("base"))
    return r.crossJoin(F.broadcast(base)).select("model", F.round(M.relative(F.col("decode_chars_per_second"), F.col("base")), 6).alias("ratio"))


@query("SELECT event_type, round(quantile_cont(value, 0.025), 6) AS lo, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.975), 6) AS hi FROM events GROUP BY event_type")
def percentiles(spark, sf_dir):
    p = F.percentile("value", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return io.table(spark, sf_dir, "events").groupBy("event_type").agg(p.alias("p")).select("event_type", *[F.round(F.col("p")[k], 6).alias(c) for k, c in enumerate(("lo", "median", "hi"))])


@query("SELECT count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs, count(DISTINCT sha256(text)) AS texts FROM documents")
def distinct_used(spark, sf_dir):
    d = io.table(spark, sf_dir, "documents")
    return d.agg(F.countDistinct("source").alias("sources"), F.countDistinct("lang").alias("langs"), F.countDistinct(X.digest(F.col("text"))).alias("texts"))


@query(r"""WITH t AS (SELECT doc_id, lang, CAST(length(text) AS BIGINT) AS chars, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS BIGINT) AS tokens FROM documents)
SELECT doc_id, lang, chars, tokens, round(sum(chars) OVER (PARTITION BY lang) / sum(tokens) OVER (PARTITION BY lang), 6) AS chars_per_token FROM t""")
def survey(spark, sf_dir):
    d = io.table(spark, sf_dir, "documents").select("doc_id", "lang", F.length("text").cast("long").alias("chars"), X.count_matches(F.col("text"), X.WORDS).alias("tokens"))
    return M.survey(d, "lang").withColumn("chars_per_token", F.round("chars_per_token", 6))


@query("SELECT label, CAST(p - 1 AS BIGINT) AS pos, round(avg(CAST(embedding[p] AS DOUBLE)), 6) AS value FROM embeddings, range(1, 65) r(p) GROUP BY label, p")
def embedding_mean(spark, sf_dir):
    return M.embedding_mean(io.table(spark, sf_dir, "embeddings"), "label", "embedding").select("label", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))


ITEMS = "SELECT item_id, text AS context, [' ' || trim(left(text, 20), ' '), ' ' || trim(right(text, 20), ' '), ' ' || trim(substr(text, 10, 15), ' ')] AS choices, CAST(item_id % 3 AS BIGINT) AS gold FROM benchmark"


@query(f"SELECT item_id, context, choices, gold FROM ({ITEMS})")
def mc_items(spark, sf_dir):
    t = F.col("text")
    raw = io.table(spark, sf_dir, "benchmark").select("item_id", t.alias("context"), F.array(F.substring(t, 1, 20), F.right(t, F.lit(20)), F.substring(t, 10, 15)).alias("choices"), (F.col("item_id") % 3).cast("long").alias("gold"))
    return S.items(raw, "item_id", "context", "choices", "gold")


@query("""SELECT label, max(d) AS max_abs_diff FROM (SELECT a.label, unnest(list_transform(list_zip(a.embedding, b.embedding), lambda z: abs(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))) AS d
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - a.vec_id % 5) GROUP BY label""")
def max_abs_diff(spark, sf_dir):
    # Each vector against the first of its run of five.
    e = io.table(spark, sf_dir, "embeddings").withColumn("run", F.col("vec_id") - F.col("vec_id") % 5)
    first = e.filter("vec_id = run").select("run", F.col("embedding").alias("other"))
    return M.max_abs_diff(e.join(first, "run"), "label", F.col("embedding"), F.col("other"))


LM = r"""w AS (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM documents), f AS (SELECT w, count(*) AS n FROM w GROUP BY w),
m AS (SELECT sum(n) AS total, count(*) AS types FROM f)"""


@query(rf"WITH {LM}, t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS w FROM documents) SELECT doc_id, round(sum(-ln((coalesce(n, 0) + 1) / CAST(total + types AS DOUBLE))), 4) AS nats FROM t LEFT JOIN f USING (w), m GROUP BY doc_id")
def unigram_nats(spark, sf_dir):
    d = io.table(spark, sf_dir, "documents")
    return S.unigram_nats(d, "doc_id", S.unigram_model(d)).select("doc_id", F.round("nats", 4).alias("nats"))


@query(rf"WITH {LM}, t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS w FROM documents) SELECT doc_id, CASE WHEN count(*) <= 500 THEN round(sum(-ln((coalesce(n, 0) + 1) / CAST(total + types AS DOUBLE))), 4) END AS nats, count(*) AS tokens FROM t LEFT JOIN f USING (w), m GROUP BY doc_id")
def doc_nats(spark, sf_dir):
    d = io.table(spark, sf_dir, "documents")
    s = S.unigram_nats(d, "doc_id", S.unigram_model(d))
    return s.select("doc_id", F.when(F.col("tokens") <= 500, F.round("nats", 4)).alias("nats"), "tokens")


@query(rf"""WITH {LM}, i AS ({ITEMS}), c AS (SELECT item_id, gold, pos, choices[pos + 1] AS choice FROM i, range(3) r(pos)), t AS (SELECT item_id, pos, unnest(regexp_extract_all(lower(choice), '[\p{{L}}\p{{N}}_]+')) AS w FROM c),
n AS (SELECT item_id, pos, sum(-ln((coalesce(n, 0) + 1) / CAST(total + types AS DOUBLE))) AS nats FROM t LEFT JOIN f USING (w), m GROUP BY item_id, pos),
s AS (SELECT item_id, gold, list(round(-coalesce(nats, 0), 4) ORDER BY pos) AS lp, list(round(-coalesce(nats, 0) / length(choice), 6) ORDER BY pos) AS lc FROM c LEFT JOIN n USING (item_id, pos) GROUP BY item_id, gold)
SELECT item_id, list_position(lp, list_max(lp)) - 1 = gold AS correct_sum, list_position(lc, list_max(lc)) - 1 = gold AS correct_char FROM s""")
def mc_scoring(spark, sf_dir):
    return S.score_items(mc_items(spark, sf_dir), "item_id", S.unigram_model(io.table(spark, sf_dir, "documents")))


@query("SELECT step, round(CASE WHEN step < 10 THEN 0.001 * (step + 1) / 10 ELSE 0.001 * (0.1 + 0.9 * 0.5 * (1 + cos(pi() * (step - 10) / CAST(89 AS DOUBLE)))) END, 9) AS lr FROM range(100) t(step)")
def lr_schedule(spark, sf_dir):
    return spark.range(100).select(F.col("id").alias("step"), F.round(X.learning_rate(F.col("id"), 100, 10, 0.001, 0.1), 9).alias("lr"))


@query("SELECT doc_id, CAST(greatest(8, round_even(1024 * (doc_id % 17 + 1) / CAST(8 * 9 AS DOUBLE), 0) * 8) AS BIGINT) AS seq_len FROM documents")
def equal_text_seq(spark, sf_dir):
    return io.table(spark, sf_dir, "documents").select("doc_id", X.equal_text_length((F.col("doc_id") % 17 + 1) / F.lit(9.0)).alias("seq_len"))


