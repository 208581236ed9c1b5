"""Queries of tokenizer counts, merges, training, retrofit and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import text as X
from corpuscle.operators import bpe as T
from corpuscle.sources import io

from .catalog import query

#: Distinct words with their symbols, as DuckDB sees them.
WORDS = r"w AS (SELECT w, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{Nl}\p{No}]+')) AS w FROM documents) GROUP BY w)"
PAIRS = WORDS + ", p AS (SELECT substr(w, k, 1) AS l, substr(w, k + 1, 1) AS r, freq FROM (SELECT w, freq, unnest(range(1, length(w))) AS k FROM w WHERE length(w) > 1)), c AS (SELECT l, r, CAST(sum(freq) AS BIGINT) AS cnt FROM p GROUP BY l, r)"


def docs(spark, sf_dir) -> DataFrame:
    return io.table(spark, sf_dir, "documents")


def words(spark, sf_dir) -> DataFrame:
    d = docs(spark, sf_dir).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(X.LETTERS), F.lit(0))).alias("w")).groupBy("w").agg(F.count("*").alias("freq"))
    return d.withColumn("symbols", F.filter(F.split("w", ""), lambda x: x != ""))


@query(f"WITH {PAIRS} SELECT l, r, cnt FROM c")
def pair_counts(spark, sf_dir):
    return T.pair_counts(words(spark, sf_dir))


@query(f"WITH {PAIRS} SELECT l, r, cnt FROM c ORDER BY cnt DESC, l, r LIMIT 1")
def best_pair(spark, sf_dir):
    return T.best_pair(T.pair_counts(words(spark, sf_dir)))


# Merging e + r: RE2 and a private mark give the same left-to-right result.
MERGED = WORDS + ", m AS (SELECT w, freq, string_split(replace(regexp_replace(replace(w, 'er', chr(57344)), '(.)', '\\1|', 'g'), chr(57344), 'er'), '|') AS s FROM w)"


@query(f"WITH {MERGED} SELECT w, array_to_string(list_filter(s, lambda x: x <> ''), ' ') AS symbols FROM m")
def merge_once(spark, sf_dir):
    return words(spark, sf_dir).select("w", F.array_join(T.merge_once(F.col("symbols"), F.lit("e"), F.lit("r")), " ").alias("symbols"))


@query(f"""WITH {MERGED}, z AS (SELECT list_filter(s, lambda x: x <> '') AS s, w, freq FROM m WHERE contains(w, 'er')),
old AS (SELECT substr(w, k, 1) AS l, substr(w, k + 1, 1) AS r, -freq AS d FROM (SELECT w, freq, unnest(range(1, length(w))) AS k FROM z)),
new AS (SELECT s[k] AS l, s[k + 1] AS r, freq AS d FROM (SELECT s, freq, unnest(range(1, len(s))) AS k FROM z WHERE len(s) > 1))
SELECT l, r, CAST(sum(d) AS BIGINT) AS delta FROM (SELECT * FROM old UNION ALL SELECT * FROM new) GROUP BY l, r HAVING sum(d) <> 0""")
def pair_delta(spark, sf_dir):
    # Only words that hold the pair change, so only their pairs are counted anew.
    w = words(spark, sf_dir).filter(F.contains("w", F.lit("er")))
    now = w.withColumn("symbols", T.merge_once(F.col("symbols"), F.lit("e"), F.lit("r")))
    signed = T.pair_counts(w).withColumn("cnt", -F.col("cnt")).unionByName(T.pair_counts(now))
    return signed.groupBy("l", "r").agg(F.sum("cnt").alias("delta")).filter("delta <> 0")


def learnt(spark, sf_dir, n: int = 60):
    return T.learn(docs(spark, sf_dir), X.STAGE1, n)


def merge_table(spark, merges, first: int = 0) -> DataFrame:
    return spark.createDataFrame([(first + k, a, b) for k, (a, b) in enumerate(merges)], "rank int, left string, right string")


@query()
def bpe_train(spark, sf_dir):
    return merge_table(spark, learnt(spark, sf_dir)[1])


@query()
def superbpe_train(spark, sf_dir):
    ids, merges = learnt(spark, sf_dir, 40)
    small = docs(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("text"))
    return merge_table(spark, T.learn(small, X.STAGE2, 20, merges, ids, rules=True)[1], len(merges))


@query()
def super_train(spark, sf_dir):
    # Nine tenths of the vocabulary above the alphabet are stage-1 merges, the rest cross blanks.
    size = 256 + 60
    n1 = round(0.9 * size) - 256
    ids, merges = learnt(spark, sf_dir, n1)
    lines = docs(spark, sf_dir).select(F.explode(F.split("text", "\n")).alias("text"))
    ids, more = T.learn(lines, X.STAGE2, size - len(ids), merges, ids, rules=True)
    return spark.createDataFrame(sorted(ids.items(), key=lambda x: x[1]), "token string, id int")


@query()
def retrofit_learn(spark, sf_dir):
    ids, merges = learnt(spark, sf_dir, 40)
    runs = docs(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit(X.WORD_RUN), F.lit(0))).alias("text"))
    return merge_table(spark, T.learn(runs, X.WORD_RUN, 20, merges, ids)[1], len(merges))


@query()
def bpe_encode(spark, sf_dir):
    out = T.encode(docs(spark, sf_dir), X.STAGE1, learnt(spark, sf_dir)[1])
    return out.select("doc_id", F.size("tokens").cast("long").alias("tokens"))


@query()
def roundtrip(spark, sf_dir):
    out = T.encode(docs(spark, sf_dir).select("doc_id", X.nfc("text").alias("text")), X.STAGE1, learnt(spark, sf_dir)[1])
    return out.select("doc_id", (T.decode("tokens") == F.col("text")).alias("same"))


@query()
def token_pieces(spark, sf_dir):
    ids, merges = learnt(spark, sf_dir)
    base = {t: i for t, i in ids.items() if i < 286}
    pieces = T.base_pieces(list(ids), merges[:30], base, ids)
    return spark.createDataFrame(list(pieces.items()), "token string, pieces array<string>")


@query()
def retrofit_tokens(spark, sf_dir):
    ids, merges = learnt(spark, sf_dir)
    return T.new_token_uses(T.token_counts(docs(spark, sf_dir), X.STAGE1, merges), {t for t, i in ids.items() if i < 286}, merges)


@query()
def retrofit_report(spark, sf_dir):
    merges = learnt(spark, sf_dir)[1]
    base = T.vocabulary(merges[:30])
    d = docs(spark, sf_dir).select("lang", "text", F.length("text").alias("chars"))
    d = T.compare_encodings(d, X.STAGE1, merges[:30], merges, keep=("lang", "chars"), of=T.vocabulary(merges) - base)
    # A text counts once, in the row without a token, and once more for each new token it has.
    d = d.withColumn("token", F.explode(F.concat(F.array(F.lit(None).cast("string")), "used"))).groupBy("lang", "token")
    sums = {"docs": F.count("*"), "chars": F.sum("chars"), "base": F.sum("base"), "new": F.sum("new"), "round_trips": F.count_if("round_trip"), "identical": F.count_if("identical")}
    d = d.agg(*[v.alias(k) for k, v in sums.items()])
    d = d.groupBy("lang").agg(*[F.max(F.when(F.isnull("token"), F.col(k))).alias(k) for k in sums], F.count("token").alias("used"))
    n = T.new_tokens(spark, base, merges, X.STAGE1)
    n = n.agg(F.count("*").alias("new_tokens"), F.count_if("whole").alias("whole"), F.count_if(~F.col("whole")).alias("partial"), F.count_if("reachable").alias("reachable"))
    rates = {"base_chars_per_token": F.try_divide("chars", "base"), "new_chars_per_token": F.try_divide("chars", "new"), "token_change": F.try_divide("new", "base") - 1}
    return d.crossJoin(F.broadcast(n)).select("lang", "docs", "chars", *[F.round(v, 6).alias(k) for k, v in rates.items()], "round_trips", "identical", "new_tokens", "whole", "partial", "reachable", "used")


VOCAB = r"v AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) - 1 AS id FROM (SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{2,4}')) AS token FROM documents) GROUP BY token ORDER BY n DESC, token LIMIT 200))"
NEW = r"x AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) AS rank FROM (SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{2,5}')) AS token FROM benchmark) GROUP BY token ORDER BY n DESC, token LIMIT 100))"


def common(df: DataFrame, pattern: str, n: int) -> DataFrame:
    t = df.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return t.orderBy(F.desc("n"), "token").limit(n)


def vocabulary(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window

    rank = F.row_number().over(Window.orderBy(F.desc("n"), "token"))
    vocab = common(docs(spark, sf_dir), "[a-z]{2,4}", 200).select("token", (rank - 1).cast("long").alias("id"))
    return vocab, common(io.table(spark, sf_dir, "benchmark"), "[a-z]{2,5}", 100).select("token", rank.cast("long").alias("rank"))


@query(f"WITH {VOCAB}, {NEW} SELECT token, (SELECT max(id) FROM v) + row_number() OVER (ORDER BY rank, token) AS id FROM x WHERE token NOT IN (SELECT token FROM v)")
def retrofit_ids(spark, sf_dir):
    return T.retrofit_ids(*vocabulary(spark, sf_dir))


@query(f"WITH {VOCAB}, {NEW} SELECT 'new' AS part, count(*) AS n FROM (SELECT token FROM x EXCEPT SELECT token FROM v) UNION ALL SELECT 'both', count(*) FROM (SELECT token FROM x INTERSECT SELECT token FROM v) UNION ALL SELECT 'all', count(*) FROM (SELECT token FROM x UNION SELECT token FROM v)")
def new_tokens_setops(spark, sf_dir):
    v, x = (t.select("token") for t in vocabulary(spark, sf_dir))
    n = lambda name, d: d.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return n("new", x.exceptAll(v)).unionByName(n("both", x.intersect(v))).unionByName(n("all", x.unionByName(v).distinct()))


@query(f"WITH {VOCAB} SELECT token, CASE WHEN token IN ('th', 'on') THEN 0 ELSE CAST(length(token) AS BIGINT) END AS bytes FROM v")
def token_bytes(spark, sf_dir):
    return T.token_bytes(vocabulary(spark, sf_dir)[0], ["th", "on"])


GLUED = r"SELECT DISTINCT replace(g, ' ', 'Ġ') AS token FROM (SELECT unnest(regexp_extract_all(text, ' ?[A-Za-z:]+(?: [A-Za-z:]+){0,5}')) AS g FROM documents)"


def glued(spark, sf_dir) -> DataFrame:
    g = F.explode(F.regexp_extract_all("text", F.lit(" ?[A-Za-z:]+(?: [A-Za-z:]+){0,5}"), F.lit(0)))
    return docs(spark, sf_dir).select(g.alias("g")).select(F.replace("g", F.lit(" "), F.lit("Ġ")).alias("token")).distinct()


@query(f"SELECT token, contains(trim(token, 'Ġ'), 'Ġ') AS superword FROM ({GLUED})")
def superword_flag(spark, sf_dir):
    return glued(spark, sf_dir).select("token", X.superword(F.col("token")).alias("superword"))


@query(f"SELECT token, contains(token, ':Ġ') OR len(list_filter(string_split(token, 'Ġ'), lambda x: x <> '')) > 4 AS banned FROM ({GLUED})")
def merge_rule(spark, sf_dir):
    return glued(spark, sf_dir).select("token", X.banned_merge(F.col("token")).alias("banned"))


TOKENS = r"t AS (SELECT doc_id, lang, text, unnest(regexp_extract_all(text, '[^ ]+(?: [a-z]+)?')) AS token FROM documents)"


def tokens(spark, sf_dir) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", "lang", F.explode(F.regexp_extract_all("text", F.lit("[^ ]+(?: [a-z]+)?"), F.lit(0))).alias("token"))


@query(f"WITH {TOKENS} SELECT token, count(*) AS n FROM t WHERE contains(token, ' ') GROUP BY token ORDER BY n DESC, token LIMIT 25")
def top_superwords(spark, sf_dir):
    return tokens(spark, sf_dir).filter(F.contains("token", F.lit(" "))).groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(25)


@query(rf"""WITH {TOKENS}, a AS (SELECT lang, count(*) AS tokens, count(*) FILTER (contains(token, ' ')) AS supers, CAST(sum(length(token)) AS BIGINT) AS covered FROM t GROUP BY lang),
b AS (SELECT lang, sum(length(text)) AS chars, greatest(sum(len(regexp_extract_all(text, '[\p{{L}}\p{{Nl}}\p{{No}}]+'))), 1) AS syllables FROM documents GROUP BY lang)
SELECT lang, tokens, round(chars / tokens, 6) AS chars_per_token, round(tokens / syllables, 6) AS tokens_per_syllable, round(supers / tokens, 6) AS superword_share FROM a JOIN b USING (lang)""")
def compression_stats(spark, sf_dir):
    d = docs(spark, sf_dir)
    found = F.regexp_extract_all("text", F.lit("[^ ]+(?: [a-z]+)?"), F.lit(0))
    d = d.select("lang", F.length("text").alias("chars"), X.count_matches(F.col("text"), X.LETTERS).alias("syl"), found.alias("t"))
    d = d.select("lang", "chars", "syl", F.size("t").alias("n"), F.size(F.filter("t", lambda x: F.contains(x, F.lit(" ")))).alias("s"))
    n = F.sum("n")
    return d.groupBy("lang").agg(n.alias("tokens"), F.round(F.sum("chars") / n, 6).alias("chars_per_token"), F.round(n / F.greatest(F.sum("syl"), F.lit(1)), 6).alias("tokens_per_syllable"), F.round(F.sum("s") / n, 6).alias("superword_share"))


@query(r"SELECT lang, round(1 - sum(len(regexp_extract_all(text, '[^ ]+(?: [a-z]+)?'))) / sum(len(regexp_extract_all(text, '[^ ]+'))), 6) AS reduction FROM documents GROUP BY lang")
def token_reduction(spark, sf_dir):
    n = lambda p: F.sum(X.count_matches(F.col("text"), p))
    return docs(spark, sf_dir).groupBy("lang").agg(F.round(1 - n("[^ ]+(?: [a-z]+)?") / n("[^ ]+"), 6).alias("reduction"))


@query("""WITH t AS (SELECT doc_id, list_append(regexp_extract_all(text, '[^ ]+'), '<eos>') AS t FROM documents),
a AS (SELECT doc_id, t, sum(len(t)) OVER (ORDER BY doc_id) - len(t) AS s, sum(len(t)) OVER () AS total FROM t),
x AS (SELECT s + k AS g, t[k + 1] AS token, total FROM (SELECT t, s, total, unnest(range(len(t))) AS k FROM a))
SELECT CAST(g // 4096 AS BIGINT) AS batch_id, CAST(g % 4096 // 512 AS BIGINT) AS row_id, CAST(g % 512 AS BIGINT) AS col, token FROM x WHERE g < (total // 4096) * 4096""")
def pack_sequences(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", F.regexp_extract_all("text", F.lit("[^ ]+"), F.lit(0)).alias("t"))
    return T.pack(d, "doc_id", "t", "<eos>", 8, 512)
