"""Queries of paired statistics, exact tests and decision rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import text as X
from corpuscle.operators import stats as H
from corpuscle.sources import io

from .catalog import query
from .measure_queries import PAIRS, SCORES, both, scores

RESAMPLES = 10_000
LN2 = "ln(CAST(2 AS DOUBLE))"
#: The SQL draws as groups of one bucket do; larger groups draw each bucket's part by a multinomial split.
ALL = H.draws_sql("SELECT i, chars, nats_a, nats_b FROM p", None, RESAMPLES)
STRATA = f"""{PAIRS}, x AS (SELECT domain, b, sum(nats_a) / sum(nats_b) - 1 AS rel, sum(nats_a) / ({LN2} * sum(chars)) AS bpc_a, sum(nats_b) / ({LN2} * sum(chars)) AS bpc_b FROM {H.draws_sql("SELECT i, domain, chars, nats_a, nats_b FROM p", "domain", RESAMPLES)} GROUP BY domain, b)"""


def by_domain(spark, sf_dir) -> DataFrame:
    p = both(spark, sf_dir).select("i", "chars", "nats_a", "nats_b").join(scores(spark, sf_dir).filter("run = 'a'").select("i", "domain"), "i")
    return H.resampled(p, ["domain"], RESAMPLES, {"nats_a": "a", "nats_b": "b_", "chars": "c"})


def rounded(*columns: str) -> list:
    return [F.round(c, 6).alias(c) for c in columns]


@query(f"""WITH {PAIRS}, x AS (SELECT b, (sum(nats_a) - sum(nats_b)) / ({LN2} * sum(chars)) AS diff, sum(nats_a) / sum(nats_b) - 1 AS rel FROM {ALL} GROUP BY b),
y AS (SELECT (sum(nats_a) - sum(nats_b)) / ({LN2} * sum(chars)) AS diff, sum(nats_a) / sum(nats_b) - 1 AS rel_diff FROM p),
z AS (SELECT quantile_cont(diff, 0.025) AS lo, quantile_cont(diff, 0.5) AS median, quantile_cont(diff, 0.975) AS hi, quantile_cont(rel, 0.025) AS rel_lo, quantile_cont(rel, 0.975) AS rel_hi FROM x)
SELECT round(diff, 6) AS diff, round(lo, 6) AS lo, round(median, 6) AS median, round(hi, 6) AS hi, lo > 0 OR hi < 0 AS significant, round(rel_diff, 6) AS rel_diff, round(rel_lo, 6) AS rel_lo, round(rel_hi, 6) AS rel_hi FROM y, z""")
def paired_bootstrap(spark, sf_dir):
    return H.paired_bootstrap(both(spark, sf_dir), RESAMPLES).select(*rounded("diff", "lo", "median", "hi"), "significant", *rounded("rel_diff", "rel_lo", "rel_hi"))


@query(f"""WITH {STRATA}, m AS (SELECT b, avg(rel) AS rel FROM x GROUP BY b)
SELECT round(quantile_cont(rel, 0.025), 6) AS lo, round(quantile_cont(rel, 0.5), 6) AS median, round(quantile_cont(rel, 0.975), 6) AS hi FROM m""")
def stratified_bootstrap(spark, sf_dir):
    x = by_domain(spark, sf_dir).groupBy("b").agg(F.avg(F.col("a") / F.col("b_") - 1).alias("rel"))
    return x.agg(*H.interval(F.col("rel"))).select(*rounded("lo", "median", "hi"))


#: Two groups of two runs each, scored on the same documents; the runs of a group differ by a factor.
RUNS = {"a": (1.0, 1.002), "b": (0.999, 1.004)}
GROUPS = ", ".join(f"sum(nats_{g} * CAST({f} AS DOUBLE)) / ({LN2} * sum(chars)) AS {g}{k}" for g, fs in RUNS.items() for k, f in enumerate(fs))


@query(f"""WITH {PAIRS}, x AS (SELECT b, {GROUPS} FROM {ALL} GROUP BY b), y AS (SELECT {GROUPS} FROM p),
z AS (SELECT quantile_cont((a0 + a1) / 2 - (b0 + b1) / 2, 0.025) AS lo, quantile_cont((a0 + a1) / 2 - (b0 + b1) / 2, 0.975) AS hi FROM x)
SELECT round((a0 + a1) / 2 - (b0 + b1) / 2, 6) AS diff, round(lo, 6) AS lo, round(hi, 6) AS hi FROM y, z""")
def bootstrap_group_mean(spark, sf_dir):
    return group_mean(spark, sf_dir).select(*rounded("diff", "lo", "hi"))


def group_mean(spark, sf_dir) -> DataFrame:
    p = both(spark, sf_dir)
    runs = {g: [F.col(f"nats_{g}") * f for f in fs] for g, fs in RUNS.items()}
    return H.group_mean_bootstrap(p, runs["a"], runs["b"], RESAMPLES)


INTERVALS = "v AS (SELECT domain, quantile_cont(rel, 0.025) AS lo, quantile_cont(rel, 0.975) AS hi FROM x GROUP BY domain)"


@query(f"""WITH {STRATA}, {INTERVALS}
SELECT CASE WHEN bool_and(hi < 0) THEN 'A better' WHEN bool_and(lo > 0) THEN 'B better' ELSE 'not distinguishable' END AS verdict FROM v""")
def decide(spark, sf_dir):
    v = by_domain(spark, sf_dir).groupBy("domain").agg(*H.interval(F.col("a") / F.col("b_") - 1))
    return v.agg(H.decide(F.col("lo"), F.col("hi")).alias("verdict"))


@query(f"""WITH {PAIRS}, x AS (SELECT b, {GROUPS} FROM {ALL} GROUP BY b)
SELECT CASE WHEN quantile_cont((a0 + a1) / 2 - (b0 + b1) / 2, 0.975) < 0 THEN 'small' ELSE 'large' END AS choice FROM x""")
def choose_n(spark, sf_dir):
    return group_mean(spark, sf_dir).select(F.when(F.col("hi") < 0, "small").otherwise("large").alias("choice"))


@query(f"""WITH {STRATA}, {INTERVALS}, r AS (SELECT domain, 1 - sum(CASE WHEN run = 'a' THEN tokens END) / (2.0 * sum(CASE WHEN run = 'b' THEN tokens END)) AS reduction FROM s GROUP BY domain)
SELECT bool_and(reduction >= 0.15 AND hi < 0.01) AS non_inferior, bool_and(reduction >= 0.75 AND hi < 0.01) AS strict FROM v JOIN r USING (domain)""")
def noninferiority(spark, sf_dir):
    v = by_domain(spark, sf_dir).groupBy("domain").agg(*H.interval(F.col("a") / F.col("b_") - 1))
    t = scores(spark, sf_dir).groupBy("domain").pivot("run", ["a", "b"]).agg(F.sum("tokens")).select("domain", (1 - F.col("a") / (2 * F.col("b"))).alias("reduction"))
    j = v.join(t, "domain")
    return j.agg(H.non_inferior(F.col("reduction"), F.col("hi")).alias("non_inferior"), H.non_inferior(F.col("reduction"), F.col("hi"), least=0.75).alias("strict"))


DIFF = f"(sum(nats_a) - sum(nats_b)) / ({LN2} * sum(chars))"


@query(f"""WITH {PAIRS}, t AS (SELECT *, row_number() OVER (ORDER BY chars, i) - 1 AS k, count(*) OVER () AS n FROM p),
d AS (SELECT i, chars, nats_a, nats_b, unnest(['all', CASE WHEN k < floor(n * CAST(0.95 AS DOUBLE)) THEN 'shortest 95%' END, CASE WHEN k < n // 2 THEN 'short' ELSE 'long' END, CASE WHEN i % 2 = 1 THEN 'second set' END]) AS part FROM t),
g AS (SELECT part, {DIFF} AS diff, count(*) FILTER (nats_a < nats_b) AS favours_a, count(*) AS n FROM d WHERE part IS NOT NULL GROUP BY part)
SELECT part, round(diff, 6) AS diff, favours_a, n, (diff > 0) = (max(CASE WHEN part = 'all' THEN diff END) OVER () > 0) AS same_sign FROM g""")
def sensitivity(spark, sf_dir):
    return H.sensitivity(both(spark, sf_dir), F.col("i") % 2 == 1).withColumn("diff", F.round("diff", 6))


@query("""WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS n01, count(*) FILTER (quality = 0 AND toxic = 0) AS n10 FROM labels),
t AS (SELECT n01, n10, sum(exp(lgamma(n01 + n10 + 1) - lgamma(i + 1) - lgamma(n01 + n10 - i + 1) - (n01 + n10) * ln(CAST(2 AS DOUBLE)))) AS tail FROM c, unnest(range(least(n01, n10) + 1)) u(i) GROUP BY n01, n10)
SELECT n01 AS a_only, n10 AS b_only, round(CASE WHEN n01 + n10 = 0 THEN 1 ELSE least(1, 2 * tail) END, 9) AS p_value FROM t""")
def mcnemar(spark, sf_dir):
    l = io.table(spark, sf_dir, "labels")  # noqa: E741
    a, b = F.col("quality") == 1, F.col("toxic") == 0
    c = l.agg(F.count_if(a & ~b).alias("a_only"), F.count_if(~a & b).alias("b_only"))
    return c.withColumn("p_value", F.round(H.mcnemar_p(F.col("a_only"), F.col("b_only")), 9))


def t_sql(df: str) -> str:
    """The 0.975 quantile of Student's t for whole degrees of freedom, in DuckDB: the finite series in the angle, halved to a double's end."""
    term = "exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1) + 2 * j * ln(cos(a)))"
    odd = "exp(lgamma(j + 1) - lgamma(j + 1.5) + ln(sqrt(pi()) / 2) + 2 * j * ln(cos(a)))"
    even = f"sin(a) * coalesce(list_sum(list_transform(range(df // 2), lambda j: {term})), 0)"
    odd = f"2 / pi() * (a + sin(a) * cos(a) * coalesce(list_sum(list_transform(range((df - 1) // 2), lambda j: {odd})), 0))"
    central = f"CASE WHEN df % 2 = 0 THEN {even} ELSE {odd} END"
    return f"""h AS (SELECT df, 0 AS step, CAST(0 AS DOUBLE) AS lo, pi() / 2 AS hi FROM ({df}) UNION ALL
SELECT df, step + 1, CASE WHEN {central} < 0.95 THEN a ELSE lo END, CASE WHEN {central} < 0.95 THEN hi ELSE a END FROM (SELECT *, (lo + hi) / 2 AS a FROM h) WHERE step < 60),
q AS (SELECT df, sqrt(df) * tan((lo + hi) / 2) AS t FROM h WHERE step = 60)"""


@query(f"WITH RECURSIVE {t_sql('SELECT unnest(range(1, 31)) AS df')} SELECT df, round(t, 6) AS t FROM q")
def t_threshold(spark, sf_dir):
    return spark.range(1, 31).select(F.col("id").alias("df"), F.round(H.t_quantile_udf(F.lit(0.975), F.col("id").cast("double")), 6).alias("t"))


TAIL = "list_sum(list_transform(range(k, n + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(p) + (n - j) * ln(1 - p))))"
LOWER = f"""c AS (SELECT toxic, CAST(sum(quality) AS BIGINT) AS k, count(*) AS n FROM labels GROUP BY toxic),
h AS (SELECT *, 0 AS step, CAST(0 AS DOUBLE) AS lo, k / CAST(n AS DOUBLE) AS hi FROM c UNION ALL
SELECT toxic, k, n, step + 1, CASE WHEN {TAIL} < 0.025 THEN p ELSE lo END, CASE WHEN {TAIL} < 0.025 THEN hi ELSE p END FROM (SELECT *, (lo + hi) / 2 AS p FROM h) WHERE step < 50),
l AS (SELECT toxic, k, n, CASE WHEN k = 0 THEN 0 ELSE (lo + hi) / 2 END AS lower FROM h WHERE step = 50)"""


@query(f"WITH RECURSIVE {LOWER} SELECT toxic, k, n, round(lower, 9) AS lower FROM l")
def binomial_lower(spark, sf_dir):
    c = io.table(spark, sf_dir, "labels").groupBy("toxic").agg(F.sum("quality").cast("long").alias("k"), F.count("*").alias("n"))
    return c.withColumn("lower", F.round(H.binomial_lower_udf("k", "n"), 9))


@query(f"WITH RECURSIVE {LOWER} SELECT toxic, round(lower, 9) > 0.25 AS included FROM l")
def inclusion(spark, sf_dir):
    c = binomial_lower(spark, sf_dir)
    return c.select("toxic", (F.col("lower") > 0.25).alias("included"))


SEEDS = f"""{SCORES}, e AS (SELECT domain, i % 3 AS seed, sum(nats) / ({LN2} * sum(chars)) AS bpc FROM s GROUP BY ALL),
sp AS (SELECT CAST(count(*) AS BIGINT) AS k, sqrt(avg((x.bpc - y.bpc) * (x.bpc - y.bpc))) AS sigma FROM e x JOIN e y ON x.domain = y.domain AND x.seed > 0 AND y.seed = 0)"""


@query(f"WITH RECURSIVE {SEEDS}, {t_sql('SELECT k AS df FROM sp')} SELECT k, round(t * sigma, 6) AS threshold FROM sp JOIN q ON df = k")
def noise_threshold(spark, sf_dir):
    return seed_noise(spark, sf_dir).withColumn("threshold", F.round("threshold", 6))


def seed_noise(spark, sf_dir) -> DataFrame:
    s = scores(spark, sf_dir).groupBy("domain", (F.col("i") % 3).alias("seed")).agg(X.bpc(F.col("nats"), F.col("chars")).alias("bpc"))
    return H.noise_threshold(s, "domain", "seed", "bpc")


@query(f"""WITH RECURSIVE {STRATA}, v AS (SELECT domain, quantile_cont(bpc_a - bpc_b, 0.025) AS lo, quantile_cont(bpc_a - bpc_b, 0.975) AS hi FROM x GROUP BY domain),
e AS (SELECT domain, i % 3 AS seed, sum(nats) / ({LN2} * sum(chars)) AS bpc FROM s GROUP BY ALL),
sp AS (SELECT CAST(count(*) AS BIGINT) AS k, sqrt(avg((x.bpc - y.bpc) * (x.bpc - y.bpc))) AS sigma FROM e x JOIN e y ON x.domain = y.domain AND x.seed > 0 AND y.seed = 0),
{t_sql('SELECT k AS df FROM sp')}, f AS (SELECT domain, {DIFF} AS diff FROM p GROUP BY domain)
SELECT domain, CASE WHEN NOT (lo > 0 OR hi < 0) OR abs(diff) <= t * sigma THEN 'not resolved' WHEN diff < 0 THEN 'A lower' ELSE 'A higher' END AS direction FROM f JOIN v USING (domain), sp, q""")
def direction(spark, sf_dir):
    bpc = lambda c: F.col(c) / (F.ln(F.lit(2.0)) * F.col("c"))
    v = by_domain(spark, sf_dir).groupBy("domain").agg(*H.interval(bpc("a") - bpc("b_")))
    wide = scores(spark, sf_dir).groupBy("domain").pivot("run", ["a", "b"]).agg(X.bpc(F.col("nats"), F.col("chars")))
    j = wide.select("domain", (F.col("a") - F.col("b")).alias("diff")).join(v, "domain").crossJoin(F.broadcast(seed_noise(spark, sf_dir).select("threshold")))
    return j.select("domain", H.direction((F.col("lo") > 0) | (F.col("hi") < 0), F.col("diff"), F.col("threshold")).alias("direction"))


@query(f"""WITH {SCORES}, g AS (SELECT domain, i % 2 AS depth, run, sum(nats) / ({LN2} * sum(chars)) AS bpc FROM s GROUP BY ALL)
SELECT domain, CAST(depth AS BIGINT) AS depth, round(max(CASE WHEN run = 'a' THEN bpc END) - max(CASE WHEN run = 'b' THEN bpc END), 6) AS effect FROM g GROUP BY domain, depth""")
def scaling_pivot(spark, sf_dir):
    wide = scores(spark, sf_dir).groupBy("domain", (F.col("i") % 2).alias("depth")).pivot("run", ["a", "b"]).agg(X.bpc(F.col("nats"), F.col("chars")))
    return wide.select("domain", "depth", F.round(F.col("a") - F.col("b"), 6).alias("effect"))
