"""Measures of corpora, tokenizers and models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions.text import bpc


def lm_summary(scores: DataFrame, *by: str) -> DataFrame:
    """Bits and characters per token of each group; a group without characters, or with a score missing, fails the query."""
    good = (F.sum("chars") > 0) & (F.count("nats") == F.count("*")) & (F.count("chars") == F.count("*"))
    checked = F.when(good, bpc(F.col("nats"), F.col("chars"))).otherwise(F.raise_error(F.lit("scores and characters do not pair")).cast("double"))
    return scores.groupBy(*by).agg(checked.alias("bpc"), (F.sum("chars") / F.sum("tokens")).alias("chars_per_token"))


def paired(a: DataFrame, b: DataFrame, key: str = "i", check: tuple[str, ...] = ("digest", "chars"), value: str = "nats") -> DataFrame:
    """Rows of two runs side by side; a row that one run lacks, or whose checks differ, fails the query."""
    j = a.select(key, *[F.col(c).alias(f"{c}_a") for c in (*check, value)]).join(b.select(key, *[F.col(c).alias(f"{c}_b") for c in (*check, value)]), key, "full")
    same = F.lit(True)
    for c in check:
        same = same & F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b"))
    ok = F.when(same & F.col(f"{value}_a").isNotNull() & F.col(f"{value}_b").isNotNull(), F.col(key)).otherwise(F.raise_error(F.lit("runs do not pair")).cast("long"))
    return j.select(ok.alias(key), *[F.col(f"{c}_a").alias(c) for c in check], f"{value}_a", f"{value}_b")


def common_docs(scores: DataFrame, run: str, key: str, value: str) -> DataFrame:
    """Keys with a value in every run, by counting: no join per run."""
    n = scores.agg(F.countDistinct(run).alias("runs"))
    have = scores.filter(F.col(value).isNotNull()).groupBy(key).agg(F.countDistinct(run).alias("have"))
    return have.crossJoin(F.broadcast(n)).filter("have = runs").select(key)


def rates(gen: DataFrame, *by: str) -> DataFrame:
    """Ratios of sums of generation records."""
    g = gen.groupBy(*by) if by else gen.groupBy()
    return g.agg(
        (F.sum("new_chars") / F.sum("decode_seconds")).alias("decode_chars_per_second"),
        (F.sum(F.col("new_tokens") - 1) / F.sum("decode_seconds")).alias("decode_tokens_per_second"),
        (F.sum("prompt_chars") / F.sum("prefill_seconds")).alias("prefill_chars_per_second"),
        (F.sum("new_chars") / F.sum("new_tokens")).alias("chars_per_token"),
        F.avg("repetition").alias("repetition"),
        F.nullif(F.max("memory"), F.lit(0)).alias("max_memory"),
    )


def relative(a: Column, b: Column) -> Column:
    """a / b, null where the reference is missing or 0."""
    return F.try_divide(a, b)


def embedding_mean(vectors: DataFrame, by: str, vector: str) -> DataFrame:
    """by, pos, value: the elementwise mean of the vectors of each group."""
    return vectors.select(by, F.posexplode(vector).alias("pos", "x")).groupBy(by, "pos").agg(F.avg(F.col("x").cast("double")).alias("value"))


def spare_rows(vectors: DataFrame, used: DataFrame, key: str, vector: str, rows: int) -> DataFrame:
    """key, pos, value of ``rows`` more vectors after the largest key: the mean of the vectors that no one uses, zeros if all are used."""
    top = vectors.agg(F.max(key).alias("_top"))
    size = vectors.select(F.size(vector).alias("_n")).limit(1)
    free = vectors.join(used.select(key), key, "left_anti").select(F.posexplode(vector).alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    places = size.select(F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("pos")).join(free, "pos", "left")
    new = vectors.sparkSession.range(1, rows + 1).crossJoin(F.broadcast(top)).select((F.col("_top") + F.col("id")).alias(key))
    return new.crossJoin(F.broadcast(places)).select(key, "pos", F.coalesce("mean", F.lit(0.0)).alias("value"))


def max_abs_diff(pairs: DataFrame, by: str, a: Column, b: Column) -> DataFrame:
    """by, max_abs_diff: the largest difference between the components of two vectors."""
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return pairs.groupBy(by).agg(F.max(F.array_max(gaps)).alias("max_abs_diff"))


def verify(made: DataFrame, recorded: DataFrame, key: str, value: str, tolerance: float = 1e-12) -> DataFrame:
    """key, holds: whether the recorded value is the made one up to the tolerance; a key that one side lacks does not hold."""
    j = made.select(key, F.col(value).alias("_a")).join(recorded.select(key, F.col(value).alias("_b")), key, "full")
    close = F.abs(F.col("_a") - F.col("_b")) <= tolerance * F.greatest(F.abs("_a"), F.abs("_b"))
    return j.select(key, F.coalesce(close, F.lit(False)).alias("holds"))


def survey(texts: DataFrame, by: str) -> DataFrame:
    """The rows with chars_per_token of their group; a group without tokens fails the query."""
    sums = texts.groupBy(by).agg(F.sum("chars").alias("_c"), F.sum("tokens").alias("_t"))
    ratio = F.when(F.col("_t") > 0, F.col("_c") / F.col("_t")).otherwise(F.raise_error(F.lit("a group without tokens")).cast("double"))
    return texts.join(sums.select(F.col(by).alias("_by"), ratio.alias("chars_per_token")), F.col(by).eqNullSafe(F.col("_by"))).drop("_by")


def reproduces(measured: DataFrame, expected: dict[str, float], key: str, value: str, tolerance: float = 1e-9) -> DataFrame:
    """The measured rows; one that is further than the tolerance from what was recorded, or was not measured, fails the query."""
    want = measured.sparkSession.createDataFrame(list(expected.items()), f"{key} string, _want double")
    j = want.join(measured, key, "left")
    ok = F.abs(F.col(value) - F.col("_want")) <= tolerance
    return j.select(key, F.when(ok, F.col(value)).otherwise(F.raise_error(F.concat(F.col(key), F.lit(" does not give its recorded value"))).cast("double")).alias(value))
