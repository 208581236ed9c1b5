"""Model scoring: a scorer gives nats for words; the built-in one is an add-one unigram model made by an aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions.text import WORDS, first_max


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))


def unigram_model(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word, n of a corpus."""
    return docs.select(F.explode(words(F.col(text_col))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def unigram_nats(docs: DataFrame, key: str, model: DataFrame, text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """key, nats, tokens of each text with a word; words of a text are counted before they meet the model."""
    total = model.agg((F.sum("n") + F.count("*")).alias("total"))
    t = docs.select(key, *extra, F.explode(words(F.col(text_col))).alias("word")).groupBy(key, *extra, "word").agg(F.count("*").alias("c"))
    j = t.join(model, "word", "left").crossJoin(F.broadcast(total))
    nats = -F.ln((F.coalesce("n", F.lit(0)) + 1) / F.col("total").cast("double"))
    return j.groupBy(key, *extra).agg(F.sum(F.col("c") * nats).alias("nats"), F.sum("c").alias("tokens"))


def items(raw: DataFrame, key: str, context: str, choices: str, gold: str) -> DataFrame:
    """Multiple-choice items: each choice with one leading blank; a gold out of range, a blank choice or under two choices fails."""
    trimmed = F.transform(choices, lambda c: F.concat(F.lit(" "), F.trim(c)))
    good = (F.size(choices) >= 2) & F.col(gold).between(0, F.size(choices) - 1) & F.forall(choices, lambda c: F.trim(c) != "")
    return raw.select(key, context, F.when(good, trimmed).otherwise(F.raise_error(F.lit("malformed item")).cast("array<string>")).alias(choices), gold)


def score_items(mc: DataFrame, key: str, model: DataFrame) -> DataFrame:
    """key, correct_sum, correct_char: the choice of largest log-probability, and of largest per character; first on ties."""
    c = mc.select(key, "gold", F.posexplode("choices").alias("pos", "choice"))
    n = unigram_nats(c, key, model, "choice", ("pos",))
    j = c.join(n, [key, "pos"], "left").withColumn("lp", -F.coalesce("nats", F.lit(0.0)))
    row = F.struct("pos", F.round("lp", 4).alias("lp"), F.round(F.col("lp") / F.length("choice"), 6).alias("lc"))
    s = j.groupBy(key, "gold").agg(F.array_sort(F.collect_list(row)).alias("r"))
    pick = lambda f: first_max(F.transform("r", lambda x: x[f])) == F.col("gold")
    return s.select(key, pick("lp").alias("correct_sum"), pick("lc").alias("correct_char"))
