"""Mixing sources to target weights by iterative proportional fitting.

Token counts of the cells (source, language, topic) are raked until the margins
meet their targets; the cell weights become inclusion probabilities, calibrated
so that the expected tokens meet a budget, and documents are drawn by a hash of
their id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

MARGINS = ("source", "lang", "topic")
#: The name of the missing category, most rounds of raking, and the relative change of a cell in a round that ends them.
MISSING, ROUNDS, CLOSE = "-", 50, 1e-12


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")).cast("long")


def form_topic(text: Column) -> Column:
    """A topic by form, for corpora without a topic column: table, marked, numbers or prose."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.instr(t, " | ") > 0, "table").when(t.rlike("[#$%&*]{3}"), "marked").when(t.rlike("[0-9]{4}"), "numbers").otherwise("prose")


def category(value: Column) -> Column:
    """A category's name in the cells: a real value is marked, so that none is taken for the missing one."""
    return F.when(value.isNull(), MISSING).otherwise(F.concat(F.lit("="), value.cast("string")))


def named(targets: dict[str, dict[str | None, float]]) -> dict[str, dict[str, float]]:
    """Targets by the categories' names; the missing category is None."""
    return {m: {MISSING if k is None else f"={k}": float(v) for k, v in shares.items()} for m, shares in targets.items()}


def rake(cells: pd.DataFrame, targets: dict[str, dict[str, float]], rounds: int = ROUNDS) -> np.ndarray:
    """Weights of the cells (columns source, lang, topic, tokens) whose weighted tokens meet the target shares.

    Each round scales every margin in turn; the rounds end when one changes no cell by more than ``CLOSE``, which is so
    at the fit, or, where the targets contradict each other or the empty cells, in the circle that is left; after
    ``rounds`` at the latest. A category without a target share or without tokens keeps its scale. The weighted tokens
    add up to 1.
    """
    mass, coded = cells["tokens"].to_numpy(float), [(m, *pd.factorize(cells[m])) for m in MARGINS]
    for _ in range(rounds):
        last = mass
        for m, code, names in coded:
            have = np.bincount(code, mass, len(names))
            want = np.array([targets[m].get(x, 0.0) for x in names])
            scale = np.where((have > 0) & (want > 0), want / np.where(have > 0, have, 1), 1.0)
            mass = mass * scale[code]
        if (np.abs(mass - last) <= CLOSE * last).all():
            break
    return mass / mass.sum() if mass.sum() else mass


def tempered(cells: pd.DataFrame, power: float) -> dict[str, dict[str, float]]:
    """Target shares proportional to the tokens of each category raised to ``power``."""
    out = {}
    for m in MARGINS:
        sums = cells.groupby(m)["tokens"].sum().astype(float) ** power
        out[m] = (sums / sums.sum()).to_dict() if sums.sum() else {}
    return out


def probabilities(tokens: np.ndarray, share: np.ndarray, budget: float, rounds: int = 30) -> np.ndarray:
    """min(1, c * share / tokens), with c such that the expected tokens are ``budget``; cells without tokens get the least of the others."""
    rate = np.where(tokens > 0, share / np.where(tokens > 0, tokens, 1), 0.0)
    full = np.zeros(len(tokens), bool)
    c = 0.0
    for _ in range(rounds):
        open_ = (rate * tokens)[~full].sum()
        c = (budget - tokens[full].sum()) / open_ if open_ > 0 else 0.0
        full = full | (c * rate >= 1)
    p = np.where(full, 1.0, np.minimum(1.0, c * rate))
    return np.where(tokens > 0, p, p[tokens > 0].min() if (tokens > 0).any() else 1.0)


def rake_table(cells: DataFrame, targets: dict[str, dict[str, float]] | None, power: float, scratch: Scratch, rounds: int = ROUNDS) -> DataFrame:
    """The cells with their mass: ``rake`` (and ``tempered`` without targets) as joins, one written table a step."""
    spark, want = cells.sparkSession, {}
    for m in MARGINS:
        if targets:
            want[m] = spark.createDataFrame([(k, float(v)) for k, v in targets[m].items()], "name string, want double")
        else:
            sums = cells.groupBy(F.col(m).alias("name")).agg(F.pow(F.sum("tokens").cast("double"), F.lit(float(power))).alias("want"))
            total = sums.agg(F.sum("want")).first()[0] or 0.0
            want[m] = scratch.write(sums.withColumn("want", F.col("want") / total) if total else sums.limit(0), f"want-{m}")
    mass = scratch.write(cells.withColumn("mass", F.col("tokens").cast("double")), "mass")
    for _ in range(rounds):
        start = mass
        for k, m in enumerate(MARGINS):
            have = mass.groupBy(F.col(m).alias("name")).agg(F.sum("mass").alias("have")).join(want[m], "name", "left")
            scale = have.select("name", F.when((F.col("have") > 0) & (F.col("want") > 0), F.col("want") / F.col("have")).otherwise(1.0).alias("scale"))
            last = F.col("mass") if k == 0 else F.col("last")
            scaled = scratch.write(mass.join(scale, F.col(m) == F.col("name")).select(*MARGINS, "tokens", (F.col("mass") * F.col("scale")).alias("mass"), last.alias("last")), "mass")
            if mass is not start:
                scratch.drop(mass)
            mass = scaled
        scratch.drop(start)
        if mass.filter(F.abs(F.col("mass") - F.col("last")) > CLOSE * F.col("last")).isEmpty():
            break
    return mass


def probability_table(mass: DataFrame, budget: float, rounds: int = 30) -> DataFrame:
    """The cells with ``p`` as of ``probabilities``: the cells at 1 are those above a rate, so each round is one aggregation."""
    total = mass.agg(F.sum("mass")).first()[0] or 1.0
    d = mass.withColumn("rate", F.when(F.col("tokens") > 0, F.col("mass") / total / F.col("tokens")).otherwise(0.0))
    c = most = 0.0
    for _ in range(rounds):
        full = F.lit(most) * F.col("rate") >= 1
        open_, taken = d.agg(F.sum(F.when(~full, F.col("rate") * F.col("tokens"))), F.sum(F.when(full, F.col("tokens")))).first()
        last, c = c, (budget - (taken or 0)) / open_ if open_ else 0.0
        most = max(most, c)
        if c == last:
            break
    p = F.when(F.lit(most) * F.col("rate") >= 1, 1.0).otherwise(F.least(F.lit(1.0), F.lit(c) * F.col("rate")))
    d = d.withColumn("p", p)
    least = d.filter("tokens > 0").agg(F.min("p")).first()[0]
    return d.select(*MARGINS, F.when(F.col("tokens") > 0, F.col("p")).otherwise(1.0 if least is None else least).alias("p"))


def uniform(id_col: Column, seed: int) -> Column:
    """A number in [0, 1) from the seed and the id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def mix(docs: DataFrame, topic: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", targets: dict[str, dict[str, float]] | None = None, power: float = 0.7, budget: float = 0.8, seed: int = 17, max_cells: int = 20_000) -> DataFrame:
    """The input columns with mix_tokens, mix_probability and mix_sampled; one row for each input row.

    Targets are shares by margin, with None for the missing category; where none are given they are the tempered
    shares. Every source, language and topic has its own target. Tokens are words. Up to ``max_cells`` cells are raked on
    the driver, more of them by joins in Spark, with the same result. Null and empty texts have no tokens and the least
    probability. Rows that repeat an id are drawn alike; null ids are one id. Columns of the input that are named as
    those added are replaced, all others stay, whatever their names. An empty table gives an empty one.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "mixing")
    added = ("mix_tokens", "mix_probability", "mix_sampled")
    keep = [c for c in docs.columns if c not in added]
    topic = topic if topic is not None else form_topic(F.col(text_col))
    # The input's columns travel in one struct, where no helper's name can meet theirs.
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), *[category(c).alias(m) for m, c in zip(MARGINS, (F.col(source_col), F.col(lang_col), topic), strict=True)], n_words(F.col(text_col)).alias("tokens"))
    counts = scratch.write(d.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")), "cells")
    targets = named(targets) if targets else None
    small = counts.count() <= max_cells
    if small:
        cells = counts.toPandas().sort_values(list(MARGINS)).reset_index(drop=True)
        share = rake(cells, targets or tempered(cells, power))
        p = probabilities(cells["tokens"].to_numpy(float), share, budget * float(cells["tokens"].sum()))
        table = [(*map(str, key), float(v)) for key, v in zip(cells[list(MARGINS)].itertuples(index=False), p, strict=True)]
        lookup = spark.createDataFrame(table, "s string, l string, t string, p double")
    else:
        mass = rake_table(counts, targets, power, scratch)
        total = float(counts.agg(F.sum("tokens")).first()[0])
        lookup = scratch.write(probability_table(mass, budget * total).toDF("s", "l", "t", "p"), "probability")
    out = d.join(F.broadcast(lookup) if small else lookup, (F.col("source") == F.col("s")) & (F.col("lang") == F.col("l")) & (F.col("topic") == F.col("t")))
    return out.select(*[F.col("row")[c].alias(c) for c in keep], F.col("tokens").alias("mix_tokens"), F.col("p").alias("mix_probability"), (uniform(F.col("row")[id_col], seed) < F.col("p")).alias("mix_sampled"))


def oracle_sql(power: float = 0.7, budget: float = 0.8, seed: int = 17, rounds: int = 20, fills: int = 30) -> str:
    """The same rows in DuckDB SQL, each round a common table expression; ``rounds`` are enough for the cells to stand still."""
    topic = "CASE WHEN instr(t, ' | ') > 0 THEN 'table' WHEN regexp_matches(t, '[#$%&*]{3}') THEN 'marked' WHEN regexp_matches(t, '[0-9]{4}') THEN 'numbers' ELSE 'prose' END"
    ctes = [
        "d0 AS (SELECT doc_id, coalesce('=' || source, '-') AS source, coalesce('=' || lang, '-') AS lang, coalesce(text, '') AS t FROM documents)",
        f"d AS (SELECT doc_id, source, lang, {topic} AS topic, CAST(len(list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS BIGINT) AS n FROM d0)",
        "c AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n) AS DOUBLE) AS tokens FROM d GROUP BY ALL)",
    ]
    for m in MARGINS:
        ctes.append(f"t_{m} AS (SELECT {m}, pow(s, CAST({power} AS DOUBLE)) / sum(pow(s, CAST({power} AS DOUBLE))) OVER () AS want FROM (SELECT {m}, sum(tokens) AS s FROM c GROUP BY {m}))")
    last, k = "(SELECT *, tokens AS mass FROM c)", 0
    for _ in range(rounds):
        for m in MARGINS:
            k += 1
            ctes.append(f"r{k} AS MATERIALIZED (SELECT x.source, x.lang, x.topic, x.tokens, CASE WHEN h.have > 0 AND t.want > 0 THEN x.mass * (t.want / h.have) ELSE x.mass END AS mass FROM {last} x JOIN (SELECT {m}, sum(mass) AS have FROM {last} GROUP BY {m}) h USING ({m}) JOIN t_{m} t USING ({m}))")
            last = f"r{k}"
    ctes.append(f"f0 AS MATERIALIZED (SELECT source, lang, topic, tokens, CASE WHEN tokens > 0 THEN mass / sum(mass) OVER () / tokens ELSE 0 END AS rate, false AS done, CAST(0 AS DOUBLE) AS c FROM {last})")
    total = f"CAST({budget} AS DOUBLE) * (SELECT sum(tokens) FROM c)"
    for k in range(1, fills + 1):
        ctes.append(f"q{k} AS MATERIALIZED (SELECT CASE WHEN sum(rate * tokens) FILTER (NOT done) > 0 THEN ({total} - coalesce(sum(tokens) FILTER (done), 0)) / (sum(rate * tokens) FILTER (NOT done)) ELSE 0 END AS c FROM f{k - 1})")
        ctes.append(f"f{k} AS MATERIALIZED (SELECT source, lang, topic, tokens, rate, done OR q{k}.c * rate >= 1 AS done, q{k}.c AS c FROM f{k - 1}, q{k})")
    ctes.append(f"p0 AS (SELECT *, CASE WHEN done THEN CAST(1 AS DOUBLE) ELSE least(CAST(1 AS DOUBLE), c * rate) END AS p FROM f{fills})")
    ctes.append("p AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN p ELSE (SELECT min(p) FROM p0 WHERE tokens > 0) END AS p FROM p0)")
    u = f"CAST(CAST(('0x' || substr(md5('{seed}|' || CAST(doc_id AS VARCHAR)), 1, 13)) AS BIGINT) AS DOUBLE) / 4503599627370496.0"
    return "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, n AS n_tokens, round(p, 6) AS probability, {u} < p AS sampled FROM d JOIN p USING (source, lang, topic)"
