"""Corpus operators: dedup, decontamination, samples, splits, order and parts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions.text import digest, eval_text

#: Ids in one bucket of a running sum: a task orders that many rows at most, if ids are dense.
BUCKET = 1 << 16


def running_sum(df: DataFrame, pos: str, value: Column, out: str, bucket: int = BUCKET) -> DataFrame:
    """Adds the sum of ``value`` over all rows up to this one in the order of the integer ``pos``.

    Two levels: sums within buckets of positions run in parallel, and only one row per bucket
    passes through the single ordered window.
    """
    d = df.withColumn("_b", F.floor(F.col(pos) / bucket)).withColumn("_v", value)
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = d.groupBy("_b").agg(F.sum("_v").alias("_t")).select("_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_o"))
    inner = Window.partitionBy("_b").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return d.join(offsets, "_b").withColumn(out, (F.sum("_v").over(inner) + F.col("_o")).cast("long")).drop("_b", "_v", "_o")


def exact_dedup(df: DataFrame, key: Column, pos: str) -> DataFrame:
    """The first row of each key in source order, by one aggregation with map-side combining."""
    rest = [c for c in df.columns if c != pos]
    first = df.groupBy(key.alias("_k")).agg(F.min(F.col(pos)).alias(pos), F.min_by(F.struct(*rest), F.col(pos)).alias("_r"))
    return first.select(pos, *[f"_r.{c}" for c in rest]).select(*df.columns)


def held_out_keys(*sets: DataFrame) -> DataFrame:
    """Digests of all texts of the sets."""
    out = None
    for s in sets:
        k = s.select(digest(F.col("text")).alias("digest"))
        out = k if out is None else out.unionByName(k)
    return out.distinct()


def decontaminate(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Documents whose text and whose cut are both not held out. Catalyst broadcasts the keys if they are small."""
    d = docs.withColumn("_a", digest(F.col("text"))).withColumn("_b", digest(eval_text(F.col("text"))))
    k = keys.select("digest")
    return d.join(k, d["_a"] == k["digest"], "left_anti").join(k, F.col("_b") == F.col("digest"), "left_anti").drop("_a", "_b")


def draw(seed: int | str, *cols: str) -> Column:
    """A reproducible order: md5 of the seed and the ids."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]).cast("binary"))


def enough(df: DataFrame, n: int) -> DataFrame:
    """The frame itself; refuses one with fewer than ``n`` rows, of which no more are read."""
    have = df.limit(n).count()
    if have < n:
        raise ValueError(f"only {have} usable documents, {n} needed")
    return df


def sample(df: DataFrame, n: int, seed: int, pos: str) -> DataFrame:
    """n rows without replacement, in source order; which ones depends on seed and id alone. Too few rows are refused."""
    return enough(df, n).orderBy(draw(seed, pos), pos).limit(n).orderBy(pos)


def first_rows(df: DataFrame, n: int, pos: str, last: bool = False) -> DataFrame:
    """The first (or last) n rows in source order; too few rows are refused."""
    return enough(df, n).orderBy(F.desc(pos) if last else F.asc(pos)).limit(n)


def batches(df: DataFrame, size: Column, pos: str, rows: int) -> DataFrame:
    """Adds batch: rows of like size together, ``rows`` a batch, so that little is padded. Equal sizes go by pos."""
    from .stats import ranked

    d = ranked(df.withColumn("_size", size), "_size", pos, "_rank")
    return d.withColumn("batch", F.floor(F.col("_rank") / rows).cast("long")).drop("_size", "_rank")


def order_digest(df: DataFrame, pos: str, value: Column, bucket: int = BUCKET) -> DataFrame:
    """digest, n: one digest of all values in the order of the integer ``pos``.

    It is the digest of the digests of runs of positions, so that a run is hashed in its own task and one line
    for each run, not for each row, meets in the last.
    """
    lines = lambda key, h: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, h))), lambda x: x["h"]), "\n").cast("binary"), 256)
    d = df.select(F.col(pos).alias("p"), F.floor(F.col(pos) / bucket).alias("b"), F.sha2(value.cast("binary"), 256).alias("h"))
    runs = d.groupBy("b").agg(lines("p", "h").alias("h"), F.count("*").alias("n"))
    return runs.agg(lines("b", "h").alias("digest"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def budget_split(df: DataFrame, pos: str, size: Column, first_budget: int, middle_rows: int, last_budget: int) -> DataFrame:
    """Adds split: first until its budget is reached (the row that crosses it is in), then rows, then the last until its budget."""
    d = running_sum(df.withColumn("_s", size), pos, F.col("_s"), "_c")
    d = d.withColumn("_first", F.col("_c") - F.col("_s") < first_budget)
    d = running_sum(d, pos, F.when(F.col("_first"), 0).otherwise(1), "_r")
    d = d.withColumn("_mid", ~F.col("_first") & (F.col("_r") <= middle_rows))
    d = running_sum(d, pos, F.when(F.col("_first") | F.col("_mid"), 0).otherwise(F.col("_s")), "_l")
    last = ~F.col("_first") & ~F.col("_mid") & (F.col("_l") - F.col("_s") < last_budget)
    split = F.when(F.col("_first"), "first").when(F.col("_mid"), "middle").when(last, "last")
    return d.withColumn("split", split).drop("_s", "_c", "_first", "_mid", "_r", "_l")


def in_order(df: DataFrame, pos: str, schema: str, fold) -> DataFrame:
    """``fold(positions, sizes, state) -> (numbers, state)`` over all rows in the order of ``pos``, some thousand at a time.

    What a row gets depends on all rows before it, so the pairs of position and size (16 bytes a row, no texts) pass
    through one sorted stream; it holds one batch and a few numbers, and spills while it sorts.
    """

    def run(frames):
        state = None
        for f in frames:
            numbers, state = fold(f["pos"].to_numpy(), f["size"].to_numpy(), state)
            yield pd.DataFrame({"pos": f["pos"], "number": numbers})

    return df.repartition(1).sortWithinPartitions("pos").mapInPandas(run, "pos long, number long").filter("number >= 0").toDF(*schema.split())


def closed_after(sizes, held: int, number: int, limit: int) -> tuple[list[int], int, int]:
    """The number of each row's part, what the open part holds, and its number: a part closes after the row that brings it to ``limit``."""
    total, out, a = sizes.cumsum(), [], 0
    while a < len(sizes):
        before = int(total[a - 1]) if a else 0
        # The first row at which the part is full, found in the running sums.
        b = int(total.searchsorted(before + limit - held))
        end = min(b + 1, len(sizes))
        out += [number] * (end - a)
        if b < len(sizes):
            number, held = number + 1, 0
        else:
            held += int(total[-1]) - before
        a = end
    return out, held, number


def shard_assign(df: DataFrame, pos: str, size: Column, limit: int) -> DataFrame:
    """pos, shard: a shard closes after the row that brings it to ``limit``."""

    def fold(_, sizes, state):
        out, held, number = closed_after(sizes, *(state or (0, 0)), limit)
        return out, (held, number)

    return in_order(df.select(F.col(pos).cast("long").alias("pos"), size.cast("long").alias("size")), pos, f"{pos} shard", fold)


def shard_names(shards: DataFrame, shard: str = "shard", validation: int | None = None) -> DataFrame:
    """Adds name: shards by number, the validation shard by one that sorts after all others."""
    number = F.col(shard) if validation is None else F.when(F.col(shard) == validation, 99_999).otherwise(F.col(shard))
    return shards.withColumn("name", F.format_string("shard_%05d", number.cast("long")))


def unit_parts(units: DataFrame, order: str, size: str, part_limit: int, total_limit: int) -> DataFrame:
    """order, part of the units kept: a part closes at a unit end once it has ``part_limit`` or the total ``total_limit``.

    One row per unit (a row group of a file) passes through the ordered stream, not one per document.
    """

    def fold(_, sizes, state):
        held, part, total = state or (0, 0, 0)
        before = total + sizes.cumsum() - sizes
        kept = int((before < total_limit).sum())
        out, held, part = closed_after(sizes[:kept], held, part, part_limit)
        return out + [-1] * (len(sizes) - kept), (held, part, total + int(sizes.sum()))

    return in_order(units.select(F.col(order).cast("long").alias("pos"), F.col(size).cast("long").alias("size")), order, f"{order} part", fold)


def contiguity(df: DataFrame, pos: str, *by: str) -> DataFrame:
    """Whether the positions of each group are one block without gaps."""
    return df.groupBy(*by).agg((F.max(pos) - F.min(pos) + 1 == F.countDistinct(pos)).alias("contiguous"))
