"""The training-data pipeline over documents: each stage reads all rows that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm import bagminhash, bpe, mixing, pii, quality_mil
from corpuscle.llm.common import Scratch, id_remainder, read, text_hash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents to drop up to this count are broadcast (16 bytes each); beyond it the same join shuffles.
BROADCAST_IDS = 2_000_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality_mil.fit(docs, read(spark, sf_dir, "labels").filter(id_remainder("doc_id", 5) != 0))
    return quality_mil.accepted(docs.select(*COLUMNS), model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of least id.

    A document is its id and its text, so a text stays whatever other rows share its id. Of rows that
    repeat both one stays, that of the least other columns; empty texts all stay.
    """
    found = bagminhash.near_duplicates(docs).groupBy(F.col("doc_id").alias("id_"), F.col("text_hash").alias("hash_")).agg(F.min("kept").alias("kept"), F.count("*").alias("n"))
    empty = F.col("hash_") == text_hash(F.lit(""))
    marked = Scratch(spark, "pipeline").write(found.filter(~F.col("kept") | ((F.col("n") > 1) & ~empty)), "marked")
    total, repeated = marked.agg(F.count("*"), F.count_if("kept")).first()
    side = F.broadcast(marked) if total <= BROADCAST_IDS else marked
    d = docs.select(*COLUMNS, text_hash(F.col("text")).alias("text_hash_"))
    same = (F.col("text_hash_") == F.col("hash_")) & F.col("doc_id").eqNullSafe(F.col("id_"))
    stay = d.join(side, same, "left_anti").select(*COLUMNS)
    if not repeated:
        return stay
    rest = [c for c in COLUMNS if c != "doc_id"]
    several = d.join(side.filter("kept"), same, "left_semi").groupBy("doc_id", "text_hash_").agg(F.min(F.struct(*rest)).alias("row"))
    return stay.unionByName(several.select("doc_id", *[F.col("row")[c].alias(c) for c in rest]))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their personal data masked; a null text becomes the empty text."""
    found = pii.find(docs, keep=("lang", "source", "n_chars"))
    out = found.withColumn("text", pii.masked(F.col("text"), F.col("spans")))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights of source, language and topic."""
    return mixing.mix(docs.select(*COLUMNS)).filter("mix_sampled").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded bytes."""
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.digests(bpe.encode_decode(docs, path, pattern))


STAGES = [("quality classifier", quality), ("near duplicates", near_duplicates), ("personal data", personal_data), ("mixing", mix), ("tokens", encode)]

#: Classifier, signatures and merges have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table documents; every stage before it is written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.write(docs, name.replace(" ", "-"))
    return docs
