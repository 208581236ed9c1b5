"""The opN_ queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bagminhash, bpe, langid, mixing, multiindex, pii, quality_mil, quality_rules, secrets, toxicity
from .common import id_remainder, read


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.digests(bpe.encode_decode(read(spark, sf_dir, "documents"), path, pattern))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(read(spark, sf_dir, "documents")).drop("cleaned")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(read(spark, sf_dir, "documents"), secrets.production_network()))


def op4_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(read(spark, sf_dir, "documents")).drop("text_hash")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("mix_tokens").alias("n_tokens"), F.round("mix_probability", 6).alias("probability"), F.col("mix_sampled").alias("sampled"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = read(spark, sf_dir, "documents"), id_remainder("doc_id", 4) == 2
    model = langid.fit(docs, F.coalesce(~held, F.lit(False)))
    return langid.predict(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op7_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = read(spark, sf_dir, "documents"), id_remainder("doc_id", 5) == 0
    model = quality_mil.fit(docs, read(spark, sf_dir, "labels").filter(~held))
    return quality_mil.predict(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")


def op8_toxicity_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = read(spark, sf_dir, "documents"), id_remainder("doc_id", 4) == 2
    model = toxicity.fit(docs, read(spark, sf_dir, "labels").filter(~held))
    return toxicity.predict(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")


def op9_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(read(spark, sf_dir, "documents")))


def op10_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.near_vectors(read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe_codec, op2_quality_rules, op3_secret_scan, op4_bagminhash, op5_mixing, op6_language_id, op7_quality_mil, op8_toxicity_nbsvm, op9_pii_bootstrap, op10_multi_index)}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": quality_rules.ORACLE_SQL, "op5_mixing": mixing.oracle_sql(), "op10_multi_index": multiindex.ORACLE_SQL}
