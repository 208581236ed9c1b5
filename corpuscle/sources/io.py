"""Readers, sinks and manifests. Every dataset carries an explicit order column; lines end at \\n only."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parquet_texts(spark: SparkSession, paths: list[str], columns: tuple[str, ...] = ("text",)) -> DataFrame:
    """The wanted columns only, with the file that each row came from as its order key."""
    return spark.read.parquet(*paths).select(*columns, F.col("_metadata.file_path").alias("file"))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, corrupt: str | None = None) -> DataFrame:
    """JSON Lines; ``corrupt`` names a column for lines that can't be parsed (a torn last line), else they fail."""
    reader = spark.read.option("lineSep", "\n")
    if corrupt:
        kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        return reader.schema(kind.add(corrupt, "string")).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt).json(path)
    return reader.schema(schema).option("mode", "FAILFAST").json(path)


def corpus_texts(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file, or for .jsonl the text of each record with a blank line after it."""
    if path.endswith(".jsonl"):
        return read_jsonl(spark, path, "text string").select(F.concat("text", F.lit("\n\n")).alias("text"))
    return spark.read.option("lineSep", "\n").text(path).select(F.col("value").alias("text"))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.text(path)


def write_shards(df: DataFrame, path: str, shard: str = "shard") -> None:
    """zstd Parquet, one folder per shard; Spark's committer makes each write whole or absent."""
    df.write.option("compression", "zstd").partitionBy(shard).parquet(path)


def run_files(spark: SparkSession, path: str, schema: str, name_pattern: str) -> DataFrame:
    """Result files with their key groups from the file name as ``key``; a key with two files is refused."""
    df = spark.read.schema(schema).option("recursiveFileLookup", "true").option("multiLine", "true").json(path)
    df = df.withColumn("file", F.col("_metadata.file_path")).withColumn("key", F.regexp_extract("file", name_pattern, 0))
    twice = df.groupBy("key").agg(F.countDistinct("file").alias("n")).filter("n > 1").limit(3).collect()
    if twice:
        raise ValueError(f"more than one file for {[r['key'] for r in twice]}")
    return df


def last_match(column, pattern: str, group: int = 1):
    """The last match of a pattern in a log."""
    return F.element_at(F.regexp_extract_all(column, F.lit(pattern), F.lit(group)), -1)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def verify_manifest(actual: DataFrame, expected: DataFrame, key: str, value: str) -> DataFrame:
    """key, status: ok, changed, missing (expected, not there) or stray (there, not expected)."""
    j = expected.select(key, F.col(value).alias("want")).join(actual.select(key, F.col(value).alias("have")), key, "full")
    status = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "stray").when(F.col("have") == F.col("want"), "ok").otherwise("changed")
    return j.select(key, status.alias("status"))


def last_record_wins(log: DataFrame, key: str, order: str) -> DataFrame:
    """Of an append-only log the last record of each key, by one aggregation."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, *[f"r.{c}" for c in rest])


def tokenizer_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """vocab(token, id) and merges(rank, left, right) of a tokenizer file; refuses what is no byte-level BPE."""
    data = json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
    model = data.get("model", {})
    if model.get("type") != "BPE":
        raise ValueError("not a BPE tokenizer")
    before = data.get("pre_tokenizer") or {}
    steps = before.get("pretokenizers", []) if before.get("type") == "Sequence" else []
    kinds = [s.get("type") for s in steps]
    if kinds.count("Split") != 1 or "ByteLevel" not in kinds:
        raise ValueError("exactly one Split and a ByteLevel step are needed")
    merges = []
    for k, m in enumerate(model["merges"]):
        pair = m.split(" ") if isinstance(m, str) else list(m)
        if len(pair) != 2:
            raise ValueError(f"malformed merge {m!r}")
        merges.append((k, *pair))
    vocab = spark.createDataFrame(sorted(model["vocab"].items(), key=lambda x: x[1]), "token string, id int")
    return vocab, spark.createDataFrame(merges, "rank int, left string, right string")


def run_folders(spark: SparkSession, root: str, pattern: str) -> dict[str, str]:
    """name, folder of the runs below ``root``: files whose path matches ``pattern``, named by its first group; a run found in two folders is refused."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    found = files.select(F.regexp_extract("path", pattern, 1).alias("name"), F.regexp_extract("path", f"^(.*?{pattern})", 1).alias("folder")).filter("name <> ''").distinct()
    out: dict[str, str] = {}
    for name, folder in found.orderBy("name", "folder").collect():
        if out.setdefault(name, folder) != folder:
            raise ValueError(f"two copies of {name}: {out[name]} and {folder}")
    return out


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small result as a table of text, for reports; more than ``most`` rows are refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    cell = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [df.columns, ["-"] * len(df.columns), *([cell(v) for v in r] for r in rows)]
    return "\n".join(f"| {' | '.join(x)} |" for x in lines)
