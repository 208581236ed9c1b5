"""Shared plumbing: table access, shared scratch tables, Arrow batches, hashed grams."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows in one Arrow batch sent to Python: texts may be long, so batches stay small.
ARROW_ROWS = 128


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Fewer rows in a batch for all that the session runs from now on: the option is read when a plan runs."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local one only for a local master."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/checkpoints/corpuscle"


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive lost executors.

    ``drop`` frees a table that nothing reads any more; what the returned result
    still reads stays until the session's owner cleans the folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            path.getFileSystem(conf).delete(path, True)


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value made once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def text_hash(text: Column) -> Column:
    """A 64-bit hash of a text; a null text is the empty one."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo: the fixed folds of the labelled operators."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def doc_view(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, so that other columns can't clash."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def map_texts(df: DataFrame, work, fields: list[T.StructField], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Run ``work(list of texts) -> dict of column -> list or Arrow array`` over Arrow batches.

    Rows keep their ``keep`` columns; a null text reaches ``work`` as None.
    """
    schema = T.StructType([df.schema[k] for k in keep] + fields)
    small_batches(df.sparkSession)
    names = [f.name for f in fields]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            made = work(batch.column("text").to_pylist())
            cols = [batch.column(k) for k in keep] + [made[n] for n in names]
            arrays = [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(cols, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
            del made, cols, arrays, batch
            pa.default_memory_pool().release_unused()

    return df.select(*keep, "text").mapInArrow(run, schema)


def gram_ids(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bucket of each run of n bytes (uint8) or code points (uint32)."""
    size = len(data) - n + 1
    if size <= 0:
        return np.zeros(0, np.int64)
    h = np.full(size, 2166136261 + 977 * n, np.uint32)
    for k in range(n):
        h ^= data[k : k + size]
        h *= np.uint32(16777619)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(32 - bits)).astype(np.int64)


def text_bytes(text: str | None, fold: bool = True) -> np.ndarray:
    """UTF-8 of the text between spaces, white space as one blank, lower case on demand."""
    s = " ".join((text or "").split())
    return np.frombuffer(f" {s.lower() if fold else s} ".encode("utf-8", "replace"), np.uint8)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def platt(score: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope and offset of a logistic fit with smoothed targets (Platt), by Newton steps."""
    pos, neg = float(y.sum()), float(len(y) - y.sum())
    if pos == 0 or neg == 0:
        return 1.0, 0.0
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, float(np.log((pos + 1) / (neg + 1)))
    for _ in range(steps):
        p = sigmoid(a * score + b)
        w = p * (1 - p) + 1e-9
        g = np.array([((p - target) * score).sum() + 1e-3 * (a - 1), (p - target).sum()])
        h = np.array([[(w * score * score).sum() + 1e-3, (w * score).sum()], [(w * score).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-3), b


def bounded_sample(docs: DataFrame, rows: int, max_chars: int, labels: DataFrame | None = None) -> DataFrame:
    """At most ``rows`` rows of ``docs`` (doc_id, text and more), one for each id: the ids of the lowest hashes among texts up to ``max_chars``.

    A repeated id gives its text of the least hash. ``labels`` (doc_id, label), one row an id, restricts the ids and adds
    the label. Only the chosen ids are broadcast: ``rows`` of them at most.
    """
    d = docs.filter(F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") <= max_chars)).withColumn("_hash", text_hash(F.col("text")))
    ids = d.select("doc_id", "_hash") if labels is None else d.select("doc_id", "_hash").join(labels, "doc_id")
    ids = ids.groupBy("doc_id").agg(F.min("_hash").alias("_hash"), *([] if labels is None else [F.max("label").alias("label")]))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return d.join(F.broadcast(ids), ["doc_id", "_hash"]).dropDuplicates(["doc_id"]).drop("_hash")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, max_chars: int) -> DataFrame:
    """A bounded sample of labelled texts: doc_id, text, label.

    ``docs`` has doc_id and text, ``labels`` doc_id and the label; a repeated label row counts as its maximum.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    return bounded_sample(docs, rows, max_chars, known).select("doc_id", "text", "label")
