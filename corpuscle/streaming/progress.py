"""Resumable progress: done items, run signatures, exactly-once streams of files."""

from __future__ import annotations

import hashlib
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.operators.corpus import draw, order_digest, unit_parts


def remaining(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items that no earlier call finished."""
    return items.join(done.select(key), key, "left_anti")


def signature(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def guard(spark: SparkSession, folder: str, config: dict) -> None:
    """Writes the run's signature to a new folder; refuses a folder of another run."""
    path = f"{folder}/signature"
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(fs_path):
        have = spark.read.text(path).first()[0]
        if have != signature(config):
            raise ValueError(f"{folder} belongs to a run with other settings")
    else:
        spark.createDataFrame([(signature(config),)], "value string").coalesce(1).write.text(path)


def resume_stream(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, transform, max_files: int = 100):
    """Transform new Parquet files into the sink, exactly once: the checkpoint remembers what was read.

    Each call handles what is there and stops, so a later call continues and a longer run starts as the shorter did.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    query = transform(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def truncate_log(log: DataFrame, step: str, upto: int) -> DataFrame:
    """The log as it was at a checkpoint."""
    return log.filter(f"{step} < {int(upto)}")


def file_system(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Hadoop has them."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


class Lock:
    """One writer for a folder: the lock file is made whole or not at all, and goes with the block."""

    def __init__(self, spark: SparkSession, folder: str):
        self.fs, self.path = file_system(spark, f"{folder}/.writer")
        self.folder = folder

    def __enter__(self):
        try:
            self.fs.create(self.path, False).close()
        except Exception as error:
            raise RuntimeError(f"another process writes into {self.folder}") from error
        return self

    def __exit__(self, *_):
        self.fs.delete(self.path, False)


MANIFEST = "part int, units array<long>, docs long, skipped long, chars long, digest string, seed long, source string"


def read_parts(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of a stream's parts; empty where there is none."""
    fs, path = file_system(spark, f"{folder}/manifest")
    return spark.read.schema(MANIFEST).json(f"{folder}/manifest") if fs.exists(path) else spark.createDataFrame([], MANIFEST)


def part_digest(part: DataFrame) -> str:
    """A digest of a part's positions and texts in their order."""
    return order_digest(part, "pos", F.concat_ws("\n", F.col("pos").cast("string"), F.col("text"))).first()["digest"]


def extend_parts(spark: SparkSession, docs: DataFrame, folder: str, seed: int, source: str, part_chars: int, max_chars: int, held_out: DataFrame | None = None, deadline: float | None = None) -> DataFrame:
    """Writes the parts of a seeded stream that are not there yet, and returns the manifest.

    ``docs`` has unit (integer), doc and text. Units come in the seed's order, a unit's documents in an order of the
    seed and the unit; a part closes at a unit end once it has ``part_chars``, the last one where the stream has
    ``max_chars``, and a longer stream goes on after the parts of a shorter one. Texts whose digest ``held_out`` has are skipped. A folder of another seed
    or source, and a part that changed since it was written, are refused; a part that the manifest does not name (one
    left by a crash) is written anew. After each part its line is added; past the ``deadline`` (of time.monotonic) the
    next call goes on. Too little text is refused.
    """
    with Lock(spark, folder):
        done = sorted(read_parts(spark, folder).collect(), key=lambda r: r["part"])
        if any((r["seed"], r["source"]) != (seed, source) for r in done):
            raise ValueError(f"{folder} holds the stream of another seed or source")
        for r in done:
            if part_digest(spark.read.parquet(f"{folder}/part={r['part']}")) != r["digest"]:
                raise ValueError(f"part {r['part']} of {folder} changed since it was written")
        d = docs.withColumn("hash", F.sha2(F.col("text").cast("binary"), 256))
        d = d.withColumn("skip", F.lit(False)) if held_out is None else d.join(held_out.select(F.col("digest").alias("hash"), F.lit(True).alias("skip")).distinct(), "hash", "left")
        d = d.withColumn("skip", F.coalesce("skip", F.lit(False)))
        sizes = d.groupBy("unit").agg(F.coalesce(F.sum(F.when(~F.col("skip"), F.length("text"))), F.lit(0)).alias("size"))
        # One row for each unit: what the driver holds grows with files, not with documents.
        total, read = sum(r["chars"] for r in done), {u for r in done for u in r["units"]}
        order = [r["unit"] for r in sizes.select("unit").orderBy(draw(seed, "unit"), "unit").collect() if r["unit"] not in read]
        wanted: dict[int, list[int]] = {}
        if total < max_chars and order:
            units = sizes.join(spark.createDataFrame(list(enumerate(order)), "place long, unit long"), "unit")
            for r in unit_parts(units, "place", "size", part_chars, max_chars - total).join(units, "place").orderBy("place").collect():
                wanted.setdefault(len(done) + r["part"], []).append(r["unit"])
                total += r["size"]
        for number in sorted(wanted):
            if deadline is not None and time.monotonic() >= deadline:
                return read_parts(spark, folder)
            mine = d.join(F.broadcast(spark.createDataFrame(list(enumerate(wanted[number])), "k long, unit long")), "unit")
            rows = mine.filter("not skip").withColumn("at", draw(seed, "unit", "doc"))
            rows = rows.select(F.row_number().over(order_of("k", "at", "doc")).cast("long").alias("pos"), "unit", "doc", "text")
            rows.write.mode("overwrite").parquet(f"{folder}/part={number}")
            written = spark.read.parquet(f"{folder}/part={number}")
            n, chars = written.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
            line = (number, wanted[number], n, mine.filter("skip").count(), chars, part_digest(written), seed, source)
            spark.createDataFrame([line], MANIFEST).coalesce(1).write.mode("append").json(f"{folder}/manifest")
        if total < max_chars:
            raise ValueError(f"the source holds only {total} characters, {max_chars} are wanted")
        return read_parts(spark, folder)


def order_of(*columns: str):
    from pyspark.sql import Window

    return Window.orderBy(*columns)


def pack_resumed(docs: DataFrame, pos: str, tokens: str, eos: str, batch: int, seq_len: int, state: dict | None = None) -> tuple[DataFrame, dict]:
    """Whole batches (batch_id, row_id, col, token) of the documents after those that ``state`` read, and the state after them.

    The state is plain JSON: the position read last and the tokens left over (fewer than a batch). They come first, so
    that a resumed packing gives the batches that an uninterrupted one would.
    """
    from corpuscle.operators.bpe import pack

    if seq_len < 2 or batch < 1:
        raise ValueError(f"sequence length {seq_len} and batch {batch} must be at least 2 and 1")
    state = state or {"position": None, "left": [], "batches": 0}
    spark = docs.sparkSession
    d = docs.select(F.col(pos).cast("long").alias(pos), F.concat(F.col(tokens), F.array(F.lit(eos))).alias(tokens))
    if state["position"] is not None:
        d = d.filter(F.col(pos) > state["position"])
    first, last = d.agg(F.min(pos), F.max(pos)).first()
    if first is None:
        return spark.createDataFrame([], "batch_id long, row_id long, col long, token string"), state
    if state["left"]:
        d = spark.createDataFrame([(first - 1, state["left"])], f"{pos} long, {tokens} array<string>").unionByName(d)
    size = batch * seq_len
    packed = pack(d, pos, tokens, None, batch, seq_len).withColumn("batch_id", F.col("batch_id") + state["batches"])
    total = d.agg(F.sum(F.size(tokens))).first()[0]
    whole = total // size
    tail, have = [], 0
    for r in d.select(pos, tokens).orderBy(F.desc(pos)).toLocalIterator():
        if have >= total - whole * size:
            break
        tail, have = r[tokens] + tail, have + len(r[tokens])
    return packed, {"position": last, "left": tail[len(tail) - (total - whole * size) :] if total > whole * size else [], "batches": state["batches"] + whole}


def committed(spark: SparkSession, rows: DataFrame, log: str, key: str) -> int:
    """Adds to a log the rows whose key it does not have, in one commit; how many."""
    fs, path = file_system(spark, log)
    new = remaining(rows, spark.read.parquet(log), key) if fs.exists(path) else rows
    n = new.count()
    if n:
        new.write.mode("append").parquet(log)
    return n
