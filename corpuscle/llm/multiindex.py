"""Near-duplicate vectors by an inverted multi-index.

Two codebooks, one for each half of the unit vectors, make a product grid of
cells. A vector is stored in its nearest cell and asks the nearest cells in the
order of the multi-sequence traversal, as many as reach the target recall for
neighbours right at the threshold. What a cell holds and what asks it are
compared in double precision, in blocks. Holders travel with the cells that they
ask, askers with their home alone: enough to count a pair once.
"""

from __future__ import annotations

import hashlib
import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, small_batches
from .graph import components


#: Rows in a cell that the codebooks aim at; rows of a block; cells whose sizes are broadcast (24 bytes each).
CELL, BLOCK, BROADCAST_CELLS = 512, 1024, 500_000


@dataclass
class Grid:
    left: np.ndarray
    right: np.ndarray
    visits: int

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of the two halves of each row to the codebooks."""
        k = self.left.shape[1]
        return square(x[:, :k], self.left), square(x[:, k:], self.right)

    def cells(self, x: np.ndarray, visits: int | None = None) -> np.ndarray:
        """The cells that each row asks, nearest first; the first is its home."""
        d1, d2 = self.halves(x)
        n = min(visits or self.visits, d1.shape[1] * d2.shape[1])
        o1, o2 = np.argsort(d1, 1, kind="stable"), np.argsort(d2, 1, kind="stable")
        return np.array([traverse(d1[i], d2[i], o1[i], o2[i], n) for i in range(len(x))], np.int64).reshape(len(x), n)


def square(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


def traverse(d1: np.ndarray, d2: np.ndarray, o1: np.ndarray, o2: np.ndarray, n: int) -> list[int]:
    """Multi-sequence traversal: the n cells of least summed distance, by a heap over the two sorted lists."""
    width, out = len(d2), []
    heap, seen = [(d1[o1[0]] + d2[o2[0]], 0, 0)], {(0, 0)}
    while heap and len(out) < n:
        _, i, j = heapq.heappop(heap)
        out.append(int(o1[i]) * width + int(o2[j]))
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(o1) and b < len(o2) and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (d1[o1[a]] + d2[o2[b]], a, b))
    return out


def codebook(x: np.ndarray, k: int, seed: int, steps: int = 12) -> np.ndarray:
    """k-means; an empty centre takes the row farthest from its own."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(steps):
        d = square(x, c)
        near = d.argmin(1)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        if (n == 0).any():
            far = np.argsort(-d[np.arange(len(x)), near])[: (n == 0).sum()]
            c[n == 0] = x[far]
    return c


def fit(sample: np.ndarray, rows: int, threshold: float, recall: float = 0.99, cell: int = CELL, least: int = 8, seed: int = 1) -> Grid:
    """Codebooks for about ``cell`` rows a cell, ``least`` words each at the least, and the visits that reach ``recall``.

    Recall is measured on neighbours made at exactly the threshold, in random directions: a pair
    is found if either end asks the home of the other. Closer neighbours are found more surely.
    """
    half = max(1, sample.shape[1] // 2)
    k = int(np.clip(round(np.sqrt(rows / cell)), least, 1024))
    grid = Grid(codebook(sample[:, :half], k, seed), codebook(sample[:, half:], k, seed + 1) if sample.shape[1] > half else np.zeros((1, 0)), 1)
    rng = np.random.default_rng(seed + 2)
    x = sample[rng.choice(len(sample), min(1000, len(sample)), replace=False)]
    noise = rng.normal(size=x.shape)
    noise -= (noise * x).sum(1)[:, None] * x
    noise /= np.maximum(np.linalg.norm(noise, axis=1), 1e-12)[:, None]
    y = threshold * x + np.sqrt(1 - threshold**2) * noise
    every = len(grid.left) * len(grid.right)
    rank = lambda asks, home: np.where((hit := asks == home[:, None]).any(1), hit.argmax(1), len(asks[0]))
    most = min(every, 512)
    while True:
        a, b = grid.cells(x, most), grid.cells(y, most)
        reached = np.quantile(np.minimum(rank(a, b[:, 0]), rank(b, a[:, 0])), recall, method="higher")
        if reached < most:
            grid.visits = int(reached) + 1
            return grid
        if most == every:
            raise RuntimeError(f"recall {recall} is not reached in all {every} cells")
        most = min(2 * most, every)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def keyed(df: DataFrame) -> DataFrame:
    """vec_id, key, vector: key is a digest of the components; both null for vectors that link with nothing."""
    kind = df.schema["vector"].dataType.elementType
    arrow = pa.float32() if isinstance(kind, T.FloatType) else pa.float64()

    def run(batches):
        for batch in batches:
            keys, vectors = [], []
            for v in batch.column("vector").to_pylist():
                ok = v is not None and len(v) > 0 and None not in v
                x = np.array(v, np.float64) + 0.0 if ok else None
                ok = ok and bool(np.isfinite(x).all()) and bool(x.any())
                keys.append(hashlib.md5(x.tobytes()).digest() if ok else None)
                vectors.append(x.tolist() if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(vectors, pa.list_(arrow))], names=["vec_id", "key", "vector"])

    schema = T.StructType([df.schema["vec_id"], T.StructField("key", T.BinaryType()), T.StructField("vector", T.ArrayType(kind))])
    return df.mapInArrow(run, schema)


def matrix(column) -> np.ndarray:
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    return flat.reshape(len(column), -1)


def asked(classes: DataFrame, grid: Grid) -> DataFrame:
    """key, n, vector, asks: the cells that each vector asks, its home first."""
    shared = classes.sparkSession.sparkContext.broadcast(grid)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                cells = shared.value.cells(unit(matrix(batch.column("vector"))))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(cells), pa.list_(pa.int64()))], names=[*batch.schema.names, "asks"])

    classes = classes.select("key", "n", "vector")
    return classes.mapInArrow(run, T.StructType([*classes.schema.fields, T.StructField("asks", T.ArrayType(T.LongType()))]))


def block_pairs(keys: list[bytes], n: np.ndarray, x: np.ndarray, asks: np.ndarray, home: np.ndarray, holders: np.ndarray, askers: np.ndarray, cell: int, threshold: float):
    """Links between holders and askers of one cell: (links of each row, connecting pairs of rows).

    ``asks`` has the cells that holders ask. A pair that meets in two cells counts in that of the end with the lesser key alone.
    """
    sim = x[holders] @ x[askers].T
    i, j = np.nonzero(sim >= threshold)
    i, j = holders[i], askers[j]
    rank = np.empty(len(keys), np.int64)
    rank[sorted(range(len(keys)), key=keys.__getitem__)] = np.arange(len(keys))
    i, j = i[i != j], j[i != j]
    apart = home[j] != cell
    twice = apart & (rank[j] < rank[i])
    twice[twice] = (asks[i[twice]] == home[j[twice]][:, None]).any(1)
    i, j, apart = i[~twice], j[~twice], apart[~twice]
    links = np.bincount(i, n[j], len(keys)) + np.bincount(j[apart], n[i[apart]], len(keys))
    root = np.arange(len(keys))
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            break
        root = low
    return links, [(k, r) for k, r in enumerate(root) if k != r]


def compare(cells: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """key, links, u, v: link counts (u null) and connecting pairs (key null) of every cell, in blocks of holders and askers."""
    spark = cells.sparkSession
    visits = cells.select(F.posexplode("asks").alias("place", "cell"))
    sizes = visits.groupBy("cell").agg(F.ceil(F.count_if(F.col("place") == 0) / block).alias("holds"), F.ceil(F.count("*") / block).alias("askers")).filter("holds > 0")
    sizes = Scratch(spark, "multi-index").write(sizes, "sizes")
    side = F.broadcast(sizes) if sizes.count() <= BROADCAST_CELLS else sizes
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hold, ask = F.pmod(F.xxhash64("key", F.lit(1)), F.col("holds")), F.pmod(F.xxhash64("key", F.lit(2)), F.col("askers"))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = cells.withColumn("cell", F.get("asks", F.lit(0))).join(side, "cell")
    own = own.select("cell", "askers", hold.alias("h"), upto("askers").alias("a"), F.lit(True).alias("holder"), "key", "n", "vector", "asks")
    other = cells.select("key", "n", "vector", F.slice("asks", 1, 1).alias("asks"), F.explode("asks").alias("cell")).join(side, "cell")
    other = other.select("cell", "askers", upto("holds").alias("h"), ask.alias("a"), F.lit(False).alias("holder"), "key", "n", "vector", "asks")
    # The blocks of a cell go round the tasks, from a place of the cell's own.
    task = F.pmod(F.pmod(F.xxhash64("cell"), F.lit(tasks)) + F.col("h") * F.col("askers") + F.col("a"), F.lit(tasks)).cast("int")
    rows = own.unionByName(other).repartitionById(tasks, task).drop("askers").sortWithinPartitions("cell", "h", "a")

    def run(batches):
        now, held = None, []

        def done():
            place = {}
            for r in held:
                if r[0] or r[1] not in place:
                    place[r[1]] = r
            keys = list(place)
            index = {k: i for i, k in enumerate(keys)}
            holders = np.array([index[r[1]] for r in held if r[0]], np.int64)
            askers = np.array([index[r[1]] for r in held if not r[0]], np.int64)
            if not len(holders) or not len(askers):
                return None
            n = np.array([place[k][2] for k in keys], np.float64)
            asks = np.full((len(keys), max(len(place[k][4]) for k in keys)), -1, np.int64)
            for i, k in enumerate(keys):
                asks[i, : len(place[k][4])] = place[k][4]
            links, pairs = block_pairs(keys, n, unit(np.array([place[k][3] for k in keys], np.float64)), asks, asks[:, 0], holders, askers, now[0], threshold)
            some = np.flatnonzero(links)
            void, count = [None] * len(pairs), len(some)
            return pa.RecordBatch.from_arrays(
                [pa.array([keys[k] for k in some] + void, pa.binary()), pa.array([int(v) for v in links[some]] + void, pa.int64()), pa.array([None] * count + [keys[a] for a, _ in pairs], pa.binary()), pa.array([None] * count + [keys[b] for _, b in pairs], pa.binary())],
                names=["key", "links", "u", "v"],
            )

        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in ("cell", "h", "a", "holder", "key", "n", "vector", "asks")]
            for c, h, a, *row in zip(*cols, strict=True):
                if now != (c, h, a):
                    if held and (out := done()) is not None:
                        yield out
                    now, held = (c, h, a), []
                held.append(row)
        if held and (out := done()) is not None:
            yield out

    return rows.mapInArrow(run, "key binary, links long, u binary, v binary")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, recall: float = 0.995, sample_rows: int = 20_000) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each input row.

    n_links counts the other rows whose vectors have a cosine of at least ``threshold`` in double
    precision, equal vectors included; component_id is the least id reachable by links, the row's
    own included; kept: it is the row's id. Null, empty and zero vectors, and those with a null or
    non-finite component, link with nothing; vectors of different lengths do not link. Rows that
    repeat an id are vectors of their own; null ids stay null and are above every other. Codebooks are fitted on
    ``sample_rows`` vectors, the least digests; every vector is indexed, in a grid of 8 by 8 cells at the least. Columns
    but the two named are left out, whatever their names. An empty table gives an empty one.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "multi-index")
    small_batches(spark, 2048)
    kind = vectors.schema[vector_col].dataType
    narrow = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    df = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<float>" if narrow else "array<double>").alias("vector"))
    rows = scratch.write(keyed(df), "rows")
    classes = rows.filter("key is not null").groupBy("key").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"), F.first("vector").alias("vector"))
    classes = scratch.write(classes.withColumn("dim", F.size("vector")), "classes")
    found = None
    for dim, n in sorted(map(tuple, classes.groupBy("dim").count().collect())):
        part = classes.filter(F.col("dim") == dim)
        sample = part.select("key", "vector").orderBy("key").limit(sample_rows).toArrow()
        grid = fit(unit(matrix(sample["vector"].combine_chunks())), n, threshold, recall)
        one = compare(scratch.write(asked(part, grid), "cells"), threshold)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = scratch.write(found, "found")
    links = found.filter("key is not null").groupBy("key").agg(F.sum("links").alias("links"))
    roots = components(found.filter("u is not null").select("u", "v"), scratch).withColumnRenamed("id", "key")
    placed = scratch.write(classes.select("key", "vec_id", "n").join(roots, "key", "left").select("key", "vec_id", "n", F.coalesce("root", "key").alias("root")), "placed")
    least = placed.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    groups = scratch.write(placed.join(least, "root").join(links, "key", "left").select("key", "component_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links")), "groups")
    out = rows.select("vec_id", "key").join(groups, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


#: All pairs, for small tables.
ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS v FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= CAST(0.95 AS DOUBLE)),
reach(id, r) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.v, reach.r FROM reach JOIN l ON reach.id = l.u),
c AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.u = v.vec_id) AS n_links, c.component_id, c.component_id = v.vec_id AS kept FROM v JOIN c ON c.id = v.vec_id
"""
