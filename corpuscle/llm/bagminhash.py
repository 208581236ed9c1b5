"""Near-duplicate texts by BagMinHash over multisets of five-word shingles.

A shingle with count c owns the weight interval (0, c]. Dyadic strips of that
interval, (0,1], (1,2], (2,4], ..., are roots of trees of Poisson processes: each
process has a first point, which one of its halves inherits, while the other half
waits for a point of its own; processes of width one go on point by point. Points
depend on shingle and interval alone. Halves beyond c are left out, and the point
of a process within c falls on one random slot of the signature, which keeps its
earliest. A process whose point comes later than all slots of its text ends with
all its halves, so the work grows with shingles plus slots, not with their product,
and two slots agree with the weighted Jaccard similarity as probability.

Signatures are banded; members of a bucket are compared with the bucket's pivot;
where components still differ, the bucket is compared wholly, in blocks. Links
are verified by exact multiset overlap.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, doc_view, map_texts, small_batches, text_hash
from .graph import components

SHINGLE, BANDS, ROWS = 5, 24, 5
#: Distinct shingles whose points are made together: about 20 MB.
STRIPS = 100_000
WORD = re.compile(r"[^\x20\x09-\x0D]+")
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit mixer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def wait(point: np.ndarray) -> np.ndarray:
    """The exponential waiting time that a point's hash stands for."""
    return -np.log((point >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54)


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def bag(words: list[str], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles as 64-bit hashes, and their counts. Fewer than k words are one shingle, none are none."""
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(k, len(h))
    n = len(h) - size + 1
    s = np.full(n, size, np.uint64)
    for i in range(size):
        s = mix(s * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(s, return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two bags: sum of least counts over sum of largest; 0 if both are empty."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = int(np.minimum(a[1][i], b[1][j]).sum())
    high = int(a[1].sum() + b[1].sum()) - low
    return low / high if high else 0.0


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], slots: int) -> np.ndarray:
    """The earliest point of each slot, one row per bag; empty bags stay infinite."""
    sig = np.full(len(bags) * slots, np.inf)
    latest = np.full(len(bags), np.inf)

    def first(base, low, width):
        """Key of the process over (low, low + width] of a shingle, the hash of its first point and the wait for it."""
        key = mix(base + low.astype(np.uint64) * GOLDEN + width.astype(np.uint64))
        point = mix(key)
        return key, point, wait(point) / width

    def offer(doc, time, point):
        slot = ((mix(point ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)) * np.uint64(slots)) >> np.uint64(32)
        np.minimum.at(sig, doc * slots + slot.astype(np.int64), time)

    def settle(docs):
        latest[docs] = sig.reshape(-1, slots)[docs].max(1)

    # Roots: the dyadic strips below each count, and the one that holds it.
    roots = []
    for d, (ids, counts) in enumerate(bags):
        low, width, base, count = 0, 1, ids, counts
        while len(base):
            roots.append((base, np.full(len(base), d), np.full(len(base), low), np.full(len(base), width), count))
            low, width = low + width, max(1, low + width)
            more = count > low
            base, count = base[more], count[more]
    if not roots:
        return sig.reshape(-1, slots)
    base, doc, low, width, count = (np.concatenate(x) for x in zip(*roots, strict=True))
    key, point, time = first(base, low, width)
    nodes, leaves = (base, key, doc, low, width, count, point, time), []
    while len(nodes[0]):
        base, key, doc, low, width, count, point, time = nodes
        whole = low + width <= count
        offer(doc[whole], time[whole], point[whole])
        settle(np.unique(doc[whole]))
        live = time < latest[doc]
        leaf = live & (width == 1)
        leaves.append((key[leaf], doc[leaf], time[leaf]))
        base, doc, low, width, count, point, time = (x[live & (width > 1)] for x in (base, doc, low, width, count, point, time))
        # The point falls into one half; the other half waits for its own from then on.
        half = width // 2
        right = (mix(point + width.astype(np.uint64) * GOLDEN) >> np.uint64(63)).astype(np.int64)
        heir, other = low + right * half, low + (1 - right) * half
        own, drawn, gap = first(base, other, half)
        heir_key = first(base, heir, half)[0]
        both = [(base, base), (heir_key, own), (doc, doc), (heir, other), (half, half), (count, count), (point, drawn), (time, time + gap)]
        nodes = tuple(np.concatenate(x) for x in both)
        inside = (nodes[3] < nodes[5]) & (nodes[7] < latest[nodes[2]])
        nodes = tuple(x[inside] for x in nodes)
    key, doc, time = (np.concatenate(x) for x in zip(*leaves, strict=True))
    live = time < latest[doc]
    key, doc, time = key[live], doc[live], time[live]
    made = 1
    while len(key):
        # Few live processes: several successive points of each at once.
        block = int(np.clip(4096 // len(key), 1, 64))
        point = mix(key[:, None] + np.arange(made, made + block, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
        gap = wait(point)
        # Added one after the other, so that a point is the same number whatever the block.
        times = np.empty_like(gap)
        for i in range(block):
            time = time + gap[:, i]
            times[:, i] = time
        use = times < latest[doc][:, None]
        offer(np.broadcast_to(doc[:, None], use.shape)[use], times[use], point[use])
        settle(np.unique(doc))
        live = time < latest[doc]
        key, doc, time = key[live], doc[live], time[live]
        made += block
    return sig.reshape(-1, slots)


def bands(sig: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each run of ``rows`` slots."""
    bits = sig.view(np.uint64)
    out = np.repeat(np.arange(1, bits.shape[1] // rows + 1, dtype=np.uint64)[None], len(bits), 0)
    for i in range(rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + bits[:, i::rows])
    return out.view(np.int64)


def sign(docs: DataFrame, n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, body, key (digest of the words), size (shingles), bands of the rows doc_id, body, text. Texts without words have no bands."""

    def work(texts):
        place, index, bags, keys = {}, [], [], []
        for t in texts:
            words = words_of(t)
            key = hashlib.md5(" ".join(words).encode("utf-8", "replace")).digest()
            if key not in place:
                place[key] = len(bags)
                bags.append(bag(words))
            keys.append(key)
            index.append(place[key])
        # In parts of bounded size: a few very long texts may share a batch.
        parts, room = [[]], STRIPS
        for x in bags:
            if parts[-1] and room < len(x[0]):
                parts.append([])
                room = STRIPS
            parts[-1].append(x)
            room -= len(x[0])
        b = np.concatenate([bands(signatures(p, n_bands * rows), rows) for p in parts])
        sizes = [int(x[1].sum()) for x in bags]
        return {"key": keys, "size": [sizes[i] for i in index], "bands": [b[i].tolist() if sizes[i] else [] for i in index]}

    fields = [T.StructField("key", T.BinaryType()), T.StructField("size", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    return map_texts(docs, work, fields, keep=("doc_id", "body"))


def verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs u, v whose multisets overlap enough."""
    small_batches(pairs.sparkSession, 128)
    j = pairs.join(texts.withColumnsRenamed({"key": "u", "text": "a"}), "u").join(texts.withColumnsRenamed({"key": "v", "text": "b"}), "v").select("u", "v", "a", "b")

    def run(batches):
        for batch in batches:
            made, keep = {}, []
            u, v, a, b = (batch.column(k).to_pylist() for k in ("u", "v", "a", "b"))
            for x, text in [*zip(u, a, strict=True), *zip(v, b, strict=True)]:
                if x not in made:
                    made[x] = bag(words_of(text))
            for x, y in zip(u, v, strict=True):
                keep.append(similarity(made[x], made[y]) >= threshold)
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return j.mapInArrow(run, "u binary, v binary")


def true_texts(texts: DataFrame) -> DataFrame:
    """Only rows whose text has the key, one for each key."""

    def run(batches):
        for batch in batches:
            ok = [hashlib.md5(" ".join(words_of(t)).encode("utf-8", "replace")).digest() == k for k, t in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            yield batch.filter(pa.array(ok, pa.bool_()))

    return texts.mapInArrow(run, "key binary, text string").groupBy("key").agg(F.first("text").alias("text"))


def overlaps(queries: list[tuple[np.ndarray, np.ndarray]], targets: list[tuple[np.ndarray, np.ndarray]]):
    """For each query bag, its overlap with every target bag, by one inverted index over the targets' shingles."""
    ids = np.concatenate([t[0] for t in targets])
    owner = np.repeat(np.arange(len(targets)), [len(t[0]) for t in targets])
    counts = np.concatenate([t[1] for t in targets])
    order = np.argsort(ids, kind="stable")
    ids, owner, counts = ids[order], owner[order], counts[order]
    for q in queries:
        a, b = np.searchsorted(ids, q[0], "left"), np.searchsorted(ids, q[0], "right")
        n = b - a
        at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        yield np.bincount(owner[at], np.minimum(counts[at], np.repeat(q[1], n)), len(targets))


def block_links(rows: list[tuple[bytes, bytes, str, bool]], threshold: float) -> list[tuple[bytes, bytes]]:
    """rows: key, component, text, whether it is a query. Links of queries to others, no more than unite the components."""
    keys = {r[0]: r for r in rows}
    names = list(keys)
    bags = [bag(words_of(keys[k][2])) for k in names]
    sizes = np.array([b[1].sum() for b in bags])
    comp = [keys[k][1] for k in names]
    parent = {c: c for c in comp}

    def top(c):
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    wanted = {r[0] for r in rows if r[3]}
    asked = [i for i, k in enumerate(names) if k in wanted]
    out = []
    for i, low in zip(asked, overlaps([bags[i] for i in asked], bags), strict=True):
        union = sizes + sizes[i] - low
        for j in np.flatnonzero(low >= threshold * union):
            a, b = top(comp[i]), top(comp[j])
            if a != b:
                parent[a] = b
                out.append((min(names[i], names[j]), max(names[i], names[j])))
    return out


def compare_blocks(state: DataFrame, texts: DataFrame, threshold: float, block: int = 512) -> DataFrame:
    """u, v: links that unite the components of every bucket in ``state`` (band, key, comp), no pair of members left out.

    In each bucket that holds several components, the members outside its largest component are the
    queries, compared with all members. A bucket is cut into blocks of about ``block`` queries and
    ``block`` members; a task holds one pair of blocks at a time. Buckets with the same members count once.
    """
    by_comp = state.groupBy("band", "comp").agg(F.count("*").alias("n"), *[F.sum(F.xxhash64("key", F.lit(seed)).cast("decimal(38,0)")).alias(f"h{seed}") for seed in (1, 2)])
    buckets = by_comp.groupBy("band").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("comp", F.struct("n", "comp")).alias("largest"), F.count("*").alias("comps"), F.sum("h1").alias("h1"), F.sum("h2").alias("h2"))
    # The same number of members and the same two sums of 64-bit hashes: the same members.
    buckets = buckets.filter("comps > 1").groupBy("n", "h1", "h2").agg(F.min_by(F.struct("band", "most", "largest"), "band").alias("b"))
    buckets = buckets.select("b.band", "b.largest", F.ceil(F.col("n") / block).alias("parts"), F.ceil((F.col("n") - F.col("b.most")) / block).alias("asks"))
    rows = state.join(buckets, "band").withColumn("query", F.col("comp") != F.col("largest"))
    part, ask = F.pmod(F.xxhash64("key", F.lit(1)), F.col("parts")), F.pmod(F.xxhash64("key", F.lit(2)), F.col("asks"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    tasks = int(state.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cell = lambda p, a: F.struct(p.cast("long").alias("part"), a.cast("long").alias("ask"))
    member = F.transform(upto("asks"), lambda a: F.struct(cell(part, a).alias("cell"), F.lit(False).alias("query")))
    asker = F.when(F.col("query"), F.transform(upto("parts"), lambda p: F.struct(cell(p, ask).alias("cell"), F.lit(True).alias("query")))).otherwise(F.array().cast("array<struct<cell:struct<part:bigint,ask:bigint>,query:boolean>>"))
    # The cells of a bucket go round the tasks, from a place of the bucket's own.
    task = F.pmod(F.pmod(F.xxhash64("band"), F.lit(tasks)) + F.col("r.cell.part") * F.col("asks") + F.col("r.cell.ask"), F.lit(tasks)).cast("int")
    rows = rows.select("band", "key", "comp", "asks", F.explode(F.concat(member, asker)).alias("r")).select("band", "key", "comp", "r.cell.part", "r.cell.ask", "r.query", task.alias("task"))
    rows = rows.join(texts, "key").repartitionById(tasks, F.col("task")).select("band", "part", "ask", "key", "comp", "query", "text")
    rows = rows.sortWithinPartitions("band", "part", "ask")

    def run(batches):
        now, held = None, []

        def done():
            links = block_links(held, threshold) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.binary()) for k in (0, 1)], names=["u", "v"])

        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in ("band", "part", "ask", "key", "comp", "text", "query")]
            for band, p, a, *row in zip(*cols, strict=True):
                if now != (band, p, a):
                    if held:
                        yield done()
                    now, held = (band, p, a), []
                held.append(tuple(row))
        if held:
            yield done()

    return rows.mapInArrow(run, "u binary, v binary")


def link_classes(docs: DataFrame, classes: DataFrame, scratch: Scratch, threshold: float, broadcast_rows: int = 400_000) -> DataFrame | None:
    """key, root for the classes that have a verified link to another; None if none has.

    Every bucket compares its members with one pivot: that settles most groups of near copies in one
    pass. Buckets that then still hold several components are compared in blocks, wholly.
    """
    slots = classes.select("key", "size", F.explode("bands").alias("band"))
    shared = slots.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band")
    slots = scratch.write(slots.join(shared, "band"), "slots")
    if slots.isEmpty():
        return None
    # One row of each class gives its text; the text's hash finds it, so that rows without an id or with a common one do no harm.
    members = scratch.write(slots.select("key").distinct().join(classes.select("key", F.col("rep.doc_id").alias("id_"), F.col("rep.body").alias("body_")), "key"), "members")
    # 32 bytes a row: broadcast up to a checked count, else an ordinary join.
    side = F.broadcast(members) if members.count() <= broadcast_rows else members
    texts = scratch.write(true_texts(docs.join(side, (F.col("body") == F.col("body_")) & F.col("doc_id").eqNullSafe(F.col("id_"))).select("key", "text")), "texts")
    pivots = slots.groupBy("band").agg(F.min_by(F.struct("key", "size"), "key").alias("p"))
    fit = F.least("size", "p.size") >= threshold * F.greatest("size", "p.size")
    pairs = slots.join(pivots, "band").filter((F.col("key") != F.col("p.key")) & fit).select(F.col("p.key").alias("u"), F.col("key").alias("v")).distinct()
    links = scratch.write(verify(pairs, texts, threshold), "found")
    roots = components(links, scratch)
    state = scratch.write(slots.join(roots.withColumnRenamed("id", "key"), "key", "left").select("band", "key", F.coalesce("root", "key").alias("comp")), "state")
    more = scratch.write(compare_blocks(state, texts, threshold).distinct(), "more")
    scratch.drop(slots, members, texts, state)
    if not more.isEmpty():
        roots = components(links.unionByName(more), scratch)
    return None if roots.isEmpty() else roots.withColumnRenamed("id", "key")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """doc_id, class_id, component_id, kept, text_hash: one row for each input row.

    class_id is the least id among texts with the same words (case and white space aside);
    component_id is the least id reachable by links of weighted Jaccard similarity of at least
    ``threshold`` between five-word shingle multisets; kept holds for one document of each group, the one of the
    least id (null is above every id) and, where that id has several texts in the group, of one of these. Texts of
    fewer than five words are one shingle. Null and empty texts link with nothing and are kept, each a class of its own.
    text_hash is the text's 64-bit hash. Rows that repeat an id and a text share its fate. An empty table gives an empty
    one; columns but the id and the text are left out, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "bagminhash")
    d = doc_view(docs, id_col, text_col).withColumn("body", text_hash(F.col("text")))
    signed = scratch.write(sign(d), "signed")
    full = signed.filter("size > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "body")).alias("rep")
    classes = scratch.write(full.groupBy("key").agg(first, F.first("size").alias("size"), F.first("bands").alias("bands")), "classes")
    rows = signed.select("doc_id", "body", F.when(F.col("size") > 0, F.col("key")).alias("key"))
    roots = link_classes(d, classes, scratch, threshold)
    placed = classes.select("key", "rep", F.col("key").alias("root")) if roots is None else classes.select("key", "rep").join(roots, "key", "left").select("key", "rep", F.coalesce("root", "key").alias("root"))
    placed = scratch.write(placed, "placed")
    least = placed.groupBy("root").agg(F.min(F.struct("rep.no_id", "rep.doc_id", "key")).alias("least"))
    # Written first: a join of two plain tables lets Spark split the rows of one very common text.
    groups = scratch.write(placed.join(least, "root").select("key", F.col("rep.doc_id").alias("class_id"), F.col("least.doc_id").alias("component_id"), (F.col("least.key") == F.col("key")).alias("chosen")), "groups")
    scratch.drop(classes, placed)
    out = rows.join(groups, "key", "left")
    alone = F.col("key").isNull()
    kept = alone | (F.col("chosen") & F.col("doc_id").eqNullSafe(F.col("component_id")))
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), kept.alias("kept"), F.col("body").alias("text_hash"))
