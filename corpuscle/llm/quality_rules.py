"""Quality rules: text statistics in one pass, and cross-document line frequency.

Lines are normalised and hashed; the distinct documents of each (host, line)
are counted; lines above the limits are removed, and documents that keep too
little are rejected. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_hash

#: A word, as the contract has it: no blank and none of tab, newline, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS, -1), lambda w: w != "")


def with_window_hashes(df: DataFrame, words: str, out: str, doublings: int = 3) -> DataFrame:
    """Adds a 64-bit hash of each run of ``2 ** doublings`` words.

    The hash of a run is that of its two halves, so the work is one short step per word
    and doubling. Each array is a column of its own: it is made once, not once per use.
    """
    last = f"{out}_0"
    df = df.withColumn(last, F.transform(words, lambda w: F.xxhash64(w)))
    for k in range(doublings):
        now, reach = f"{out}_{k + 1}", 2 ** (k + 1)
        size = F.size(last)
        halves = F.zip_with(last, F.slice(last, 2**k + 1, F.greatest(size, F.lit(1))), lambda a, b: F.xxhash64(a, b))
        whole = F.size(words) - (reach - 1)
        df = df.withColumn(now, F.when(whole > 0, F.slice(halves, 1, F.greatest(whole, F.lit(1)))).otherwise(F.array().cast("array<bigint>"))).drop(last)
        last = now
    return df.withColumnRenamed(last, out)


def covered(hashes: Column, window: int = 8) -> Column:
    """Words inside windows that the text has twice or more, the first included.

    Only texts with a repeat pay for the sort.
    """
    ranked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(a: Column) -> Column:
        last = F.size(a) - 1
        same = lambda j, k: F.get(a, j)["h"] == F.get(a, k)["h"]
        hit = F.filter(a, lambda x, k: F.coalesce((k > 0) & same(k - 1, k), F.lit(False)) | F.coalesce((k < last) & same(k, k + 1), F.lit(False)))
        return F.array_sort(F.transform(hit, lambda x: x["i"]))

    def bound(value: Column, use) -> Column:
        """``use(value)`` with the value made once."""
        return F.element_at(F.transform(F.array(value), use), 1)

    def total(s: Column) -> Column:
        steps = F.transform(s, lambda p, k: F.least(F.lit(window), F.coalesce(F.get(s, k + 1) - p, F.lit(window))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)

    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(bound(ranked, lambda a: bound(starts(a), total)))


def base_rules(docs: DataFrame, min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    """The columns of ``docs`` but ``text``, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    A null text has no words: it counts 0 everywhere and fails. So does an empty one.
    """
    keep = [c for c in docs.columns if c != "text"]
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = docs.select(
        *keep,
        words_of(F.col("text")).alias("words"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.when(F.instr(text, "\n") > 0, F.size(lines) - F.size(F.array_distinct(lines))).otherwise(0).cast("long").alias("n_dup_lines"),
    )
    d = d.withColumn("n_words", F.size("words").cast("long")).withColumn("word_chars", F.length(F.concat_ws("", "words")).cast("long"))
    d = with_window_hashes(d, "words", "hashes").drop("words")
    d = d.withColumn("n_repeat_words", covered(F.col("hashes"), 8)).drop("hashes")
    return d.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))


def frequent_lines(lines: DataFrame, hosts: DataFrame, min_documents: int, max_share: float) -> DataFrame:
    """host, h of the lines above the limits; lines has one row per host, line and document, hosts the number of documents."""
    counts = lines.groupBy("host", "h").agg(F.count("*").alias("n")).filter(F.col("n") > min_documents)
    counts = counts.join(hosts.withColumnRenamed("host", "host_"), F.col("host").eqNullSafe(F.col("host_")))
    return counts.filter(F.col("n") > max_share * F.col("documents")).select("host", "h")


def text_lines(docs: DataFrame, *keys: str) -> DataFrame:
    """The keys, place, h, chars: one row for each line that is not blank, with its place in the text."""
    text = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[0-9]", "0")
    lines = docs.select(*keys, F.posexplode(F.split(text, "\n", -1)).alias("place", "line"))
    lines = lines.withColumn("line", F.trim(F.regexp_replace("line", BLANKS, " "))).filter("line <> ''")
    return lines.select(*keys, "place", F.xxhash64("line").alias("h"), F.length("line").alias("chars"))


def removals(docs: DataFrame, scratch: Scratch, min_documents: int = 10, max_share: float = 0.02, min_kept: float = 0.2) -> DataFrame:
    """host, body, gone, places of the texts with frequent lines: whether their removal depletes the text, and the places of these lines."""
    # One row per host, document (id and text) and line. Repeated rows add their characters to all lines of a text alike, which keeps the shares.
    lines = scratch.write(text_lines(docs, "host", "doc_id", "body").groupBy("host", "h", "doc_id", "body").agg(F.sum("chars").alias("chars")), "lines")
    hosts = docs.select("host", "doc_id", "body").distinct().groupBy("host").agg(F.count("*").alias("documents"))
    hot = scratch.write(frequent_lines(lines, hosts, min_documents, max_share), "hot")
    side = hot.select(F.col("host").alias("host_"), F.col("h").alias("h_"), F.lit(True).alias("hit"))
    same = (F.col("h") == F.col("h_")) & F.col("host").eqNullSafe(F.col("host_"))
    sums = lines.join(side, same, "left").groupBy("host", "body").agg(F.sum("chars").alias("line_chars"), F.sum(F.when(F.col("hit"), F.col("chars")).otherwise(0)).alias("removed_chars"))
    gone = sums.filter("removed_chars > 0").select("host", "body", (F.col("line_chars") - F.col("removed_chars") < min_kept * F.col("line_chars")).alias("gone"))
    # Copies have their lines at the same places, so the set is no longer than the text.
    places = text_lines(docs, "host", "body").join(side, same).groupBy(F.col("host").alias("host_"), F.col("body").alias("body_")).agg(F.collect_set("place").alias("places"))
    return gone.join(places, (F.col("body") == F.col("body_")) & F.col("host").eqNullSafe(F.col("host_"))).select("host", "body", "gone", "places")


def without_lines(text: Column, places: Column) -> Column:
    """The text without the lines at these places."""
    lines = F.split(text, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), places)
    return F.when(places.isNull(), text).otherwise(F.array_join(F.transform(kept, lambda k: F.get(lines, k)), "\n"))


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_documents: int = 10, max_share: float = 0.02, min_kept: float = 0.2) -> DataFrame:
    """doc_id, the base statistics, base_failed, depleted, kept, cleaned; one row for each input row, other columns left out.

    A line is normalised (lower case, digits as 0, runs of blanks as one) and hashed. It is
    above the limits if more than ``min_documents`` distinct documents of its host have it and they
    are more than ``max_share`` of the host's documents; it is removed then, and cleaned
    is the text without such lines. A document is depleted if less than ``min_kept`` of the
    characters of its lines stay. A document is an id with a text: rows that repeat both count
    once, copies under ids of their own each count. Null hosts are one host, null ids one id;
    null and empty texts have no lines, fail the base rules and are not depleted, but count among
    the host's documents. kept: neither failed nor depleted. An empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "quality-rules")
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text"))
    d = d.withColumn("body", text_hash(F.col("text")))
    gone = removals(d, scratch, min_documents, max_share, min_kept).select(F.col("host").alias("host_"), F.col("body").alias("body_"), "gone", "places")
    out = base_rules(d.withColumn("raw", F.col("text"))).join(gone, (F.col("body") == F.col("body_")) & F.col("host").eqNullSafe(F.col("host_")), "left")
    out = out.withColumn("depleted", F.coalesce("gone", F.lit(False))).withColumn("kept", ~F.col("base_failed") & ~F.coalesce("gone", F.lit(False)))
    out = out.withColumn("cleaned", without_lines(F.col("raw"), F.col("places")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "depleted", "cleaned")


#: The same rows in DuckDB: hashes are replaced by the lines and windows themselves.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, host, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, i, array_to_string(list_slice(words, i, i + 7), ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, CAST(sum(least(8, coalesce(nxt - i, 8))) AS BIGINT) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY doc_id),
bodies AS (SELECT DISTINCT host, doc_id, t FROM d),
hosts AS (SELECT host, count(*) AS host_documents FROM bodies GROUP BY host),
lines AS (SELECT host, doc_id, t, trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM (SELECT host, doc_id, t, unnest(string_split(t, chr(10))) AS line FROM bodies)),
per AS (SELECT host, doc_id, t, line, sum(length(line)) AS chars FROM lines WHERE line <> '' GROUP BY ALL),
hot AS (SELECT host, line FROM (SELECT host, line, count(*) AS n FROM per GROUP BY ALL) JOIN hosts USING (host) WHERE n > 10 AND n > 0.02 * host_documents),
gone AS (SELECT host, t FROM (SELECT per.host, per.t, sum(chars) AS all_chars, sum(CASE WHEN hot.line IS NULL THEN 0 ELSE chars END) AS removed FROM per LEFT JOIN hot ON per.host = hot.host AND per.line = hot.line GROUP BY ALL) WHERE removed > 0 AND all_chars - removed < 0.2 * all_chars),
o AS (SELECT w.doc_id, w.host, w.t, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(w.t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words FROM w LEFT JOIN cov USING (doc_id))
SELECT o.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed, NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND gone.t IS NULL AS kept, gone.t IS NOT NULL AS depleted
FROM o LEFT JOIN gone ON o.host = gone.host AND o.t = gone.t
"""
