"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

Fixed rules give seed entities. The words before an entity form a lexical
pattern; patterns and instances form a bipartite graph whose scores are iterated
in Spark, and patterns of high confidence discover identifiers that no rule covers.

Places are found without a user function: the matches and the gaps between them
(the text split by the same expression) have the same order, so running sums of
their lengths give every start and end in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bound, text_hash

#: The rules in linear-time Java form. Possessive repeats give the same matches, as nothing that
#: follows could use the characters they hold; a match starts where its run does or where the last match ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "context")

#: A token with a digit or an at sign, whole.
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"

SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"

#: Entries of an array that are summed one after the other, and code points of a text that are cut at a time.
BLOCK, CUT = 128, 4096
#: Texts with discovered identifiers up to this count, and their identifiers up to five times it, are broadcast (about 100 bytes each).
BROADCAST_TEXTS = 200_000


def running(sizes: Column, step=lambda a, b: a + b) -> Column:
    """The running sums (or ``step``) of an array of non-negative ints.

    Growing an array copies it, so entries are summed in blocks and the blocks' totals after that: the work is in
    proportion to the length times half a block, not to its square.
    """
    one = lambda a: F.aggregate(a, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x))))
    blocks = lambda a: F.transform(F.sequence(F.lit(0), F.floor(F.size(a) / BLOCK).cast("int")), lambda k: one(F.slice(a, k * BLOCK + 1, BLOCK)))
    joined = lambda parts: bound(one(F.transform(parts, lambda p: F.element_at(p, -1))), lambda before: F.flatten(F.transform(parts, lambda p, k: F.transform(F.slice(p, 2, BLOCK), lambda x: step(F.get(before, k), x)))))
    return bound(sizes, lambda a: bound(blocks(a), joined))


def ends_of(found: Column, gaps: Column) -> Column:
    """Where each match ends, given the matches and the text's pieces between them."""
    return running(F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.length(m) + F.length(g)))


def matches(text: Column, pattern: str, kind: int) -> Column:
    """(start, kind, end, value) of each match."""

    def spans(found: Column) -> Column:
        place = lambda ends: F.transform(found, lambda m, i: F.struct((F.get(ends, i) - F.length(m)).alias("start"), F.lit(kind).alias("kind"), F.get(ends, i).alias("end"), m.alias("value")))
        return bound(ends_of(found, F.split(text, pattern, -1)), place)

    return bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans).cast(SPANS)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """The card checksum of a string of digits."""
    places = F.transform(F.regexp_extract_all(F.reverse(value), F.lit("[0-9]"), F.lit(0)), lambda d, i: d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1))
    total = F.aggregate(places, F.lit(0), lambda acc, x: acc + F.when(x > 9, x - 9).otherwise(x))
    return total % 10 == 0


def small_parts(value: Column) -> Column:
    """All dotted parts at most 255."""
    return F.forall(F.split(value, r"\."), lambda x: F.regexp_replace(x, "^0+(?=.)", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def base_spans(text: Column) -> Column:
    """The spans of the four rules by start, then kind; texts without the marks of a rule skip it."""
    none = F.array().cast(SPANS)
    size = lambda v: F.length(digits(v))
    email = F.when(F.instr(text, "@") > 0, matches(text, EMAIL, 0)).otherwise(none)
    numeric = text.rlike("[0-9]")
    ip = F.when(text.rlike(r"[0-9]\.[0-9]"), F.filter(matches(text, IP, 1), lambda s: small_parts(s["value"]))).otherwise(none)
    card = F.when(
        numeric & text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"),
        F.filter(F.filter(matches(text, CARD, 2), lambda s: size(s["value"]).between(12, 19)), lambda s: luhn(digits(s["value"]))),
    ).otherwise(none)
    phone = F.when(F.instr(text, "+") > 0, F.filter(matches(text, PHONE, 3), lambda s: size(s["value"]).between(9, 15))).otherwise(none)
    return F.array_sort(F.concat(email, ip, card, phone))


def tokens(text: Column) -> Column:
    """(start, end, token, context) of the tokens with a digit or an at sign.

    The context is the two white-space words before the token, of any length, in lower case with digits as 0; near
    the start of the text it is ``^`` and one word, or ``^``.
    """
    words = "array<string>"
    last_two = lambda a: F.reverse(F.slice(F.reverse(a), 1, 2))

    def places(found: Column) -> Column:
        def of(gaps: Column) -> Column:
            tails = F.transform(gaps, lambda g: last_two(F.filter(F.split(g, r"\s+", -1), lambda w: w != "")))

            def with_tails(tails: Column) -> Column:
                token = lambda i: F.when(i >= 0, F.array(F.get(found, i))).otherwise(F.array().cast(words))
                tail = lambda i: F.when(i >= 0, F.get(tails, i)).otherwise(F.array().cast(words))
                before = lambda i: F.array_join(last_two(F.concat(F.array(F.lit("^")), token(i - 2), tail(i - 1), token(i - 1), tail(i))), " ")
                context = lambda i: F.regexp_replace(F.lower(before(i)), "[0-9]", "0")
                return bound(ends_of(found, gaps), lambda ends: F.transform(found, lambda t, i: F.struct((F.get(ends, i) - F.length(t)).alias("start"), F.get(ends, i).alias("end"), t.alias("token"), context(i).alias("context"))))

            return bound(tails, with_tails)

        return bound(F.split(text, TOKEN, -1), of)

    return bound(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), places)


def occurrences(docs: DataFrame, min_digits: int) -> DataFrame:
    """body, start, end, value, context, seed: the rule spans (seeds) and the other tokens of ``min_digits`` digits or more, each with the words before it.

    ``docs`` has body, text, spans; a text counts once, however many copies it has. A span that another span covers is
    no instance of its own; its context is that of the token in which it starts. Tokens and spans meet as rows in
    the order of their places, so a text's work is in proportion to their number.
    """
    # The token without the marks around it.
    head = lambda t: F.length(t) - F.length(F.regexp_replace(t, r"^[^\p{L}\p{N}+]+", ""))
    value = lambda t: F.regexp_replace(t, r"^[^\p{L}\p{N}+]+|[^\p{L}\p{N}]+$", "")
    row = lambda at, span, start, end, kind, value, context: F.struct(at.alias("at"), F.lit(span).alias("span"), start.alias("start"), end.alias("end"), kind.alias("kind"), value.alias("value"), context.alias("context"))
    token = lambda t: row(t["start"], 0, t["start"] + head(t["token"]), t["start"] + head(t["token"]) + F.length(value(t["token"])), F.lit(0), value(t["token"]), t["context"])
    span = lambda s: row(s["start"], 1, s["start"], s["end"], s["kind"], s["value"], F.lit(None).cast("string"))
    both = F.concat(F.transform(tokens(F.col("text")), token), F.transform("spans", span))
    d = docs.filter(F.col("text").rlike("[0-9@]")).select("body", F.explode(both).alias("r")).select("body", "r.*").distinct()
    order = "at, span, end DESC, kind"
    w = Window.partitionBy("body").orderBy("at", "span", F.desc("end"), "kind")
    d = d.select(
        "*",
        F.last("context", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("words"),
        F.max(F.expr("IF(span = 1, end, NULL)")).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("reach"),
        F.expr(f"lead(IF(span = 1, start, NULL)) IGNORE NULLS OVER (PARTITION BY body ORDER BY {order})").alias("next"),
    )
    covered = F.coalesce(F.col("reach") >= F.col("end"), F.lit(False))
    free = F.coalesce(F.col("reach") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("next") >= F.col("end"), F.lit(True))
    unseen = (F.col("span") == 0) & free & (F.length(digits(F.col("value"))) >= min_digits)
    d = d.filter(F.when(F.col("span") == 1, ~covered).otherwise(unseen))
    return d.select("body", "start", "end", F.lower("value").alias("value"), F.col("words").alias("context"), (F.col("span") == 1).alias("seed"))


def patterns_of(rows: DataFrame, scratch: Scratch, rounds: int, min_seeds: int, min_score: float) -> DataFrame:
    """pattern, score of the patterns of high confidence.

    Instance scores start at 1 for seeds. A pattern scores the mean score of its distinct
    instances; an instance that no rule found scores 1 - prod(1 - pattern score) over its
    patterns that have ``min_seeds`` distinct supporting instances.
    """
    # A pattern is its context words: shapes differ between the seeds and what is to be found.
    edges = scratch.write(rows.groupBy(F.col("context").alias("pattern"), "value").agg(F.max("seed").alias("seed")), "edges")
    score = F.when(F.col("seed"), 1.0).otherwise(0.0)
    current = edges.withColumn("belief", score)
    patterns = None
    for k in range(rounds):
        patterns = current.groupBy("pattern").agg(F.avg("belief").alias("score"), F.sum(F.when(F.col("belief") >= min_score, 1).otherwise(0)).alias("support"))
        patterns = patterns.filter((F.col("support") >= min_seeds) & (F.col("score") > 0))
        if k + 1 < rounds:
            strong = edges.join(patterns, "pattern").groupBy("value").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9)))))).alias("belief"))
            current = edges.join(strong, "value", "left").withColumn("belief", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("belief", F.lit(0.0))))
            current = scratch.write(current, f"round{k}")
    return patterns.filter(F.col("score") >= min_score).select("pattern", "score")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, min_seeds: int = 3, min_score: float = 0.6, min_digits: int = 4, keep: tuple[str, ...] = ()) -> DataFrame:
    """The ``keep`` columns, doc_id, text, spans: for each input row its spans (start, kind, end, value), by start, then kind.

    ``kind`` is the place in KINDS. A null text is the empty text and has no spans; null ids stay null. Rows that
    repeat an id keep their own spans: found identifiers go back by the text, so copies get the same. A token is
    discovered if it has ``min_digits`` digits or more, no rule covers it, and the words before it
    are a pattern that ``min_seeds`` distinct instances support with a score of ``min_score``. An empty table gives an
    empty one. Columns that ``keep`` does not name are left out, whatever their names; of the ``keep`` columns those
    named doc_id, text or spans are replaced by the operator's own.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keep = tuple(c for c in keep if c not in ("doc_id", "text", "spans"))
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(0).alias("none"))
    d = docs.select(kept.alias("row"), F.col(id_col).alias("doc_id"), text.alias("text"), text_hash(F.col(text_col).cast("string")).alias("body"))
    d = d.withColumn("spans", base_spans(F.col("text")))
    rows = scratch.write(occurrences(d.select("body", "text", "spans"), min_digits), "tokens")
    good = patterns_of(rows, scratch, rounds, min_seeds, min_score)
    new = rows.filter(~F.col("seed")).join(good.withColumnRenamed("pattern", "context"), "context")
    span = F.struct(F.col("start"), F.lit(len(KINDS) - 1).alias("kind"), F.col("end"), F.col("value"))
    new = scratch.write(new.groupBy(F.col("body").alias("body_")).agg(F.collect_set(span).cast(SPANS).alias("found")), "found")
    texts, identifiers = new.agg(F.count("*"), F.sum(F.size("found"))).first()
    # Few texts hold a discovered identifier: only their hashes and spans travel, no text does. Beyond the bound Spark joins as it sees fit.
    side = F.broadcast(new) if texts <= BROADCAST_TEXTS and (identifiers or 0) <= 5 * BROADCAST_TEXTS else new
    out = d.join(side, F.col("body") == F.col("body_"), "left") if texts else d.withColumn("found", F.lit(None).cast(SPANS))
    spans = F.when(F.col("found").isNull(), F.col("spans")).otherwise(F.array_sort(F.concat("spans", F.coalesce("found", F.array().cast(SPANS)))))
    return out.select(*[F.col("row")[c].alias(c) for c in keep], "doc_id", "text", spans.alias("spans"))


def name_of(kind: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, KINDS)), kind + 1)


def joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", name_of(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, the counts of the four rules, the digest of their spans, and all spans as text, from what ``find`` returns."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < len(KINDS) - 1)
    return found.select("doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(4)], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """The text with each span as its kind in brackets; a span that starts inside an earlier one is joined to it.

    ``spans`` are sorted by start. The text is cut in blocks once, so that a piece costs its own length and a block.
    """

    def whole(blocks: Column) -> Column:
        def piece(a: Column, b: Column) -> Column:
            upto = F.floor(F.greatest(b - 1, a) / CUT).cast("int")
            part = lambda k: F.substring(F.coalesce(F.get(blocks, k), F.lit("")), F.greatest(a - k * CUT, F.lit(0)) + 1, F.greatest(F.least(b - k * CUT, F.lit(CUT)) - F.greatest(a - k * CUT, F.lit(0)), F.lit(0)))
            return F.array_join(F.transform(F.sequence(F.floor(a / CUT).cast("int"), upto), part), "")

        def of(reach: Column) -> Column:
            before = lambda i: F.when(i > 0, F.get(reach, i - 1)).otherwise(0)
            mark = lambda s, i: F.when(s["start"] >= before(i), F.concat(piece(before(i), s["start"]), F.lit("["), F.upper(name_of(s["kind"])), F.lit("]"))).otherwise("")
            return F.concat(F.array_join(F.transform(spans, mark), ""), piece(F.element_at(reach, -1), F.length(text)))

        return bound(running(F.transform(spans, lambda s: s["end"]), F.greatest), of)

    return F.when(F.size(spans) == 0, text).otherwise(bound(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0)), whole))
