"""Personal data: fixed patterns, then terms that disclose the found entities.

Base spans are e-mail addresses, IP addresses, card and phone numbers. Every
value found is a protected entity e. Terms t that stand near entities are
weighed by what is left to find out about the entity for one who reads t, in
documents of the whole corpus:
    p(e | t) = n(t, e) / (n(t) + PRIOR),   left(t, e) = -log2 p(e | t) bits,
0 bits when a term occurs nowhere but with the entity. PRIOR smooths: it keeps
chance from looking certain and needs no least count, so entities seen once
count too. A term that leaves at most GENERALISE bits is generalised, one that
leaves at most REMOVE bits removed, wherever it stands in the corpus. Only
texts that hold the term count, so the corpus may grow without changing what
is decided. Documents of the same text count once: copies are no evidence.

Built-in functions only. Counts are partial aggregates; term counts read all
words of all documents that pass a bit filter over the terms near entities, and
fold before the shuffle but for texts that may have copies, which a second such
filter tells. The patterns are possessive forms of the
stated ones: they match the same strings without backtracking, so long runs of
digits or letters neither overflow the stack nor take quadratic time.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitmap import bits_of, may_hold
from .common import let, saved

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
# A match starts where a run of its first characters starts, or where the match before ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A text without this string has no match of the kind.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
AROUND = 48
WORD = r"\p{L}+"
PRIOR = 0.5
# Bits left: 1.5 is one text of the entity's among two that hold the term, 0.5 is three of three.
GENERALISE = 1.5
REMOVE = 0.5
SPAN_TYPE = "array<struct<start:int,rank:int,end:int,value:string>>"


def matches(text: Column, pattern: str | Column, rank: int, keep: Callable[[Column], Column] = lambda v: F.lit(True)) -> Column:
    """Matches whose value passes ``keep``, as (start, rank, end, value), in code points, end exclusive."""
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    none = F.array().cast(SPAN_TYPE)
    start = F.struct(F.lit(0).alias("pos"), none.alias("out"))

    def spans(cut: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            value = F.get(cut["found"], i)
            begin = acc["pos"] + F.length(F.get(cut["between"], i))
            end = begin + F.length(value)
            span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), value.alias("value"))
            # Only what is kept is copied, so many dropped matches cost nothing.
            out = F.when(keep(value), F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
            return F.struct(end.alias("pos"), out.alias("out"))

        found = F.size(cut["found"])
        walked = F.aggregate(F.sequence(F.lit(0), found - 1), start, add, lambda acc: acc["out"])
        return F.when(found > 0, walked).otherwise(none)

    return let(F.struct(F.regexp_extract_all(text, p, F.lit(0)).alias("found"), F.split(text, p, -1).alias("between")), spans)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of ``value`` pass the Luhn check."""

    def total(back: Column) -> Column:
        def worth(i: Column) -> Column:
            d = F.substr(back, i, F.lit(1)).cast("int")
            return F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

        return F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), lambda a, i: a + worth(i))

    return let(F.reverse(digits(value)), total) % 10 == 0


def holds(kind: str, value: Column) -> Column:
    """Whether a match is of its kind."""
    if kind == "ip":
        # Without leading zeros a part of more than three digits is above 255.
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.substring(F.concat(F.lit("0"), part(p)), 1, 4).cast("int") <= 255))
    if kind == "card":
        return F.length(digits(value)).between(12, 19) & luhn(F.when(F.length(digits(value)).between(12, 19), value).otherwise("1"))
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Valid base spans by start, then kind."""
    each = []
    for rank, kind in enumerate(KINDS):
        spans = matches(text, PATTERNS[kind], rank, functools.partial(holds, kind))
        if kind in NEEDS:
            spans = F.when(F.contains(text, F.lit(NEEDS[kind])), spans).otherwise(F.array().cast(SPAN_TYPE))
        each.append(spans)
    return F.array_sort(F.concat(*each))


def near_terms(text: Column, span: Column) -> Column:
    """Lower-cased whole words within AROUND characters of a span, outside it."""
    left = F.substr(text, F.greatest(span["start"] - AROUND, F.lit(0)) + 1, F.least(span["start"], F.lit(AROUND)))
    left = F.when(span["start"] > AROUND, F.regexp_replace(left, r"^\p{L}+", "")).otherwise(left)
    right = F.regexp_replace(F.substr(text, span["end"] + 1, F.lit(AROUND)), r"^\p{L}+", "")
    cut = F.length(text) > span["end"] + AROUND
    right = F.when(cut, F.regexp_replace(right, r"\p{L}+$", "")).otherwise(right)
    return F.lower(F.concat_ws(" ", left, right))


def words_among(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, print, term) of the distinct words of every text that pass the bit filter of the written table ``terms``."""
    bits = bits_of(terms.select(F.xxhash64("term").alias("key")).distinct(), terms.count())
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)))
    return rows.select("id", "print", F.explode(words).alias("term")).where(may_hold(bits, F.xxhash64("term")))


def disclosing_terms(rows: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((term, left) of the terms to act on, (id, print, term) of words that may be among them).

    ``rows``: (id, print, text) of all documents; ``spans``: the same with base spans.
    """
    entity = F.xxhash64("s.rank", "s.value").alias("entity")
    seen = spans.select("print", "text", F.explode("spans").alias("s"))
    terms = F.array_distinct(F.regexp_extract_all(near_terms(F.col("text"), F.col("s")), F.lit(WORD), F.lit(0)))
    mentions = saved(seen.select("print", entity, terms.alias("terms")), "mentions")
    pairs = mentions.select("print", "entity", F.explode("terms").alias("term"))
    pairs = saved(pairs.groupBy("entity", "term").agg(F.countDistinct("print").alias("n_te")), "pairs")
    # Documents per candidate term: words that pass the filter meet in the count itself, not in a join.
    # Only texts that may have copies keep their print, so all others fold to one row a term in each task.
    twice = saved(rows.groupBy("print").count().where("count > 1").select(F.col("print").alias("key")), "copied-texts")
    copied = bits_of(twice, twice.count())
    words = words_among(rows, pairs).select("term", F.when(may_hold(copied, F.col("print")), F.col("print")).alias("copied"))
    single = F.count(F.when(F.col("copied").isNull(), F.lit(1)))
    n_t = saved(words.groupBy("term").agg((single + F.countDistinct("copied")).alias("n_t")), "term-counts")
    left = -F.log2(F.col("n_te") / (F.col("n_t") + F.lit(PRIOR)))
    flagged = pairs.join(n_t, "term").groupBy("term").agg(F.min(left).alias("left"))
    flagged = saved(flagged.where(F.col("left") <= GENERALISE), "disclosing")
    return flagged, words_among(rows, flagged)


def protect(documents: DataFrame) -> DataFrame:
    """(doc_id, text, spans, removed) for every row of ``documents`` (doc_id, text).

    ``spans`` holds (start, rank, end, value) by start, then rank: base kinds
    0 to 3 in the order of KINDS, 4 for a disclosing term. Terms inside a base
    span are part of it and get no span of their own. ``removed`` lists the
    terms to remove, the other ones are generalised. Null text counts as
    empty: no spans. Rows that repeat or have a null doc_id are told apart by
    their text and each returned; an empty table gives no rows. No other
    column is read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("id"), text.alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("print"), "text")
    based = rows.select("*", base_spans(F.col("text")).alias("spans"))
    marked = based.where(F.size("spans") > 0)
    flagged, present = disclosing_terms(rows, marked)
    acts = present.join(flagged, "term").groupBy("id", "print").agg(
        F.collect_set("term").alias("terms"),
        F.collect_set(F.when(F.col("left") <= REMOVE, F.col("term"))).alias("removed"),
    )
    acts = acts.select(F.col("id").alias("i"), F.col("print").alias("p"), "terms", "removed")
    joined = based.join(acts, F.col("id").eqNullSafe(F.col("i")) & (F.col("print") == F.col("p")), "left")
    extra = F.filter(
        matches(F.col("text"), WORD, len(KINDS), lambda word: F.array_contains("terms", F.lower(word))),
        lambda t: ~F.exists("spans", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])),
    )
    spans = F.when(F.col("terms").isNull(), F.col("spans")).otherwise(F.array_sort(F.concat("spans", extra)))
    return joined.select(
        F.col("id").alias("doc_id"), "text", spans.alias("spans"),
        F.coalesce("removed", F.array().cast("array<string>")).alias("removed"),
    )


def listed(spans: Column) -> Column:
    """Spans as 'kind:start:end', comma-joined."""
    names = F.array(*[F.lit(k) for k in (*KINDS, TERM)])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def sanitised(protected: DataFrame) -> Column:
    """The text with base spans replaced by their kind, terms removed or generalised to their initial."""
    text = protected["text"]
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def put(acc: Column, s: Column) -> Column:
        gone = F.array_contains(protected["removed"], F.lower(s["value"]))
        term = F.when(gone, "").otherwise(F.concat(F.substr(s["value"], F.lit(1), F.lit(1)), F.lit(".")))
        new = F.when(s["rank"] < len(KINDS), F.get(names, s["rank"])).otherwise(term)
        before = F.substr(text, acc["pos"] + 1, s["start"] - acc["pos"])
        # A span inside the one before is gone already.
        inside = s["start"] < acc["pos"]
        return F.struct(
            F.greatest(acc["pos"], s["end"]).alias("pos"),
            F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], before, new)).alias("out"),
        )

    return F.aggregate(
        protected["spans"], start, put, lambda acc: F.concat(acc["out"], F.substr(text, acc["pos"] + 1, F.length(text)))
    )


def digest(protected: DataFrame) -> DataFrame:
    """Per document: how many valid spans of each base kind, a hash of the base spans, and all spans."""
    base = F.filter(F.col("spans"), lambda s: s["rank"] < len(KINDS))
    ranks = F.transform(F.col("spans"), lambda s: s["rank"])
    counts = [
        (F.size("spans") - F.size(F.array_remove(ranks, r))).cast("long").alias(f"n_{k}") for r, k in enumerate(KINDS)
    ]
    return protected.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
