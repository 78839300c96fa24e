"""Cross-site boilerplate lines by distinct-site spread.

A line's sites are the distinct sources whose documents hold it; white space at
its ends does not tell lines apart. A passage inside a longer line is no line
and out of reach. Every line
hash gets a HyperLogLog sketch of its sites, merged by partial aggregation. An
estimate farther from the threshold than MARGIN decides by itself; lines
nearer get an exact distinct count. Lines on at least ``sites`` sites are
boilerplate: all their occurrences go, but for the first one of the corpus
(smallest doc_id, then position), so no text vanishes altogether.

Hot lines fold in every map task; the later join of line occurrences with the
boilerplate lines runs on written tables, where AQE splits a hot line. Whole
texts are shuffled once, by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, saved

SITES = 5
MIN_CHARS = 16
LG_K = 10
# Beyond four standard errors (1.04 / sqrt(2**LG_K)) of the sketch the estimate decides.
MARGIN = 4 * 1.04 / 2 ** (LG_K / 2)
# What is trimmed off a line's ends: blanks, tabs and the other control characters of line ends.
ENDS = " \t\x0b\x0c\r"


def line_array(text: Column) -> Column:
    """Lines of a text, cut at newlines; null text: no lines."""
    return F.split(text, "\n", -1)


def occurrences(documents: DataFrame, min_chars: int) -> DataFrame:
    """(id, print, site, line, pos): lines of at least ``min_chars`` characters once trimmed.

    ``print`` is the text's hash: together with the id it names the row, so
    that rows which repeat a doc_id with other texts stay apart.
    """
    rows = documents.select(
        F.col("doc_id").cast("long").alias("id"),
        F.xxhash64("text").alias("print"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("site"),
        F.posexplode(line_array(F.col("text").cast("string"))).alias("pos", "content"),
    )
    content = F.btrim(F.col("content"), F.lit(ENDS))
    return rows.where(F.length(content) >= min_chars).select("id", "print", "site", F.xxhash64(content).alias("line"), "pos")


def boilerplate(lines: DataFrame, sites: int) -> DataFrame:
    """(line, first): hashes of the lines on at least ``sites`` sites, and their first occurrence."""
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "print", "pos")).alias("first")
    spread = lines.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("about"), first)
    # Lines that are surely below the threshold are dropped before anything is written.
    spread = saved(spread.where(F.col("about") >= F.lit(sites * (1 - MARGIN))), "line-spread")
    near = F.col("about") <= F.lit(sites * (1 + MARGIN))
    close = spread.where(near).select("line")
    exact = lines.select("line", "site").join(close, "line", "left_semi")
    exact = exact.groupBy("line").agg(F.countDistinct("site").alias("spread")).where(F.col("spread") >= sites)
    sure = spread.where(~near).select("line", "first")
    return sure.unionByName(spread.join(exact.select("line"), "line").select("line", "first"))


def without_boilerplate(documents: DataFrame, sites: int = SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """``documents`` with two more columns: ``clean_text`` and ``removed_lines`` (long).

    Null text: null clean text, 0 lines removed. Empty texts and lines shorter
    than ``min_chars`` are never boilerplate. Documents without a source form
    one site. Rows that repeat a doc_id and text are treated alike. Of a line's
    occurrences with null doc_ids only, the first by text hash stays. All
    columns of ``documents`` are kept as they are, whatever their names; an
    empty table gives no rows.
    """
    lines = occurrences(documents, min_chars)
    marked = saved(boilerplate(lines, sites), "boilerplate")
    hits = lines.select("line", "id", "print", "pos").join(marked, "line")
    is_first = (
        F.col("id").eqNullSafe(F.col("first.id"))
        & (F.col("print") == F.col("first.print"))
        & (F.col("pos") == F.col("first.pos"))
    )
    drop = hits.where(~is_first).groupBy("id", "print").agg(F.collect_set("pos").alias("drop"))
    drop = drop.select(F.col("id").alias("__id"), F.col("print").alias("__print"), F.col("drop").alias("__drop"))
    doc_id, text = documents["doc_id"], documents["text"]
    joined = documents.join(
        drop, doc_id.cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__print")), "left"
    )

    def without(lines: Column) -> Column:
        # The difference is taken by hashing, so many dropped lines of many cost no more than their sum.
        places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__drop"))
        return F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n")

    clean = F.when(F.col("__drop").isNull(), text).otherwise(let(line_array(text.cast("string")), without))
    removed = F.coalesce(F.size("__drop"), F.lit(0)).cast("long")
    return joined.select(*[documents[c] for c in documents.columns], clean.alias("clean_text"), removed.alias("removed_lines"))
