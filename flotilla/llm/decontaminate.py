"""Benchmark decontamination by spaced-seed hashing.

A seed is the hash of six tokens; a mask says which of those from a place on,
the others may be anything. Seeds of every mask at every position of the
benchmark items and of the documents meet in a join on the hash. A hit fixes a
diagonal (document position minus item position); along it the tokens of
document and item are compared, and the document is contaminated when some
WINDOW of consecutive item tokens agrees in at least NEED places, so
substituted words do not hide an overlap. An item shorter than WINDOW is one
window, the count is scaled. The masks are complete: whatever places are
substituted within that rule, some mask at some place looks at none of them (a
test enumerates all patterns). Items too short for the rule, of fewer than
SHORT tokens, count where all their tokens stand side by side.

Documents' seeds pass a bit filter sized by the number of item seeds before
the shuffle, so mostly hits are shuffled. Texts of documents with a hit are
read again through a second such filter. A passage that many documents share
is a hot hash: that join is a plain join of two shuffled sides, which AQE
splits. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitmap import bits_of, may_hold
from .common import let, saved, word_array

# Token places each mask looks at; it ignores the others. Found by a search over sets of
# four masks of six places for one that leaves out no pattern of substitutions the rule admits.
MASKS = ((0, 2, 4, 6, 8, 9), (0, 1, 4, 5, 6, 7), (0, 1, 2, 3, 4, 6), (0, 1, 5, 8, 9, 10))
WINDOW = 16
NEED = 13
SHORT = 9


def seed(words: Column, at: Column, number: int) -> Column:
    """Hash of mask ``number`` laid on ``words`` from place ``at`` (from 0); null where the mask juts out."""
    value = F.xxhash64(F.lit(number), *[F.get(words, at + F.lit(o)) for o in MASKS[number]])
    return F.when(at + F.lit(max(MASKS[number])) < F.size(words), value)


def places(words: Column, span: int) -> Column:
    """Places where ``span`` tokens can start, exploded; shorter texts have none."""
    last = F.size(words) - F.lit(span)
    return F.explode(F.when(last >= 0, F.sequence(F.lit(0), last)))


def seeds(rows: DataFrame, keys: list[str], bits: Column | None = None) -> DataFrame:
    """``keys``, place and hash of all seeds of ``rows`` (keys, words) that pass the filter."""
    shortest = min(map(max, MASKS)) + 1
    spread = rows.select(*keys, "words", places(F.col("words"), shortest).alias("at"))
    # One row a seed before the filter: its test is compiled once, not once for every mask.
    each = F.array(*[seed(F.col("words"), F.col("at"), i) for i in range(len(MASKS))])
    out = spread.select(*keys, "at", F.explode(each).alias("seed")).where(F.col("seed").isNotNull())
    return out if bits is None else out.where(may_hold(bits, F.col("seed")))


def whole_runs(rows: DataFrame, items: DataFrame) -> DataFrame:
    """(id, print, item_id): documents that hold all tokens of an item of fewer than SHORT tokens side by side."""
    run = F.array_join("item", " ")  # tokens hold no blanks, so this names the tokens
    short = saved(items.where(F.size("item") < SHORT).select("item_id", F.size("item").alias("size"), run.alias("run")), "short-items")
    sizes = sorted(r.size for r in short.select("size").distinct().collect())  # at most SHORT - 1
    if not sizes:
        return items.select(F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("print"), "item_id").limit(0)
    bits = bits_of(short.select(F.xxhash64("run").alias("key")), short.count())
    spread = rows.select("id", "print", "words", places(F.col("words"), sizes[0]).alias("at"))
    runs = [F.when(F.col("at") + size <= F.size("words"), F.array_join(F.slice("words", F.col("at") + 1, size), " ")) for size in sizes]
    runs = spread.select("id", "print", F.explode(F.array(*runs)).alias("run"))
    runs = runs.where(may_hold(bits, F.xxhash64("run"))).distinct()
    return runs.join(short.select("run", "item_id"), "run").select("id", "print", "item_id")


def overlap(words: Column, item: Column, diagonal: Column) -> Column:
    """Most agreeing places in any WINDOW of item tokens laid on the document along ``diagonal``.

    Items shorter than WINDOW are one window; the count is then scaled to WINDOW.
    """
    n = F.size(item)
    same = F.transform(
        item,
        lambda token, i: F.when((i + diagonal >= 0) & (F.get(words, F.greatest(i + diagonal, F.lit(0))) == token), 1).otherwise(0),
    )
    width = F.least(n, F.lit(WINDOW))

    def best(agree: Column) -> Column:
        sums = F.transform(
            F.sequence(F.lit(1), n - width + 1),
            lambda j: F.aggregate(F.slice(agree, j, width), F.lit(0), lambda a, x: a + x),
        )
        return F.array_max(sums)

    return let(same, best) * F.lit(WINDOW) / width


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(id, print, item_id): overlaps found between documents and benchmark items.

    ``id`` is the doc_id and ``print`` the hash of the text, which together
    name a row, also where doc_ids repeat or are null. Null and empty texts
    and items overlap with nothing. Items that repeat an item_id are one item
    with several texts.
    """
    rows = documents.select(
        F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("print"), word_array(F.col("text").cast("string")).alias("words")
    )
    items = saved(
        benchmark.select(
            F.col("item_id").cast("long").alias("item_id"), F.xxhash64("text").alias("item_print"),
            word_array(F.col("text").cast("string")).alias("item"),
        ).where(F.size("item") > 0).distinct(),
        "items",
    )
    item_seeds = seeds(items.where(F.size("item") >= SHORT).withColumn("words", F.col("item")), ["item_id", "item_print"])
    item_seeds = saved(item_seeds.withColumnRenamed("at", "item_at"), "item-seeds")
    bits = bits_of(item_seeds.select(F.col("seed").alias("key")), item_seeds.count())
    found = seeds(rows, ["id", "print"], bits).join(item_seeds, "seed")
    hits = found.select("id", "print", "item_id", "item_print", (F.col("at") - F.col("item_at")).alias("diagonal"))
    hits = saved(hits.distinct(), "hits")
    wanted = bits_of(hits.select(F.xxhash64("id", "print").alias("key")), hits.count())
    texts = rows.where(may_hold(wanted, F.xxhash64("id", "print"))).dropDuplicates(["id", "print"])
    texts = texts.select(F.col("id").alias("i"), F.col("print").alias("p"), "words")
    laid = hits.join(items, ["item_id", "item_print"]).join(
        texts, F.col("id").eqNullSafe(F.col("i")) & (F.col("print") == F.col("p"))
    )
    rated = laid.select("id", "print", "item_id", overlap(F.col("words"), F.col("item"), F.col("diagonal")).alias("agree"))
    found = rated.where(F.col("agree") >= NEED).select("id", "print", "item_id")
    return found.unionByName(whole_runs(rows, items)).distinct()


def flag_documents(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` with two more columns: ``contaminated`` (boolean) and ``n_items`` (long).

    One row for every row of ``documents``, whatever repeats or is null; all
    its columns are kept as they are. An empty benchmark contaminates nothing.
    """
    found = saved(contaminated(documents, benchmark), "overlaps")
    per = found.groupBy("id", "print").agg(F.count(F.lit(1)).alias("n"))
    per = per.select(F.col("id").alias("__id"), F.col("print").alias("__print"), F.col("n").alias("__n"))
    joined = documents.join(
        per,
        documents["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(documents["text"]) == F.col("__print")),
        "left",
    )
    n = F.coalesce("__n", F.lit(0))
    return joined.select(*[documents[c] for c in documents.columns], (n > 0).alias("contaminated"), n.alias("n_items"))
