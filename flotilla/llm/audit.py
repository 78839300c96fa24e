"""Interaction audit of five text filters by the Hart-Mas-Colell potential.

A document fails some of the filters A to E; the removal game gives every
coalition S of filters v(S), the documents that at least one of them removes.
Its potential is P(S) = (v(S) + the sum over i in S of P(S without i)) / |S|,
with P of the empty coalition 0. A filter's Shapley value, its removals
averaged over all orders, is P(all) - P(all without it). What a filter removes
at a step of an order is a difference of two coalitions, too: v(S with i) -
v(S), where S are the filters before it. So one row of 32 values per part
answers all 120 orders.

The documents are read once; what stays of a text is its hash, its part and
five bits. The smallest id of every text is an aggregate on the text's hash,
which folds a hot text inside every map task; rows are joined with it by hash
and id, so the copies of one text do not meet in one task. From there on all
is partial aggregates to (part, failure pattern) counts.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, saved

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
ORDERS = ["".join(p) for p in permutations(FILTERS)]
# P(S) is a multiple of 1 / 120 for up to five filters, so 120 * P(S) stays an integer.
SCALE = 120

MIN_WORDS = 100
DISTINCT_PERCENT = 80
CAPITAL_PERCENT = 10


def members(letters: str) -> int:
    """The coalition of some letters, as a bit set."""
    return sum(1 << FILTERS.index(x) for x in letters)


def text_failures(text: Column) -> Column:
    """Bits 0 to 3: the text fails A (few words), B (repetitive), C (capitals), D (markup characters)."""
    words = F.filter(F.split(text, f"[{SPACE_CLASS}]+"), lambda w: w != "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))

    def bits(w: Column) -> Column:
        few = F.size(w) < MIN_WORDS
        repetitive = F.lit(100) * F.size(F.array_distinct(w)) < F.lit(DISTINCT_PERCENT) * F.size(w)
        return few.cast("int") + repetitive.cast("int") * 2

    shape = F.element_at(F.transform(F.array(words), bits), 1)
    loud = (F.lit(100) * capitals > F.lit(CAPITAL_PERCENT) * F.length(text)).cast("int")
    marked = text.rlike("[#$%&*|]").cast("int")
    return shape + loud * 4 + marked * 8


def failures(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the set of filters they fail.

    Bit i of ``mask`` stands for the i-th letter of FILTERS.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    # SHA-256 names a text: equal names are equal texts.
    rows = saved(rows.select("id", "part", F.unhex(F.sha2("text", 256)).alias("name"), text_failures(F.col("text")).alias("mask")), "audit-rows")
    first = rows.groupBy("name").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    # Joined by text and id: the copies of a hot text spread over all tasks.
    copy = (F.col("id").isNotNull() & F.col("first").isNull()).cast("int") * 16
    judged = rows.join(first, ["name", "id"], "left").select("id", "part", (F.col("mask") + copy).alias("mask"))
    return (
        judged.join(marks, "id", "left").groupBy("part", "mask")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("good")).alias("good"), F.count_if(F.col("toxic")).alias("toxic"))
    )


def removal_game(counts: DataFrame) -> DataFrame:
    """(part, total, alone, v, v_good, v_toxic): the game of every part.

    Arrays over coalitions hold at place S (a bit set) how many documents the
    filters of S remove; ``alone`` holds at place S how many fail exactly S.
    """
    def removed(what: str) -> Column:
        return F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(F.lit(s)) != 0, F.col(what)).otherwise(F.lit(0))) for s in range(ALL + 1)])

    alone = F.array(*[F.sum(F.when(F.col("mask") == s, F.col("n")).otherwise(F.lit(0))) for s in range(ALL + 1)])
    return counts.groupBy("part").agg(
        F.sum("n").alias("total"), alone.alias("alone"),
        removed("n").alias("v"), removed("good").alias("v_good"), removed("toxic").alias("v_toxic"),
    )


def potentials(v: Column) -> Column:
    """120 * P(S) at place S, from the smaller coalitions up: a subset's number is always smaller."""

    def without_one(p: Column, s: Column) -> Column:
        return sum(
            (F.when(s.bitwiseAND(F.lit(1 << i)) != 0, F.get(p, s - F.lit(1 << i))).otherwise(F.lit(0)) for i in range(len(FILTERS))),
            F.lit(0).cast("long"),
        )

    def add(p: Column, s: Column) -> Column:
        value = F.lit(SCALE) * F.get(v, s) + without_one(p, s)
        # The division is exact: SCALE is a multiple of every denominator.
        return F.array_append(p, F.call_function("div", value, F.bit_count(s)))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ALL)), F.array(F.lit(0).cast("long")), add)


def filter_audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter order and step: what the step's filter removes after those before it.

    ``documents`` needs doc_id, text and lang, ``labels`` doc_id, quality and
    toxic. Counts are of documents of the part (lang; null: empty string):
    kept after the step, removed by it, redundant (failing its filter, removed
    earlier), unique_fails (failing its filter only), good_lost and toxic_lost
    (removed here, by label), shapley (removed here, summed over all orders).

    A null text counts as empty: it fails A, and E if a smaller doc_id has an
    empty text. A null doc_id is no smaller and no larger than another: such a
    row never fails E and has no label. Rows that repeat a doc_id count each;
    rows of one doc_id are no copies of each other. Rows of ``labels`` that
    repeat a doc_id are one label, 1 if any of them is. Other columns are not
    read. An empty table gives no rows.
    """
    game = removal_game(failures(documents, labels))
    game = game.withColumn("potential", potentials(F.col("v")))
    # Coalitions before and after each step, tabulated with the orders.
    table = F.array(*[
        F.struct(F.lit(o).alias("filter_order"), F.lit(k + 1).alias("step"), F.lit(o[k]).alias("filter"),
                 F.lit(members(o[:k])).alias("before"), F.lit(members(o[k])).alias("own"), F.lit(members(o[: k + 1])).alias("after"))
        for o in ORDERS for k in range(len(FILTERS))
    ])
    steps = game.select("*", F.inline(table))

    def gained(v: str) -> Column:
        return F.get(F.col(v), F.col("after")) - F.get(F.col(v), F.col("before"))

    removed = gained("v")
    return steps.select(
        "part", "filter_order", "step",
        (F.col("total") - F.get(F.col("v"), F.col("after"))).alias("kept"),
        removed.alias("removed"),
        (F.get(F.col("v"), F.col("own")) - removed).alias("redundant"),
        F.get(F.col("alone"), F.col("own")).alias("unique_fails"),
        gained("v_good").alias("good_lost"),
        gained("v_toxic").alias("toxic_lost"),
        (F.get(F.col("potential"), F.lit(ALL)) - F.get(F.col("potential"), F.lit(ALL) - F.col("own"))).alias("shapley"),
        "filter",
    )
