"""Entropy balancing: document rates that meet each source's word target, rounded into copies.

Rates r_d minimise sum r (log r - 1) subject to sum r_d * size_d = target of
the source and r_d <= CAP. The dual is one multiplier per source, and the
solution is the exponential tilt r_d = min(CAP, exp(lambda * x_d)) with
x_d = size_d over the source's mean size. Newton's method solves all sources
side by side: every round is one aggregate over the (source, size) histogram
of the documents, kept between brackets, since the sum rises with lambda.

Rounding is systematic: with F the running sum of rates in the order
(size, salt, doc_id) of a source, a document gets floor(F_d + p) -
floor(F_before + p) copies, so the words taken stay within the largest size of
the target; of PHASES values of p each source takes the one that comes nearest,
which the histogram alone tells. The
running sum is put together from three levels (sizes of a source, salts of a
size, documents of a salt), none of which holds more rows than distinct sizes,
``salts`` or documents of one salt: a source, or one size of a source, with a
third of all rows is spread over ``salts`` groups.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, saved

CAP = 3.0
WEIGHTS = (1.0, 2.0, 3.0)
ROWS_PER_SALT = 100_000
LEAST_SALTS = 64
ROUNDS = 60
LAMBDA_MAX = 64.0
TOLERANCE = 1e-7
# Starting points of the rounding that are tried for each source.
PHASES = 64


def word_count(text: Column) -> Column:
    """Number of space-separated words; null text: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE_CLASS}]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) of the sized documents, one row per source.

    Weights go round 1, 2, 3 in code-point order of the sources, null last.
    A target stops at CAP times the source's size; what is above is shared
    again by weight among the sources that have not stopped, until none is
    above. Only totals come to the driver, never the list of sources.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # Global place of a source: its place in its range of the order plus the ranges before.
    ranged = saved(
        per.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources"
    )
    order = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    parts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = parts.select(
        F.col("part"),
        F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(
            "before"
        ),
    )
    place = F.row_number().over(order) - 1 + F.col("before")
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (place % len(WEIGHTS) + 1).cast("int"))
    ranked = ranged.join(before, "part").select(
        "source", "source_size", weight.alias("weight"), (F.lit(CAP) * F.col("source_size")).alias("most")
    )
    ranked = saved(ranked, "source-weights")
    # Water level: share = level * weight; every round stops the sources above it.
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, stopped = 0.0, -1
    while True:
        above = F.col("most") < F.lit(level) * F.col("weight")
        row = ranked.agg(
            F.count_if(above), F.sum(F.when(above, F.col("most"))), F.sum(F.when(~above, F.col("weight")))
        ).first()
        count, fixed, free = row[0], float(row[1] or 0.0), float(row[2] or 0.0)
        if count == stopped or free <= 0.0:
            break
        stopped, level = count, (total - fixed) / free
    target = F.least(F.col("most"), F.lit(level) * F.col("weight"))
    return ranked.select("source", "source_size", target.alias("target"))


def exact_sum(c: Column) -> Column:
    """Sum of doubles as decimals: the same for any order of the rows, so reruns agree to the last bit."""
    return F.sum(c.cast("decimal(38,10)")).cast("double")


def newton_step(rows: DataFrame, state: DataFrame) -> DataFrame:
    """One safeguarded Newton step of every source that is not done: one join and one aggregate over the histogram.

    The state's columns are keys of the aggregate, so the state stands in the
    plan once; every source has a row in the histogram.
    """
    joined = rows.select(F.col("source").alias("s"), "size", "n").join(state, F.col("s").eqNullSafe(F.col("source")))
    x = F.col("size") / F.col("mean")
    rate = F.exp(F.least(F.col("lam") * x, F.lit(60.0)))
    words = F.col("n") * F.col("size")
    counts = ~F.col("done") & (F.col("size") > 0)
    sums = joined.groupBy("source", "target", "mean", "lam", "low", "high", "done").agg(
        exact_sum(F.when(counts, words * F.least(rate, F.lit(CAP)))).alias("value"),
        exact_sum(F.when(counts, F.when(rate < CAP, words * x * rate).otherwise(0.0))).alias("slope"),
    )
    gap = F.col("value") - F.col("target")
    step = F.col("lam") - gap / F.col("slope")
    inside = (F.col("slope") > 0) & (step > F.col("new_low")) & (step < F.col("new_high"))
    done = F.col("done") | F.col("value").isNull() | (F.col("new_high") - F.col("new_low") < 1e-12)
    done = done | (F.abs(gap) <= TOLERANCE * F.greatest(F.col("target"), F.lit(1.0)))
    return (
        sums.withColumn("new_low", F.when(gap < 0, F.col("lam")).otherwise(F.col("low")))
        .withColumn("new_high", F.when(gap > 0, F.col("lam")).otherwise(F.col("high")))
        .withColumn("new_done", done)
        .select(
            "source", "target", "mean",
            F.when(F.col("new_done"), F.col("lam")).when(inside, step)
            .otherwise((F.col("new_low") + F.col("new_high")) / 2).alias("lam"),
            F.col("new_low").alias("low"), F.col("new_high").alias("high"), F.col("new_done").alias("done"),
        )
    )


def tilts(histogram: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, lam): Newton iterations for all sources at once over (source, size, n)."""
    mean = histogram.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    state = targets.join(mean, targets["source"].eqNullSafe(mean["source"])).select(
        targets["source"], "target", "mean",
        F.lit(0.0).alias("lam"), F.lit(-LAMBDA_MAX).alias("low"), F.lit(LAMBDA_MAX).alias("high"),
        F.lit(False).alias("done"),
    )
    state = saved(state, "tilts")
    for _ in range(ROUNDS):
        # Written each round: a plan never holds more than one step, and the state is scanned with its true size.
        state = saved(newton_step(histogram, state), "tilts")
        if state.where(~F.col("done")).isEmpty():
            break
    return state.select("source", "mean", "lam")


def phases(levels: DataFrame, targets: DataFrame) -> DataFrame:
    """(ps, phase): for each source the rounding start whose words come nearest to the target."""
    tried = levels.withColumn("phase", F.explode(F.expr(f"transform(sequence(0, {PHASES - 1}), i -> (i + 0.5D) / {PHASES})")))
    start = F.col("before_size") + F.col("phase")
    copies = F.floor(start + F.col("n") * F.col("rate")) - F.floor(start)
    words = tried.groupBy("source", "phase").agg(F.sum(copies * F.col("size")).alias("words"))
    words = words.join(
        targets.select(F.col("source").alias("ps"), F.col("target")), F.col("source").eqNullSafe(F.col("ps"))
    )
    off = F.struct(F.abs(F.col("words") - F.col("target")), "phase")
    return words.groupBy("ps").agg(F.min_by("phase", off).alias("phase"))


def mix(documents: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken) for every row of ``documents``.

    ``copies`` is how often the mix takes the document, 0 to 3; ``taken`` its
    words counted as often. Null or empty texts have size 0 and get no copy
    (they have no words to give). Null sources form one source of their own,
    last in order. Repeated rows are separate documents; ties in doc_id are
    broken by nothing and get the same copies or differ by one, in an order
    fixed by the row values. An empty table, or one without words, gives
    rows with target 0 and nothing taken. No other column is read.
    """
    sized = saved(
        documents.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            word_count(F.col("text")).alias("size"),
        ),
        "sizes",
    )
    targets = saved(source_targets(sized), "targets")
    histogram = saved(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "size-histogram")
    lam = tilts(histogram, targets).withColumnRenamed("source", "s")

    # Rates per (source, size), and the running sum of rates before each size.
    x = F.col("size") / F.col("mean")
    rate = F.when(F.col("size") > 0, F.least(F.lit(CAP), F.exp(F.least(F.col("lam") * x, F.lit(60.0))))).otherwise(0.0)
    by_size = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        histogram.join(lam, F.col("source").eqNullSafe(F.col("s")))
        .withColumn("rate", rate)
        .withColumn("before_size", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(by_size), F.lit(0.0)))
        .select("source", "size", "rate", "before_size")
    )
    levels = saved(levels, "levels")
    levels = levels.join(phases(levels.join(histogram.withColumnsRenamed({"source": "hs", "size": "hz"}), F.col("source").eqNullSafe(F.col("hs")) & (F.col("size") == F.col("hz"))), targets), F.col("source").eqNullSafe(F.col("ps")))
    levels = levels.join(
        targets.withColumnRenamed("source", "t"), F.col("source").eqNullSafe(F.col("t"))
    ).drop("t")

    rows = histogram.agg(F.sum("n")).first()[0] or 0
    salts = max(LEAST_SALTS, math.ceil(rows / ROWS_PER_SALT))
    salted = sized.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    by_salt = Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        salted.groupBy("source", "size", "salt")
        .agg(F.count(F.lit(1)).alias("m"))
        .withColumn("before_salt", F.coalesce(F.sum("m").over(by_salt), F.lit(0)))
    )
    offsets = offsets.join(
        levels.withColumnRenamed("source", "ls").withColumnRenamed("size", "lz"),
        F.col("source").eqNullSafe(F.col("ls")) & (F.col("size") == F.col("lz")),
    ).select("source", "size", "salt", "before_salt", "rate", "before_size", "phase", "source_size", "target")
    offsets = saved(offsets, "offsets")
    offsets = offsets.select(*[F.col(c).alias(f"o_{c}") for c in offsets.columns])

    nth = F.row_number().over(Window.partitionBy("source", "size", "salt").orderBy("doc_id"))
    numbered = salted.withColumn("nth", nth)
    joined = numbered.join(
        offsets,
        F.col("source").eqNullSafe(F.col("o_source"))
        & (F.col("size") == F.col("o_size"))
        & (F.col("salt") == F.col("o_salt")),
    )
    place = F.col("o_before_salt") + F.col("nth")
    upto = F.floor(F.col("o_before_size") + F.col("o_rate") * place + F.col("o_phase"))
    before = F.floor(F.col("o_before_size") + F.col("o_rate") * (place - 1) + F.col("o_phase"))
    copies = F.least(upto - before, F.lit(int(CAP))).cast("long")
    return joined.select(
        "doc_id", "source", "size",
        F.col("o_source_size").alias("source_size"), F.col("o_target").alias("target"), F.col("o_rate").alias("rate"),
        copies.alias("copies"), (copies * F.col("size")).alias("taken"),
    )
