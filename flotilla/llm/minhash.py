"""Near-duplicate detection: circulant MinHash, banding, exact Jaccard on full shingle sets.

Signature. Shingle hashes fall into a universe of ``UNIVERSE`` places. One
permutation (sigma) spreads the places, the other (pi), shifted circularly by
k = 0..K-1, gives signature coordinate k: min over the set of
pi[(sigma(s) + k) mod UNIVERSE]. For one shingle the K values are neighbours in
pi, so a document's signature is a minimum over contiguous slices.

Candidates. Documents with the same shingle set (one 128-bit fingerprint) form
a class and go on as its smallest doc_id. ``rows`` coordinates make a band;
rows and bands are set from the threshold so that a pair at the threshold
shares no band with probability below MISS. All members of a band's bucket are
compared with the bucket's smallest member h, exactly, on full sets. Two other
members x and y are compared only where that leaves a link between different
components open. Their intersection is |x & y & h| plus the shingles foreign to
h which they share, so a link needs either
  A. min(|x & h|, |y & h|) large enough by itself, and Jaccard distances to h
     that differ by no more than a link's distance, or
  B. enough shared foreign shingles; only those found in several components
     count, and one of them is early in hash order in both sets (prefix filter).
Pairs of kind B meet in buckets of one foreign shingle, which are again first
compared with their smallest member. So a large group of copies costs a few
comparisons per member plus the pairs that truly stay open; nothing is capped.

Joins run on written tables by id or bucket key, where AQE splits hot keys;
class and bucket summaries are partial aggregates. Components are found by
hooking parents to the smallest label around and pointer jumping, until nothing
changes; each round is written to the shared checkpoint folder. Rounds grow
with the logarithm of a chain, not its length. No links or components come to
the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved
from .words import NON_SPACE, PIECE, find_words, mix, text_groups

UNIVERSE = 1 << 20
SEED = 20240607
MISS = 1e-5
MOST_BANDS = 32
SLICE = 16_384
# Rows of ids and numbers that a task of a written step takes; with fewer, there is one task a core.
ROWS_PER_TASK = 100_000


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of at most ``rows`` rows, in as many tasks as these are worth, however many partitions its shuffle has."""
    least = df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(least, math.ceil(rows / ROWS_PER_TASK)))


def band_shape(threshold: float) -> tuple[int, int]:
    """(rows, bands): the longest bands for which at most MOST_BANDS keep the miss rate below MISS."""
    best = (1, 1)
    for rows in range(1, 17):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(MISS) / math.log1p(-hit))
        if bands <= MOST_BANDS:
            best = (rows, bands)
    return best


@lru_cache(4)
def permutations(width: int) -> tuple[np.ndarray, np.ndarray]:
    """sigma, and for every place the ``width`` values of pi that follow it circularly."""
    rng = np.random.default_rng(SEED)
    sigma = rng.permutation(UNIVERSE).astype(np.int32)
    pi = rng.permutation(UNIVERSE).astype(np.int32)
    return sigma, np.lib.stride_tricks.sliding_window_view(np.r_[pi, pi[: width - 1]], width)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in order, and where each text's begin (one more at the end).

    Texts of 1 to n - 1 words have one shingle, their whole word sequence.
    """
    w = find_words(data, offsets, NON_SPACE)
    count = np.bincount(w.doc, minlength=w.docs)
    odd = mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    sums, docs = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(w.hash) >= n:
        last = len(w.hash) - n + 1
        sums = sum((w.hash[i : i + last] * odd[i] for i in range(1, n)), w.hash[:last] * odd[0])
        whole = w.doc[:last] == w.doc[n - 1 :]
        sums, docs = mix(sums[whole]), w.doc[:last][whole]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        first = np.searchsorted(w.doc, short)
        extra = np.array(
            [(w.hash[a : a + c] * odd[:c]).sum(dtype=np.uint64) + np.uint64(c) for a, c in zip(first, count[short], strict=True)],
            np.uint64,
        )
        sums, docs = np.r_[sums, mix(extra ^ odd[0])], np.r_[docs, short]
    order = np.lexsort((sums, docs))
    sums, docs = sums[order], docs[order]
    keep = np.r_[True, (sums[1:] != sums[:-1]) | (docs[1:] != docs[:-1])][: len(sums)]
    sums, docs = sums[keep], docs[keep]
    return sums, np.searchsorted(docs, np.arange(w.docs + 1))


def signatures(sets: np.ndarray, begin: np.ndarray, width: int) -> np.ndarray:
    """Circulant MinHash signature of each set (rows of empty sets hold UNIVERSE)."""
    sigma, windows = permutations(width)
    out = np.full((len(begin) - 1, width), UNIVERSE, np.int32)
    places = sigma[(sets & np.uint64(UNIVERSE - 1)).astype(np.int64)]
    owner = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    for a in range(0, len(sets), SLICE):
        own = owner[a : a + SLICE]
        heads = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        low = np.minimum.reduceat(windows[places[a : a + SLICE]], heads, axis=0)
        out[own[heads]] = np.minimum(out[own[heads]], low)
    return out


def band_keys(signature: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """One 64-bit key per document and band, different between bands."""
    odd = mix(np.arange(101, 101 + rows, dtype=np.uint64)) | np.uint64(1)
    parts = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    salt = mix(np.arange(1001, 1001 + bands, dtype=np.uint64))
    return mix((parts * odd).sum(axis=2, dtype=np.uint64) + salt).view(np.int64)


def sketch(documents: DataFrame, n: int, threshold: float) -> DataFrame:
    """(doc_id, n_shingles, print, bands) of every row."""
    rows, bands = band_shape(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_groups(batch.column(1), PIECE):
                sets, begin = shingle_sets(data, offsets, n)
                keys = band_keys(signatures(sets, begin, rows * bands), rows, bands)
                size = np.diff(begin)
                prints = [
                    blake2b(sets[i:j].tobytes(), digest_size=16).digest() if j > i else None
                    for i, j in zip(begin[:-1], begin[1:], strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(size, pa.int64()),
                        pa.array(prints, pa.binary()),
                        pa.ListArray.from_arrays(
                            pa.array(np.arange(0, keys.size + 1, bands), pa.int32()), pa.array(keys.ravel(), pa.int64())
                        ),
                    ],
                    ["doc_id", "n_shingles", "print", "bands"],
                )

    ids = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return ids.mapInArrow(run, "doc_id long, n_shingles long, print binary, bands array<long>")


def compared(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """(a, b, shared, total, size, foreign) of each pair, on full shingle sets.

    ``shared`` and ``total`` are the sizes of intersection and union, ``size``
    that of b's set, ``foreign`` b's shingles outside a's set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_groups(batch.column(2), PIECE):
                left, lo = shingle_sets(data, offsets, n)
                shared, total, size, foreign = [], [], [], []
                for c, d, other, off in text_groups(batch.column(3).slice(a, b - a), PIECE):
                    right, ro = shingle_sets(other, off, n)
                    for k in range(c, d):
                        x, y = left[lo[k] : lo[k + 1]], right[ro[k - c] : ro[k - c + 1]]
                        new = np.setdiff1d(y, x, assume_unique=True)
                        both = y.size - new.size
                        shared.append(both)
                        total.append(x.size + y.size - both)
                        size.append(y.size)
                        foreign.append(new.view(np.int64))
                ids = [batch.column(i).slice(a, b - a) for i in (0, 1)]
                numbers = [pa.array(v, pa.int64()) for v in (shared, total, size)]
                yield pa.RecordBatch.from_arrays(
                    [*ids, *numbers, pa.array(foreign, pa.list_(pa.int64()))],
                    ["a", "b", "shared", "total", "size", "foreign"],
                )

    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return rows.mapInArrow(run, "a long, b long, shared long, total long, size long, foreign array<long>")


def joined(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over the undirected ``edges`` (a, b) for each node that has one."""
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = saved(edges.select(F.inline(ways)), "edges")
    # No step of a round has more than two rows an edge and way.
    rows = 2 * both.count()

    def pointed(parents: DataFrame) -> DataFrame:
        """(a, parent, label): each node's parent, and the parent of that one."""
        up = parents.select(F.col("a").alias("parent"), F.col("parent").alias("label"))
        return saved(dealt(parents.join(up, "parent").select("a", "parent", "label"), rows), "labels")

    def total(labels: DataFrame) -> tuple:
        return tuple(labels.agg(*[F.sum(F.col(c).cast("decimal(38,0)")) for c in ("parent", "label")]).first())

    labels = pointed(saved(dealt(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("parent")), rows), "parents"))
    now = total(labels)
    while True:
        # Smallest label of the node and its neighbours: the node's new parent, and, hooked on, its parent's.
        near = both.join(labels.select("a", "label"), "a").select(F.col("b").alias("a"), "label")
        low = near.unionByName(labels.select("a", "label")).groupBy("a").agg(F.min("label").alias("low"))
        low = saved(dealt(low.join(labels.select("a", "parent"), "a"), rows), "low")
        hooks = low.select(F.col("parent").alias("a"), F.col("low").alias("parent"))
        parents = low.select("a", F.col("low").alias("parent")).unionByName(hooks).groupBy("a").agg(F.min("parent").alias("parent"))
        labels = pointed(saved(dealt(parents, rows), "parents"))
        # Parents never grow, so equal sums mean that none has changed: every node points to its component's smallest.
        was, now = now, total(labels)
        if was == now:
            break
    return labels.select(F.col("a").alias("node"), "label")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over the undirected ``edges`` (a, b) for each of ``nodes``.

    Nodes without an edge are left out of the rounds and keep their own label.
    """
    return nodes.select("node").join(joined(edges), "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def joined_further(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` of ``components`` with further ``edges``: rounds over the components that these join, not over all nodes."""
    ends = [labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}")) for c in ("a", "b")]
    between = edges.join(ends[0], "a").join(ends[1], "b").where("label_a <> label_b")
    between = between.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct()
    found = joined(between).select(F.col("node").alias("label"), F.col("label").alias("smallest"))
    return labels.join(found, "label", "left").select("node", F.coalesce("smallest", "label").alias("label"))


def linked(percent: int) -> Column:
    return F.lit(100) * F.col("shared") >= F.lit(percent) * F.col("total")


def placed(rated: DataFrame, labels: DataFrame) -> DataFrame:
    """(h, rep, n, shared, d, foreign, label) of compared members whose leader's members lie in several components."""
    rows = rated.select(
        F.col("a").alias("h"), F.col("b").alias("rep"), F.col("size").alias("n"), "shared",
        (1 - F.col("shared") / F.col("total")).alias("d"), "foreign",
    ).join(labels.withColumnRenamed("node", "rep"), "rep")
    rows = saved(rows, "placed")
    several = rows.groupBy("h").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 < l1").select("h")
    return saved(rows.join(several, "h", "left_semi"), "open")


def sides(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Pairs x, y of members of different components that meet on ``keys``, x before y."""
    x = left.select(*keys, *[F.col(c).alias(f"{c}_x") for c in columns])
    y = right.select(*keys, *[F.col(c).alias(f"{c}_y") for c in columns])
    return x.join(y, keys).where((F.col("label_x") != F.col("label_y")) & (F.col("rep_x") < F.col("rep_y")))


def may_link(shared: Column, n_x: Column, n_y: Column, percent: int) -> Column:
    """Whether sets of these sizes would be linked if they shared so many shingles."""
    return F.lit(100) * shared >= F.lit(percent) * (n_x + n_y - shared)


def rest_needed(percent: int) -> Column:
    """How many foreign shingles x and y must share to be linked, whatever they share inside h."""
    inside = F.least("shared_x", "shared_y")
    need = F.ceil((F.lit(percent) * (F.col("n_x") + F.col("n_y"))) / F.lit(100.0 + percent) - F.lit(1e-9))
    return F.greatest(need - inside, F.lit(1))


def foreign_rows(opened: DataFrame, percent: int) -> DataFrame:
    """(h, shingle, rep, n, shared, left, label, least): members of ``placed`` by foreign shingle.

    Only shingles whose members lie in several components count. ``left``: how
    many of those the member has from this one on, in hash order; a row stays
    if they are enough for a link with any set (prefix filter). ``least``: the
    shingle's smallest member.
    """
    rows = saved(opened.select("h", "rep", "n", "shared", "label", F.explode("foreign").alias("shingle")), "foreign")
    count = rows.count()
    several = rows.groupBy("h", "shingle").agg(
        F.min("label").alias("l0"), F.max("label").alias("l1"), F.min(F.struct("rep", "n", "shared")).alias("least")
    )
    rows = rows.join(several.where("l0 < l1").select("h", "shingle", "least"), ["h", "shingle"])
    after = Window.partitionBy("h", "rep").orderBy(F.col("shingle").desc())
    rows = rows.withColumn("left", F.row_number().over(after))
    enough = F.greatest(F.ceil((F.lit(percent) * F.col("n") - 100 * F.col("shared")) / F.lit(100.0) - F.lit(1e-9)), F.lit(1))
    return saved(dealt(rows.where(F.col("left") >= enough), count), "foreign-open")


def foreign_pairs(rated: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(a, b): open pairs of kind B."""
    rows = foreign_rows(placed(rated, labels), percent)
    pairs = sides(rows, rows, ["h", "shingle"], ["rep", "n", "shared", "label", "left"])
    pairs = pairs.where(F.least("left_x", "left_y") >= rest_needed(percent))
    return pairs.select(F.col("rep_x").alias("a"), F.col("rep_y").alias("b")).distinct()


def known_pairs(rated: DataFrame) -> DataFrame:
    return rated.select("a", "b")


def open_links(rated: DataFrame, labels: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b): links among open pairs of kind A, and with the smallest members of kind B's buckets."""
    slack = 1 - percent / 100 + 1e-9
    rows = placed(rated, labels)
    # Distances are met in bins as wide as the slack: only equal or neighbouring bins can link.
    bin_ = F.floor(F.col("d") / F.lit(slack))
    around = rows.withColumn("bin", F.explode(F.array(bin_ - 1, bin_, bin_ + 1)))
    by_leader = may_link(F.least("shared_x", "shared_y"), F.col("n_x"), F.col("n_y"), percent)
    fits = by_leader & (F.abs(F.col("d_x") - F.col("d_y")) <= F.lit(slack))
    kind_a = sides(around, rows.withColumn("bin", bin_), ["h", "bin"], ["rep", "n", "shared", "d", "label"]).where(fits)
    kind_a = kind_a.select(F.col("rep_x").alias("a"), F.col("rep_y").alias("b"))
    foreign = foreign_rows(rows, percent).where(F.col("rep") != F.col("least.rep"))
    foreign = foreign.select(
        F.col("least.rep").alias("a"), F.col("rep").alias("b"), "left",
        F.col("least.n").alias("n_x"), F.col("n").alias("n_y"),
        F.col("least.shared").alias("shared_x"), F.col("shared").alias("shared_y"),
    )
    stars = foreign.where(F.col("left") >= rest_needed(percent)).select("a", "b")
    pairs = kind_a.unionByName(stars).distinct().join(known_pairs(rated), ["a", "b"], "left_anti")
    pairs = saved(pairs, "open-pairs")
    return compared(pairs, texts, n).where(linked(percent)).select("a", "b").distinct()


def id_links(named: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): classes, by their smallest ids, that hold texts of one doc_id."""
    texts = named.groupBy("doc_id").agg(F.min("print").alias("low"), F.max("print").alias("high"))
    several = texts.where(F.col("low") != F.col("high")).select("doc_id")
    held = named.select("doc_id", "print").join(several, "doc_id").distinct()
    held = saved(held.join(classes.select("print", "rep"), "print").select("doc_id", "rep"), "several-texts")
    least = held.groupBy("doc_id").agg(F.min("rep").alias("a"))
    return held.join(least, "doc_id").where(F.col("rep") != F.col("a")).select("a", F.col("rep").alias("b")).distinct()


def near_duplicates(documents: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``documents`` (doc_id, text).

    Words are runs of non-space (space, \\t..\\r) after A-Z is lower-cased; a
    set holds the distinct ``n``-word shingles, or the whole sequence of a
    shorter text. Two documents are linked when 100 * shared >= percent *
    union. Null, empty and blank texts have empty sets and are linked with
    nothing. Rows that repeat a doc_id count as one document with several
    texts, which links what each of them is near; each row keeps its own set size. A null doc_id can't be named: its
    row has a null component and is kept. An empty table gives no rows. No
    other column is read.
    """
    threshold = percent / 100
    sketches = saved(sketch(documents, n, threshold), "sketches")
    named = sketches.where(F.col("doc_id").isNotNull() & F.col("print").isNotNull())
    count = sketches.count()
    entries = count * band_shape(threshold)[1]
    classes = named.groupBy("print").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")
    )
    classes = saved(dealt(classes, count), "classes")
    buckets = classes.select("rep", "n", F.explode("bands").alias("key"))
    leaders = (
        buckets.groupBy("key")
        .agg(F.min("rep").alias("leader"), F.max("rep").alias("last"))
        .where(F.col("leader") != F.col("last"))
        .select("key", "leader")
    )
    leaders = saved(dealt(leaders, entries), "leaders")
    members = saved(dealt(buckets.join(leaders, "key").select("key", "leader", "rep", "n"), entries), "members")
    stars = members.where(F.col("rep") != F.col("leader")).select(F.col("leader").alias("a"), F.col("rep").alias("b"))
    stars = saved(dealt(stars.distinct(), entries), "stars")
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = saved(texts.join(wanted, "doc_id", "left_semi"), "texts")
    rated = compared(stars, texts, n)
    # Rows that repeat a doc_id may give a pair several ratings; the closest counts.
    closest = F.max(F.struct(F.col("shared") / F.col("total"), "shared", "total", "size", "foreign")).alias("m")
    rated = saved(rated.groupBy("a", "b").agg(closest).select("a", "b", "m.shared", "m.total", "m.size", "m.foreign"), "rated")
    same_id = saved(id_links(named, classes), "id-links")
    ends = members.select(F.col("rep").alias("node")).unionByName(same_id.select(F.explode(F.array("a", "b")).alias("node")))
    nodes = saved(dealt(ends.distinct(), count), "nodes")
    links = rated.where(linked(percent)).select("a", "b").unionByName(same_id)
    labels = saved(components(nodes, links), "components")
    more = saved(open_links(rated, labels, texts, n, percent), "more-links")
    if not more.isEmpty():
        labels = saved(joined_further(labels, more), "components")
    # Once more over foreign shingles: what their smallest members have not joined.
    last = foreign_pairs(rated, labels, percent).join(known_pairs(rated), ["a", "b"], "left_anti")
    last = saved(compared(saved(last, "last-pairs"), texts, n).where(linked(percent)).select("a", "b"), "last-links")
    if not last.isEmpty():
        labels = saved(joined_further(labels, last), "components")

    reps = classes.select("print", "rep")
    reps = saved(
        reps.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
            "print", F.coalesce("label", "rep").alias("label")
        ),
        "reps",
    )
    out = sketches.select("doc_id", "n_shingles", "print").join(reps, "print", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
