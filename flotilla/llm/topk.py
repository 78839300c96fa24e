"""Exact top-k inner products by block-at-a-time pruning over document-range blocks.

Vectors become integers, floor(256 * x), and are cut in vec_id order into
blocks of BLOCK, each with a forward index (its vectors) and a summary: per
component its largest and smallest value. For a query the sum over components
of the better of q * largest and q * smallest, the summed maxima, bounds every
score of the block.

1. Summaries and queries meet in cells of bounded size; the blocks of the whole
   table are ranked per query by their bound, and the FIRST best are scored. The
   k-th score they give is the query's floor.
2. Summaries meet queries again: a block is needed by a query if its bound
   reaches the floor. Only needed blocks, and the queries that need them, are
   shuffled; no vector of another block is looked at.
3. A query visits the blocks of a cell in the order of their bounds and scores
   them through their forward index until the next bound falls below the k-th
   score so far or the floor. A bound equal to it is still scored, for ties go
   to the smaller vec_id.

A cell holds the vectors of at most RANGE_BLOCKS blocks (or GROUP_BLOCKS
summaries) and about CHUNK queries, whatever the table's size; queries are
dealt to chunks by a hash of the row, so equal vectors or a hot region cannot
pile up in one cell. A window with a group limit keeps the k best of each query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

SCALE = 256
BLOCK = 128
RANGE_BLOCKS = 64
GROUP_BLOCKS = 4096
CHUNK = 4096
# Blocks that are scored for a query's floor.
FIRST = 2
NONE = -math.inf


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """(row, vec_id, dim, v): components floor(256 * x); unusable vectors are left out. ``row`` numbers the rows."""
    x = F.col("embedding").cast("array<double>")
    good = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & good)
    return rows.select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"),
        F.size("embedding").alias("dim"), F.transform(x, lambda e: F.floor(e * SCALE)).alias("v"),
    )


def matrix(column: pa.ChunkedArray | pa.Array, rows: int, dim: int) -> np.ndarray:
    """The lists of a column as the rows of a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(rows, dim)


def block_index(vectors: DataFrame, total: int) -> DataFrame:
    """One row per block: range and group (numbers), dim, n, summary (high, low) and forward index (ids, rows, v) as packed numbers."""
    size, ranges = BLOCK, RANGE_BLOCKS

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts).sort_by([("dim", "ascending"), ("vec_id", "ascending"), ("row", "ascending")])
        part = TaskContext.get().partitionId() << 32
        dims, number = table["dim"].to_numpy(), 0
        for dim in np.unique(dims).tolist():
            a, b = (int(np.searchsorted(dims, dim, side)) for side in ("left", "right"))
            for at in range(a, b, size):
                block = table.slice(at, min(size, b - at))
                v = matrix(block["v"], block.num_rows, dim).astype(np.int64)
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([part + number], pa.int64()), "range": pa.array([part + number // ranges], pa.int64()),
                    "dim": pa.array([dim], pa.int32()), "n": pa.array([block.num_rows], pa.int32()),
                    "high": [v.max(axis=0).tobytes()], "low": [v.min(axis=0).tobytes()],
                    "ids": [block["vec_id"].to_numpy().tobytes()], "rows": [block["row"].to_numpy().tobytes()], "v": [v.tobytes()],
                })
                number += 1

    wanted = max(1, math.ceil(total / (size * ranges)))
    ranged = vectors.repartitionByRange(wanted, "vec_id", "row")
    schema = "block long, range long, dim int, n int, high binary, low binary, ids binary, rows binary, v binary"
    return saved(ranged.mapInArrow(cut, schema), "blocks")


def unpacked(column: pa.ChunkedArray, dim: int | None = None) -> np.ndarray:
    """Packed 64-bit numbers of all rows, one below the other."""
    flat = np.frombuffer(b"".join(x.as_py() for x in column), np.int64)
    return flat if dim is None else flat.reshape(-1 if dim else column.length(), dim)


def number_kind(q: np.ndarray, c: np.ndarray) -> type:
    """Doubles if all sums stay below 2**53, so exact; else Python integers."""
    large = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    return np.float64 if large < 2.0**53 else object


def bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Summed maxima: what no score of a block (column) with a query (row) exceeds."""
    zero = np.zeros_like(q)
    return np.maximum(q, zero) @ high.T + np.minimum(q, zero) @ low.T


def best_in_blocks(q, q_rows, floor, c, c_ids, c_rows, heads, high, low, k: int):
    """(query, vec_id, score) of the k best candidates of every query, by pruned visits of blocks that begin at ``heads``."""
    kind = number_kind(q, c)
    q, c = q.astype(kind), c.astype(kind)
    bound = bounds(q, high.astype(kind), low.astype(kind))
    order = np.argsort(-bound, axis=1, kind="stable")
    ends = np.r_[heads[1:], len(c)]
    top = np.full((len(q), k), NONE, kind)
    ids = np.full((len(q), k), np.iinfo(np.int64).max, np.int64)
    active = np.arange(len(q))
    for turn in range(len(heads)):
        blocks = order[active, turn]
        # Bounds only fall from here: a query whose next bound is below its k-th score or floor is done.
        going = (bound[active, blocks] >= top[active, k - 1]) & (bound[active, blocks] >= floor[active])
        active, blocks = active[going], blocks[going]
        if not len(active):
            break
        for b in np.unique(blocks):
            rows = active[blocks == b]
            part = slice(heads[b], ends[b])
            score = q[rows] @ c[part].T
            score[q_rows[rows][:, None] == c_rows[part][None, :]] = NONE
            # Merge with the best so far: larger score first, then smaller id.
            s = np.concatenate([top[rows], score], axis=1)
            i = np.concatenate([ids[rows], np.broadcast_to(c_ids[part], score.shape)], axis=1)
            by_id = np.argsort(i, axis=1, kind="stable")
            s, i = np.take_along_axis(s, by_id, 1), np.take_along_axis(i, by_id, 1)
            pick = np.argsort(-s, axis=1, kind="stable")[:, :k]
            top[rows], ids[rows] = np.take_along_axis(s, pick, 1), np.take_along_axis(i, pick, 1)
    real = top != NONE
    return np.repeat(q_rows, real.sum(axis=1)), ids[real], top[real]


def queries_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, rows, floors) of a cell's queries."""
    dim = table["dim"][0].as_py()
    floor = np.array([NONE if f is None else f for f in table["floor"].to_pylist()], object)
    return matrix(table["v"], table.num_rows, dim), table["row"].to_numpy(), floor


def long_columns(columns, names: list[str]) -> pa.Table:
    return pa.table([pa.array([int(x) for x in c] if c.dtype == object else c.astype(np.int64), pa.int64()) for c in columns], names)


def score_cells(queries: DataFrame, blocks: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(row, vec_id, score): the k best of every query among the blocks of its cell."""

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["row", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return long_columns([np.zeros(0, np.int64)] * 3, names)
        dim = left["dim"][0].as_py()
        q, q_rows, floor = queries_of(left)
        sizes = right["n"].to_numpy()
        parts = [unpacked(right[c], dim) for c in ("v", "high", "low")]
        c = parts[0] if dim else np.zeros((int(sizes.sum()), 0), np.int64)
        heads = np.cumsum(sizes) - sizes
        found = best_in_blocks(q, q_rows, floor, c, unpacked(right["ids"]), unpacked(right["rows"]), heads, parts[1], parts[2], k)
        return long_columns(found, names)

    # Columns of its own, where both sides come from the same tables.
    blocks = blocks.select(*[F.col(c).alias(c) for c in blocks.columns])
    return queries.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInArrow(cell, "row long, vec_id long, score long")


def exact_top_k(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each row whose vec_id is divisible by ``every``.

    Null vectors and vectors with a null, NaN or infinite component take no
    part, nor do rows without a vec_id. Every other row is a candidate, and a
    query if its vec_id says so, also where rows repeat a vec_id or a vector:
    a query leaves out nothing but its own row. Vectors are compared only with
    vectors of their own length; empty vectors score 0 with each other. Ties
    go to the smaller vec_id; a query with fewer than k others gets all. An
    empty table gives no rows. Scores beyond 64 bits fail the job. No column
    but ``vec_id`` and ``embedding`` is read.
    """
    vectors = saved(integer_vectors(embeddings), "vectors")
    blocks = block_index(vectors, vectors.count())
    groups = max(1, math.ceil(blocks.count() / GROUP_BLOCKS))
    queries = vectors.where(F.col("vec_id") % F.lit(every) == 0)
    chunks = max(1, math.ceil(queries.count() / CHUNK))
    queries = queries.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int"))
    group = F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("group")
    summaries = blocks.select("block", "range", "dim", "high", "low", group, F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    all_groups = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group")
    cell, first = ["group", "chunk", "dim"], FIRST

    def ranked(left: pa.Table, right: pa.Table) -> pa.Table:
        """The FIRST blocks of every query by bound."""
        if not left.num_rows or not right.num_rows:
            return pa.table({"row": pa.array([], pa.int64()), "block": pa.array([], pa.int64()), "bound": pa.array([], pa.float64())})
        dim = left["dim"][0].as_py()
        q, rows, _ = queries_of(left)
        bound = bounds(q.astype(float), unpacked(right["high"], dim).astype(float), unpacked(right["low"], dim).astype(float))
        best = np.argsort(-bound, axis=1, kind="stable")[:, :first]
        number = right["block"].to_numpy()
        return pa.table({
            "row": np.repeat(rows, best.shape[1]), "block": number[best].ravel(), "bound": np.take_along_axis(bound, best, 1).ravel(),
        })

    def needed(left: pa.Table, right: pa.Table) -> pa.Table:
        """The ranges that each query needs, and the blocks that some query of the chunk needs."""
        out = {name: [] for name in ("range", "block", "row")}
        if left.num_rows and right.num_rows:
            dim = left["dim"][0].as_py()
            q, rows, floor = queries_of(left)
            high, low = unpacked(right["high"], dim), unpacked(right["low"], dim)
            kind = number_kind(q, np.r_[high, low])
            reach = bounds(q.astype(kind), high.astype(kind), low.astype(kind)) >= floor[:, None]
            ranges, number = right["range"].to_numpy(), right["block"].to_numpy()
            some = np.flatnonzero(reach.any(axis=0))
            out = {"range": ranges[some].tolist(), "block": number[some].tolist(), "row": [None] * len(some)}
            for r in np.unique(ranges[some]):
                wants = rows[reach[:, ranges == r].any(axis=1)].tolist()
                out["range"] += [int(r)] * len(wants)
                out["block"] += [None] * len(wants)
                out["row"] += wants
        return pa.table({n: pa.array(v, pa.int64()) for n, v in out.items()})

    no_floor = queries.withColumn("floor", F.lit(None).cast("long"))
    tops = no_floor.select("*", all_groups).groupBy(*cell).cogroup(summaries.groupBy(*cell)).applyInArrow(
        ranked, "row long, block long, bound double"
    )
    order = Window.partitionBy("row").orderBy(F.col("bound").desc(), "block")
    firsts = saved(tops.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= FIRST).select("row", "block"), "first-blocks")
    # A block that is the best of very many queries goes to each of their chunks.
    asked = no_floor.join(firsts, "row")
    wanted = asked.select("block", "chunk").distinct()
    found = score_cells(asked, blocks.join(wanted, "block"), ["block", "chunk", "dim"], k)
    floors = found.groupBy("row").agg(F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(k - 1)).alias("floor"))
    queries = saved(queries.join(floors, "row", "left"), "floored-queries")

    cells = queries.select("*", all_groups).groupBy(*cell).cogroup(summaries.groupBy(*cell)).applyInArrow(
        needed, "range long, block long, row long"
    )
    needs = saved(cells, "needed")
    asked = queries.join(needs.where(F.col("row").isNotNull()).select("range", "row").distinct(), "row")
    # What a chunk's queries need of a range: the chunk of a block's row is told by the cell's queries.
    chunked = asked.select("range", "chunk", "dim").distinct()
    held = blocks.join(needs.where(F.col("block").isNotNull()).select("block").distinct(), "block").join(chunked, ["range", "dim"])
    found = score_cells(asked, held, ["range", "chunk", "dim"], k)
    best = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    ranked_rows = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    ids = queries.select("row", F.col("vec_id").alias("query_id"))
    return ranked_rows.join(ids, "row").select("query_id", "rank", "vec_id", "score")
