"""A clustered layout of the stored inspection table (SNK1): rows along a space-filling curve.

Inside a month the rows follow the Z-order of (driver, plate, day): the bits of
their ranks, taken in turn. Rows near in any of the three lie in few row
groups, whose smallest and largest values then rule most groups out for a point
search on a driver or a plate alike, where a plain sort would serve one of them
only.

Ranks keep the order of the values: each column's RANKS - 1 cuts are quantiles
of a bounded sample of its values (SAMPLE at most, picked by a hash of the
value), found by one sort of the sample. A cut that is off only makes row
groups overlap more; the rows are those of the plain layout, and every reader
of the table reads this one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tables
from .files import with_partition_columns

BITS = 8
RANKS = 1 << BITS
SAMPLE = 100_000
COLUMNS = ("conductor", "placa")
# Bytes of a row group; a search opens whole groups.
ROW_GROUP_BYTES = 8 << 20


def cuts(rows: DataFrame, column: str) -> list[str]:
    """At most RANKS - 1 values that part the distinct values of a column into runs of about equal number."""
    values = rows.select(F.col(column).alias("v")).where(F.col("v").isNotNull()).distinct()
    count = values.select(F.hll_sketch_estimate(F.hll_sketch_agg("v")).alias("n")).first().n or 0
    share = max(1, -(-2 * count // SAMPLE))
    some = values.where(F.pmod(F.xxhash64("v"), F.lit(share)) == 0).limit(SAMPLE)
    parts = some.select("v", F.ntile(RANKS).over(Window.orderBy("v")).alias("part"))
    firsts = parts.groupBy("part").agg(F.min("v").alias("v")).where(F.col("part") > 1)
    return [r.v for r in firsts.orderBy("v").collect()]


def rank(value: Column, bounds: list[str]) -> Column:
    """How many of the sorted ``bounds`` a value reaches, by halving steps; null: 0."""
    if not bounds:
        return F.lit(0)
    array = F.array(*[F.lit(b) for b in bounds])
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(BITS))])
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(array, at + step - 1) <= value, at + step).otherwise(at))
    return F.coalesce(found, F.lit(0))


def z_order(ranks: list[Column]) -> Column:
    """The bits of some ranks, in turn, as one number."""
    n = len(ranks)
    bits = [
        F.call_function("shiftleft", F.call_function("getbit", r.cast("long"), F.lit(i)).cast("long"), F.lit(n * i + (n - 1 - k)))
        for k, r in enumerate(ranks)
        for i in range(BITS)
    ]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def write_clustered(inspections: DataFrame, path: str, mode: str = "overwrite", row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Store inspections like ``tables.write_inspections``, the rows of a month in Z-order.

    The curve is cut by range into tasks, so a month with very many rows
    becomes several files and a hot driver's rows spread by plate and day.
    """
    typed = with_partition_columns(inspections.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in tables.INSPECTION_SCHEMA]))
    day = F.coalesce(F.dayofmonth("fecha"), F.lit(0)) * (RANKS // 32)
    curve = z_order([*[rank(F.col(c), cuts(typed, c)) for c in COLUMNS], day])
    months = tables.PARTITION_SCHEMA.names
    placed = typed.withColumn("__z", curve).repartitionByRange(*months, "__z", *COLUMNS).sortWithinPartitions(*months, "__z", *COLUMNS)
    out = placed.drop("__z").write.mode(mode).partitionBy(*months).option("parquet.block.size", row_group_bytes)
    out.parquet(path)
