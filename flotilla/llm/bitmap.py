"""A bit filter over hash keys, in SQL functions, sized by the number of keys.

One scalar subquery makes it, each task tests its rows against it before
anything is shuffled. It takes about 16 bits a key, two of them set, from
2**20 bits (128 KiB) up to MOST_BITS (8 MiB, about four million keys at that
rate); a fuller one passes more. A test that passes wrongly only costs a row
in the join that follows, so the filter never changes a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 16
LEAST_BITS = 1 << 20
MOST_BITS = 1 << 26


def slots_for(keys: int) -> int:
    """64-bit slots (a power of two) for so many keys."""
    bits = min(MOST_BITS, max(LEAST_BITS, keys * BITS_PER_KEY))
    return 1 << (bits // 64 - 1).bit_length()


def _mark(key: Column) -> Column:
    """The two bits of a key in its slot; the slot takes other bits of the key."""
    one = F.lit(1).cast("long")
    bit = [F.shiftrightunsigned(key, n).bitwiseAND(F.lit(63).cast("long")).cast("int") for n in (40, 50)]
    return F.call_function("shiftleft", one, bit[0]).bitwiseOR(F.call_function("shiftleft", one, bit[1]))


def bits_of(keys: DataFrame, count: int) -> Column:
    """The filter over the bigint column ``key``, as a scalar array column; ``count``: how many keys there are, about."""
    slots = slots_for(count)
    slot = F.col("key").bitwiseAND(F.lit(slots - 1).cast("long"))
    marked = keys.select(slot.alias("slot"), _mark(F.col("key")).alias("bits"))
    none = keys.sparkSession.range(slots).select(F.col("id").alias("slot"), F.lit(0).cast("long").alias("bits"))
    words = marked.unionByName(none).groupBy("slot").agg(F.bit_or("bits").alias("bits"))
    row = words.agg(F.sort_array(F.collect_list(F.struct("slot", "bits"))).alias("all"))
    return row.select(F.col("all.bits").alias("bits")).scalar()


def may_hold(bits: Column, key: Column) -> Column:
    """False only if ``key`` is surely not among the filter's keys."""
    slot = key.bitwiseAND((F.size(bits) - 1).cast("long")).cast("int")
    mark = _mark(key)
    return F.get(bits, slot).bitwiseAND(mark) == mark
