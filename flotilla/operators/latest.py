"""Latest row per key (WIN1, WIN2) as a partial aggregate.

``max(struct(order_cols..., payload...))`` per key is planned as a map-side
partial aggregate followed by one shuffle of at most one row per key per
task. A key holding a third of all rows is therefore folded inside every
map task before the shuffle; a sorted ``row_number()`` window would instead
send that whole key to one task. Ties on the first ordering column are
broken by the next one (D15: the larger id wins).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_per_key(
    df: DataFrame,
    key: str | Sequence[str],
    order_by: Sequence[str],
    payload: Sequence[str] = (),
    count_as: str | None = None,
) -> DataFrame:
    """One row per ``key`` carrying the values of the greatest row by ``order_by``.

    Rows whose first ordering column is null never win over a dated row
    (structs order null fields first). ``count_as`` adds the number of rows
    per key in the same pass.
    """
    keys = [key] if isinstance(key, str) else list(key)
    fields = list(order_by) + [c for c in payload if c not in order_by]
    aggs = [F.max(F.struct(*[F.col(c) for c in fields])).alias("_latest")]
    if count_as:
        aggs.append(F.count(F.lit(1)).alias(count_as))
    out = df.groupBy(*keys).agg(*aggs)
    cols = [F.col(k) for k in keys] + [F.col(f"_latest.{c}").alias(c) for c in fields]
    if count_as:
        cols.append(F.col(count_as))
    return out.select(*cols)
