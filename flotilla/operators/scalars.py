"""Putting several one-row results side by side without a join.

Each input is a one-row aggregate. They are stacked with ``unionByName``
(missing columns null) and folded by one global ``max`` per column, where
exactly one input supplies each column. No cross product is formed and the
final aggregate reads as many rows as there are inputs.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def side_by_side(*frames: DataFrame) -> DataFrame:
    columns: list[str] = []
    for frame in frames:
        for name in frame.columns:
            if name in columns:
                raise ValueError(f"column {name!r} supplied twice")
            columns.append(name)
    stacked = functools.reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), frames
    )
    return stacked.agg(*[F.max(F.col(c)).alias(c) for c in columns])
