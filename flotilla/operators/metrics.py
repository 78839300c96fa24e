"""Custom metrics (PRS2): declared measures by declared dimensions, with totals at every level, from one scan.

The rows are first folded to one row per combination of dimension values (and
of the values counted apart, where a measure counts distinct ones), a partial
aggregate before the shuffle. The grouping sets expand those rows, not the
table: a cube over four dimensions reads and shuffles the table once and not
sixteen times.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("count", "sum", "min", "max", "avg", "distinct")


@dataclass(frozen=True)
class Measure:
    """What is measured: ``kind`` of ``value`` over the rows that pass ``where``; a count needs no value."""

    kind: str
    value: Column | None = None
    where: Column | None = None

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind of measure {self.kind!r}; expected one of {KINDS}")
        if self.value is None and self.kind != "count":
            raise ValueError(f"a measure of kind {self.kind!r} needs a value")

    def seen(self) -> Column:
        """The measured value; null where the row does not count."""
        value = F.lit(1) if self.value is None else self.value
        return value if self.where is None else F.when(self.where, value)


def cube(dimensions: Sequence[str]) -> list[tuple[str, ...]]:
    """Every subset of the dimensions, the largest first."""
    return [s for n in range(len(dimensions), -1, -1) for s in combinations(dimensions, n)]


def rollup(dimensions: Sequence[str]) -> list[tuple[str, ...]]:
    """The dimensions, and ever shorter heads of them down to the grand total."""
    return [tuple(dimensions[:n]) for n in range(len(dimensions), -1, -1)]


def custom_metrics(
    rows: DataFrame, dimensions: dict[str, Column], measures: dict[str, Measure], levels: Sequence[Sequence[str]] | None = None
) -> DataFrame:
    """(dimensions, nivel, measures): one row per level and combination of values that occurs.

    ``levels`` lists the grouping sets, each a choice of dimensions; by default
    all of them (``cube``). In a row of a level that leaves a dimension out
    its column is null and its bit in ``nivel`` is set, the first dimension
    having the highest bit; a null value of a dimension leaves the bit unset.
    A level repeated in ``levels`` counts once. Without rows there are no rows.
    """
    names = list(dimensions)
    sets = list(dict.fromkeys(tuple(n for n in names if n in s) for s in (cube(names) if levels is None else levels)))
    unknown = {d for s in levels or () for d in s} - set(names)
    if unknown or not names or not measures:
        raise ValueError(f"unknown dimensions {sorted(unknown)}" if unknown else "dimensions and measures are needed")
    if clash := set(names) & set(measures) | {"nivel"} & {*names, *measures}:
        raise ValueError(f"names used twice: {sorted(clash)}")

    fine = [c.alias(f"d_{n}") for n, c in dimensions.items()]
    apart = [m.seen().alias(f"k_{n}") for n, m in measures.items() if m.kind == "distinct"]
    partial = []
    for n, m in measures.items():
        seen = F.col(f"s_{n}")
        if m.kind in ("count", "avg"):
            partial.append(F.count(seen).alias(f"n_{n}"))
        if m.kind in ("sum", "avg"):
            partial.append(F.sum(seen).alias(f"v_{n}"))
        if m.kind in ("min", "max"):
            partial.append(getattr(F, m.kind)(seen).alias(f"v_{n}"))
    picked = [m.seen().alias(f"s_{n}") for n, m in measures.items() if m.kind != "distinct"]
    keys = [f"d_{n}" for n in names] + [f"k_{n}" for n, m in measures.items() if m.kind == "distinct"]
    # A count of rows keeps the fold a plain aggregate where nothing but distinct values is asked for.
    folded = rows.select(*fine, *apart, *picked).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *partial)

    def whole(n: str, m: Measure) -> Column:
        count, value = F.coalesce(F.sum(f"n_{n}"), F.lit(0)), f"v_{n}"
        merged = {
            "count": lambda: count,
            "sum": lambda: F.sum(value),
            "min": lambda: F.min(value),
            "max": lambda: F.max(value),
            "avg": lambda: F.sum(value).cast("double") / F.nullif(F.sum(f"n_{n}"), F.lit(0)).cast("double"),
            "distinct": lambda: F.countDistinct(f"k_{n}"),
        }
        return merged[m.kind]().alias(n)

    columns = [F.col(f"d_{n}") for n in names]
    grouped = folded.groupingSets([[F.col(f"d_{n}") for n in s] for s in sets], *columns)
    out = grouped.agg(F.grouping_id(*columns).cast("int").alias("nivel"), *[whole(n, m) for n, m in measures.items()])
    return out.select(*[F.col(f"d_{n}").alias(n) for n in names], "nivel", *measures)
