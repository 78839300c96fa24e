"""PRS2: custom metrics against plain counting at every level; one scan, expanded after the fold."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from flotilla.operators.metrics import Measure, cube, custom_metrics, rollup
from flotilla.plans.queries import inspection_metrics

DIMS = ["a", "b", "c", "d"]


def brute(rows, levels):
    out = set()
    for level in levels:
        groups = {}
        for r in rows:
            groups.setdefault(tuple(r[n] if n in level else None for n in DIMS), []).append(r)
        for key, members in groups.items():
            xs = [r["x"] for r in members if r["x"] is not None]
            bits = sum((n not in level) << (3 - i) for i, n in enumerate(DIMS))
            big = [r for r in members if r["x"] is not None and r["x"] > 5]
            out.add((*key, bits, len(members), len(big), sum(xs) if xs else None, min(xs, default=None), max(xs, default=None),
                     round(sum(xs) / len(xs), 9) if xs else None, len({r["k"] for r in members} - {None}), len({r["k"] for r in big} - {None})))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    pick = lambda *v: rng.choice(v)
    return [dict(a=pick(1, 2, None), b=pick("x", "y", None, ""), c=pick(None), d=pick(True, False), x=pick(None, *range(9)), k=pick(None, *"pqrst")) for _ in range(400)]


@pytest.mark.parametrize("levels", [None, rollup(DIMS), [("b",), ("d", "a"), ("b",)], [()]], ids=str)
def test_every_level(spark, rows, levels):
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "a int, b string, c string, d boolean, x int, k string")
    big = F.col("x") > 5
    got = custom_metrics(
        df, {n: F.col(n) for n in DIMS},
        {"n": Measure("count"), "big": Measure("count", where=big), "total": Measure("sum", F.col("x")), "low": Measure("min", F.col("x")),
         "high": Measure("max", F.col("x")), "mean": Measure("avg", F.col("x")), "keys": Measure("distinct", F.col("k")),
         "big_keys": Measure("distinct", F.col("k"), big)},
        levels,
    ).collect()
    found = [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in got]
    assert len(found) == len(set(found)) and set(found) == brute(rows, cube(DIMS) if levels is None else levels)
    assert custom_metrics(df.limit(0), {"a": F.col("a")}, {"n": Measure("count")}, [("a",)]).count() == 0


def test_declarations_are_checked(spark):
    df = spark.range(3)
    for bad in (
        lambda: Measure("median", F.col("id")), lambda: Measure("sum"),
        lambda: custom_metrics(df, {"id": F.col("id")}, {"n": Measure("count")}, [("other",)]),
        lambda: custom_metrics(df, {"n": F.col("id")}, {"n": Measure("count")}),
        lambda: custom_metrics(df, {}, {"n": Measure("count")}), lambda: custom_metrics(df, {"id": F.col("id")}, {}),
    ):
        with pytest.raises(ValueError):
            bad()


def test_one_scan_and_the_sets_expand_the_folded_rows(fleet001):
    plan = inspection_metrics(fleet001.visits().selectExpr("*", "'a' as contrato", "'b' as campo_coordinacion", "cast(vehiculo_id as string) as placa"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    lines = text.splitlines()
    assert len([x for x in lines if "FileScan" in x]) == 1
    expand = next(i for i, x in enumerate(lines) if re.search(r"\bExpand \[", x))
    # Below the expansion the rows were folded by a partial and a final aggregate.
    assert len([x for x in lines[expand:] if "Aggregate(" in x]) >= 2 and any("Exchange" in x for x in lines[expand:])
