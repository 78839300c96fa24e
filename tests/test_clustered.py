"""SNK1's clustered layout: the rows of the plain one, fewer row groups for a point search on either column."""

from __future__ import annotations

import os
import random

from pyspark.sql import functions as F

from flotilla.session import scratch_path
from flotilla.sources import clustered, tables


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_same_rows_and_months(spark, fleet001):
    path = os.path.join(scratch_path(spark, "t-clustered"), "inspecciones")
    rows = fleet001.inspecciones()
    odd = rows.where("inspeccion_id % 53 = 0").select("inspeccion_id", F.lit(None).cast("string").alias("conductor"), "placa", "contrato", "campo_coordinacion",
                                F.lit(None).cast("timestamp_ntz").alias("fecha"), "resultado")
    clustered.write_clustered(rows.unionByName(odd), path)
    clustered.write_clustered(rows.where("inspeccion_id % 61 = 0"), path, mode="append")
    want = rows.unionByName(odd).unionByName(rows.where("inspeccion_id % 61 = 0"))
    got = tables.read_inspections(spark, path)
    assert rows_of(got.select(*tables.INSPECTION_COLUMNS)) == rows_of(want.select(*tables.INSPECTION_COLUMNS))
    assert got.where("anio <> year(fecha) or mes_num <> month(fecha)").count() == 0


def scanned(df):
    """(rows found, rows of the row groups that were opened), the latter from the scan's own metric."""
    found = df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan
    while "Scan" not in plan.nodeName():
        plan = plan.children().apply(0)
    return len(found), plan.metrics().apply("numOutputRows").value()


def test_point_searches_open_few_row_groups(spark):
    rng = random.Random(2)
    rows = [(i, f"Customer#{rng.randrange(2000):09d}", f"P{rng.randrange(3000):05d}", f"2000-03-{rng.randrange(1, 32):02d} 00:00:00") for i in range(60_000)]
    df = spark.createDataFrame(rows, "inspeccion_id long, conductor string, placa string, f string").select(
        "inspeccion_id", "conductor", "placa", F.lit("x").alias("contrato"), F.lit("y").alias("campo_coordinacion"),
        F.col("f").cast("timestamp_ntz").alias("fecha"), F.lit("F").alias("resultado"),
    )
    base = scratch_path(spark, "t-groups")
    laid = {}
    for name, write in (("plain", tables.write_inspections), ("curve", clustered.write_clustered)):
        if name == "plain":
            spark.sparkContext._jsc.hadoopConfiguration().set("parquet.block.size", str(32 << 10))
            try:
                write(df, os.path.join(base, name))
            finally:
                spark.sparkContext._jsc.hadoopConfiguration().unset("parquet.block.size")
        else:
            write(df, os.path.join(base, name), row_group_bytes=32 << 10)
        table = tables.read_inspections(spark, os.path.join(base, name))
        laid[name] = [scanned(table.where(F.col(c) == v)) for c, v in (("conductor", rows[7][1]), ("placa", rows[7][2]))]
    for plain, curve in zip(laid["plain"], laid["curve"], strict=True):
        assert plain[0] == curve[0] > 0  # the same answer
        # Dictionaries of the row groups help the plain layout, too, where a column has one.
        assert curve[1] < 60_000 / 4 and curve[1] <= plain[1], laid
    assert sum(n for _, n in laid["curve"]) < sum(n for _, n in laid["plain"]) / 3, laid


def test_ranks_keep_the_order(spark):
    values = [f"v{i:04d}" for i in range(1000)] + ["", "zzz", "é", "日本"]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v string")
    bounds = clustered.cuts(df, "v")
    assert bounds == sorted(bounds) and len(bounds) == clustered.RANKS - 1
    got = df.where("v is not null").select("v", clustered.rank(F.col("v"), bounds).alias("r")).orderBy("v").collect()
    assert [r.r for r in got] == [sum(b.encode() <= r.v.encode() for b in bounds) for r in got]
    assert df.where("v is null").select(clustered.rank(F.col("v"), bounds).alias("r")).first().r == 0
    z = spark.range(1).select(clustered.z_order([F.lit(5), F.lit(3), F.lit(0)]).alias("z")).first().z
    assert z == 0b100_010_110  # bits of 5 (101), 3 (011) and 0, in turn
    assert clustered.cuts(df.limit(0), "v") == [] and df.select(clustered.rank(F.col("v"), [])).distinct().count() == 1
