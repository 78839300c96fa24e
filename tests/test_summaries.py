"""Maintained aggregates equal those of the whole table after uploads in any order, failures and rewrites."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from flotilla.operators import dashboard, fleet
from flotilla.operators.filters import Filters, filter_dates
from flotilla.session import scratch_path
from flotilla.sources import manifest, summaries, tables
from flotilla.sources.summaries import Summaries


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def check(found, spark, path):
    table = tables.read_inspections(spark, path)
    assert rows_of(found.latest()) == rows_of(fleet.latest_inspection_per_driver(table))
    assert rows_of(found.vehicle_summary()) == rows_of(fleet.vehicle_summary(table))
    assert rows_of(found.monthly()) == rows_of(dashboard.monthly_series(table))
    for desde, hasta in ((None, None), ("1997-03-05", None), (None, "1998-01-01"), ("1996-02-29", "1999-12-31"), ("2030-01-01", None)):
        flt = Filters(fecha_inicio=desde or "", fecha_fin=hasta or "")
        assert rows_of(found.totals(desde, hasta)) == rows_of(dashboard.inspection_counts(filter_dates(table, "fecha", flt)))


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_uploads(spark, fleet001, monkeypatch, seed):
    monkeypatch.setattr(manifest, "FAN_IN", 2)
    path = os.path.join(scratch_path(spark, "t-sums"), "inspecciones")
    found, rng = Summaries(spark, path), random.Random(seed)
    # Some rows without date, driver or plate, some within the day, some twice.
    base = fleet001.inspecciones()
    odd = base.where("inspeccion_id % 37 = 0").select(
        (F.col("inspeccion_id") + 10**7).alias("inspeccion_id"),
        F.when(F.col("inspeccion_id") % 2 == 0, F.col("conductor")).alias("conductor"),
        F.when(F.col("inspeccion_id") % 3 > 0, F.col("placa")).alias("placa"), "contrato", "campo_coordinacion",
        F.when(F.col("inspeccion_id") % 5 > 0, F.col("fecha") + F.expr("interval 5 hours")).alias("fecha"), "resultado",
    )
    rows = base.unionByName(odd).unionByName(base.where("inspeccion_id % 41 = 0"))
    parts = list(range(5))
    rng.shuffle(parts)
    for i, part in enumerate(parts):
        tables.write_inspections(rows.where(F.pmod(F.xxhash64("inspeccion_id"), F.lit(5)) == part), path, mode="append" if i else "overwrite")
        if i != 3:  # one upload is taken in together with the next
            assert found.update() > 0 and found.update() == 0
        if i in (0, 3):
            check(found, spark, path)
    check(found, spark, path)
    assert len(found.manifest.entries()) <= 3
    # The table is rewritten: nothing of the old states counts.
    tables.write_inspections(rows.where("inspeccion_id % 2 = 0"), path)
    check(found, spark, path)
    assert found.update() > 0
    check(found, spark, path)


def test_update_cut_short_is_not_seen(spark, fleet001, monkeypatch):
    path = os.path.join(scratch_path(spark, "t-sums-cut"), "inspecciones")
    tables.write_inspections(fleet001.inspecciones(), path)
    found = Summaries(spark, path)
    monkeypatch.setattr(manifest.Manifest, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        found.update()
    monkeypatch.undo()
    check(found, spark, path)
    assert found.update() > 0
    check(found, spark, path)


def test_two_updates_at_once_count_once(spark, fleet001, monkeypatch):
    path = os.path.join(scratch_path(spark, "t-sums-two"), "inspecciones")
    tables.write_inspections(fleet001.inspecciones(), path)
    found, other = Summaries(spark, path), Summaries(spark, path)
    real = Summaries._write
    state = {"first": True}

    def write(self, states, tramo):
        if state.pop("first", None):
            other.update()
        real(self, states, tramo)

    monkeypatch.setattr(Summaries, "_write", write)
    assert found.update() == 0
    check(found, spark, path)


def test_range_reads_no_facts(spark, fleet001):
    path = os.path.join(scratch_path(spark, "t-sums-plan"), "inspecciones")
    tables.write_inspections(fleet001.inspecciones(), path)
    found = Summaries(spark, path)
    found.update()
    for df in (found.totals("1997-01-01", "1998-01-01"), found.latest(), found.vehicle_summary()):
        assert all(".resumen/" in f for f in df.inputFiles())


def test_error_bound_of_large_counts(spark, monkeypatch):
    """Beyond what a sketch holds the estimate stays within four standard errors."""
    monkeypatch.setattr(summaries, "LG_ENTRIES", 10)
    path = os.path.join(scratch_path(spark, "t-sums-large"), "inspecciones")
    n = 50_000
    rows = spark.range(n).select(
        F.col("id").alias("inspeccion_id"), F.concat(F.lit("c"), F.col("id") % 40_000).alias("conductor"), F.lit("AAA000").alias("placa"),
        F.lit("x").alias("contrato"), F.lit("y").alias("campo_coordinacion"),
        F.expr("timestamp_ntz'2000-01-01' + make_interval(0, 0, 0, cast(id % 60 as int))").alias("fecha"), F.lit("F").alias("resultado"),
    )
    tables.write_inspections(rows, path)
    found = Summaries(spark, path)
    found.update()
    row = found.totals().first()
    assert row.total_inspecciones == n and row.total_vehiculos == 1
    assert abs(row.total_conductores / 40_000 - 1) < 4 / 2**5


def test_empty_table(spark, fleet001):
    path = os.path.join(scratch_path(spark, "t-sums-none"), "inspecciones")
    tables.write_inspections(fleet001.inspecciones().limit(0), path)
    found = Summaries(spark, path)
    found.update()
    assert found.latest().count() == 0 and tuple(found.totals().first()) == (0, 0, 0) and found.monthly().count() == 0
