"""Sanity numbers of FIXTURES.md §4 at sf0.01."""

from pyspark.sql import functions as F

from flotilla.operators import dashboard, fleet
from flotilla.operators.filters import Filters, filter_dates, filter_drivers
from flotilla.plans.queries import dashboard_of


def test_inspections(fleet01):
    insp = fleet01.inspecciones()
    row = insp.agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("conductor").alias("d"),
        F.countDistinct("placa").alias("p"),
        F.countDistinct(F.date_format("fecha", "yyyy-MM")).alias("m"),
    ).first()
    assert tuple(row) == (15000, 1500, 1875, 80)


def _by(df, col):
    return {r[0]: r[1] for r in df.groupBy(col).count().collect()}


def test_driver_status(fleet01):
    d = fleet01.drivers()
    counts = _by(d, "estado")
    assert d.count() == 1600
    assert counts == {"verde": 476, "amarillo": 702, "rojo": 422}
    assert d.where(F.col("ultima_inspeccion").isNull()).count() == 100


def test_vehicle_status(fleet01):
    v = fleet01.vehicles()
    assert v.count() == 2000
    assert _by(v, "estado") == {"verde": 121, "amarillo": 151, "naranja": 241, "rojo": 1487}
    assert v.where(F.col("ultima_inspeccion").isNull()).count() == 125


def test_drivers_filtered(fleet01):
    f = Filters(estado="rojo", fecha_inicio="2000-01-01", fecha_fin="2000-06-30")
    d = filter_drivers(fleet01.drivers(), f)
    assert d.count() == 257
    assert d.where(F.col("ultima_inspeccion").isNotNull()).count() == 157


def test_fatigue(fleet01):
    levels = fleet.evaluation_levels(fleet01.evaluaciones())
    assert _by(levels, "estado_fatiga") == {"baja": 8015, "leve": 1511, "crítica": 474}
    fat = fleet01.fatigue()
    assert _by(fat, "estado_fatiga") == {"baja": 131, "leve": 12, "crítica": 7}
    assert fat.count() == 150 and fat.where(F.col("placa").isNotNull()).count() == 150


def test_failed_vehicles_and_event_bounds(fleet01):
    v = fleet01.vehicles(with_result=True)
    assert v.where(F.col("ultimo_resultado") == "F").count() == 638
    ev = fleet01.evaluaciones()
    f = Filters(fecha_inicio="2024-01-05", fecha_fin="2024-01-10")
    assert filter_dates(ev, "fecha_evaluacion", f).count() == 1615
    assert filter_dates(ev, "fecha_evaluacion", f, calendar_days=True).count() == 1945


def test_dashboard_metrics(fleet01):
    m = dashboard_of(fleet01).first()
    assert (m.total_inspecciones, m.total_conductores, m.total_vehiculos) == (15000, 1500, 1875)
    assert m.fatiga_detectada == 7
    assert m.inspecciones_vencidas == fleet01.vehicles().where(
        F.col("dias_sin_inspeccion").isNull() | (F.col("dias_sin_inspeccion") > 90)
    ).count()


def test_dashboard_approximate_distinct_is_close(fleet01):
    row = dashboard.inspection_counts(fleet01.inspecciones(), approx_rsd=0.01).first()
    assert row.total_inspecciones == 15000
    assert abs(row.total_conductores - 1500) <= 1500 * 0.05
    assert abs(row.total_vehiculos - 1875) <= 1875 * 0.05
