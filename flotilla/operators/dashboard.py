"""Dashboard tables (SRC1-SRC4, AGG5-AGG10, AGG14, PRJ7-PRJ9, SCA4, SCA8).

aggregate over a base table: exact distinct counts use Spark's distinct
aggregation (partial aggregation on the distinct key before the shuffle),
and share-of-total runs over the few rows of an aggregate, never over raw
rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, status, text, vocab
from .scalars import side_by_side


def monthly_series(inspecciones: DataFrame, vehicle: str = "placa") -> DataFrame:
    """AGG8: per ``yyyy-MM`` month, inspections and distinct vehicles (by the column ``vehicle``)."""
    return inspecciones.groupBy(dates.month_label(F.col("fecha")).alias("mes")).agg(
        F.count(F.lit(1)).alias("inspecciones"),
        F.countDistinct(vehicle).alias("vehiculos"),
    )


def monthly_inspections(inspecciones: DataFrame, vehicle: str = "placa") -> DataFrame:
    """PRJ7: (mes, inspecciones) for the first bar chart, a projection of the
    one monthly series; Catalyst prunes the distinct count it does not use."""
    return monthly_series(inspecciones, vehicle).select("mes", "inspecciones")


def monthly_vehicles(inspecciones: DataFrame, vehicle: str = "placa") -> DataFrame:
    """PRJ7: (mes, vehiculos) for the second bar chart, from the same series."""
    return monthly_series(inspecciones, vehicle).select("mes", "vehiculos")


def with_all_months(series: DataFrame) -> DataFrame:
    """A monthly series with the months that it leaves out between its first and last, counting 0."""
    first_day = lambda c: F.to_date(F.concat(c, F.lit("-01")), "yyyy-MM-dd")
    ends = series.agg(F.min("mes").alias("first"), F.max("mes").alias("last"))
    months = ends.select(F.explode(F.sequence(first_day(F.col("first")), first_day(F.col("last")), F.expr("interval 1 month"))).alias("day"))
    spine = months.select(dates.month_label(F.col("day")).alias("mes"))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in series.columns if c != "mes"]
    return spine.join(series, "mes", "left").select("mes", *counts)


def monthly_comparison(inspecciones: DataFrame, vehicle: str = "placa") -> DataFrame:
    """PRS1: change of every month from the month before.

    All months from the first to the last are there: one without an inspection
    counts 0, so each is compared with its calendar predecessor. Rows without a
    date belong to no month. The window is unpartitioned but runs over one row
    per month, so a single task sees only a few hundred rows.
    """
    series = with_all_months(monthly_series(inspecciones, vehicle))
    w = Window.orderBy("mes")
    prev = F.lag("inspecciones").over(w)
    return series.select(
        "mes",
        "inspecciones",
        "vehiculos",
        prev.alias("inspecciones_mes_anterior"),
        (F.col("inspecciones") - prev).alias("variacion"),
        F.when(prev > 0, (F.col("inspecciones") - prev).cast("double") / prev.cast("double")).alias(
            "variacion_relativa"
        ),
    )


def inspection_counts(
    inspecciones: DataFrame, approx_rsd: float | None = None, driver: str = "conductor", vehicle: str = "placa"
) -> DataFrame:
    """AGG5, AGG6 (D16): total inspections and distinct drivers and vehicles, one pass.

    Exact by default. With ``approx_rsd`` the distinct counts are HyperLogLog++
    sketches (``approx_count_distinct``) with that relative standard
    deviation: fixed-size buffers merged map-side, no shuffle of distinct keys.
    """
    if approx_rsd is None:
        distinct = lambda c: F.countDistinct(c)
    else:
        distinct = lambda c: F.approx_count_distinct(c, rsd=approx_rsd)
    return inspecciones.agg(
        F.count(F.lit(1)).alias("total_inspecciones"),
        distinct(driver).alias("total_conductores"),
        distinct(vehicle).alias("total_vehiculos"),
    )


def fatigue_detected(fatigue: DataFrame) -> DataFrame:
    """D5: drivers whose latest evaluation is crítica (``fatigue`` is latest-per-driver)."""
    return fatigue.agg(F.count_if(F.col("estado_fatiga") == F.lit(vocab.CRITICA)).alias("fatiga_detectada"))


def overdue_vehicles(vehicles: DataFrame, overdue_days: int = vocab.OVERDUE_DAYS) -> DataFrame:
    """D6: vehicles never inspected or inspected more than ``overdue_days`` ago."""
    dias = F.col("dias_sin_inspeccion")
    return vehicles.where(dias.isNull() | (dias > F.lit(overdue_days)))


def vehicle_counts(
    vehiculos: DataFrame, vehicle_summary: DataFrame, as_of: str, key: str, overdue_days: int = vocab.OVERDUE_DAYS
) -> DataFrame:
    """AGG5-AGG7 over vehicles: inspections, inspected vehicles, and registered ones overdue (D6), in one pass.

    Registry and summary meet in a full join, so vehicles outside the registry
    count as inspected, and never as overdue. Inspections without a vehicle
    count as inspections only.
    """
    known = vehiculos.select(F.col(key).alias("__key"), F.lit(True).alias("__registered"))
    joined = known.join(vehicle_summary, F.col("__key") == F.col(key), "full")
    days = dates.days_since(F.col("fecha"), as_of)
    return joined.agg(
        F.coalesce(F.sum("total_inspecciones"), F.lit(0)).alias("total_inspecciones"),
        F.count(key).alias("total_vehiculos"),
        F.count_if(F.col("__registered") & (days.isNull() | (days > F.lit(overdue_days)))).alias("inspecciones_vencidas"),
    )


def dashboard_metrics(vehicles: DataFrame, latest: DataFrame, levels: DataFrame) -> DataFrame:
    """SRC1 / PRJ9: the five dashboard scalars in one row.

    All come from aggregates with one row per vehicle (``vehicle_counts``), per
    driver with an inspection (``latest``) and per driver with an evaluation.
    """
    drivers = latest.agg(F.count(latest.columns[0]).alias("total_conductores"))
    return side_by_side(vehicles, drivers, fatigue_detected(levels)).select(
        "total_inspecciones",
        "total_conductores",
        "total_vehiculos",
        "fatiga_detectada",
        "inspecciones_vencidas",
    )


def metrics_text(metrics: DataFrame) -> DataFrame:
    """SCA4: the scalars as displayed; only null becomes ``--``."""
    return metrics.select(*[text.coalesce_dash(F.col(c)).alias(c) for c in metrics.columns])


def driver_compliance(drivers: DataFrame) -> DataFrame:
    """SRC3 / AGG9: drivers per status."""
    return drivers.groupBy("estado").agg(F.count(F.lit(1)).alias("value"))


def fatigue_distribution(fatigue: DataFrame) -> DataFrame:
    """SRC4 / AGG10: latest evaluations per level, in the dashboard vocabulary."""
    label = status.fatigue_dashboard_label(F.col("estado_fatiga"))
    return fatigue.groupBy(label.alias("estado")).agg(F.count(F.lit(1)).alias("value"))


def with_share(dist: DataFrame) -> DataFrame:
    """AGG14: each slice's share of the total, as double, over the small aggregate."""
    total = F.sum("value").over(Window.partitionBy())
    return dist.select("estado", "value", (F.col("value").cast("double") / total.cast("double")).alias("share"))


def compliance_colors(dist: DataFrame) -> DataFrame:
    """SCA8 over the driver-compliance slices."""
    return dist.select("estado", "value", status.compliance_slice_color(F.col("estado")).alias("color"))


def fatigue_colors(dist: DataFrame) -> DataFrame:
    """SCA8 over the fatigue slices."""
    return dist.select("estado", "value", status.fatigue_slice_color(F.col("estado")).alias("color"))
