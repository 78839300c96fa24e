"""Driver, vehicle and fatigue status tables (SRC5-SRC7, JOI1, JOI2, SCA9-SCA11).

Each status table is a registry left-joined to a per-key aggregate of the
event table. The aggregate side has one row per key, so the join is
between two key-unique inputs: no hot key survives to the join, and AQE
broadcasts the aggregate at runtime when its measured size is small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, status, vocab
from .latest import latest_per_key

def latest_inspection_per_driver(inspecciones: DataFrame, key: str = "conductor", vehicle: str = "placa") -> DataFrame:
    """WIN1: key, inspeccion_id, vehicle, fecha of each driver's latest inspection.

    ``key`` and ``vehicle`` name the columns that identify driver and vehicle:
    the texts of a stored table, or numbers where names are joined later.
    """
    latest = latest_per_key(inspecciones.where(F.col(key).isNotNull()), key, ["fecha", "inspeccion_id"], [vehicle])
    return latest.select(key, "inspeccion_id", vehicle, "fecha")


def latest_evaluation_per_driver(evaluaciones: DataFrame, key: str = "conductor") -> DataFrame:
    """WIN2: key, evaluacion_id, fecha_evaluacion, score_fatiga of the latest evaluation."""
    latest = latest_per_key(evaluaciones, key, ["fecha_evaluacion", "evaluacion_id"], ["score_fatiga"])
    return latest.select(key, "evaluacion_id", "fecha_evaluacion", "score_fatiga")


def driver_status(
    conductores: DataFrame, latest: DataFrame, as_of: str, bands=vocab.DRIVER_BANDS, key: str = "conductor"
) -> DataFrame:
    """SRC5: one row per registered driver, inspected or not (D1).

    ``latest``: (key, placa, fecha) of each driver's latest inspection; both
    sides are unique per key, so no hot driver reaches the join.
    """
    last = latest.select(F.col(key).alias("__key"), "placa", F.col("fecha").alias("ultima_inspeccion"))
    joined = conductores.join(last, F.col(key) == F.col("__key"), "left")
    dias = dates.days_since(F.col("ultima_inspeccion"), as_of)
    return joined.select(
        "conductor",
        status.driver_status_label(dias, bands).alias("estado"),
        "placa",
        "contrato",
        "campo_coordinacion",
        dias.alias("dias_sin_inspeccion"),
        "ultima_inspeccion",
    )


def vehicle_summary(inspecciones: DataFrame, key: str = "placa") -> DataFrame:
    """AGG11: per vehicle, the number of inspections and the latest one (one pass)."""
    return latest_per_key(
        inspecciones, key, ["fecha", "inspeccion_id"], ["resultado"], count_as="total_inspecciones"
    )


def vehicle_status(
    vehiculos: DataFrame,
    summary: DataFrame,
    as_of: str,
    bands=vocab.VEHICLE_BANDS,
    with_result: bool = False,
    key: str = "placa",
) -> DataFrame:
    """SRC6: one row per registered vehicle (D2) from ``vehicle_summary``; never inspected = 0 inspections, rojo."""
    last = summary.select(
        F.col(key).alias("__key"),
        "total_inspecciones",
        F.col("fecha").alias("ultima_inspeccion"),
        F.col("resultado").alias("ultimo_resultado"),
    )
    joined = vehiculos.join(last, F.col(key) == F.col("__key"), "left")
    dias = dates.days_since(F.col("ultima_inspeccion"), as_of)
    cols = [
        "placa",
        status.vehicle_status_label(dias, bands).alias("estado"),
        F.coalesce(F.col("total_inspecciones"), F.lit(0).cast("bigint")).alias("total_inspecciones"),
        dias.alias("dias_sin_inspeccion"),
        "ultima_inspeccion",
    ]
    if with_result:
        cols.append("ultimo_resultado")
    return joined.select(*cols)


def fatigue_levels(latest_eval: DataFrame, conductores: DataFrame, key: str = "conductor") -> DataFrame:
    """D7: each known driver's latest evaluation with its level, all levels; no plate."""
    known = latest_eval if key == "conductor" else latest_eval.join(conductores.select(key, "conductor"), key)
    return known.select(
        key,
        *([] if key == "conductor" else ["conductor"]),
        "score_fatiga",
        status.fatigue_level(F.col("score_fatiga")).alias("estado_fatiga"),
        "fecha_evaluacion",
    )


def fatigue_status(levels: DataFrame, latest: DataFrame, key: str = "conductor") -> DataFrame:
    """SRC7 / JOI2: the levels with the plate of the driver's latest inspection (null when never inspected)."""
    plate = latest.select(F.col(key).alias("__key"), "placa")
    joined = levels.join(plate, F.col(key) == F.col("__key"), "left")
    return joined.select("conductor", "placa", "score_fatiga", "estado_fatiga", "fecha_evaluacion")


def evaluation_levels(evaluaciones: DataFrame) -> DataFrame:
    """Every evaluation with its level (SCA11), no latest-per-driver reduction."""
    return evaluaciones.withColumn("estado_fatiga", status.fatigue_level(F.col("score_fatiga")))


def fatigue_vocabularies(fatigue: DataFrame) -> DataFrame:
    """SCA12: the level of each row in all three vocabularies."""
    level = F.col("estado_fatiga")
    return fatigue.select(
        "conductor",
        level.alias("estado_fatiga"),
        status.fatigue_filter_label(level).alias("fatiga_filtro"),
        status.fatigue_dashboard_label(level).alias("fatiga_dashboard"),
    )
