"""Table and card projections of the list pages (PRJ1-PRJ5, SCA1, SCA3, SCA6, SCA7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, status


def drivers_table(drivers: DataFrame) -> DataFrame:
    """PRJ1/PRJ2: the seven driver columns, status upper-cased, date as text."""
    return drivers.select(
        "conductor",
        F.upper(F.col("estado")).alias("estado"),
        "placa",
        "contrato",
        "campo_coordinacion",
        "dias_sin_inspeccion",
        dates.display_date(F.col("ultima_inspeccion")).alias("ultima_inspeccion"),
    )


def drivers_colored(drivers: DataFrame) -> DataFrame:
    """SCA6: the colour band of each driver card."""
    return drivers.select("conductor", "estado", status.driver_color(F.col("estado")).alias("color"))


def vehicles_table(vehicles: DataFrame) -> DataFrame:
    """PRJ3/PRJ4: the five vehicle columns."""
    return vehicles.select(
        "placa",
        F.upper(F.col("estado")).alias("estado"),
        "total_inspecciones",
        "dias_sin_inspeccion",
        dates.display_date(F.col("ultima_inspeccion")).alias("ultima_inspeccion"),
    )


def vehicles_colored(vehicles: DataFrame) -> DataFrame:
    """SCA7: the colour band of each vehicle card."""
    return vehicles.select("placa", "estado", status.vehicle_color(F.col("estado")).alias("color"))


def fatigue_table(fatigue: DataFrame) -> DataFrame:
    """PRJ5: the five fatigue columns."""
    return fatigue.select(
        "conductor",
        "placa",
        "score_fatiga",
        "estado_fatiga",
        dates.display_date(F.col("fecha_evaluacion")).alias("fecha_evaluacion"),
    )
