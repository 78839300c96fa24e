"""Global page filters (FLT1-FLT10) and the per-page totals (AGG1-AGG3).

The filter record holds four strings where ``""`` means unset. Each page
turns the set ones into predicates and ANDs them into a single ``where``;
unset ones add no predicate at all, so the plan carries only what applies.
Date bounds on stored timestamps are null-passing and reach the Parquet
scan when the column comes straight from a table.
"""

from __future__ import annotations

import dataclasses
import functools
import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, vocab


@dataclass(frozen=True)
class Filters:
    estado: str = ""
    fatiga: str = ""
    fecha_inicio: str = ""
    fecha_fin: str = ""

    def merge(self, **changes: str) -> "Filters":
        """FLT10: an update replaces the fields it carries; last write wins."""
        return dataclasses.replace(self, **changes)

    def __post_init__(self) -> None:
        for bound in (self.fecha_inicio, self.fecha_fin):
            if bound:
                dates.check_iso_date(bound)


NO_FILTERS = Filters()


def _conjunction(preds: list[Column | None]) -> Column | None:
    active = [p for p in preds if p is not None]
    return functools.reduce(operator.and_, active) if active else None


def _apply(df: DataFrame, preds: list[Column | None]) -> DataFrame:
    cond = _conjunction(preds)
    return df if cond is None else df.where(cond)


def _equals(c: Column, value: str) -> Column | None:
    """FLT1: equality only when set; a null cell never equals a set value."""
    return (c == F.lit(value)) if value else None


def _date_preds(ts: Column, f: Filters, calendar_days: bool = False) -> list[Column | None]:
    upper = dates.upper_bound_calendar if calendar_days else dates.upper_bound
    return [dates.lower_bound(ts, f.fecha_inicio), upper(ts, f.fecha_fin)]


def filter_drivers(drivers: DataFrame, f: Filters) -> DataFrame:
    """FLT1, FLT4, FLT5, FLT7; the fatigue filter is not applied here (FLT8)."""
    preds = [_equals(F.col("estado"), f.estado)] + _date_preds(F.col("ultima_inspeccion"), f)
    return _apply(drivers, preds)


def filter_vehicles(vehicles: DataFrame, f: Filters) -> DataFrame:
    """FLT2: same as drivers; the fatigue filter is ignored."""
    preds = [_equals(F.col("estado"), f.estado)] + _date_preds(F.col("ultima_inspeccion"), f)
    return _apply(vehicles, preds)


def filter_fatigue(fatigue: DataFrame, f: Filters, calendar_days: bool = False) -> DataFrame:
    """FLT3: both ``estado`` and ``fatiga`` are compared with ``estado_fatiga``,
    so two different set values give no rows; date bounds on ``fecha_evaluacion``."""
    level = F.col("estado_fatiga")
    preds = [_equals(level, f.estado), _equals(level, f.fatiga)]
    preds += _date_preds(F.col("fecha_evaluacion"), f, calendar_days)
    return _apply(fatigue, preds)


def filter_dates(df: DataFrame, column: str, f: Filters, calendar_days: bool = False) -> DataFrame:
    """Only the date bounds of ``f`` on ``column``."""
    return _apply(df, _date_preds(F.col(column), f, calendar_days))


def filter_raw_dates(df: DataFrame, column: str, f: Filters) -> DataFrame:
    """FLT6: bounds on a date held as text, with the page's exact semantics."""
    raw = F.col(column)
    preds = [dates.raw_bound(raw, f.fecha_inicio, True), dates.raw_bound(raw, f.fecha_fin, False)]
    return _apply(df, preds)


def count_by_label(df: DataFrame, column: str, labels: list[tuple[str, str]]) -> DataFrame:
    """AGG1-AGG3: one pass, one row: ``total`` (every row, unknown labels too)
    and one ``count_if`` per (output column, label)."""
    aggs = [F.count(F.lit(1)).alias("total")]
    aggs += [F.count_if(F.col(column) == F.lit(label)).alias(name) for name, label in labels]
    return df.agg(*aggs)


def drivers_totals(drivers: DataFrame) -> DataFrame:
    return count_by_label(
        drivers, "estado", [("amarillo", vocab.AMARILLO), ("rojo", vocab.ROJO), ("verde", vocab.VERDE)]
    )


def vehicles_totals(vehicles: DataFrame) -> DataFrame:
    return count_by_label(
        vehicles,
        "estado",
        [("verde", vocab.VERDE), ("amarillo", vocab.AMARILLO), ("naranja", vocab.NARANJA), ("rojo", vocab.ROJO)],
    )


def fatigue_totals(fatigue: DataFrame) -> DataFrame:
    return count_by_label(
        fatigue, "estado_fatiga", [("critica", vocab.CRITICA), ("leve", vocab.LEVE), ("baja", vocab.BAJA)]
    )
