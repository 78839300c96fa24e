"""Status bands, fatigue levels, vocabularies and colour bands as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab


def status_from_days(
    days: Column, bands: Sequence[tuple[int, str]], otherwise: str = vocab.ROJO
) -> Column:
    """SCA10: first band whose upper bound (inclusive) holds; never inspected
    (null days) falls through to ``otherwise``."""
    expr = None
    for limit, label in bands:
        cond = days <= F.lit(limit)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    if expr is None:
        return F.lit(otherwise)
    return expr.otherwise(F.lit(otherwise))


def driver_status_label(days: Column, bands=vocab.DRIVER_BANDS) -> Column:
    return status_from_days(days, bands)


def vehicle_status_label(days: Column, bands=vocab.VEHICLE_BANDS) -> Column:
    return status_from_days(days, bands)


def fatigue_level(
    score: Column,
    critica_min: float = vocab.FATIGUE_CRITICA_MIN,
    leve_min: float = vocab.FATIGUE_LEVE_MIN,
) -> Column:
    """SCA11 / D4: level from score; a null score has no level."""
    return (
        F.when(score.isNull(), F.lit(None).cast("string"))
        .when(score >= F.lit(critica_min), F.lit(vocab.CRITICA))
        .when(score >= F.lit(leve_min), F.lit(vocab.LEVE))
        .otherwise(F.lit(vocab.BAJA))
    )


def _label_map(src: int, dst: int) -> Column:
    pairs = []
    for level in vocab.FATIGUE_LEVELS:
        pairs += [F.lit(level[src]), F.lit(level[dst])]
    return F.create_map(*pairs)


def fatigue_filter_label(level: Column) -> Column:
    """SCA12: fatigue-table label → filter-box label (crítica → grave ...)."""
    return _label_map(0, 1)[level]


def fatigue_dashboard_label(level: Column) -> Column:
    """SCA12: fatigue-table label → dashboard label (crítica → Fatiga ...)."""
    return _label_map(0, 2)[level]


def driver_color(estado: Column) -> Column:
    """SCA6: rojo → red, amarillo → yellow, anything else (null too) → green."""
    return (
        F.when(estado == F.lit(vocab.ROJO), F.lit("red"))
        .when(estado == F.lit(vocab.AMARILLO), F.lit("yellow"))
        .otherwise(F.lit("green"))
    )


def vehicle_color(estado: Column) -> Column:
    """SCA7: verde, amarillo, naranja keep their colour; anything else → red."""
    return (
        F.when(estado == F.lit(vocab.VERDE), F.lit("green"))
        .when(estado == F.lit(vocab.AMARILLO), F.lit("yellow"))
        .when(estado == F.lit(vocab.NARANJA), F.lit("orange"))
        .otherwise(F.lit("red"))
    )


def _slice_color(label: Column, green: str, yellow: str, red: str) -> Column:
    return (
        F.when(label == F.lit(green), F.lit(vocab.SLICE_GREEN))
        .when(label == F.lit(yellow), F.lit(vocab.SLICE_YELLOW))
        .when(label == F.lit(red), F.lit(vocab.SLICE_RED))
        .otherwise(F.lit(vocab.SLICE_GREY))
    )


def compliance_slice_color(estado: Column) -> Column:
    """SCA8: driver-compliance pie colour; unknown labels grey."""
    return _slice_color(estado, vocab.VERDE, vocab.AMARILLO, vocab.ROJO)


def fatigue_slice_color(estado: Column) -> Column:
    """SCA8: fatigue pie colour over dashboard labels; unknown labels grey."""
    apto, leve, fatiga = (lvl[2] for lvl in reversed(vocab.FATIGUE_LEVELS))
    return _slice_color(estado, apto, leve, fatiga)
