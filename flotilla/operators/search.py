"""Parameterised search over inspections (SRC8, FLT11-FLT14, PRJ6, AGG4).

Parameters are six strings; ``""`` is unset and adds no predicate (``"0"``
and ``" "`` are kept, as in the form). Text fields match as case-insensitive
substrings (D11), month and year by equality. When the table carries the
``anio`` / ``mes_num`` partition columns of a stored inspection table, the
month and year predicates use them so the scan prunes partitions.
"""

from __future__ import annotations

import datetime as dt
import functools
import operator
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, vocab
from ..functions.dates import ntz_midnight

# Search field → inspection column.
TEXT_FIELDS = {
    "placa": "placa",
    "conductor": "conductor",
    "contrato": "contrato",
    "campo": "campo_coordinacion",
}


@dataclass(frozen=True)
class SearchParams:
    placa: str = ""
    conductor: str = ""
    contrato: str = ""
    campo: str = ""
    mes: str = ""
    ano: str = ""

    def __post_init__(self) -> None:
        _check_int("mes", self.mes, vocab.MES_RANGE)
        _check_int("ano", self.ano, vocab.ANO_RANGE)

    def active(self) -> dict[str, str]:
        """FLT11: the parameters that are sent, i.e. the non-empty ones."""
        return {f.name: getattr(self, f.name) for f in fields(self) if getattr(self, f.name)}


def _check_int(name: str, value: str, bounds: tuple[int, int]) -> None:
    """FLT14: the form only submits whole numbers inside its min/max."""
    if not value:
        return
    try:
        number = int(value)
    except ValueError as exc:
        raise ValueError(f"{name} must be a whole number, got {value!r}") from exc
    lo, hi = bounds
    if not lo <= number <= hi:
        raise ValueError(f"{name} must be between {lo} and {hi}, got {number}")


def date_range(year: int, month: int | None) -> Column:
    """FLT13: ``fecha`` in the year, or in the month of the year."""
    first = dt.date(year, month or 1, 1)
    after = dt.date(year + (month in (None, 12)), 1 if month in (None, 12) else month + 1, 1)
    return (F.col("fecha") >= ntz_midnight(first.isoformat())) & (F.col("fecha") < ntz_midnight(after.isoformat()))


def search_predicate(params: SearchParams, columns: list[str]) -> Column | None:
    preds: list[Column] = []
    for name, value in params.active().items():
        if name in TEXT_FIELDS:
            col = F.col(TEXT_FIELDS[name])
            preds.append(F.lower(col).contains(F.lower(F.lit(value))))
        elif name == "mes" and ("mes_num" in columns or not params.ano):
            col = F.col("mes_num") if "mes_num" in columns else F.month("fecha")
            preds.append(col == F.lit(int(value)))
        elif name == "ano" and "anio" in columns:
            preds.append(F.col("anio") == F.lit(int(value)))
    if params.ano and "anio" not in columns:
        # With a year the dates form one range, which reaches the Parquet scan.
        preds.append(date_range(int(params.ano), int(params.mes) if params.mes else None))
    return functools.reduce(operator.and_, preds) if preds else None


PARTITION_COLUMNS = ("anio", "mes_num")


def search(inspecciones: DataFrame, params: SearchParams) -> DataFrame:
    """SRC8: the matching inspection rows, all inspection columns (partition
    columns of a stored table serve the filter and are not returned)."""
    cond = search_predicate(params, inspecciones.columns)
    found = inspecciones if cond is None else inspecciones.where(cond)
    return found.drop(*[c for c in PARTITION_COLUMNS if c in found.columns])


def search_count(inspecciones: DataFrame, params: SearchParams) -> DataFrame:
    """AGG4: the number of results."""
    return search(inspecciones, params).agg(F.count(F.lit(1)).alias("resultados"))


def search_as_text(inspecciones: DataFrame, params: SearchParams) -> DataFrame:
    """PRJ6 / SCA5: the results with every cell as the text the table shows."""
    return text.as_js_text(search(inspecciones, params))
