"""Report metrics (AGG13, SNK2, PRS2): four indicators in long form.

Each indicator is a one-row aggregate over its own source; the four rows
are stacked with ``unionByName``, so no join is formed between them.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab


def _indicator(df: DataFrame, name: str, cond=None) -> DataFrame:
    value = F.count(F.lit(1)) if cond is None else F.count_if(cond)
    return df.agg(F.lit(name).alias("indicador"), value.alias("valor"))


def failed_vehicles(vehicles_with_result: DataFrame) -> DataFrame:
    """D13: vehicles whose latest inspection failed."""
    return vehicles_with_result.where(F.col("ultimo_resultado") == F.lit(vocab.RESULTADO_FALLA))


def inspections_done(inspecciones: DataFrame) -> DataFrame:
    """The first indicator, counted from inspections."""
    return _indicator(inspecciones, vocab.IND_INSPECCIONES)


def inspections_and_failures(vehicle_summary: DataFrame, vehiculos: DataFrame, key: str) -> DataFrame:
    """The first and third indicator from one row per vehicle: inspections done, registered vehicles with failures."""
    known = vehiculos.select(F.col(key).alias("__key"))
    joined = vehicle_summary.join(known, F.col("__key") == F.col(key), "left")
    failed = F.col("__key").isNotNull() & (F.col("resultado") == F.lit(vocab.RESULTADO_FALLA))
    both = joined.agg(F.coalesce(F.sum("total_inspecciones"), F.lit(0)).alias("done"), F.count_if(failed).alias("failed"))
    names = [(vocab.IND_INSPECCIONES, "done"), (vocab.IND_VEHICULOS_FALLAS, "failed")]
    rows = F.array(*[F.struct(F.lit(n).alias("indicador"), F.col(c).alias("valor")) for n, c in names])
    return both.select(F.inline(rows))


def report_of_aggregates(inspections: DataFrame, drivers: DataFrame, fatigue: DataFrame) -> DataFrame:
    """AGG13 / PRJ10 from ``inspections_and_failures``, driver statuses and fatigue levels."""
    critical = _indicator(drivers, vocab.IND_CONDUCTORES_CRITICOS, F.col("estado") == F.lit(vocab.ROJO))
    tired = _indicator(fatigue, vocab.IND_FATIGA, F.col("estado_fatiga") == F.lit(vocab.CRITICA))
    return inspections.unionByName(critical).unionByName(tired)


def report_metrics(
    done: DataFrame, drivers: DataFrame, vehicles_with_result: DataFrame, fatigue: DataFrame
) -> DataFrame:
    """AGG13 / PRJ10: (indicador, valor) rows in display order of the report.

    ``done``: the row of ``inspections_done``.
    """
    rows = [
        done,
        _indicator(drivers, vocab.IND_CONDUCTORES_CRITICOS, F.col("estado") == F.lit(vocab.ROJO)),
        _indicator(
            vehicles_with_result,
            vocab.IND_VEHICULOS_FALLAS,
            F.col("ultimo_resultado") == F.lit(vocab.RESULTADO_FALLA),
        ),
        _indicator(fatigue, vocab.IND_FATIGA, F.col("estado_fatiga") == F.lit(vocab.CRITICA)),
    ]
    return functools.reduce(DataFrame.unionByName, rows)


def report_lines(metrics: DataFrame) -> DataFrame:
    """SNK2: the text lines of the report, one per indicator."""
    return metrics.select(F.format_string("%s: %d", F.col("indicador"), F.col("valor")).alias("linea"))
