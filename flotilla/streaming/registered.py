"""Registered file and stream queries (SRC9, SRC10, SNK1, STR1, STR2) and their oracles.

Each query writes its input with Spark into a fresh folder under the shared
checkpoint root, reads it back through the file reader or runs the stream
to completion with ``availableNow``, and returns the committed output read
back as a DataFrame.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..operators import fleet
from ..operators.ingest import IngestJob, write_inserted
from ..plans.catalog import Fleet
from ..operators.search import SearchParams
from ..plans.queries import AS_OF, RAW_RANGE, SEARCH_MULTI, register
from ..session import scratch_path
from ..sources import files, tables, text_index
from ..sources.clustered import write_clustered
from ..sources.key_index import KeyIndex
from ..sources.summaries import Summaries
from .alert_windows import windows_over
from .alerts import alerts_over
from .ingest_stream import run_ingest_stream

MODE = vocab.DEFAULT_PLATE_MODE
NAME = "inspecciones.csv"
# Another column order than the upload schema's.
REORDERED = ["resultado", "fecha", "placa", "fila", "campo_coordinacion", "conductor", "contrato"]


def _from_files(f: Fleet, fmt: str, columns: list[str] | None = None) -> DataFrame:
    """SRC9/SRC10: the upload written as files of a format and read back through the upload reader.

    The folder also holds the rows as a file the gate must skip.
    """
    source = os.path.join(scratch_path(f.spark, f"{fmt}-ingest"), NAME)
    files.write_upload(f.upload(), source, fmt, columns)
    other = f.upload().select(F.concat_ws(",", "fila", "placa").alias("line"))
    other.write.mode("append").text(os.path.join(source, f"{files.FILE}=notas"))
    upload = files.read_upload(f.spark, source, fmt, glob=f"*.{fmt}")
    return IngestJob(upload, f.stored(MODE), MODE, filename=NAME).summary()


@register("ingest_csv_summary")
def _ingest_csv_summary(f: Fleet) -> DataFrame:
    return _from_files(f, "csv")


@register("ingest_csv_reordered_summary")
def _ingest_csv_reordered(f: Fleet) -> DataFrame:
    """CSV files whose columns come in another order."""
    return _from_files(f, "csv", REORDERED)


@register("ingest_json_summary")
def _ingest_json_summary(f: Fleet) -> DataFrame:
    return _from_files(f, "json")


@register("ingest_parquet_summary")
def _ingest_parquet_summary(f: Fleet) -> DataFrame:
    return _from_files(f, "parquet")


def _stored_again(f: Fleet) -> str:
    """SNK1/SET1: the stored table written, the upload's new rows appended to it; its path."""
    path = os.path.join(scratch_path(f.spark, "stored"), "inspecciones")
    tables.write_inspections(f.stored(MODE), path)
    job = IngestJob(f.upload(), tables.read_inspections(f.spark, path), MODE)
    write_inserted(job.inserted(), path)
    return path


@register("ingest_stored_table")
def _ingest_stored_table(f: Fleet) -> DataFrame:
    """Every column of the stored table after the ingest, read back as the other pages read it."""
    return tables.read_inspections(f.spark, _stored_again(f)).select(*tables.INSPECTION_COLUMNS)


@register("ingest_stored_driver_status")
def _ingest_stored_status(f: Fleet) -> DataFrame:
    """SRC5 over the stored table after the ingest."""
    return Fleet(f.spark, f.sf_dir, AS_OF, inspections_path=_stored_again(f)).drivers()


def _maintained(f: Fleet) -> Summaries:
    """The stored table written in three parts, the oldest rows last, its aggregates updated after the first two."""
    path = os.path.join(scratch_path(f.spark, "maintained"), "inspecciones")
    found = Summaries(f.spark, path)
    for i, part in enumerate(("fecha >= '2000-01-01'", "year(fecha) in (1997, 1998, 1999)", "fecha < '1997-01-01'")):
        tables.write_inspections(f.inspecciones().where(part), path, mode="append" if i else "overwrite")
        if i < 2:
            found.update()
    return found


@register("maintained_driver_status")
def _maintained_drivers(f: Fleet) -> DataFrame:
    """WIN1, SRC5 from maintained states, some of the table's files not being in yet."""
    return fleet.driver_status(f.conductores(), _maintained(f).latest(), AS_OF)


@register("maintained_vehicle_status")
def _maintained_vehicles(f: Fleet) -> DataFrame:
    """AGG11, SRC6 from maintained states."""
    return fleet.vehicle_status(f.vehiculos(), _maintained(f).vehicle_summary(), AS_OF)


@register("maintained_range_totals")
def _maintained_totals(f: Fleet) -> DataFrame:
    """AGG5, AGG6 over a range of dates from the days' sketches."""
    return _maintained(f).totals(RAW_RANGE.fecha_inicio, RAW_RANGE.fecha_fin)


@register("maintained_monthly_series")
def _maintained_monthly(f: Fleet) -> DataFrame:
    """AGG8 from the days' sketches."""
    return _maintained(f).monthly()


@register("clustered_table")
def _clustered(f: Fleet) -> DataFrame:
    """SNK1 in the clustered layout, read back like the plain one."""
    path = os.path.join(scratch_path(f.spark, "clustered"), "inspecciones")
    write_clustered(f.inspecciones(), path)
    return tables.read_inspections(f.spark, path).select(*tables.INSPECTION_COLUMNS)


@register("ingest_indexed_summary")
def _ingest_indexed(f: Fleet) -> DataFrame:
    """JOI3 by the stored table's bucketed keys."""
    path = os.path.join(scratch_path(f.spark, "keyed"), "inspecciones")
    tables.write_inspections(f.stored(MODE), path)
    index = KeyIndex(f.spark, path, buckets=8)
    index.update()
    return IngestJob(f.upload(), tables.read_inspections(f.spark, path), MODE, filename=NAME, key_index=index).summary()


def _searched(params: SearchParams):
    def query(f: Fleet) -> DataFrame:
        """FLT12 over a stored table with a trigram index, in two parts: stored and indexed, then appended and indexed."""
        path = os.path.join(scratch_path(f.spark, "indexed"), "inspecciones")
        rows = f.inspecciones()
        tables.write_inspections(rows.where(F.col("inspeccion_id") % 3 > 0), path)
        text_index.update_index(f.spark, path)
        tables.write_inspections(rows.where(F.col("inspeccion_id") % 3 == 0), path, mode="append")
        text_index.update_index(f.spark, path)
        return text_index.search_indexed(f.spark, path, params)

    return query


for _name, _params in {
    "search_indexed_placa": SearchParams(placa="b12"),
    "search_indexed_conductor": SearchParams(conductor="customer#00000012"),
    "search_indexed_multi": SEARCH_MULTI,
}.items():
    register(_name)(_searched(_params))


@register("stream_ingest_summary")
def _stream_ingest_summary(f: Fleet) -> DataFrame:
    """STR1: the upload's files ingested one per micro-batch."""
    work = scratch_path(f.spark, "stream-ingest")
    source = os.path.join(work, NAME)
    files.write_upload(f.upload(), source, "csv")
    return run_ingest_stream(f.spark, source, f.stored(MODE), work, MODE, filename=NAME)


@register("stream_ingest_repeated")
def _stream_ingest_repeated(f: Fleet) -> DataFrame:
    """STR1: the same rows come a second time in other files; those batches insert nothing."""
    work = scratch_path(f.spark, "stream-repeated")
    source = os.path.join(work, NAME)
    once = f.upload()
    again = once.withColumn(files.FILE, F.concat(F.lit("otra-vez-"), files.FILE))
    files.write_upload(once.unionByName(again), source, "csv")
    return run_ingest_stream(f.spark, source, f.stored(MODE), work, MODE, filename=NAME)


@register("stream_fatigue_alerts")
def _stream_fatigue_alerts(f: Fleet) -> DataFrame:
    """STR2: critical evaluations per day, deduplicated, from a stream of events."""
    return alerts_over(f.spark, f.sf_dir, scratch_path(f.spark, "stream-alerts"))


@register("stream_fatigue_windows")
def _stream_fatigue_windows(f: Fleet) -> DataFrame:
    """STR2: the same with event-time state, closed days only (watermark, dedup, window, append)."""
    return windows_over(f.spark, f.sf_dir, scratch_path(f.spark, "stream-windows"))


def stream_oracle_sql(ingest_ctes, with_) -> dict[str, str]:
    ctes = ingest_ctes(MODE)
    summary = with_(
        ctes,
        """SELECT 'inspecciones.csv' AS filename, total_rows, valid_rows, invalid_rows, duplicados, insertados,
                  (SELECT coalesce(list(error ORDER BY fila), []) FROM first_errors) AS invalid
           FROM counts""",
    )
    repeated = with_(
        ctes,
        """SELECT 'inspecciones.csv' AS filename, 2 * total_rows AS total_rows, 2 * valid_rows AS valid_rows,
                  2 * invalid_rows AS invalid_rows, 2 * valid_rows - insertados AS duplicados, insertados,
                  (SELECT coalesce(list(error ORDER BY fila), []) FROM (
                     SELECT fila, error FROM (SELECT * FROM flagged UNION ALL SELECT * FROM flagged) t
                     WHERE NOT valida ORDER BY fila LIMIT 5) e) AS invalid
           FROM counts""",
    )
    alerts = with_(
        f"""crit AS (
  SELECT e.event_id, e.ts FROM events e JOIN customer c ON e.user_id = c.c_custkey
  WHERE e.value >= {vocab.FATIGUE_CRITICA_MIN})""",
        """SELECT date_trunc('day', ts) AS dia_inicio, date_trunc('day', ts) + INTERVAL 1 DAY AS dia_fin,
       count(DISTINCT event_id) AS alertas
FROM crit
GROUP BY 1, 2""",
    )
    # Days that end no later than ten minutes before the last event of all.
    windows = with_(
        f"""crit AS (
  SELECT e.event_id, e.ts FROM events e JOIN customer c ON e.user_id = c.c_custkey
  WHERE e.value >= {vocab.FATIGUE_CRITICA_MIN})""",
        """SELECT * FROM (
  SELECT date_trunc('day', ts) AS dia_inicio, date_trunc('day', ts) + INTERVAL 1 DAY AS dia_fin,
         count(DISTINCT event_id) AS alertas
  FROM crit GROUP BY 1, 2) d
WHERE dia_fin <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""",
    )
    after = ctes + """,
after_ingest AS (
  SELECT inspeccion_id, conductor, placa, contrato, campo_coordinacion, fecha, resultado FROM stored
  UNION ALL
  SELECT CAST('0x' || substr(md5(concat(archivo, ':', fila)), 1, 15) AS BIGINT), conductor, placa, contrato,
         campo_coordinacion, CAST(fecha AS TIMESTAMP), resultado FROM inserted)"""
    table = with_(after, "SELECT * FROM after_ingest")
    status = with_(
        after,
        f"""SELECT r.conductor,
       CASE WHEN dias <= 90 THEN 'verde' WHEN dias <= 365 THEN 'amarillo' ELSE 'rojo' END AS estado,
       l.placa, r.contrato, r.campo_coordinacion, dias AS dias_sin_inspeccion, l.fecha AS ultima_inspeccion
FROM conductores r LEFT JOIN (
  SELECT *, date_diff('day', CAST(fecha AS DATE), DATE '{AS_OF}') AS dias,
         row_number() OVER (PARTITION BY conductor ORDER BY fecha DESC, inspeccion_id DESC) AS rn
  FROM after_ingest) l ON r.conductor = l.conductor AND l.rn = 1""",
    )
    return {
        "ingest_csv_summary": summary,
        "ingest_csv_reordered_summary": summary,
        "ingest_json_summary": summary,
        "ingest_parquet_summary": summary,
        "ingest_indexed_summary": summary,
        "ingest_stored_table": table,
        "ingest_stored_driver_status": status,
        "ingest_result_table": table,
        "stream_ingest_summary": summary,
        "stream_ingest_repeated": repeated,
        "stream_fatigue_alerts": alerts,
        "stream_fatigue_windows": windows,
    }
