"""STR2 with event-time state: critical evaluations per day, once each, as a continuous append query.

A watermark trails the largest event time of the whole stream by ``delay``.
Evaluation ids are remembered until the watermark passes them, so a repeat
within the delay counts once; a day's count is held until the watermark passes
the day's end, is then written once and its state dropped. So the state holds
the ids of the last ``delay`` and the days still open, whatever the age of the
stream. Rows that come after the watermark has passed them are dropped, and the
open days are not reported; ``alerts.run_fatigue_alerts`` is the form that
counts late rows and the open day, at the price of keeping all alerts.

The file sink names what each batch wrote in its own log, so a batch that is
re-run after a failure is not counted twice.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import vocab
from ..session import ensure_utc
from ..sources import tables
from ..sources.files import stream_of

DELAY = "10 minutes"
WINDOW = "1 day"
OUT_SCHEMA = "dia_inicio timestamp, dia_fin timestamp, alertas bigint"


def is_critical(ts: Column, value: Column, critica_min: float) -> Column:
    """The test of an evaluation, tied to its time.

    A plain ``value >= x`` would be pushed below the watermark, which would
    then follow the critical evaluations only and close a day late.
    """
    return F.when(ts.isNotNull(), value >= F.lit(critica_min))


def alert_windows(
    events: DataFrame, customer: DataFrame, critica_min: float = vocab.FATIGUE_CRITICA_MIN, delay: str = DELAY
) -> DataFrame:
    """(dia_inicio, dia_fin, alertas) of a streaming DataFrame (event_id, ts, user_id, value).

    On a batch DataFrame watermarks do nothing: it gives all days at once.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    critical = timed.where(is_critical(F.col("ts"), F.col("value"), critica_min))
    known = critical.join(customer, critical["user_id"] == customer["c_custkey"], "left_semi")
    once = known.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else known.dropDuplicates(["event_id"])
    days = once.groupBy(F.window("ts", WINDOW).alias("dia")).agg(F.count(F.lit(1)).alias("alertas"))
    return days.select(F.col("dia.start").alias("dia_inicio"), F.col("dia.end").alias("dia_fin"), "alertas")


def start_alert_windows(
    spark: SparkSession,
    events_path: str,
    customer: DataFrame,
    work_dir: str,
    delay: str = DELAY,
    files_per_batch: int | None = None,
    processing_time: str | None = None,
) -> StreamingQuery:
    """Start the query over the evaluations at ``events_path`` (a file, a folder or a URI).

    With ``processing_time`` it keeps watching the path; without it, it works
    off what is there and stops. Starting again on the same ``work_dir`` goes
    on from its checkpoint.
    """
    ensure_utc(spark)
    events = stream_of(spark, events_path, files_per_batch).select("event_id", "ts", "user_id", "value")
    writer = (
        alert_windows(events, customer, delay=delay)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", os.path.join(work_dir, "days"))
        .option("checkpointLocation", os.path.join(work_dir, "checkpoint"))
    )
    writer = writer.trigger(processingTime=processing_time) if processing_time else writer.trigger(availableNow=True)
    return writer.start()


def closed_days(spark: SparkSession, work_dir: str) -> DataFrame:
    """The days that are closed so far, as written; times without zone, as in the events."""
    days = spark.read.schema(OUT_SCHEMA).parquet(os.path.join(work_dir, "days"))
    return days.select(*[F.col(c).cast("timestamp_ntz").alias(c) for c in ("dia_inicio", "dia_fin")], "alertas")


def windows_over(spark: SparkSession, sf_dir: str, work_dir: str) -> DataFrame:
    """The query over the events table of a test-data directory, worked off to the end."""
    customer = tables.read(spark, sf_dir, "customer", "c_custkey")
    start_alert_windows(spark, os.path.join(sf_dir, "events.parquet"), customer, work_dir).awaitTermination()
    return closed_days(spark, work_dir)
