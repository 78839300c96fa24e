"""STR2: fatigue alerts per day from a stream of evaluations.

Every micro-batch keeps its critical evaluations of known drivers, one row per
evaluation id, under ``epoch=<batch id>``; a re-run batch replaces its own
rows. The days are counted over the distinct ids of all epochs, so the answer
does not hang on how the files fall into batches, late rows count whenever
they come, and the day still open is reported too. Inside ``foreachBatch``
plans are batch plans: AQE splits a driver that holds much of a batch.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab
from ..session import ensure_utc
from ..sources import tables
from ..sources.files import stream_of

ALERT_SCHEMA = "event_id bigint, dia_inicio timestamp_ntz"


def critical_evaluations(events: DataFrame, customer: DataFrame, critica_min: float = vocab.FATIGUE_CRITICA_MIN) -> DataFrame:
    """(event_id, dia_inicio) of the critical evaluations of known drivers, one row per id."""
    known = events.where(F.col("value") >= F.lit(critica_min)).join(
        customer, events["user_id"] == customer["c_custkey"], "left_semi"
    )
    day = F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    return known.groupBy("event_id").agg(F.min(day).alias("dia_inicio"))


def alerts_per_day(alerts: DataFrame) -> DataFrame:
    """(dia_inicio, dia_fin, alertas): distinct critical evaluations of each day."""
    once = alerts.groupBy("event_id").agg(F.min("dia_inicio").alias("dia_inicio"))
    per_day = once.groupBy("dia_inicio").agg(F.count(F.lit(1)).alias("alertas"))
    end = F.col("dia_inicio") + F.expr("INTERVAL 1 DAY")
    return per_day.select("dia_inicio", end.alias("dia_fin"), "alertas")


def run_fatigue_alerts(
    spark: SparkSession, events_path: str, customer: DataFrame, work_dir: str, files_per_batch: int | None = None
) -> DataFrame:
    """Run the alert stream over the evaluations at ``events_path`` and return the days.

    The path is a file, a folder or a URI that Spark reads. ``files_per_batch``
    bounds each micro-batch.
    """
    ensure_utc(spark)
    events = stream_of(spark, events_path, files_per_batch).select("event_id", "ts", "user_id", "value")
    out_dir = os.path.join(work_dir, "alerts")
    spark.createDataFrame([], ALERT_SCHEMA).write.mode("overwrite").parquet(os.path.join(out_dir, "epoch=-1"))

    def process(batch: DataFrame, batch_id: int) -> None:
        found = critical_evaluations(batch, customer)
        found.write.mode("overwrite").parquet(os.path.join(out_dir, f"epoch={batch_id}"))

    query = (
        events.writeStream.foreachBatch(process)
        .option("checkpointLocation", os.path.join(work_dir, "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return alerts_per_day(spark.read.schema(ALERT_SCHEMA).parquet(out_dir))


def alerts_over(spark: SparkSession, sf_dir: str, work_dir: str, files_per_batch: int | None = None) -> DataFrame:
    """The alert stream over the events table of a test-data directory."""
    customer = tables.read(spark, sf_dir, "customer", "c_custkey")
    return run_fatigue_alerts(spark, os.path.join(sf_dir, "events.parquet"), customer, work_dir, files_per_batch)
