"""Stream results equal batch results (STR1, STR2), and a re-run batch is idempotent."""

import os

from pyspark.sql import functions as F

from flotilla.operators.ingest import IngestJob
from flotilla.session import scratch_path
from flotilla.sources import files
from flotilla.functions import vocab
from flotilla.sources import tables
from flotilla.streaming.alerts import alerts_over, run_fatigue_alerts
from flotilla.streaming.ingest_stream import fold_into, make_batch_writer, run_ingest_stream, stream_summary

from .conftest import SF001


def test_stream_ingest_equals_batch(spark, fleet001):
    mode = "strict"
    work = scratch_path(spark, "t-stream")
    src = os.path.join(work, "up.csv")
    files.write_upload(fleet001.upload(), src, "csv")
    streamed = run_ingest_stream(spark, src, fleet001.stored(mode), work, mode, filename="x").first()
    batch = IngestJob(fleet001.upload(), fleet001.stored(mode), mode, filename="x").summary().first()
    assert tuple(streamed) == tuple(batch)


def batches(spark, fleet, stored, mode="flexible"):
    """A batch writer over a fresh folder, and a function that sums what it counted."""
    work = scratch_path(spark, "t-batches")
    process = make_batch_writer(spark, stored, work, mode)
    return process, lambda: stream_summary(spark, work, "x").first(), work


def test_rerun_batch_is_idempotent(spark, fleet001):
    mode = "flexible"
    process, summed, _ = batches(spark, fleet001, fleet001.stored(mode), mode)
    up = fleet001.upload()
    process(up, 0)
    first = summed()
    process(up, 0)  # the same micro-batch again after a failure
    assert tuple(first) == tuple(summed())
    assert first.insertados == IngestJob(up, fleet001.stored(mode), mode).inserted().count()


def test_batch_of_duplicates_only_and_empty_store(spark, fleet001):
    empty = fleet001.stored("flexible").limit(0)
    process, summed, work = batches(spark, fleet001, empty)
    up = fleet001.upload()
    process(up, 0)
    first = summed()
    process(up, 1)  # the same rows once more: nothing new
    second = summed()
    assert second.insertados == first.insertados and second.total_rows == 2 * first.total_rows
    assert second.valid_rows == second.duplicados + second.insertados
    stored = os.path.join(work, "stored")
    tables.write_inspections(empty, stored)
    fold_into(spark, work, stored)
    assert tables.read_inspections(spark, stored).count() == first.insertados


def test_restart_goes_on_without_copying(spark, fleet001):
    mode = "flexible"
    work = scratch_path(spark, "t-restart")
    src = os.path.join(work, "up.csv")
    files.write_upload(fleet001.upload(), src, "csv")
    first = run_ingest_stream(spark, src, fleet001.stored(mode), work, mode, filename="x").first()
    again = run_ingest_stream(spark, src, fleet001.stored(mode), work, mode, filename="x").first()
    assert tuple(first) == tuple(again)


def batch_days(spark, path):
    events = spark.read.parquet(path).where(F.col("value") >= vocab.FATIGUE_CRITICA_MIN)
    known = events.join(tables.read(spark, SF001, "customer", "c_custkey"), F.col("user_id") == F.col("c_custkey"), "left_semi")
    days = known.select("event_id", F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("d")).distinct()
    return {(r.d, r["count"]) for r in days.groupBy("d").count().collect()}


def test_alerts_match_batch_days(spark):
    want = batch_days(spark, os.path.join(SF001, "events.parquet"))
    out = alerts_over(spark, SF001, scratch_path(spark, "t-alerts")).collect()
    assert {(r.dia_inicio, r.alertas) for r in out} == want and len(want) > 20
    assert all((r.dia_fin - r.dia_inicio).days == 1 for r in out)


def test_alerts_from_a_uri_one_file_per_batch(spark):
    """A folder given as a URI, in many small batches, some rows delivered twice."""
    work = scratch_path(spark, "t-alerts-uri")
    folder = os.path.join(work, "events.parquet")
    events = spark.read.parquet(os.path.join(SF001, "events.parquet"))
    events.unionByName(events.where("event_id % 5 = 0")).repartition(4).write.parquet(folder)
    uri = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    customer = tables.read(spark, SF001, "customer", "c_custkey")
    out = run_fatigue_alerts(spark, uri, customer, os.path.join(work, "out"), files_per_batch=1).collect()
    assert {(r.dia_inicio, r.alertas) for r in out} == batch_days(spark, os.path.join(SF001, "events.parquet"))


def test_empty_source_gives_zero_summary(spark, fleet001, tmp_path):
    src = tmp_path / "empty"
    src.mkdir()
    work = scratch_path(spark, "t-empty")
    row = run_ingest_stream(spark, str(src), fleet001.stored("flexible"), work, "flexible", filename="e").first()
    assert tuple(row) == ("e", 0, 0, 0, 0, 0, [])


def test_continuous_stream_picks_up_new_files(spark, fleet001):
    from flotilla.streaming.ingest_stream import start_ingest_stream

    mode = "flexible"
    work = scratch_path(spark, "t-cont")
    src = os.path.join(work, "incoming")
    up = fleet001.upload()
    files.write_upload(up.where(F.col("fila") < 500), os.path.join(src, "a"), "csv")
    query = start_ingest_stream(spark, os.path.join(src, "*", "*"), fleet001.stored(mode), work, mode,
                                processing_time="1 second")
    try:
        query.processAllAvailable()
        files.write_upload(up.where(F.col("fila") >= 500), os.path.join(src, "b"), "csv")
        query.processAllAvailable()
    finally:
        query.stop()
    got = stream_summary(spark, work, "x").first()
    want = IngestJob(up, fleet001.stored(mode), mode, filename="x").summary().first()
    assert tuple(got) == tuple(want)
