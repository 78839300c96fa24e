"""STR2 with event-time state: closed days equal the batch, state stays bounded, restarts lose and double nothing."""

from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from flotilla.functions import vocab
from flotilla.session import scratch_path
from flotilla.sources import tables
from flotilla.streaming.alert_windows import alert_windows, closed_days, start_alert_windows, windows_over

from .conftest import SF001


def events_of(spark):
    return spark.read.parquet(os.path.join(SF001, "events.parquet"))


def customers(spark):
    return tables.read(spark, SF001, "customer", "c_custkey")


def batch_days(spark, events, until):
    """Days with critical evaluations that end by ``until``."""
    known = events.where(F.col("value") >= vocab.FATIGUE_CRITICA_MIN).join(
        customers(spark), F.col("user_id") == F.col("c_custkey"), "left_semi"
    )
    days = known.select("event_id", F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("d")).distinct()
    rows = days.where(F.expr("d + interval 1 day") <= F.lit(until)).groupBy("d").count().collect()
    return {(r.d, r["count"]) for r in rows}


def days_of(spark, work):
    rows = closed_days(spark, work).collect()
    assert len(rows) == len({r.dia_inicio for r in rows})  # a day is written once
    assert all((r.dia_fin - r.dia_inicio).days == 1 for r in rows)
    return {(r.dia_inicio, r.alertas) for r in rows}


def last_watermark(events):
    return events.agg(F.expr("max(ts) - interval 10 minutes")).first()[0]


def test_closed_days_equal_the_batch(spark):
    work = scratch_path(spark, "t-windows")
    windows_over(spark, SF001, work)
    events = events_of(spark)
    assert days_of(spark, work) == batch_days(spark, events, last_watermark(events))


def write_days(spark, events, folder, days):
    """One file per day, in order, every fifth row delivered twice."""
    for day in days:
        part = events.where(F.to_date("ts") == F.lit(day)).orderBy("ts")
        part.unionByName(part.where("event_id % 5 = 0")).coalesce(1).write.mode("append").parquet(folder)


def test_many_batches_restart_and_bounded_state(spark):
    work = scratch_path(spark, "t-windows-days")
    folder = os.path.join(work, "events")
    events = events_of(spark).cache()
    days = [r.d for r in events.select(F.to_date("ts").alias("d")).distinct().orderBy("d").collect()]
    write_days(spark, events, folder, days[:6])
    run = lambda: start_alert_windows(spark, folder, customers(spark), work, files_per_batch=1)
    query = run()
    query.awaitTermination()
    seen = events.where(F.to_date("ts") <= F.lit(days[5]))
    first = days_of(spark, work)
    assert first == batch_days(spark, seen, last_watermark(seen))
    # The open day is held back, and the state holds it and the ids of ten minutes, no more.
    assert max(d for d, _ in first).date() < days[5]
    progress = query.lastProgress
    rows = sum(op["numRowsTotal"] for op in json.loads(progress.json if hasattr(progress, "json") else json.dumps(progress))["stateOperators"])
    assert rows <= 1 + seen.where((F.col("value") >= vocab.FATIGUE_CRITICA_MIN) & (F.col("ts") >= F.lit(last_watermark(seen)))).count()
    # Started again on the same folder with more files, it goes on; what is out stays out.
    write_days(spark, events, folder, days[6:12])
    run().awaitTermination()
    seen = events.where(F.to_date("ts") <= F.lit(days[11]))
    assert days_of(spark, work) == batch_days(spark, seen, last_watermark(seen)) and first < days_of(spark, work)
    run().awaitTermination()  # nothing new
    assert days_of(spark, work) == batch_days(spark, seen, last_watermark(seen))


def test_late_rows_are_dropped_and_watermark_follows_all_events(spark):
    work = scratch_path(spark, "t-windows-late")
    folder = os.path.join(work, "events")
    user = customers(spark).first().c_custkey
    schema = "event_id long, ts timestamp_ntz, user_id long, value double"

    def arrive(*rows):
        typed = [(i, t, user, v) for i, t, v in rows]
        frame = spark.createDataFrame(typed, "event_id long, t string, user_id long, value double")
        frame = frame.select("event_id", F.col("t").cast("timestamp_ntz").alias("ts"), "user_id", "value")
        assert frame.schema.simpleString() == spark.createDataFrame([], schema).schema.simpleString()
        frame.coalesce(1).write.mode("append").parquet(folder)
        start_alert_windows(spark, folder, customers(spark), work, files_per_batch=1).awaitTermination()
        return {(str(d), n) for d, n in days_of(spark, work)}

    high = vocab.FATIGUE_CRITICA_MIN + 1
    assert arrive((1, "2024-01-01 10:00:00", high), (2, "2024-01-01 11:00:00", high)) == set()
    # A row that is not critical moves the time on and closes the day.
    assert arrive((3, "2024-01-02 00:30:00", 0.0)) == {("2024-01-01 00:00:00", 2)}
    # Late for the closed day: dropped. Within the delay: counted. A repeated id: counted once.
    assert arrive((4, "2024-01-01 23:00:00", high), (5, "2024-01-02 00:25:00", high), (5, "2024-01-02 00:25:00", high)) == {("2024-01-01 00:00:00", 2)}
    assert arrive((6, "2024-01-03 01:00:00", 0.0)) == {("2024-01-01 00:00:00", 2), ("2024-01-02 00:00:00", 1)}


def test_no_events(spark):
    work = scratch_path(spark, "t-windows-none")
    folder = os.path.join(work, "events")
    events_of(spark).limit(0).write.parquet(folder)
    start_alert_windows(spark, folder, customers(spark), work).awaitTermination()
    assert days_of(spark, work) == set()


def test_batch_form_gives_all_days(spark):
    events = events_of(spark)
    twice = events.unionByName(events.limit(50))
    got = {(r.dia_inicio, r.alertas) for r in alert_windows(twice, customers(spark)).collect()}
    assert got == batch_days(spark, events, "9999-01-01")
