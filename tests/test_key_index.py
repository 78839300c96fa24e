"""JOI3 by bucketed keys: the counters of the plain join, no shuffle of the stored side, a key table that may lag."""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

from flotilla.operators.ingest import IngestJob, write_inserted
from flotilla.session import scratch_path
from flotilla.sources import key_index, tables
from flotilla.sources.key_index import KeyIndex, key_of


def store(spark, rows, name):
    path = os.path.join(scratch_path(spark, name), "inspecciones")
    tables.write_inspections(rows, path)
    return path


def counters(up, spark, path, mode, index=None):
    job = IngestJob(up, tables.read_inspections(spark, path), mode, key_index=index)
    new = sorted((r.fila, str(r.archivo)) for r in job.inserted().select("fila", "archivo").collect())
    return tuple(job.counts().first()), new


@pytest.mark.parametrize("mode", ["strict", "flexible", "permissive"])
def test_same_counters_and_rows(spark, fleet001, mode):
    path = store(spark, fleet001.stored(mode), "t-keys")
    index = KeyIndex(spark, path, buckets=4)
    up = fleet001.upload()
    want = counters(up, spark, path, mode)
    assert counters(up, spark, path, mode, index) == want  # before any update: the files themselves
    assert index.update() > 0 and index.update() == 0
    assert counters(up, spark, path, mode, index) == want
    # After an ingest the new files are not in yet; then they are.
    write_inserted(IngestJob(up, tables.read_inspections(spark, path), mode, key_index=index).inserted(), path)
    want = counters(up, spark, path, mode)
    assert want[0].__getitem__(4) == 0 and counters(up, spark, path, mode, index) == want
    assert index.update() > 0 and counters(up, spark, path, mode, index) == want
    # A session that does not know the table yet finds the buckets by the folder.
    spark.sql(f"DROP TABLE {index.name}")
    assert counters(up, spark, path, mode, KeyIndex(spark, path, buckets=4)) == want


def test_update_that_fails_before_its_mark_is_repeated(spark, fleet001, monkeypatch):
    path = store(spark, fleet001.stored("flexible"), "t-keys-fail")
    index = KeyIndex(spark, path, buckets=4)
    up = fleet001.upload()
    want = counters(up, spark, path, "flexible")
    real = spark.createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        index.update()
    monkeypatch.undo()
    assert real is not None and counters(up, spark, path, "flexible", index) == want
    assert index.update() > 0 and counters(up, spark, path, "flexible", index) == want  # keys are in twice, and count once


def test_stored_side_is_not_shuffled(spark, fleet001):
    path = store(spark, fleet001.stored("flexible"), "t-keys-plan")
    index = KeyIndex(spark, path, buckets=4)
    index.update()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = IngestJob(fleet001.upload(), tables.read_inspections(spark, path), "flexible", key_index=index).keys()
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    plan = plan.split("== Initial Plan ==")[0]
    lines = plan.splitlines()
    scan = next(i for i, line in enumerate(lines) if "SelectedBucketsCount: 4 out of 4" in line)
    depth = lambda line: len(re.match(r"[\s:+|\-*]*", line)[0])
    # Up from the scan to the join: the operators that hold it.
    above, at = [], depth(lines[scan])
    for line in reversed(lines[:scan]):
        if depth(line) < at:
            at = depth(line)
            above.append(line)
    until = next(i for i, line in enumerate(above) if "SortMergeJoin" in line and "clave" in line)
    assert not any("Exchange" in line for line in above[:until]), plan
    assert "dynamicpruning" in lines[scan] or "PartitionFilters" in lines[scan]


def test_only_the_uploads_months_are_read(spark, fleet001):
    path = store(spark, fleet001.stored("flexible"), "t-keys-months")
    index = KeyIndex(spark, path, buckets=4)
    index.update()
    up = fleet001.upload().where("fecha like '1997-03-%'")
    months = key_index.months_of(IngestJob(up, tables.read_inspections(spark, path)).valid())
    keys = index.stored(months)
    assert len(keys) == 1 and {tuple(r) for r in months.collect()} == {(1997, 3)}
    want = tables.read_inspections(spark, path).where("anio = 1997 and mes_num = 3").select("conductor", "placa", "fecha").distinct().count()
    assert keys[0].count() == want > 0


def test_keys_are_equal_if_and_only_if_their_parts_are(spark):
    values = [None, "", "null", '"', '","p":"x', "a", "A", "\\", "{}"]
    days = [None, "2000-01-01", "2000-01-02"]
    rows = [(c, p, d) for c in values for p in values for d in days]
    df = spark.createDataFrame(rows, "c string, p string, d string").withColumn("d", F.col("d").cast("date"))
    keyed = df.select(key_of(F.col("c"), F.col("p"), F.col("d")).alias("k"))
    assert keyed.distinct().count() == len(rows) and keyed.where("k is null").count() == 0
