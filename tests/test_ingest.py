"""Upload validation, dedup and summary (FIXTURES.md §4) and file ingest."""

import os

import pytest
from pyspark.sql import functions as F

from flotilla.operators.ingest import IngestJob, write_inserted
from flotilla.sources import files, tables

EXPECTED = {
    "strict": (15300, 11611, 3689, 1875, 9736),
    "flexible": (15300, 12871, 2429, 2055, 10816),
    "permissive": (15300, 13674, 1626, 2183, 11491),
}


@pytest.mark.parametrize("mode", list(EXPECTED))
def test_summary_counts(fleet01, mode):
    job = IngestJob(fleet01.upload(), fleet01.stored(mode), mode, filename="f.csv")
    row = job.summary().first()
    got = (row.total_rows, row.valid_rows, row.invalid_rows, row.duplicados, row.insertados)
    assert got == EXPECTED[mode]
    # D10 invariants
    assert row.total_rows == row.valid_rows + row.invalid_rows
    assert row.valid_rows == row.duplicados + row.insertados
    assert len(row.invalid) == 5 and row.invalid[0].startswith("Fila ")


def test_rows_partition_the_valid_set(fleet01):
    job = IngestJob(fleet01.upload(), fleet01.stored("flexible"), "flexible")
    def lines(df):
        return sorted((r.fila, r.conductor or "") for r in df.select("fila", "conductor").collect())

    assert sorted(lines(job.inserted()) + lines(job.duplicates())) == lines(job.valid())


def test_first_occurrence_wins(spark):
    rows = [
        ("a.csv", 3, "ana", "ABC123", "c", "x", "2001-01-01", "F"),
        ("a.csv", 1, "ana", "abc-123", "c", "x", "2001-01-01", "O"),
        ("a.csv", 2, "ana", "ABC123", "c", "x", "bad", "O"),
        ("a.csv", 4, "bob", "XYZ999", "c", "x", "2001-01-02", "O"),
    ]
    up = spark.createDataFrame(rows, files.UPLOAD_SCHEMA)
    stored = spark.createDataFrame([("bob", "XYZ999", "2001-01-02")], "conductor string, placa string, f string")
    stored = stored.select("conductor", "placa", F.to_date("f").alias("fecha"))
    job = IngestJob(up, stored, "flexible")
    assert [r.fila for r in job.inserted().collect()] == [1]
    assert sorted(r.fila for r in job.duplicates().collect()) == [3, 4]
    assert [r.error for r in job.first_errors().collect()] == ["Fila 2: fecha inválida (bad)"]


def test_strict_mode_rejects_unnormalised(spark):
    up = spark.createDataFrame([("a.csv", 1, "a", " abc-123", "c", "x", "2001-01-01", "F")], files.UPLOAD_SCHEMA)
    empty = spark.createDataFrame([], "conductor string, placa string, fecha date")
    assert IngestJob(up, empty, "strict").valid().count() == 0
    assert IngestJob(up, empty, "flexible").valid().first().placa == "ABC123"
    assert IngestJob(up, empty, "permissive").valid().first().placa == "ABC-123"
    with pytest.raises(ValueError):
        IngestJob(up, empty, "lenient")


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
def test_file_roundtrip(spark, fleet001, tmp_path, fmt):
    path = str(tmp_path / f"up.{fmt}")
    up = fleet001.upload()
    files.write_upload(up, path, fmt)
    back = files.read_upload(spark, path, fmt)
    mode = "flexible"
    a = IngestJob(up, fleet001.stored(mode), mode).counts().first()
    b = IngestJob(back, fleet001.stored(mode), mode).counts().first()
    assert tuple(a) == tuple(b)


def test_two_files_that_number_lines_alike(spark):
    rows = [(f, i, "ana", f"ABC12{i}", "c", "x", "2001-01-01", "F") for f in ("a.csv", "b.csv") for i in (1, 2)]
    rows[3] = ("b.csv", 2, "bob", "XYZ999", "c", "x", "2001-01-01", "F")
    job = IngestJob(spark.createDataFrame(rows, files.UPLOAD_SCHEMA), stored_rows(spark, []), "flexible")
    assert tuple(job.counts().first()) == (4, 4, 0, 1, 3)
    assert [r.fila for r in job.duplicates().collect()] == [1]


def stored_rows(spark, rows):
    return spark.createDataFrame(rows, tables.INSPECTION_SCHEMA)


def test_missing_driver_is_a_duplicate_of_itself(spark):
    up = spark.createDataFrame([("a.csv", 1, None, "ABC123", "c", "x", "2001-01-01", "F")], files.UPLOAD_SCHEMA)
    first = IngestJob(up, stored_rows(spark, []), "flexible")
    assert first.counts().first().insertados == 1
    again = IngestJob(up, first.result_table(), "flexible").counts().first()
    assert (again.insertados, again.duplicados) == (0, 1)


def write_lines(folder, name, *lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")


def test_columns_are_matched_by_name(spark, tmp_path):
    d = tmp_path / "reordered"
    write_lines(d, "a.csv", "fila,placa,conductor,fecha,extra,resultado,campo_coordinacion,contrato", "7,ABC123,ana,2001-01-01,?,F,x,c")
    row = files.read_upload(spark, str(d), "csv").first()
    assert (row.archivo, row.fila, row.placa, row.conductor, row.contrato) == ("a.csv", 7, "ABC123", "ana", "c")
    write_lines(d, "b.csv", "fila,conductor,placa,fecha,extra,resultado,campo_coordinacion,contrato", "8,bob,XYZ999,2001-01-01,?,F,x,c")
    with pytest.raises(Exception, match="(?i)header"):
        files.read_upload(spark, str(d), "csv").collect()
    missing = tmp_path / "missing"
    write_lines(missing, "a.csv", "fila,placa", "1,ABC123")
    with pytest.raises(ValueError, match="conductor"):
        files.read_upload(spark, str(missing), "csv")


def test_lines_without_numbers_are_counted_per_file(spark, tmp_path):
    d = tmp_path / "plain"
    for name in ("a.csv", "b.csv"):
        write_lines(d, name, ",".join(files.REQUIRED), *[f"ana,ABC12{i},c,x,2001-01-0{i + 1},F" for i in range(5)])
    got = files.read_upload(spark, str(d), "csv").collect()
    assert sorted((r.archivo, r.fila, r.placa) for r in got) == [(f, i + 1, f"ABC12{i}") for f in ("a.csv", "b.csv") for i in range(5)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")  # several splits a file
    try:
        split = files.read_upload(spark, str(d), "csv").collect()
        assert sorted((r.archivo, r.fila, r.placa) for r in split) == sorted((r.archivo, r.fila, r.placa) for r in got)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_corrupt_csv_lines_are_invalid(spark, tmp_path):
    d = tmp_path / "bad"
    d.mkdir()
    (d / "a.csv").write_text(
        "fila,conductor,placa,contrato,campo_coordinacion,fecha,resultado\n"
        "1,ana,ABC123,c,x,2001-01-01,F\n"
        "notanumber,bob,ABC124,c,x,2001-01-01,F\n"
    )
    (d / "ignored.txt").write_text("fila\n9\n")
    df = files.read_upload(spark, str(d), "csv", glob="*.csv")
    assert df.count() == 2
    empty = spark.createDataFrame([], "conductor string, placa string, fecha date")
    job = IngestJob(df, empty, "flexible")
    assert job.valid().count() == 1
    assert job.invalid().first().error == "Fila ?: registro ilegible"


def test_stored_table_keeps_one_schema(spark, fleet001, tmp_path):
    out = str(tmp_path / "stored")
    tables.write_inspections(fleet001.stored("flexible"), out)
    before = tables.read_inspections(spark, out).count()
    job = IngestJob(fleet001.upload(), tables.read_inspections(spark, out), "flexible")
    count = job.counts().first().insertados
    write_inserted(job.inserted(), out)
    back = tables.read_inspections(spark, out)
    assert back.count() == before + count and os.path.isdir(os.path.join(out, "anio=1995"))
    assert back.where("inspeccion_id IS NULL").count() == 0
    assert back.select("inspeccion_id").distinct().count() == back.count()
    assert back.schema["fecha"].dataType.simpleString() == "timestamp_ntz"


def test_text_report_sink(spark, fleet001, tmp_path):
    from flotilla.operators import report

    metrics = report.report_metrics(
        report.inspections_done(fleet001.inspecciones()), fleet001.drivers(), fleet001.vehicles(with_result=True),
        fleet001.fatigue(),
    )
    out = str(tmp_path / "report")
    files.write_text_report(report.report_lines(metrics), out)
    lines = sorted(r.value for r in spark.read.text(out).collect())
    assert len(lines) == 4 and any(line.startswith("Inspecciones realizadas: ") for line in lines)


def test_partitioned_stored_table_is_pruned(spark, fleet001, tmp_path):
    """With stored rows partitioned by year/month, the lookup prunes to the upload's months."""
    mode = "flexible"
    out = str(tmp_path / "stored")
    tables.write_inspections(fleet001.stored(mode), out)
    stored = tables.read_inspections(spark, out)
    upload = fleet001.upload().where(F.col("fecha").startswith("1998-03"))
    job = IngestJob(upload, stored, mode)
    ins = job.inserted()
    ins.write.format("noop").mode("overwrite").save()
    assert "dynamicpruningexpression" in ins._jdf.queryExecution().executedPlan().toString()
    plain = IngestJob(upload, fleet001.stored(mode), mode)
    assert sorted(r.fila for r in ins.collect()) == sorted(r.fila for r in plain.inserted().collect())


def test_empty_upload_summary(spark):
    up = spark.createDataFrame([], files.UPLOAD_SCHEMA)
    empty = spark.createDataFrame([], "conductor string, placa string, fecha date")
    row = IngestJob(up, empty, "strict", filename="vacio.csv").summary().first()
    assert tuple(row) == ("vacio.csv", 0, 0, 0, 0, 0, [])


def test_repeated_stored_key_counts_once(spark, fleet001):
    """A key stored thousands of times is folded before the anti-join: same rows, same counters."""
    mode = "flexible"
    stored = fleet001.stored(mode).select("conductor", "placa", "fecha")
    hot = stored.first()
    copies = spark.range(5000).select(
        F.lit(hot.conductor).alias("conductor"), F.lit(hot.placa).alias("placa"), F.lit(hot.fecha).alias("fecha")
    )
    plain = IngestJob(fleet001.upload(), stored, mode)
    skewed = IngestJob(fleet001.upload(), stored.unionByName(copies), mode)
    assert tuple(skewed.counts().first()) == tuple(plain.counts().first())
    assert sorted(r.fila for r in skewed.inserted().collect()) == sorted(r.fila for r in plain.inserted().collect())
    keys = skewed.stored_keys()
    assert keys.count() == keys.distinct().count()
