"""FLT12 with the trigram index: the rows of a search without it, from fewer files; an index that lags loses nothing."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from flotilla.operators.ingest import IngestJob
from flotilla.operators.search import SearchParams, search
from flotilla.session import scratch_path
from flotilla.sources import tables, text_index


@pytest.fixture(scope="module")
def stored(spark, fleet001):
    path = os.path.join(scratch_path(spark, "t-indexed"), "inspecciones")
    tables.write_inspections(fleet001.inspecciones(), path)
    assert text_index.update_index(spark, path) > 50
    return path


def rows_of(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


@pytest.mark.parametrize(
    "params",
    [
        SearchParams(placa="AB"), SearchParams(placa="a"), SearchParams(placa="no such"), SearchParams(conductor="CUSTOMER#00000012"),
        SearchParams(conductor="r#0"), SearchParams(campo=" "), SearchParams(contrato="uildi", campo="an"), SearchParams(mes="3", ano="2000"),
        SearchParams(conductor="0000001", mes="5"), SearchParams(), SearchParams(placa="%"), SearchParams(placa="0" * 50),
    ],
    ids=str,
)
def test_same_rows_as_without_index(spark, stored, params):
    want = rows_of(search(tables.read_inspections(spark, stored), params))
    assert rows_of(text_index.search_indexed(spark, stored, params)) == want


def test_only_files_with_a_match_are_opened(spark, stored):
    everything = len(tables.read_inspections(spark, stored).inputFiles())
    plate = tables.read_inspections(spark, stored).first().placa
    found = text_index.search_indexed(spark, stored, SearchParams(placa=plate))
    opened = found.inputFiles()
    holding = tables.read_inspections(spark, stored).where(F.col("placa") == plate).select("_metadata.file_path").distinct().count()
    assert len(opened) == holding < everything / 5
    assert text_index.candidate_files(spark, stored, SearchParams(placa="zz zz")) == []
    # Two fields intersect: no more files than either of them has.
    one = set(text_index.candidate_files(spark, stored, SearchParams(conductor="0001")))
    both = set(text_index.candidate_files(spark, stored, SearchParams(conductor="0001", placa=plate)))
    assert both <= one and both <= set(opened) | one


def test_index_follows_the_ingest_and_may_lag(spark, fleet001, monkeypatch):
    path = os.path.join(scratch_path(spark, "t-lag"), "inspecciones")
    tables.write_inspections(fleet001.stored("flexible"), path)
    params = SearchParams(conductor="customer#0000000")
    search_both = lambda: (rows_of(text_index.search_indexed(spark, path, params)), rows_of(search(tables.read_inspections(spark, path), params)))
    got, want = search_both()  # no index at all
    assert got == want and want
    assert text_index.update_index(spark, path) > 0 and text_index.update_index(spark, path) == 0
    got, want = search_both()
    assert got == want
    job = IngestJob(fleet001.upload(), tables.read_inspections(spark, path), "flexible")
    before = len(want)
    # The update that follows a write fails half-way: what it wrote is repeated later and counts once.
    real = text_index.files.for_partitioned_write

    def fail(*args):
        raise RuntimeError("lost")

    monkeypatch.setattr(text_index.files, "for_partitioned_write", lambda df, *c: fail() if "cubo" in c else real(df, *c))
    with pytest.raises(RuntimeError):
        text_index.write_inserted_indexed(job.inserted(), path)
    got, want = search_both()
    assert got == want and len(want) > before
    monkeypatch.undo()
    assert text_index.update_index(spark, path) > 0
    got, want = search_both()
    assert got == want
    known = text_index.indexed_files(spark, path)
    assert known == set(text_index.file_names(tables.read_inspections(spark, path)))


def test_awkward_values(spark):
    path = os.path.join(scratch_path(spark, "t-awkward"), "inspecciones")
    names = [None, "", "a", "ab", "abc", "ÁBC ñandú", "x" * 5000, "😀😀😀", "abcabcabc", "İstanbul", "50%_off", "abc"]
    rows = [(i, n, "AAA000", None, n, "2000-01-01 00:00:00", "F") for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "inspeccion_id long, conductor string, placa string, contrato string, campo_coordinacion string, f string, resultado string")
    tables.write_inspections(df.withColumn("fecha", F.col("f").cast("timestamp_ntz")), path)
    text_index.update_index(spark, path)
    for text in ["a", "ABC", "bca", "áb", "ñan", "😀😀", "xxx", "İst", "%_o", "abcabcabcabc", "zzz"]:
        params = SearchParams(conductor=text)
        assert rows_of(text_index.search_indexed(spark, path, params)) == rows_of(search(tables.read_inspections(spark, path), params)), text


def test_empty_table(spark, fleet001):
    path = os.path.join(scratch_path(spark, "t-none"), "inspecciones")
    tables.write_inspections(fleet001.stored("flexible").limit(0), path)
    text_index.update_index(spark, path)
    assert text_index.search_indexed(spark, path, SearchParams(placa="abc")).count() == 0
