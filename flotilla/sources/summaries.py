"""Maintained aggregates beside a stored inspection table (WIN1, AGG11, AGG6, AGG8).

Under ``<table>.resumen`` each update keeps what the table's new files add, as
states that merge:

* ``conductores`` (conductor, ultima): the latest inspection of a driver;
* ``vehiculos`` (placa, ultima, n): the latest one of a vehicle, and their number;
* ``dias`` (dia, medianoche, n, conductores, placas): inspections of a day, those
  at midnight apart from those later, and theta sketches of drivers and plates.

The greatest row, sums and sketch unions give the same whatever the order in
which rows come, so late uploads are ordinary. A manifest names each update's
folder and the files that went into it in one swap: an update that was cut
short is not seen, one that is repeated finds its files listed. Files that are
not in yet are folded when a question is asked, so the answer is always that of
the whole table. Updates are merged as the manifest merges its entries, so
there are few folders. Where files of the table are gone (it was rewritten),
the next update starts anew.

Distinct counts from sketches are exact up to ``2 ** LG_ENTRIES`` values; beyond,
the relative standard error is 1 / sqrt(2 ** LG_ENTRIES), under 0.8 %.
``dashboard.inspection_counts`` over the rows is the exact way beside.
"""

from __future__ import annotations

import functools
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import check_iso_date
from . import tables
from .manifest import Entries, Entry, Manifest
from .stored_files import file_names, read_files

LG_ENTRIES = 14

SCHEMAS = {
    "conductores": "conductor string, ultima struct<fecha: timestamp_ntz, inspeccion_id: bigint, placa: string>",
    "vehiculos": "placa string, ultima struct<fecha: timestamp_ntz, inspeccion_id: bigint, resultado: string>, n bigint",
    "dias": "dia date, medianoche boolean, n bigint, conductores binary, placas binary",
}


def fold(rows: DataFrame) -> dict[str, DataFrame]:
    """The three states of some inspections."""
    latest = lambda *rest: F.max(F.struct("fecha", "inspeccion_id", *rest)).alias("ultima")
    sketch = lambda c: F.theta_sketch_agg(c, F.lit(LG_ENTRIES))
    day = F.to_date("fecha")
    dated = rows.withColumn("dia", day).withColumn("medianoche", F.col("fecha") == day.cast("timestamp_ntz"))
    return {
        "conductores": rows.where(F.col("conductor").isNotNull()).groupBy("conductor").agg(latest("placa")),
        "vehiculos": rows.groupBy("placa").agg(latest("resultado"), F.count(F.lit(1)).alias("n")),
        "dias": dated.groupBy("dia", "medianoche").agg(
            F.count(F.lit(1)).alias("n"), sketch("conductor").alias("conductores"), sketch("placa").alias("placas")
        ),
    }


def union_of(sketches: str) -> Column:
    return F.theta_union_agg(sketches, F.lit(LG_ENTRIES))


def merged(name: str, states: DataFrame) -> DataFrame:
    """States of one kind, one per key."""
    if name == "dias":
        sums = [F.sum("n").alias("n"), *[union_of(c).alias(c) for c in ("conductores", "placas")]]
        return states.groupBy("dia", "medianoche").agg(*sums)
    sums = [F.max("ultima").alias("ultima"), *([F.sum("n").alias("n")] if name == "vehiculos" else [])]
    return states.groupBy(states.columns[0]).agg(*sums)


class Summaries:
    """The maintained aggregates of the stored inspection table at ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifest = Manifest(spark, self.path + ".resumen")

    def _files(self) -> tuple[dict[str, str], set[str]]:
        """(present files of the table, those that are in)."""
        known = {f for e in self.manifest.entries() for f in e.files}
        return file_names(tables.read_inspections(self.spark, self.path)), known

    def _write(self, states: dict[str, DataFrame], tramo: str) -> None:
        for name, df in states.items():
            df.write.mode("overwrite").parquet(os.path.join(self.manifest.folder(tramo), name))

    def update(self) -> int:
        """Take in the table's new files; how many there were."""
        present, known = self._files()
        anew = bool(known - present.keys())  # the table was rewritten
        wanted = sorted(present if anew else present.keys() - known)
        if not wanted and not anew:
            return 0
        entries = self.manifest.entries()
        number = max((e.last for e in entries), default=-1) + 1
        tramo = self.manifest.new_folder(number)
        self._write(fold(read_files(self.spark, self.path, [present[f] for f in wanted])), tramo)
        entry = Entry(tramo, number, number, files=wanted)

        def add(now: Entries) -> Entries | None:
            # Another update may have taken in some of the files meanwhile; they count once.
            if not anew and {f for e in now for f in e.files} & set(wanted):
                return None
            return [entry] if anew else [*now, entry]

        done = self.manifest.commit(add)
        self.manifest.compact(self._merge)
        self.manifest.vacuum()
        return len(wanted) if done else 0

    def _merge(self, old: Entries, tramo: str) -> Entry:
        self._write({name: merged(name, self._stored(name, old)) for name in SCHEMAS}, tramo)
        return Entry(tramo, old[0].first, old[-1].last, old[0].level + 1, files=[f for e in old for f in e.files])

    def _stored(self, name: str, entries: Entries) -> DataFrame:
        folders = [os.path.join(self.manifest.folder(e.tramo), name) for e in entries]
        if not folders:
            return self.spark.createDataFrame([], SCHEMAS[name])
        parts = [self.spark.read.schema(SCHEMAS[name]).parquet(f) for f in folders]
        return functools.reduce(DataFrame.unionByName, parts)

    def states(self, name: str) -> DataFrame:
        """One state per key over the whole table: what is stored, and the files that are not in yet."""
        present, known = self._files()
        if known - present.keys():
            return fold(tables.read_inspections(self.spark, self.path))[name]
        stored = self._stored(name, self.manifest.entries())
        pending = sorted(path for f, path in present.items() if f not in known)
        if pending:
            stored = stored.unionByName(fold(read_files(self.spark, self.path, pending))[name])
        return merged(name, stored)

    def latest(self) -> DataFrame:
        """WIN1: (conductor, inspeccion_id, placa, fecha) of each driver's latest inspection."""
        return self.states("conductores").select("conductor", "ultima.inspeccion_id", "ultima.placa", "ultima.fecha")

    def vehicle_summary(self) -> DataFrame:
        """AGG11: per vehicle, the latest inspection and the number of them."""
        return self.states("vehiculos").select("placa", "ultima.fecha", "ultima.inspeccion_id", "ultima.resultado", F.col("n").alias("total_inspecciones"))

    def totals(self, desde: str | None = None, hasta: str | None = None) -> DataFrame:
        """AGG5, AGG6 over a range of dates as the pages bound it: rows without a date pass, ``hasta`` is its midnight."""
        days = self.states("dias")
        day, midnight = F.col("dia"), F.col("medianoche")
        if desde:
            days = days.where(day.isNull() | (day >= F.lit(check_iso_date(desde)).cast("date")))
        if hasta:
            last = F.lit(check_iso_date(hasta)).cast("date")
            days = days.where(day.isNull() | (day < last) | ((day == last) & midnight))
        counted = lambda c: F.coalesce(F.theta_sketch_estimate(union_of(c)), F.lit(0)).cast("bigint")
        return days.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("total_inspecciones"),
            counted("conductores").alias("total_conductores"), counted("placas").alias("total_vehiculos"),
        )

    def monthly(self) -> DataFrame:
        """AGG8: (mes, inspecciones, vehiculos) from the days."""
        month = F.date_format("dia", "yyyy-MM").alias("mes")
        vehicles = F.coalesce(F.theta_sketch_estimate(union_of("placas")), F.lit(0)).cast("bigint").alias("vehiculos")
        return self.states("dias").groupBy(month).agg(F.sum("n").alias("inspecciones"), vehicles)
