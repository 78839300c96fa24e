"""Bucketed keys beside a stored inspection table, for an upload's look-up of stored rows (JOI3).

``<table>.claves`` holds the distinct keys (driver, normalised plate, day) of
the stored rows as one text column ``clave``, nulls told apart from any text,
partitioned by year and month and bucketed by the key. An upload's keys are
shuffled to the buckets; the stored side is read in place, without a shuffle,
and only the months that the upload touches.

The rows of ``archivos`` name the table's files whose keys are in. Keys of
other files are looked up in the files themselves, so a key table that lags
behind, or whose update was cut short, changes no answer.

Bucketing is a property of a catalog table: the folder is registered as an
external one in the session's catalog wherever it is used.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables
from .files import with_partition_columns
from .stored_files import exists, file_names, read_files

BUCKETS = 64


def key_of(conductor: Column, placa: Column, fecha: Column) -> Column:
    """One text for a key: two keys have the same if and only if all three parts are equal or both null."""
    parts = F.struct(conductor.alias("c"), placa.alias("p"), F.date_format(fecha, "yyyy-MM-dd").alias("f"))
    return F.to_json(parts, {"ignoreNullFields": "true"})


class KeyIndex:
    """The key table of the stored inspection table at ``path``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.folder = self.path + ".claves"
        self.name = f"claves_{hashlib.md5(self.folder.encode()).hexdigest()[:12]}_{buckets}"

    def _location(self) -> str:
        return os.path.join(self.folder, "claves")

    def _register(self) -> str:
        """The name of the external table over the folder, registered if this session does not know it."""
        if not self.spark.catalog.tableExists(self.name):
            location = self._location().replace("'", "\\'")
            self.spark.sql(
                f"CREATE TABLE {self.name} (clave STRING, anio INT, mes_num INT) USING parquet "
                f"PARTITIONED BY (anio, mes_num) CLUSTERED BY (clave) SORTED BY (clave) INTO {self.buckets} BUCKETS LOCATION '{location}'"
            )
            if exists(self.spark, self._location()):
                self.spark.catalog.recoverPartitions(self.name)
        return self.name

    def _indexed(self) -> set[str]:
        folder = os.path.join(self.folder, "archivos")
        if not exists(self.spark, folder):
            return set()
        return {r.archivo for r in self.spark.read.schema("archivo string").parquet(folder).collect()}

    def _pending(self) -> dict[str, str]:
        present = file_names(tables.read_inspections(self.spark, self.path))
        known = self._indexed()
        return {name: path for name, path in present.items() if name not in known}

    def _keys(self, rows: DataFrame) -> DataFrame:
        day = F.col("fecha").cast("date")
        return rows.select(key_of(F.col("conductor"), F.col("placa"), day).alias("clave"), "anio", "mes_num").distinct()

    def update(self) -> int:
        """Take in the keys of the files that are not in yet; how many files there were."""
        pending = self._pending()
        if not pending:
            return 0
        name = self._register()
        keys = self._keys(read_files(self.spark, self.path, sorted(pending.values())))
        # One task a bucket, so a bucket gets one file for each month of an update.
        keys.repartition(self.buckets, "clave").select("clave", "anio", "mes_num").write.insertInto(name)
        names = self.spark.createDataFrame([(n,) for n in sorted(pending)], "archivo string").coalesce(1)
        names.write.mode("append").parquet(os.path.join(self.folder, "archivos"))
        return len(pending)

    def stored(self, months: DataFrame) -> list[DataFrame]:
        """(clave) of the stored rows of some months (anio, mes_num): the bucketed keys, and those of files not in yet, if any.

        The months have a proven bound, 12 for each of 10,000 years, and are broadcast to prune the partitions.
        """
        inside = lambda df: df.join(F.broadcast(months), ["anio", "mes_num"], "left_semi").select("clave").distinct()
        found = [inside(self.spark.table(self._register()))]
        pending = self._pending()
        if pending:
            found.append(inside(self._keys(read_files(self.spark, self.path, sorted(pending.values())))))
        return found


def months_of(valid: DataFrame) -> DataFrame:
    """(anio, mes_num) of an upload's valid rows."""
    return with_partition_columns(valid).select("anio", "mes_num").distinct()
