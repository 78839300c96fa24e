"""A trigram index beside a stored inspection table, for text search (FLT12).

Small tables under ``<table>.indice``, about lower-cased values of the
searchable fields; each update adds a folder ``lote=<id>`` to them:

* ``lugares`` (campo, valor, archivo): the files of the table that hold a value;
* ``trigramas`` (campo, cubo, trigrama, valor): the distinct trigrams of every
  value, in ``BUCKETS`` folders by a hash of the trigram and sorted within, so
  one trigram is a few row groups of one folder;
* ``cuentas`` (campo, trigrama, n): how many values hold a trigram;
* ``archivos`` (archivo): the files that are indexed.

A search takes the ``RAREST`` trigrams of its text, intersects their postings,
verifies what is left with ``contains`` on the values, and reads the files that
hold one of them. Rows are then filtered as in a search without index, so the
index only decides which files are opened. Texts of fewer than three characters
are looked for in the values themselves, which is still no look at the rows.

``archivos`` is written last. A file that it does not name is always read: an
index that lags behind the table, or whose update was cut short, costs time and
never rows, and files that are gone from the table are not looked for. So no
lock is needed between the writer of the table and the index.
"""

from __future__ import annotations

import functools
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import write_inserted
from ..operators.search import TEXT_FIELDS, SearchParams, search
from . import files, tables
from .stored_files import LEVELS, exists, file_names, read_files

SIZE = 3
BUCKETS = 64
# Trigrams of a text whose postings are read.
RAREST = 4
POSTINGS = "trigrama string, valor string, lote string, campo string, cubo int"
PLACES = "valor string, archivo string, lote string, campo string"
COUNTS = "trigrama string, n bigint, lote string, campo string"
FILES = "archivo string, lote string"


def index_path(path: str) -> str:
    return path.rstrip("/") + ".indice"


def trigrams(value: Column) -> Column:
    """The distinct runs of SIZE characters of a text; shorter texts have none."""
    starts = F.sequence(F.lit(1), F.length(value) - F.lit(SIZE - 1))
    grams = F.array_distinct(F.transform(starts, lambda i: F.substring(value, i, F.lit(SIZE))))
    return F.when(F.length(value) >= SIZE, grams).otherwise(F.array().cast("array<string>"))


def bucket(trigram: Column) -> Column:
    return F.pmod(F.xxhash64(trigram), F.lit(BUCKETS)).cast("int")


def _read(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """One of the index's tables; empty before the first update."""
    if not exists(spark, os.path.join(index_path(path), name)):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(os.path.join(index_path(path), name))


def indexed_files(spark: SparkSession, path: str) -> set[str]:
    """Names of the indexed files: no more than the driver lists for the table itself."""
    return {r.archivo for r in _read(spark, path, "archivos", FILES).distinct().collect()}


def update_index(spark: SparkSession, path: str) -> int:
    """Index the files of the stored table at ``path`` that are not indexed yet; how many there were.

    Run it after each write to the table; a run that failed is simply repeated.
    """
    present = file_names(tables.read_inspections(spark, path))
    new = sorted(present.keys() - indexed_files(spark, path))
    if not new:
        return 0
    batch = uuid.uuid4().hex[:12]

    def store(df: DataFrame, name: str, *partitions: str) -> None:
        folder = os.path.join(index_path(path), name, f"lote={batch}")
        df.write.partitionBy(*partitions).parquet(folder) if partitions else df.write.parquet(folder)

    def stored(name: str, schema: str) -> DataFrame:
        return _read(spark, path, name, schema).where(F.col("lote") == batch)

    rows = read_files(spark, path, [present[n] for n in new])
    fields = F.array(*[F.struct(F.lit(name).alias("campo"), F.lower(c).alias("valor")) for name, c in TEXT_FIELDS.items()])
    places = rows.select(F.explode(fields).alias("f"), F.substring_index("_metadata.file_path", "/", -LEVELS).alias("archivo"))
    places = places.select("f.campo", "f.valor", "archivo").where(F.col("valor").isNotNull()).distinct()
    # Sorted by value within a field, so that a look-up skips row groups.
    store(places.repartitionByRange("campo", "valor").sortWithinPartitions("campo", "valor"), "lugares", "campo")
    values = stored("lugares", PLACES).select("campo", "valor").distinct()
    postings = values.select("campo", F.explode(trigrams(F.col("valor"))).alias("trigrama"), "valor")
    postings = files.for_partitioned_write(postings.withColumn("cubo", bucket(F.col("trigrama"))), "campo", "cubo")
    store(postings.sortWithinPartitions("campo", "cubo", "trigrama"), "trigramas", "campo", "cubo")
    counts = stored("trigramas", POSTINGS).groupBy("campo", "trigrama").agg(F.count(F.lit(1)).alias("n"))
    store(counts.sortWithinPartitions("campo", "trigrama"), "cuentas", "campo")
    store(spark.createDataFrame([(n,) for n in new], "archivo string").coalesce(1), "archivos")
    return len(new)


def write_inserted_indexed(rows: DataFrame, path: str) -> int:
    """SNK1 with the index: append an upload's new rows to the stored table and index the files they made."""
    write_inserted(rows, path)
    return update_index(rows.sparkSession, path)


def rarest(spark: SparkSession, path: str, field: str, text: str) -> list[str] | None:
    """Up to RAREST trigrams of a text, the rarest of a field's values first; None for a text without trigrams.

    Empty if no value of the field holds one of the text's trigrams.
    """
    # Cut by Spark like the values, so that both sides agree; one row, no table is read.
    grams = spark.range(1).select(trigrams(F.lower(F.lit(text))).alias("g")).first().g
    if not grams:
        return None
    counts = _read(spark, path, "cuentas", COUNTS).where((F.col("campo") == field) & F.col("trigrama").isin(grams))
    found = {r.trigrama: r.n for r in counts.groupBy("trigrama").agg(F.sum("n").alias("n")).collect()}
    return sorted(grams, key=lambda g: (found[g], g))[:RAREST] if len(found) == len(grams) else []


def matching_values(spark: SparkSession, path: str, field: str, text: str) -> DataFrame:
    """(valor): indexed values of a field that hold ``text``, lower-cased on both sides."""
    grams = rarest(spark, path, field, text)
    if grams is None:
        values = _read(spark, path, "lugares", PLACES).where(F.col("campo") == field).select("valor").distinct()
    else:
        cubes = [r.b for r in spark.createDataFrame([(g,) for g in grams], "g string").select(bucket(F.col("g")).alias("b")).distinct().collect()]
        postings = _read(spark, path, "trigramas", POSTINGS).where(
            (F.col("campo") == field) & F.col("cubo").isin(cubes) & F.col("trigrama").isin(grams)
        )
        held = postings.groupBy("valor").agg(F.countDistinct("trigrama").alias("n"))
        values = held.where(F.col("n") == len(grams)).select("valor")
    return values.where(F.col("valor").contains(F.lower(F.lit(text))))


def candidate_files(spark: SparkSession, path: str, params: SearchParams) -> list[str]:
    """Paths of the files of the table that may hold a row for the search's text parameters."""
    present = file_names(tables.read_inspections(spark, path))
    texts = {name: value for name, value in params.active().items() if name in TEXT_FIELDS}
    if not texts:
        return sorted(present.values())
    per_field = []
    for field, text in texts.items():
        places = _read(spark, path, "lugares", PLACES).where(F.col("campo") == field)
        per_field.append(places.join(matching_values(spark, path, field, text), "valor", "left_semi").select("archivo").distinct())
    both = functools.reduce(lambda a, b: a.join(b, "archivo", "left_semi"), per_field)
    found = {r.archivo for r in both.collect()}  # file names: no more than the table has files
    known = indexed_files(spark, path)
    return sorted(p for name, p in present.items() if name in found or name not in known)


def search_indexed(spark: SparkSession, path: str, params: SearchParams) -> DataFrame:
    """SRC8 over a stored table: the same rows as ``search``, from the files that may hold one."""
    return search(read_files(spark, path, candidate_files(spark, path, params)), params)
