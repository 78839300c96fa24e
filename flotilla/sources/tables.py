"""Readers for the test tables and the fleet tables bound to them (FIXTURES.md §3).

Every fleet table is a lazy DataFrame derived by Spark from the given
Parquet tables, so its size grows with theirs. Each reader selects only the
columns it needs, which Catalyst turns into the Parquet ``ReadSchema``.

``visits`` and ``fatigue_events`` come from one fact table each and carry the
driver's key instead of the name: aggregates run on them, and names are joined
to the few rows that are left. The ``%`` rules below say which raw cells are
damaged and which rows were stored before; no rule leaves a row out.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import plates

TEST_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Letters the fixture plates are built from.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# All plates of three letters and three digits, the domain of vehicle numbers.
PLATES = 26**3 * 1000
# Orders that one vehicle's inspections come from.
ORDERS_PER_VEHICLE = 8
# Spreads neighbouring vehicle numbers over the plates; prime to PLATES, so one-to-one.
SPREAD = 7919


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.select(*columns) if columns else df


def vehicle_number(orderkey: Column) -> Column:
    """The vehicle of an order; the number of vehicles grows with the orders."""
    return F.floor(orderkey / F.lit(ORDERS_PER_VEHICLE)) % F.lit(PLATES)


def plate_of(v: Column) -> Column:
    """Fixture plate of vehicle number ``v``: three letters, three digits."""
    place = v * F.lit(SPREAD) % F.lit(PLATES)
    letters = F.floor(place / F.lit(1000))

    def letter(n: Column) -> Column:
        return F.substr(F.lit(ALPHABET), (n % F.lit(26) + F.lit(1)).cast("int"), F.lit(1))

    return F.concat(
        letter(letters), letter(F.floor(letters / F.lit(26))), letter(F.floor(letters / F.lit(676))),
        F.lpad((place % F.lit(1000)).cast("string"), 3, "0"),
    )


def _people(spark: SparkSession, sf_dir: str, who: DataFrame) -> DataFrame:
    """(conductor_id, conductor, contrato, nationkey) rows with the nation's name as field."""
    nation = read(spark, sf_dir, "nation", "n_nationkey", "n_name")
    joined = who.join(nation, F.col("nationkey") == F.col("n_nationkey"), "left")
    return joined.select("conductor_id", "conductor", "contrato", F.col("n_name").alias("campo_coordinacion"))


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = read(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    return customer.toDF("conductor_id", "conductor", "contrato", "nationkey")


def conductores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Driver registry: the customers, and the suppliers, who never appear in an order."""
    supplier = read(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_nationkey").select(
        (-F.col("s_suppkey") - 1).alias("conductor_id"), F.col("s_name").alias("conductor"),
        F.lit(None).cast("string").alias("contrato"), F.col("s_nationkey").alias("nationkey"),
    )
    return _people(spark, sf_dir, _customers(spark, sf_dir).unionByName(supplier))


def vehiculos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicle registry: one vehicle for each part; there are some more than the orders use."""
    part = read(spark, sf_dir, "part", "p_partkey")
    return part.select(F.col("p_partkey").alias("vehiculo_id"), plate_of(F.col("p_partkey")).alias("placa"))


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inspections from the orders alone: driver and vehicle as numbers, no join."""
    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    return orders.select(
        F.col("o_orderkey").alias("inspeccion_id"),
        F.col("o_custkey").alias("conductor_id"),
        vehicle_number(F.col("o_orderkey")).alias("vehiculo_id"),
        F.col("o_orderdate").alias("fecha"),
        F.col("o_orderstatus").alias("resultado"),
    )


def inspecciones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inspection table: every visit with the driver's name, contract and field, if the driver is known."""
    people = _people(spark, sf_dir, _customers(spark, sf_dir))
    return (
        visits(spark, sf_dir)
        .join(people, "conductor_id", "left")
        .select(
            "inspeccion_id", "conductor", plate_of(F.col("vehiculo_id")).alias("placa"), "contrato",
            "campo_coordinacion", "fecha", "resultado",
        )
    )


def fatigue_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fatigue evaluations from the events alone, the driver as a number."""
    return read(spark, sf_dir, "events", "event_id", "ts", "user_id", "value").toDF(
        "evaluacion_id", "fecha_evaluacion", "conductor_id", "score_fatiga"
    )


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conductor_id, conductor) of the drivers that can have inspections and evaluations."""
    return read(spark, sf_dir, "customer", "c_custkey", "c_name").toDF("conductor_id", "conductor")


def evaluaciones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fatigue evaluation of a known driver, with the name."""
    joined = fatigue_events(spark, sf_dir).join(names(spark, sf_dir), "conductor_id")
    return joined.select("evaluacion_id", "conductor", "fecha_evaluacion", "score_fatiga")


def inspecciones_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upload as it arrives: every cell text, with damaged plates and dates."""
    fila = F.col("inspeccion_id")
    good_plate = F.col("placa")
    placa = (
        F.when(fila % 23 == 0, F.lit(None).cast("string"))
        .when(fila % 17 == 0, F.lit("AB12"))
        .when(
            fila % 10 == 0,
            F.concat(F.lit(" "), F.lower(F.substr(good_plate, F.lit(1), F.lit(3))), F.lit("-"),
                     F.substr(good_plate, F.lit(4), F.lit(3))),
        )
        .otherwise(good_plate)
    )
    fecha = (
        F.when(fila % 29 == 0, F.lit(None).cast("string"))
        .when(fila % 31 == 0, F.lit("basura"))
        .otherwise(F.date_format("fecha", "yyyy-MM-dd"))
    )
    # A few rows name no driver.
    conductor = F.when(fila % 97 != 0, F.col("conductor"))
    return inspecciones(spark, sf_dir).select(
        fila.alias("fila"), conductor.alias("conductor"), placa.alias("placa"), "contrato", "campo_coordinacion",
        fecha.alias("fecha"), "resultado",
    )


# Names of the fixture upload's files.
FIRST_FILE, SECOND_FILE = "inspecciones-1.csv", "inspecciones-2.csv"


def upload_from_raw(raw: DataFrame) -> DataFrame:
    """The fixture upload: all raw rows in one file, those with fila % 50 = 1 again in a second.

    Line numbers repeat between the files; (archivo, fila) names a line. Built
    in one pass over the raw rows.
    """
    files = F.when(F.col("fila") % 50 == 1, F.array(F.lit(FIRST_FILE), F.lit(SECOND_FILE))).otherwise(F.array(F.lit(FIRST_FILE)))
    return raw.select(F.explode(files).alias("archivo"), *raw.columns)


def stored_from_raw(raw: DataFrame, mode: str) -> DataFrame:
    """Inspections stored before the upload: of the valid raw rows with fila % 7 = 0 the first of
    each (driver, plate, date), normalised in ``mode``; all columns of the inspection table."""
    fecha = F.try_to_date(F.col("fecha"), "yyyy-MM-dd")
    ok = plates.plate_is_valid(F.col("placa"), mode) & fecha.isNotNull()
    valid = raw.where((F.col("fila") % 7 == 0) & ok).select(
        "fila", "conductor", plates.normalise_plate(F.col("placa"), mode).alias("placa"),
        "contrato", "campo_coordinacion", fecha.cast("timestamp_ntz").alias("fecha"), "resultado",
    )
    rest = F.min(F.struct("fila", "contrato", "campo_coordinacion", "resultado")).alias("first")
    kept = valid.groupBy("conductor", "placa", "fecha").agg(rest)
    return kept.select(
        F.col("first.fila").alias("inspeccion_id"), "conductor", "placa", F.col("first.contrato").alias("contrato"),
        F.col("first.campo_coordinacion").alias("campo_coordinacion"), "fecha", F.col("first.resultado").alias("resultado"),
    )


# Schema of a stored inspection table, and the columns it is partitioned by.
INSPECTION_SCHEMA = T.StructType(
    [
        T.StructField("inspeccion_id", T.LongType()),
        T.StructField("conductor", T.StringType()),
        T.StructField("placa", T.StringType()),
        T.StructField("contrato", T.StringType()),
        T.StructField("campo_coordinacion", T.StringType()),
        T.StructField("fecha", T.TimestampNTZType()),
        T.StructField("resultado", T.StringType()),
    ]
)
PARTITION_SCHEMA = T.StructType([T.StructField("anio", T.IntegerType()), T.StructField("mes_num", T.IntegerType())])
INSPECTION_COLUMNS = INSPECTION_SCHEMA.names


def write_inspections(inspections: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store inspections, partitioned by year and month of ``fecha``.

    Queries that then read the table (``read_inspections``) skip the base join
    and prune partitions on month/year search parameters and date bounds.
    ``mode="append"`` adds rows to a stored table.
    """
    from .files import for_partitioned_write, with_partition_columns

    typed = inspections.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in INSPECTION_SCHEMA])
    out = for_partitioned_write(with_partition_columns(typed), *PARTITION_SCHEMA.names)
    out.write.mode(mode).partitionBy(*PARTITION_SCHEMA.names).parquet(path)


def read_inspections(spark: SparkSession, path: str) -> DataFrame:
    """A stored inspection table: the inspection columns plus ``anio``/``mes_num``; it may be empty."""
    schema = T.StructType(INSPECTION_SCHEMA.fields + PARTITION_SCHEMA.fields)
    return spark.read.schema(schema).parquet(path)
