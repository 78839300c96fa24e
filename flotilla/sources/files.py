"""File ingest source and sinks (SRC9, SRC10, SNK1, SNK2).

Uploads are directories of CSV, JSON or Parquet files. Columns are matched by
name, in any order; every cell but the line number is read as text, so a bad
plate or date reaches the validation step with its original value. CSV and
JSON keep unreadable lines in a corrupt-record column instead of failing the
job. A line is named by its file (``archivo``) and line number (``fila``);
files without a ``fila`` column get their lines numbered from 1.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt"
FILE = "archivo"

# Columns every upload has; ``fila`` is optional, others are ignored.
REQUIRED = ["conductor", "placa", "contrato", "campo_coordinacion", "fecha", "resultado"]
UPLOAD_SCHEMA = T.StructType(
    [T.StructField(FILE, T.StringType()), T.StructField("fila", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in REQUIRED]
)

FORMATS = ("csv", "json", "parquet")


def _options(reader, fmt: str, glob: str | None):
    if fmt not in FORMATS:
        raise ValueError(f"unsupported upload format {fmt!r}; expected one of {FORMATS}")
    if fmt == "csv":
        # Cells keep their spaces: a plate like " abc-123" must reach validation as is.
        reader = reader.options(header="true", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false")
        # A file whose header differs from the others' is an error, not shifted cells.
        reader = reader.option("enforceSchema", "false")
    if fmt in ("csv", "json"):
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    if glob:
        # SRC10: the upload form only accepts some file names; the read does the same.
        reader = reader.option("pathGlobFilter", glob)
    return reader.format(fmt)


def upload_columns(spark: SparkSession, path: str, fmt: str, glob: str | None = None) -> list[str]:
    """Column names of the upload's files, in file order (the header of a CSV file).

    An empty folder has the columns of ``UPLOAD_SCHEMA``.
    """
    plain = [f.name for f in UPLOAD_SCHEMA if f.name != FILE]
    if fmt == "json":  # keys have no order
        return plain
    try:
        found = _options(spark.read, fmt, glob).load(path).columns
    except Exception as exc:
        if "UNABLE_TO_INFER_SCHEMA" not in str(exc):
            raise
        found = []
    columns = [c for c in found if c not in (FILE, CORRUPT)] or plain
    missing = [c for c in REQUIRED if c not in columns]
    if missing:
        raise ValueError(f"upload {path} has no column {', '.join(missing)}; it has {', '.join(columns)}")
    return columns


def _schema(columns: list[str], fmt: str) -> T.StructType:
    kind = {"fila": T.LongType()}
    fields = [T.StructField(c, kind.get(c, T.StringType())) for c in columns]
    return T.StructType(fields + ([] if fmt == "parquet" else [T.StructField(CORRUPT, T.StringType())]))


def _shaped(df: DataFrame, columns: list[str]) -> DataFrame:
    """The upload columns in order; ``archivo`` is the folder's value if the files lie in such folders, else the file."""
    name = F.col(FILE).cast("string") if FILE in df.columns else F.col("_metadata.file_name")
    fila = F.col("fila") if "fila" in columns else F.lit(None).cast("long")
    kept = [name.alias(FILE), fila.alias("fila"), *REQUIRED]
    return df.select(*kept, *([CORRUPT] if CORRUPT in df.columns else []))


def _numbered(df: DataFrame) -> DataFrame:
    """``df`` with ``fila`` counted from 1 in each file.

    Lines are counted within the file's splits, whose size Spark bounds; the
    lines of the splits before come from one row per split.
    """
    row = df.withColumns(
        {"__file": F.col("_metadata.file_path"), "__split": F.col("_metadata.file_block_start"), "__at": F.monotonically_increasing_id()}
    )
    within = Window.partitionBy("__file", "__split").orderBy("__at")
    row = row.withColumn("__n", F.row_number().over(within))
    before = Window.partitionBy("__file").orderBy("__split").rowsBetween(Window.unboundedPreceding, -1)
    splits = row.groupBy("__file", "__split").agg(F.max("__n").alias("__count"))
    splits = splits.withColumn("__before", F.coalesce(F.sum("__count").over(before), F.lit(0)))
    return (
        row.join(splits, ["__file", "__split"])
        .withColumn("fila", F.col("__n") + F.col("__before"))
        .drop("__file", "__split", "__at", "__n", "__count", "__before")
    )


def read_upload(spark: SparkSession, path: str, fmt: str = "csv", glob: str | None = None) -> DataFrame:
    """SRC9: an upload directory as a DataFrame of the upload schema."""
    columns = upload_columns(spark, path, fmt, glob)
    df = _options(spark.read, fmt, glob).schema(_schema(columns, fmt)).load(path)
    if "fila" in columns:
        return _shaped(df, columns)
    # The file's name is only known before the lines are numbered.
    named = df if FILE in df.columns else df.withColumn(FILE, F.col("_metadata.file_name"))
    return _shaped(_numbered(named), [*columns, "fila"])


def read_upload_stream(
    spark: SparkSession, path: str, fmt: str = "csv", glob: str | None = None, files_per_batch: int = 1
) -> DataFrame:
    """SRC9 as a stream: each new file in ``path`` becomes part of a micro-batch. Its files carry ``fila``."""
    columns = upload_columns(spark, path, fmt, glob)
    if "fila" not in columns:
        raise ValueError("a streamed upload needs a fila column")
    reader = spark.readStream.option("maxFilesPerTrigger", str(files_per_batch))
    return _shaped(_options(reader, fmt, glob).schema(_schema(columns, fmt)).load(path), columns)


def write_upload(df: DataFrame, path: str, fmt: str = "csv", columns: list[str] | None = None) -> None:
    """Write upload rows under one folder per ``archivo``; the number of files follows the data."""
    kept = columns or [f.name for f in UPLOAD_SCHEMA if f.name != FILE]
    writer = for_partitioned_write(df.select(FILE, *kept), FILE).write.mode("overwrite").partitionBy(FILE)
    if fmt == "csv":
        # The CSV writer trims cells unless told otherwise.
        writer = writer.options(header="true", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false")
    writer.format(fmt).save(path)


def with_partition_columns(df: DataFrame, date_col: str = "fecha") -> DataFrame:
    """Year and month columns the stored inspection table is partitioned by."""
    return df.withColumn("anio", F.year(date_col)).withColumn("mes_num", F.month(date_col))


def for_partitioned_write(df: DataFrame, *partition_cols: str) -> DataFrame:
    """Cluster rows by their output partition before a partitioned write.

    Without it every task writes one file per partition value it holds
    (tasks x months small files). The ``rebalance`` hint lets AQE coalesce
    small partitions and split a hot one (a month holding a third of the
    rows is spread over several tasks), so files stay few and even.
    """
    return df.hint("rebalance", *partition_cols)


def write_text_report(lines: DataFrame, path: str) -> None:
    """SNK2: one text line per report row."""
    lines.select(F.col(lines.columns[0]).cast("string")).write.mode("overwrite").text(path)


def stream_of(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream over Parquet files with the schema they have now; ``path`` is a file, a folder or a URI that Spark reads."""
    table = spark.read.parquet(path)
    reader = spark.readStream.schema(table.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    # A stream lists folders: of a path that is itself a file, its folder is read through a name filter.
    folder, name = os.path.split(path.rstrip("/"))
    first = table.select("_metadata.file_name").limit(1).collect()
    if first and first[0].file_name == name:
        reader, path = reader.option("pathGlobFilter", name), folder
    return reader.parquet(path)
