"""The files of a stored inspection table: their names, and a read of some of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import tables

# A file is named by its partition folders and its own name, which repeats between folders.
LEVELS = len(tables.PARTITION_SCHEMA) + 1


def file_names(df: DataFrame) -> dict[str, str]:
    """Name to path of the files that a plain read of the table opens; the driver lists them for any scan."""
    return {"/".join(p.split("/")[-LEVELS:]): p for p in df.inputFiles()}


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_files(spark: SparkSession, path: str, files: list[str]) -> DataFrame:
    """Some files of the stored table, with its partition columns."""
    schema = T.StructType(tables.INSPECTION_SCHEMA.fields + tables.PARTITION_SCHEMA.fields)
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*files)
