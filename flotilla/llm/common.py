"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

# White space of the word contract: space and the control characters \t..\r.
SPACE_CLASS = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One of the given Parquet tables, pruned to ``columns``; any path Spark can read."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back.

    Cuts the lineage: a lost executor costs a re-read of those files, and
    later joins start from a plain scan, whose exchange AQE may split.
    """
    return materialize(df, f"llm-{name}")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, where a lambda inside ``body`` would compute it for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def id_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; null ids are in no fold (null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds)


def word_array(text: Column) -> Column:
    """Lower-cased runs of letters and digits of ``text`` (null: empty array)."""
    clean = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    trimmed = F.trim(clean)
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, " "))
