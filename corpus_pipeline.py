"""Corpus pipeline: language ID, line dedup, near-dedup, decontamination, mixing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes
each stage's result as Parquet to the shared checkpoint folder and reads it
back as the next stage's documents, so a lost executor costs a re-read and no
stage runs twice. What a stage writes on the way is deleted once its result
stands; the stages' results stay, for the caller to delete with the folder. All stages but the last return the columns they were given.

Null, empty and repeated rows: a document without text or letters goes with
the language stage; null ids pass every stage (they can't be near copies of
anything named). Rows that repeat a doc_id are one document: near-dedup keeps
or drops them together. Extra columns pass through whatever their names,
those starting with two underscores aside. Empty tables give empty results.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flotilla.llm import decontaminate, langid, line_dedup, minhash, mixing
from flotilla.llm.common import saved, table
from flotilla.session import scratch_scope

# A document is rejected when no language takes this mean share of its words.
LEAST_LANGUAGE_SHARE = 0.5


def _keep(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id is among ``decided``'s (null equals null), columns unchanged."""
    ids = decided.select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(ids, docs["doc_id"].cast("long").eqNullSafe(F.col("__id")), "left_semi")


def _drop(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id is not among ``decided``'s (null equals null), columns unchanged."""
    ids = decided.select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(ids, docs["doc_id"].cast("long").eqNullSafe(F.col("__id")), "left_anti")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: undetermined ones, and those with no dominant language, go."""
    found = saved(langid.identify(docs), "stage-language")
    rejected = found.where((F.col("lang_pred") == langid.UNDETERMINED) | (F.col("score") < LEAST_LANGUAGE_SHARE))
    # Rows of one doc_id may hold several texts; it goes only if none of them has a language.
    rejected = rejected.select("doc_id").distinct().join(
        found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SHARE))
        .select(F.col("doc_id").alias("__good")).distinct(),
        F.col("doc_id").eqNullSafe(F.col("__good")),
        "left_anti",
    )
    return _drop(docs, rejected)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-site boilerplate lines; those left without any text go. n_chars follows the text."""
    clean = line_dedup.without_boilerplate(docs)
    emptied = (F.col("removed_lines") > 0) & (F.trim(F.regexp_replace("clean_text", r"\s+", " ")) == "")
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("clean_text").alias("text"))
        elif c == "n_chars":
            changed = F.length("clean_text").cast(docs.schema[c].dataType)
            columns.append(F.when(F.col("removed_lines") > 0, changed).otherwise(docs[c]).alias(c))
        else:
            columns.append(docs[c])
    return clean.where(~F.coalesce(emptied, F.lit(False))).select(*columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    found = minhash.near_duplicates(docs, n=5, percent=80)
    return _keep(docs, found.where("kept"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    flagged = decontaminate.flag_documents(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))
    return flagged.where(~flagged["contaminated"]).select(*[docs[c] for c in docs.columns])


KEY = ("doc_id", "source", "size")


def _with_key(docs: DataFrame) -> DataFrame:
    """``docs`` and the columns that tell its rows in the mix: __doc_id, __source, __size."""
    values = (F.col("doc_id").cast("long"), F.col("source").cast("string"), mixing.word_count(F.col("text")))
    return docs.select("*", *[v.alias(f"__{c}") for c, v in zip(KEY, values, strict=True)])


def _numbered(repeated: DataFrame) -> DataFrame:
    """Rows with ``__nth``, their number (from 1) within the key: within the partition first, so no task sorts a whole key."""
    rows = saved(repeated.withColumn("__part", F.spark_partition_id()), "repeated-rows")
    key = [f"__{c}" for c in KEY]
    counts = rows.groupBy(*key, "__part").agg(F.count(F.lit(1)).alias("__m"))
    before = F.coalesce(F.sum("__m").over(Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*[F.col(c).alias(f"_{c}") for c in key], F.col("__part").alias("___part"), before.alias("__before"))
    inside = F.row_number().over(Window.partitionBy(*key, "__part").orderBy(F.xxhash64("text")))
    same = functools.reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key])
    joined = rows.withColumn("__inside", inside).join(counts, same & (F.col("__part") == F.col("___part")))
    return joined.withColumn("__nth", F.col("__inside") + F.col("__before"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: every row as often as the mix takes it, with ``copy_no`` (from 1) and its source's ``target`` words.

    Rows that repeat a doc_id, source and size share what the mix takes of
    them: equal parts, and one more for the first of them as far as it goes.
    """
    mixed = mixing.mix(docs)
    per = mixed.groupBy(*KEY).agg(
        F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__rows"), F.first("target").alias("__target")
    )
    per = saved(per, "mix-keys").select(*[F.col(c).alias(f"m__{c}") for c in KEY], "__copies", "__rows", "__target")
    same = functools.reduce(Column.__and__, [F.col(f"__{c}").eqNullSafe(F.col(f"m__{c}")) for c in KEY])
    # One row a document, so it grows with the texts: never broadcast, the same join at every size.
    joined = _with_key(docs).join(per.hint("merge"), same)
    taken = joined.where(F.col("__rows") == 1).withColumn("__each", F.col("__copies"))
    if not per.where(F.col("__rows") > 1).isEmpty():
        rest = _numbered(joined.where((F.col("__rows") > 1) & (F.col("__copies") > 0)))
        more = (F.col("__nth") <= F.col("__copies") % F.col("__rows")).cast("long")
        each = F.floor(F.col("__copies") / F.col("__rows")) + more
        taken = taken.unionByName(rest.withColumn("__each", each).select(taken.columns))
    copies = F.explode(F.sequence(F.lit(1), F.col("__each").cast("int")))
    return taken.where(F.col("__each") > 0).select(*docs.columns, copies.alias("copy_no"), F.col("__target").alias("target"))


STAGES = [
    ("language", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

# The language stage's model has no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch_scope(spark, f"pipeline-{name}") as keep:
            docs = keep(stage(spark, docs, sf_dir))
    return docs
