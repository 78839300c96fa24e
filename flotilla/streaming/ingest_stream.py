"""STR1: incremental ingest of upload files with Structured Streaming.

Each micro-batch (``maxFilesPerTrigger`` files) runs through the same
``IngestJob`` as the batch path inside ``foreachBatch``. Rows stored before the
stream are read in place. A batch writes its new rows to a folder of its own and
then commits folder and counters to the manifest in one swap: a crash before the
swap leaves a folder that nobody reads, a batch that is run again after it finds
its epoch listed and does nothing. Committed epochs are merged while the stream
runs (``manifest``), so a batch opens a bounded number of folders. The summed
counters equal the batch summary of the same rows (insertados is the number of
keys new to the stored table, whatever the file order). All folders are read
with explicit schemas: an epoch without new rows and an empty stored table are
ordinary.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions import vocab
from ..operators.ingest import FIRST_ERRORS, IngestJob, as_inspections
from ..operators.scalars import side_by_side
from ..sources import files, tables
from ..sources.manifest import Entries, Entry, Manifest

COUNTERS = ["total_rows", "valid_rows", "invalid_rows", "duplicados", "insertados"]
SCHEMA = T.StructType(tables.INSPECTION_SCHEMA.fields + tables.PARTITION_SCHEMA.fields)


def manifest_of(spark: SparkSession, work_dir: str) -> Manifest:
    return Manifest(spark, os.path.join(work_dir, "new"))


def read_new(spark: SparkSession, work_dir: str) -> DataFrame:
    """Inspections the stream has stored, with ``anio`` and ``mes_num``."""
    return manifest_of(spark, work_dir).read_data(SCHEMA)


def first_of(errors: list[list]) -> list[list]:
    """The first errors of several batches (fila, message), lines without a number last."""
    return sorted(errors, key=lambda e: (e[0] is None, e[0] or 0, e[1]))[:FIRST_ERRORS]


def folded(entries: Entries) -> tuple[dict[str, int], list[list]]:
    """Counters of several epochs as one, and their first errors."""
    counters = {c: sum(e.counters[c] for e in entries) for c in COUNTERS}
    return counters, first_of([x for e in entries for x in e.errors])


def make_batch_writer(spark: SparkSession, stored: DataFrame, work_dir: str, mode: str):
    """``foreachBatch`` function: ``stored`` is the inspection table before the stream, read in place."""
    columns = SCHEMA.names

    def process(batch: DataFrame, batch_id: int) -> None:
        manifest = manifest_of(spark, work_dir)
        entries = manifest.entries()
        if manifest.covers(batch_id):
            return  # committed before a failure
        before = files.with_partition_columns(stored.select(*tables.INSPECTION_COLUMNS)) if "anio" not in stored.columns else stored
        earlier = manifest.read_data(SCHEMA, entries).select(*columns)
        job = IngestJob(batch, before.select(*columns).unionByName(earlier), mode)
        tramo = manifest.new_folder(batch_id)
        tables.write_inspections(as_inspections(job.inserted()), manifest.folder(tramo))
        # What was written is counted from its files, instead of a second look at the stored keys.
        written = manifest.read_data(SCHEMA, [Entry(tramo, batch_id, batch_id)]).count()
        # One row: the counters and the batch's first errors (at most FIRST_ERRORS, so the array is bounded).
        errors = job.first_errors().agg(F.collect_list(F.struct("fila", "error")).alias("errores"))
        row = side_by_side(job.counts(written), errors).first()
        entry = Entry(tramo, batch_id, batch_id, 0, {c: row[c] for c in COUNTERS}, first_of([[e.fila, e.error] for e in row.errores]))
        manifest.commit(lambda now: None if any(e.first <= batch_id <= e.last for e in now) else [*now, entry])
        compact(spark, work_dir)
        manifest.vacuum()

    return process


def compact(spark: SparkSession, work_dir: str) -> int:
    """Merge committed epochs whose turn it is, also while the stream runs; how many merges there were."""
    manifest = manifest_of(spark, work_dir)

    def merge(old: Entries, tramo: str) -> Entry:
        tables.write_inspections(manifest.read_data(SCHEMA, old), manifest.folder(tramo))
        return Entry(tramo, old[0].first, old[-1].last, old[0].level + 1, *folded(old))

    return manifest.compact(merge)


def start_ingest_stream(
    spark: SparkSession,
    source_dir: str,
    stored: DataFrame,
    work_dir: str,
    mode: str = vocab.DEFAULT_PLATE_MODE,
    fmt: str = "csv",
    files_per_batch: int = 1,
    processing_time: str | None = None,
    glob: str | None = None,
) -> StreamingQuery:
    """Start the ingest stream and return the running query.

    With ``processing_time`` (e.g. ``"1 minute"``) it keeps watching
    ``source_dir``; without it, it processes the files present and stops.
    Outputs go under ``work_dir``: ``new`` (data folders, partitioned by year
    and month, and their manifest) and ``checkpoint``. Starting again on the
    same ``work_dir`` goes on where the stream stopped; nothing is copied.
    """
    source = files.read_upload_stream(spark, source_dir, fmt, glob, files_per_batch)
    writer = source.writeStream.foreachBatch(make_batch_writer(spark, stored, work_dir, mode)).option(
        "checkpointLocation", os.path.join(work_dir, "checkpoint")
    )
    writer = writer.trigger(processingTime=processing_time) if processing_time else writer.trigger(availableNow=True)
    return writer.start()


def fold_into(spark: SparkSession, work_dir: str, stored_path: str) -> None:
    """Append what a stopped stream has stored to the inspection table; the next stream takes a new ``work_dir``."""
    tables.write_inspections(read_new(spark, work_dir), stored_path, mode="append")


def run_ingest_stream(
    spark: SparkSession,
    source_dir: str,
    stored: DataFrame,
    work_dir: str,
    mode: str = vocab.DEFAULT_PLATE_MODE,
    fmt: str = "csv",
    files_per_batch: int = 1,
    filename: str | None = None,
) -> DataFrame:
    """Run the stream over every file present in ``source_dir`` and return the summary row."""
    query = start_ingest_stream(spark, source_dir, stored, work_dir, mode, fmt, files_per_batch)
    query.awaitTermination()
    return stream_summary(spark, work_dir, filename or os.path.basename(source_dir.rstrip("/")))


def stream_summary(spark: SparkSession, work_dir: str, filename: str) -> DataFrame:
    """The committed counters and first errors as one summary row; zeros before the first batch."""
    counters, errors = folded(manifest_of(spark, work_dir).entries())
    row = (filename, *[counters[c] for c in COUNTERS], [message for _, message in errors])
    fields = ", ".join(f"{c} bigint" for c in COUNTERS)
    return spark.createDataFrame([row], f"filename string, {fields}, invalid array<string>")
