"""Upload validation, deduplication and summary (FLT15, FLT16, WIN3, JOI3, LIM1,
SET1, AGG12, SCA13, SCA14).

Plan shape, chosen for skewed uploads (one key may hold a third of the rows):

* flag every row in a narrow projection (no shuffle);
* one partial aggregate per (validity, key) gives the number of rows and the
  first of them, the key being (conductor, normalised plate, date), nulls
  equal: a hot key is folded in every map task;
* the left join with the stored keys runs on that key-unique side and says
  which keys are new; one global fold of it gives all five counters, so the
  upload is read once;
* duplicates are the valid rows minus the inserted lines, a join on the line
  name (archivo, fila), which spreads evenly whatever the key skew;
* the first error messages come from ``orderBy(fila).limit(n)``
  (per-task top-n, then a merge), never from a full ``collect_list``.

Invariants (D10): total = valid + invalid, valid = duplicados + insertados.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import plates, vocab
from ..sources.files import CORRUPT, FILE, with_partition_columns
from ..sources.tables import INSPECTION_COLUMNS, write_inspections
from .scalars import side_by_side

if TYPE_CHECKING:
    from ..sources.key_index import KeyIndex

KEY = ["conductor", "placa", "fecha"]
LINE = [FILE, "fila"]
PARTITION_COLUMNS = ["anio", "mes_num"]
ROW_COLUMNS = ["fila", "conductor", "placa", "contrato", "campo_coordinacion", "fecha", "resultado"]
FIRST_ERRORS = 5
DATE_FORMAT = "yyyy-MM-dd"
MISSING = "vacía"
UNREADABLE = "registro ilegible"


def same(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    """Equality of all ``columns``, null being equal to null."""
    out = F.lit(True)
    for c in columns:
        out = out & left[c].eqNullSafe(right[c])
    return out


def parse_upload_date(raw: Column) -> Column:
    return F.try_to_date(raw, DATE_FORMAT)


def error_reason(placa_ok: Column, fecha_ok: Column, placa: Column, fecha: Column,
                 readable: Column | None = None) -> Column:
    """SCA14 (D9): why a row is invalid, one clause per failed check."""
    parts = [
        F.when(~placa_ok, F.format_string("placa inválida (%s)", F.coalesce(placa, F.lit(MISSING)))),
        F.when(~fecha_ok, F.format_string("fecha inválida (%s)", F.coalesce(fecha, F.lit(MISSING)))),
    ]
    if readable is not None:
        parts.insert(0, F.when(~readable, F.lit(UNREADABLE)))
    return F.concat_ws("; ", *parts)


def flag_rows(upload: DataFrame, mode: str = vocab.DEFAULT_PLATE_MODE) -> DataFrame:
    """FLT15/FLT16: every upload row with its normalised values, validity and message."""
    if mode not in vocab.PLATE_MODES:
        raise ValueError(f"unknown plate mode {mode!r}; expected one of {vocab.PLATE_MODES}")
    placa = F.col("placa")
    fecha_raw = F.col("fecha")
    placa_ok = plates.plate_is_valid(placa, mode)
    fecha_ok = parse_upload_date(fecha_raw).isNotNull()
    # A line is readable when the reader kept no corrupt record for it and its
    # line number parsed. Testing ``fila`` too keeps the check right under CSV
    # column pruning, where only the referenced columns are parsed.
    readable = (F.col(CORRUPT).isNull() & F.col("fila").isNotNull()) if CORRUPT in upload.columns else None
    valid = placa_ok & fecha_ok if readable is None else placa_ok & fecha_ok & readable
    # A line whose number can't be read has none in its message.
    line = F.concat(F.lit("Fila "), F.coalesce(F.col("fila").cast("string"), F.lit("?")), F.lit(": "))
    message = F.concat(line, error_reason(placa_ok, fecha_ok, placa, fecha_raw, readable))
    named = F.col(FILE) if FILE in upload.columns else F.lit(None).cast("string")
    return upload.select(
        named.alias(FILE),
        "fila",
        "conductor",
        plates.normalise_plate(placa, mode).alias("placa"),
        placa.alias("placa_original"),
        "contrato",
        "campo_coordinacion",
        parse_upload_date(fecha_raw).alias("fecha"),
        fecha_raw.alias("fecha_original"),
        "resultado",
        valid.alias("valida"),
        F.when(~valid, message).alias("error"),
    )


@dataclass
class IngestJob:
    """One upload checked against the stored rows in one plate mode."""

    upload: DataFrame
    stored: DataFrame
    mode: str = vocab.DEFAULT_PLATE_MODE
    filename: str = "upload"
    # The stored table's bucketed keys, if it has them: its rows are then not looked at.
    key_index: KeyIndex | None = None

    def __post_init__(self) -> None:
        self.flagged = flag_rows(self.upload, self.mode)

    def valid(self) -> DataFrame:
        """Valid rows with normalised plate and parsed date."""
        return self.flagged.where(F.col("valida")).select(FILE, *ROW_COLUMNS)

    def invalid(self) -> DataFrame:
        """Invalid rows and their message (one per row, in line order when sorted by fila)."""
        return self.flagged.where(~F.col("valida")).select(
            "fila", F.col("placa_original").alias("placa"), F.col("fecha_original").alias("fecha"), "error"
        )

    def first_errors(self, n: int = FIRST_ERRORS) -> DataFrame:
        """LIM1: the first ``n`` messages by line number, then file; lines without a number come last."""
        rows = self.flagged.where(~F.col("valida")).select("fila", FILE, "error")
        return rows.orderBy(F.col("fila").asc_nulls_last(), FILE).limit(n).select("fila", "error")

    def keys(self) -> DataFrame:
        """Per validity and key: number of rows ``n``, their first line ``first`` (WIN3), and whether
        the key is ``nueva``, i.e. not stored yet (JOI3). Invalid rows have one row, without key."""
        rest = [c for c in ROW_COLUMNS if c not in (*KEY, "fila")]
        key = [F.when(F.col("valida"), F.col(c)).alias(c) for c in KEY]
        line = F.when(F.col("valida"), F.struct(*LINE, *rest)).alias("line")
        rows = self.flagged.select("valida", *key, line)
        grouped = rows.groupBy("valida", *KEY).agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first"))
        if self.key_index is not None:
            return self._keys_by_index(grouped)
        stored = self.stored_keys()
        joined = grouped.join(stored, same(grouped, stored, KEY) & grouped["valida"], "left")
        new = F.col("valida") & F.col("__stored").isNull()
        return joined.select("valida", *[grouped[c] for c in KEY], "n", "first", new.alias("nueva"))

    def _keys_by_index(self, grouped: DataFrame) -> DataFrame:
        """``keys`` by the bucketed keys: the upload's keys go to the buckets, the stored side stays where it is."""
        from ..sources.key_index import key_of, months_of

        # Invalid rows have no key and so no partner.
        clave = F.when(F.col("valida"), key_of(F.col("conductor"), F.col("placa"), F.col("fecha")))
        joined, new = grouped.withColumn("clave", clave), F.col("valida")
        for i, stored in enumerate(self.key_index.stored(months_of(self.valid()))):
            joined = joined.join(stored.withColumn(f"__stored{i}", F.lit(True)), "clave", "left")
            new = new & F.col(f"__stored{i}").isNull()
        return joined.select("valida", *KEY, "n", "first", new.alias("nueva"))

    def stored_keys(self) -> DataFrame:
        """The stored keys an upload row could match, distinct, with ``__stored`` set.

        When the stored table is partitioned by year and month (as SNK1 writes
        it), it is first semi-joined with the upload's months. Dynamic
        partition pruning turns that into a partition filter on the stored
        scan, so an incremental upload reads only the months it touches, not
        the whole history. The months side has a proven bound: one row per
        (year, month), at most 12 x 10,000 for any ``yyyy-MM-dd`` date.
        """
        stored = self.stored
        if set(PARTITION_COLUMNS) <= set(stored.columns):
            months = with_partition_columns(self.valid()).select(*PARTITION_COLUMNS).distinct()
            stored = stored.join(F.broadcast(months), PARTITION_COLUMNS, "left_semi")
        # Copies of one key in the stored table fold map-side here; the
        # distinct's exchange is the hash partitioning the join needs anyway.
        keys = stored.select("conductor", "placa", F.col("fecha").cast("date").alias("fecha")).distinct()
        return keys.withColumn("__stored", F.lit(True))

    def inserted(self) -> DataFrame:
        """JOI3: first lines of the keys that are not stored yet: the rows to write."""
        columns = [F.col(c) if c in KEY else F.col(f"first.{c}").alias(c) for c in ROW_COLUMNS]
        return self.keys().where("nueva").select(F.col(f"first.{FILE}").alias(FILE), *columns)

    def duplicates(self) -> DataFrame:
        """Valid rows that are not inserted: repeated in the upload or already stored."""
        valid, lines = self.valid(), self.inserted().select(*LINE)
        return valid.join(lines, same(valid, lines, LINE), "left_anti").select(*ROW_COLUMNS)

    def result_table(self) -> DataFrame:
        """SET1: stored rows followed by the new ones, as inspections."""
        stored = self.stored.select(*[F.col(c) for c in INSPECTION_COLUMNS])
        return stored.unionByName(as_inspections(self.inserted()))

    def counts(self, inserted_rows: int | None = None) -> DataFrame:
        """AGG12: the five counters in one row, from one pass over the upload.

        ``inserted_rows`` may be given when the inserted rows were already
        written; the stored keys are then not looked up again.
        """
        if inserted_rows is None:
            rows = self.keys().select("valida", "n", F.col("nueva").cast("long").alias("nueva"))
            new = F.coalesce(F.sum("nueva"), F.lit(0))
        else:
            rows = self.flagged.select("valida", F.lit(1).cast("long").alias("n"))
            new = F.lit(inserted_rows).cast("long")
        valid = F.coalesce(F.sum(F.when(F.col("valida"), F.col("n"))), F.lit(0))
        total = F.coalesce(F.sum("n"), F.lit(0))
        return rows.agg(
            total.alias("total_rows"), valid.alias("valid_rows"), (total - valid).alias("invalid_rows"),
            (valid - new).alias("duplicados"), new.alias("insertados"),
        )

    def summary(self) -> DataFrame:
        """PRJ11: the upload summary row; ``invalid`` holds the first messages."""
        errs = self.first_errors().agg(
            F.transform(ordered_errors(), lambda x: x["error"]).alias(
                "invalid"
            )
        )
        both = side_by_side(self.counts(), errs)
        return both.select(
            F.lit(self.filename).alias("filename"),
            "total_rows",
            "valid_rows",
            "invalid_rows",
            "duplicados",
            "insertados",
            "invalid",
        )


def ordered_errors() -> Column:
    """The few messages kept, by line number, those without one last."""
    return F.sort_array(F.collect_list(F.struct(F.col("fila").isNull().alias("last"), "fila", "error")))


def as_inspections(rows: DataFrame) -> DataFrame:
    """Upload rows as rows of the inspection table.

    The id is taken from the line's name (60 bits of its MD5), so it is the
    same on every run and needs no counter over the stored table.
    """
    name = F.concat_ws(":", F.coalesce(FILE, F.lit("")), F.col("fila").cast("string"))
    number = F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long")
    return rows.select(
        number.alias("inspeccion_id"), "conductor", "placa", "contrato", "campo_coordinacion",
        F.col("fecha").cast("timestamp_ntz").alias("fecha"), "resultado",
    )


def write_inserted(rows: DataFrame, path: str) -> None:
    """SNK1: append new rows to the stored inspection table, partitioned by year and month."""
    write_inspections(as_inspections(rows), path, mode="append")
