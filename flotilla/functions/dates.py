"""

The pages keep a row when its date is missing, and compare present dates
with bounds that are date-only strings read as midnight. So ``hasta`` is
inclusive only at 00:00 of the end day, and an unparseable row date never
passes a bound. All of it stays in built-in column expressions.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab
from .jsdates import js_timestamp, let


def check_iso_date(value: str) -> str:
    _dt.date.fromisoformat(value)  # raises ValueError on a malformed bound
    return value


def ntz_midnight(day: str) -> Column:
    """A ``timestamp_ntz`` literal at 00:00 of ``day`` (``yyyy-MM-dd``).

    Comparing an NTZ column with an NTZ literal puts no cast on the column,
    so the comparison is pushed to the Parquet scan.
    """
    return F.lit(check_iso_date(day)).cast("timestamp_ntz")


def date_lit(day: str) -> Column:
    return F.lit(check_iso_date(day)).cast("date")


def lower_bound(ts: Column, desde: str | None) -> Column | None:
    """FLT4: keep null dates; otherwise ``ts >= desde`` at midnight."""
    if not desde:
        return None
    return ts.isNull() | (ts >= ntz_midnight(desde))


def upper_bound(ts: Column, hasta: str | None) -> Column | None:
    """FLT5: keep null dates; otherwise ``ts <= hasta`` at midnight (faithful form)."""
    if not hasta:
        return None
    return ts.isNull() | (ts <= ntz_midnight(hasta))


def upper_bound_calendar(ts: Column, hasta: str | None) -> Column | None:
    """Day-inclusive variant of FLT5: everything before the next midnight passes."""
    if not hasta:
        return None
    next_day = F.date_add(date_lit(hasta), 1).cast("timestamp_ntz")
    return ts.isNull() | (ts < next_day)


def parse_timestamp(raw: Column) -> Column:
    """SCA2: the time the pages read from a text, in all forms they take; null where they read none."""
    return js_timestamp(raw)


def raw_bound(raw: Column, bound: str | None, lower: bool) -> Column | None:
    """FLT6: a bound on a date kept as text, exactly as the pages apply it.

    Missing or empty text passes (the page skips the test for falsy values);
    text that does not parse compares false and drops.
    """
    if not bound:
        return None
    limit = F.lit(check_iso_date(bound)).cast("timestamp")

    def kept(text: Column) -> Column:
        parsed = parse_timestamp(text)
        test = parsed >= limit if lower else parsed <= limit
        return F.when(text.isNull() | (text == F.lit("")), F.lit(True)).otherwise(F.coalesce(test, F.lit(False)))

    # A filter is pushed below the column's own expression, which stands wherever ``raw`` does: once.
    return let(raw, kept)


def display_date(ts: Column) -> Column:
    """SCA3: fixed-pattern date text; a missing date reads "Sin datos"."""
    return F.coalesce(F.date_format(ts, vocab.DISPLAY_DATE_FORMAT), F.lit(vocab.SIN_DATOS))


def days_since(ts: Column, as_of: str) -> Column:
    """SCA9: whole days from ``ts`` to the ``as_of`` date, as bigint; null stays null."""
    return F.datediff(date_lit(as_of), ts).cast("bigint")


def month_label(ts: Column) -> Column:
    """D14: ``yyyy-MM`` bucket label."""
    return F.date_format(ts, vocab.MONTH_LABEL_FORMAT)
