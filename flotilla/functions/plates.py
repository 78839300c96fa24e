"""Plate normalising and checking (SCA13, FLT16, decision D8)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab


def normalise_plate(raw: Column, mode: str) -> Column:
    """The plate value a row is stored under in ``mode``.

    strict: as given; flexible: trimmed, upper-cased, ``-`` removed;
    permissive: trimmed and upper-cased.
    """
    if mode == "strict":
        return raw
    if mode == "flexible":
        return F.regexp_replace(F.upper(F.trim(raw)), "-", "")
    if mode == "permissive":
        return F.upper(F.trim(raw))
    raise ValueError(f"unknown plate mode {mode!r}; expected one of {vocab.PLATE_MODES}")


def plate_is_valid(raw: Column, mode: str) -> Column:
    """Never null: a null plate is invalid in every mode.

    Written as ``isNotNull & test`` rather than ``coalesce(test, false)`` so
    the predicate stays visible to the optimizer (it counts as selective for
    dynamic partition pruning).
    """
    norm = normalise_plate(raw, mode)
    if mode == "permissive":
        ok = norm != F.lit("")
    else:
        ok = norm.rlike(vocab.PLATE_PATTERN)
    return norm.isNotNull() & ok
