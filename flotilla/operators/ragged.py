"""The search table over rows of unlike keys (PRJ6).

The page takes the headers from the keys of the first row and fills every row
from that row's own values by position, whatever the keys are. Rows arrive as
JSON texts; each is read into a map of variants, so no schema is looked for
over the data and a key that only one row has costs nothing elsewhere.

Keys come in the order in which JavaScript lists an object's: whole numbers
first, by value, then the others as written. A key written twice has its last
value at its first place. Cells are what ``String(v)`` gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import js_number

ROW_TYPE = "map<string,variant>"
# Keys that JavaScript lists first: array indices.
INDEX_KEY = r"^(0|[1-9][0-9]{0,9})$"
MOST_INDEX = 2**32 - 2
# Arrays inside arrays that a cell is written out for; one nested deeper shows as its JSON text.
DEPTH = 4


def _is(kind: Column, *names: str) -> Column:
    return kind.rlike(f"^({'|'.join(names)})")


def js_text(value: Column, depth: int = DEPTH) -> Column:
    """``String(v)`` of a variant: numbers as JavaScript writes them, arrays joined by commas, objects by their class."""
    kind = F.schema_of_variant(value)
    plain = value.try_cast("string")
    number = js_number(F.try_variant_get(value, "$", "double"))
    if depth:
        items = F.try_variant_get(value, "$", "array<variant>")
        # A null inside an array is empty text.
        shown = F.transform(items, lambda x: F.when(F.is_variant_null(x), F.lit("")).otherwise(js_text(x, depth - 1)))
        array = F.array_join(shown, ",")
    else:
        array = F.to_json(value)
    return (
        F.when(value.isNull() | F.is_variant_null(value), F.lit("null"))
        .when(_is(kind, "OBJECT"), F.lit("[object Object]"))
        .when(_is(kind, "ARRAY"), array)
        .when(_is(kind, "BIGINT", "DOUBLE", "DECIMAL", "FLOAT"), number)
        .otherwise(plain)
    )


def ordered_keys(row: Column) -> Column:
    """Distinct keys of a row's map in JavaScript's order."""
    keys = F.array_distinct(F.map_keys(row))
    index = lambda k: F.coalesce(F.when(k.rlike(INDEX_KEY), k.try_cast("bigint")) <= F.lit(MOST_INDEX), F.lit(False))
    numbers = F.transform(F.filter(keys, index), lambda k: k.cast("bigint"))
    return F.concat(F.transform(F.array_sort(numbers), lambda k: k.cast("string")), F.filter(keys, lambda k: ~index(k)))


def ragged_rows(rows: DataFrame, json: str, order: str) -> DataFrame:
    """(order, encabezados, celdas): keys and cells of every row of ``rows``, in the row's own order.

    A text that is no JSON object has no keys and no cells, as has a null.
    """
    read = rows.select(F.col(order), F.from_json(F.col(json), ROW_TYPE).alias("row"))
    keyed = read.select(order, F.map_entries("row").alias("entries"), F.coalesce(ordered_keys(F.col("row")), F.array().cast("array<string>")).alias("encabezados"))
    last = lambda k: F.element_at(F.filter("entries", lambda e: e["key"] == k), -1)["value"]
    return keyed.select(order, "encabezados", F.transform("encabezados", lambda k: js_text(last(k))).alias("celdas"))


def ragged_cells(rows: DataFrame, json: str, order: str) -> DataFrame:
    """(order, celdas): the table's body."""
    return ragged_rows(rows, json, order).select(order, "celdas")


def ragged_headers(rows: DataFrame, json: str, order: str) -> DataFrame:
    """(posicion, encabezado): the table's head, the keys of the first row by ``order``; one partial aggregate."""
    # Only the texts' order is aggregated; the first row alone is read as JSON.
    first = rows.agg(F.min_by(json, order).alias(json), F.min(order).alias(order))
    return ragged_rows(first, json, order).select(F.posexplode("encabezados").alias("posicion", "encabezado"))
