"""Text conversions of cells: JS-style ``String(v)`` and ``v ?? '--'``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vocab

def coalesce_dash(c: Column) -> Column:
    """SCA4: only null becomes ``--``; 0 stays ``0``."""
    return F.coalesce(c.cast("string"), F.lit(vocab.NO_VALUE))


def js_number(c: Column) -> Column:
    """The text JavaScript gives a number: plain digits where 1e-6 <= |x| < 1e21, else ``d.ddde±n``.

    Spark writes the same shortest digits, from 1e-3 to 1e7 in the same layout
    but for a whole number's ``.0``, else as ``1.2345E7``. That form is taken
    apart once, for the rows that have it.
    """
    raw = F.abs(c).cast("string")

    def moved(p: Column) -> Column:
        # The value is d.ddd * 10 ** power, the digits without their point.
        digits, power = p["digits"], p["power"]
        size = F.length(digits)
        first, rest = F.substr(digits, F.lit(1), F.lit(1)), F.substr(digits, F.lit(2))
        exponent = F.concat(
            first, F.when(size > 1, F.concat(F.lit("."), rest)).otherwise(F.lit("")),
            F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")), F.abs(power).cast("string"),
        )
        return (
            F.when((power >= 21) | (power < -6), exponent)
            .when(power < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits))
            .when(size <= power + 1, F.rpad(digits, power + 1, F.lit("0")))
            .otherwise(F.concat(F.substr(digits, F.lit(1), power + 1), F.lit("."), F.substr(digits, power + 2)))
        )

    mantissa = F.substring_index(raw, "E", 1)
    parts = F.struct(
        F.rtrim(F.replace(mantissa, F.lit("."), F.lit("")), F.lit("0")).alias("digits"),
        F.substring_index(raw, "E", -1).try_cast("int").alias("power"),
    )
    text = F.when(raw.contains("E"), F.element_at(F.transform(F.array(parts), moved), 1)).otherwise(F.regexp_replace(raw, r"\.0$", ""))
    finite = F.concat(F.when(c < 0, F.lit("-")).otherwise(F.lit("")), text)
    infinite = F.when(c > 0, F.lit("Infinity")).otherwise(F.lit("-Infinity"))
    return (
        F.when(F.isnan(c), F.lit("NaN")).when(c == 0, F.lit("0"))
        .when(F.abs(c) == F.lit(float("inf")), infinite).when(c.isNotNull(), finite)
    )


def js_string(c: Column, dtype: T.DataType) -> Column:
    """SCA5: the text ``String(v)`` gives for a cell of Spark type ``dtype``.

    null → ``null``; booleans → ``true``/``false``; doubles as ``js_number``; arrays join their elements with ``,`` and print null
    elements as empty text.
    """
    if isinstance(dtype, T.BooleanType):
        text = F.when(c, F.lit("true")).when(~c, F.lit("false"))
    elif isinstance(dtype, (T.DoubleType, T.FloatType)):
        text = js_number(c.cast("double"))
    elif isinstance(dtype, T.ArrayType):
        elem = dtype.elementType
        # String([1, null]) prints a null element as empty text, not "null".
        text = F.array_join(
            F.transform(c, lambda x: F.when(x.isNull(), F.lit("")).otherwise(js_string(x, elem))),
            ",",
        )
    elif isinstance(dtype, T.StringType):
        text = c
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit("null"))


def as_js_text(df: DataFrame) -> DataFrame:
    """PRJ6: every column, in order, rendered as text."""
    return df.select(*[js_string(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])
