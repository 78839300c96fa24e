"""Status defaults, colours, fatigue levels and text conversions (SCA4-SCA8, SCA10-SCA12)."""

from pyspark.sql import functions as F

from flotilla.functions import status, text


def _one(spark, values, fn, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r.o for r in df.orderBy("i").select(fn(F.col("v")).alias("o")).collect()]


STATES = ["verde", "amarillo", "naranja", "rojo", "otro", None]


def test_driver_color_defaults_green(spark):
    assert _one(spark, STATES, status.driver_color) == ["green", "yellow", "green", "red", "green", "green"]


def test_vehicle_color_defaults_red(spark):
    assert _one(spark, STATES, status.vehicle_color) == ["green", "yellow", "orange", "red", "red", "red"]


def test_slice_colors_default_grey(spark):
    got = _one(spark, STATES, status.compliance_slice_color)
    assert got == ["#22c55e", "#facc15", "#a3a3a3", "#ef4444", "#a3a3a3", "#a3a3a3"]
    got = _one(spark, ["Apto", "Fatiga leve", "Fatiga", "leve", None], status.fatigue_slice_color)
    assert got == ["#22c55e", "#facc15", "#ef4444", "#a3a3a3", "#a3a3a3"]


def test_status_bands(spark):
    days = [0, 90, 91, 365, 366, None]
    got = _one(spark, days, status.driver_status_label, "bigint")
    assert got == ["verde", "verde", "amarillo", "amarillo", "rojo", "rojo"]
    days = [20, 21, 45, 46, 90, 91, None]
    got = _one(spark, days, status.vehicle_status_label, "bigint")
    assert got == ["verde", "amarillo", "amarillo", "naranja", "naranja", "rojo", "rojo"]


def test_fatigue_levels_and_vocabularies(spark):
    scores = [0.0, 79.99, 80.0, 149.99, 150.0, None]
    assert _one(spark, scores, status.fatigue_level, "double") == ["baja", "baja", "leve", "leve", "crítica", None]
    levels = ["crítica", "leve", "baja"]
    assert _one(spark, levels, status.fatigue_filter_label) == ["grave", "leve", "ninguna"]
    assert _one(spark, levels, status.fatigue_dashboard_label) == ["Fatiga", "Fatiga leve", "Apto"]


def test_coalesce_dash(spark):
    assert _one(spark, [None, 0], text.coalesce_dash, "bigint") == ["--", "0"]


def test_js_string_cells(spark):
    df = spark.createDataFrame(
        [(None, None, None, None), ("x", True, 1.0, [1, None]), ("y", False, 1.5, [])],
        "s string, b boolean, d double, a array<int>",
    )
    rows = text.as_js_text(df).collect()
    assert [tuple(r) for r in rows] == [
        ("null", "null", "null", "null"),
        ("x", "true", "1", "1,"),
        ("y", "false", "1.5", ""),
    ]


NUMBERS = {
    12345678.5: "12345678.5", 123456789.25: "123456789.25", 0.0001: "0.0001", 1e20: "100000000000000000000",
    1e21: "1e+21", 1.5e22: "1.5e+22", 1e-6: "0.000001", 1.5e-6: "0.0000015", 1e-7: "1e-7", 1.25e-7: "1.25e-7",
    -2.5e-10: "-2.5e-10", -1234.0: "-1234", 0.0: "0", -0.0: "0", 100.0: "100", 0.1: "0.1", 12e6: "12000000",
    float("nan"): "NaN", float("inf"): "Infinity", float("-inf"): "-Infinity", 1e100: "1e+100", 123.0e18: "123000000000000000000",
}


def test_js_numbers(spark):
    assert _one(spark, list(NUMBERS), text.js_number, "double") == list(NUMBERS.values())
    assert _one(spark, [None], text.js_number, "double") == [None]
