
import pytest
from pyspark.sql import functions as F

from flotilla.functions import dates
from flotilla.operators.filters import Filters, filter_dates, filter_raw_dates

from .date_form_cases import CASES

VALUES = [None, "", "2024-01-10", "2024-01-10T05:00:00", "basura", "10/01/2024"]
DAY = "2024-01-10"

# value -> (kept with no bound, with desde, with hasta); 10/01/2024 is 1 October, as the pages read it.
EXPECTED = {
    None: (True, True, True),
    "": (True, True, True),
    "2024-01-10": (True, True, True),
    "2024-01-10T05:00:00": (True, True, False),
    "basura": (True, False, False),
    "10/01/2024": (True, True, False),
}


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame([(i, v) for i, v in enumerate(VALUES)], "id int, fecha string")


def _kept(df):
    return {VALUES[r.id] for r in df.select("id").collect()}


@pytest.mark.parametrize(
    "flt,idx",
    [(Filters(), 0), (Filters(fecha_inicio=DAY), 1), (Filters(fecha_fin=DAY), 2)],
)
def test_raw_bounds(raw, flt, idx):
    want = {v for v, exp in EXPECTED.items() if exp[idx]}
    assert _kept(filter_raw_dates(raw, "fecha", flt)) == want


def test_forms_are_read_as_recorded(spark):
    df = spark.createDataFrame(CASES, "s string, ms long")
    rows = df.select("s", "ms", F.unix_millis(dates.parse_timestamp(F.col("s"))).alias("got")).collect()
    assert [(r.s, r.got) for r in rows] == [(r.s, r.ms) for r in rows]


def test_days_of_all_months_and_leap_years(spark):
    from flotilla.functions.jsdates import days_from_civil

    df = spark.sql("select explode(sequence(date'0001-01-01', date'9999-12-31', interval 17 days)) as d")
    got = df.select(days_from_civil(F.year("d").cast("long"), F.month("d").cast("long"), F.day("d").cast("long")).alias("n"), F.unix_date("d").alias("w"))
    assert got.where("n <> w").count() == 0


def test_awkward_texts_are_no_dates(spark):
    odd = [None, "", " ", "x" * 100_000, "1" * 5_000, "9/9/9" * 2_000, "2024-01-10" + " " * 50_000, "(" * 5_000, "\x00", "日本", "Jan" * 4_000, "$1 \\1"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(odd)], "i int, s string")
    got = {r.i: r.t for r in df.select("i", dates.parse_timestamp(F.col("s")).alias("t")).collect()}
    assert [i for i, t in got.items() if t is not None] == [6]


def test_every_part_is_computed_once(spark):
    """Nested expressions that name a part twice multiply: the reader's stays small, and a bound names its text once."""
    assert len(str(dates.parse_timestamp(F.col("s")))) < 40_000
    df = spark.range(3).select(F.concat_ws("-", F.lit("2024-01"), F.lpad(F.hex("id"), 2, "0")).alias("fecha"))
    plan = filter_raw_dates(df, "fecha", Filters(fecha_inicio=DAY))._jdf.queryExecution().optimizedPlan()
    condition = [line for line in plan.toString().splitlines() if "Filter" in line]
    assert len(condition) == 1 and condition[0].count("lpad(") == 1


def test_raw_both_bounds(raw):
    want = {v for v, exp in EXPECTED.items() if exp[1] and exp[2]}
    assert _kept(filter_raw_dates(raw, "fecha", Filters(fecha_inicio=DAY, fecha_fin=DAY))) == want


def test_typed_bounds_null_passes_and_midnight(spark):
    df = spark.createDataFrame(
        [(1, None), (2, "2024-01-10 00:00:00"), (3, "2024-01-10 05:00:00"), (4, "2024-01-09 23:59:59")],
        "id int, s string",
    ).select("id", F.col("s").cast("timestamp_ntz").alias("ts"))
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(filter_dates(df, "ts", Filters(fecha_fin=DAY))) == [1, 2, 4]
    assert ids(filter_dates(df, "ts", Filters(fecha_fin=DAY), calendar_days=True)) == [1, 2, 3, 4]
    assert ids(filter_dates(df, "ts", Filters(fecha_inicio=DAY))) == [1, 2, 3]


def test_bad_bound_rejected():
    with pytest.raises(ValueError):
        Filters(fecha_inicio="10/01/2024")


def test_display_date_and_days(spark):
    df = spark.createDataFrame([("2001-07-02 10:00:00",), (None,)], "s string").select(
        F.col("s").cast("timestamp_ntz").alias("ts")
    )
    rows = df.select(
        dates.display_date(F.col("ts")).alias("d"), dates.days_since(F.col("ts"), "2001-08-02").alias("n")
    ).collect()
    assert [(r.d, r.n) for r in rows] == [("02/07/2001", 31), ("Sin datos", None)]
