"""Property tests: ingest and latest-per-key against brute force on random small frames."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from flotilla.operators.ingest import IngestJob
from flotilla.operators.latest import latest_per_key
from flotilla.sources import files

PLATES = ["ABC123", " abc-123", "XYZ999", "AB12", None, "", "xyz-999 "]
DATES = ["2001-01-01", "2001-01-02", "basura", None]
DRIVERS = ["ana", "bob", None]

row = st.tuples(st.sampled_from(DRIVERS), st.sampled_from(PLATES), st.sampled_from(DATES))
SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def brute_force(rows, stored, mode):
    import re

    def norm(p):
        if p is None:
            return None
        if mode == "strict":
            return p
        if mode == "flexible":
            return p.strip().upper().replace("-", "")
        return p.strip().upper()

    def ok(p):
        n = norm(p)
        if n is None:
            return False
        return n != "" if mode == "permissive" else re.search(r"^[A-Z]{3}[0-9]{3}$", n) is not None

    def day(s):
        try:
            return dt.date.fromisoformat(s) if s else None
        except ValueError:
            return None

    seen = set(stored)
    valid = inserted = 0
    for fila, (who, plate, date) in enumerate(rows):
        if ok(plate) and day(date) is not None:
            valid += 1
            key = (who, norm(plate), day(date))
            if key not in seen:
                seen.add(key)
                inserted += 1
    return len(rows), valid, len(rows) - valid, valid - inserted, inserted


@SETTINGS
@given(rows=st.lists(row, min_size=0, max_size=25), mode=st.sampled_from(["strict", "flexible", "permissive"]))
def test_ingest_counts_match_brute_force(spark, rows, mode):
    data = [("a.csv", i, who, plate, "c", "x", date, "F") for i, (who, plate, date) in enumerate(rows)]
    up = spark.createDataFrame(data, files.UPLOAD_SCHEMA)
    stored_rows = [("ana", "ABC123", dt.date(2001, 1, 1))]
    stored = spark.createDataFrame(stored_rows, "conductor string, placa string, fecha date")
    got = tuple(IngestJob(up, stored, mode).counts().first())
    assert got == brute_force(rows, stored_rows, mode)


@SETTINGS
@given(
    rows=st.lists(
        st.tuples(st.integers(0, 3), st.one_of(st.none(), st.integers(0, 5)), st.integers(0, 10**6)),
        min_size=1,
        max_size=30,
        unique_by=lambda r: r[2],
    )
)
def test_latest_per_key_matches_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "k int, ts int, id long")
    got = {r.k: (r.ts, r.id) for r in latest_per_key(df, "k", ["ts", "id"]).collect()}
    want = {}
    for k, ts, i in rows:
        cand = (ts, i)
        cur = want.get(k)
        # null timestamps order first, so any dated row wins over them
        rank = lambda c: (c[0] is not None, c[0] if c[0] is not None else 0, c[1])
        if cur is None or rank(cand) > rank(cur):
            want[k] = cand
    assert got == want


def test_months_without_inspections_count_zero(spark):
    """PRS1: every month is compared with its calendar predecessor."""
    from flotilla.operators import dashboard

    days = ["2000-01-05", "2000-01-20", "2000-04-02", "2001-02-01", None]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "placa int, d string")
    got = dashboard.monthly_comparison(df.select("placa", df.d.cast("timestamp_ntz").alias("fecha")))
    rows = {r.mes: r for r in got.collect()}
    assert len(rows) == 14 and None not in rows
    assert [rows[m].inspecciones for m in ("2000-01", "2000-02", "2000-03", "2000-04", "2001-02")] == [2, 0, 0, 1, 1]
    assert rows["2000-01"].inspecciones_mes_anterior is None
    assert rows["2000-02"].variacion == -2 and rows["2000-02"].variacion_relativa == -1.0
    assert rows["2000-04"].inspecciones_mes_anterior == 0 and rows["2000-04"].variacion_relativa is None
    assert dashboard.monthly_comparison(df.limit(0).select("placa", df.d.cast("timestamp_ntz").alias("fecha"))).count() == 0
