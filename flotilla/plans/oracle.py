"""DuckDB SQL equivalent to each registered query, over the same Parquet tables.

The test tables are views named as in TESTDATA.md. Each statement starts
from the shared ``WITH`` bindings below (written independently of the Spark
``row_number()`` windows where the Spark plans use partial aggregates, so
the two sides agree only when the semantics do.
"""

from __future__ import annotations

from ..functions import vocab
from .queries import (
    AS_OF,
    DRIVER_FILTERS,
    EVENT_RANGE,
    FATIGUE_FILTERS,
    FORMS_FROM,
    LATE_RANGE,
    RAW_RANGE,
    REPORT_FILTERS,
    VEHICLE_FILTERS,
)

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _plate(v: str) -> str:
    place = f"({v} * 7919 % 17576000)"

    def letter(n: str) -> str:
        return f"substr('{LETTERS}', CAST({n} % 26 AS INTEGER) + 1, 1)"

    letters = f"({place} // 1000)"
    return (
        f"concat({letter(letters)}, {letter(f'({letters} // 26)')}, {letter(f'({letters} // 676)')}, "
        f"lpad(CAST({place} % 1000 AS VARCHAR), 3, '0'))"
    )


BINDINGS = f"""
conductores AS (
  SELECT p.name AS conductor, p.contrato, n.n_name AS campo_coordinacion
  FROM (SELECT c_name AS name, c_mktsegment AS contrato, c_nationkey AS nk FROM customer
        UNION ALL SELECT s_name, NULL, s_nationkey FROM supplier) p LEFT JOIN nation n ON p.nk = n.n_nationkey),
plated AS (
  SELECT o.o_orderkey, o.o_orderkey // 8 % 17576000 AS v, o.o_orderstatus, o.o_orderdate,
         c.c_name, c.c_mktsegment, n.n_name, {_plate('(o.o_orderkey // 8 % 17576000)')} AS plate
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey),
inspecciones AS (
  SELECT o_orderkey AS inspeccion_id, c_name AS conductor, plate AS placa, c_mktsegment AS contrato,
         n_name AS campo_coordinacion, o_orderdate AS fecha, o_orderstatus AS resultado
  FROM plated),
vehiculos AS (SELECT {_plate('p_partkey')} AS placa FROM part),
evaluaciones AS (
  SELECT e.event_id AS evaluacion_id, c.c_name AS conductor, e.ts AS fecha_evaluacion, e.value AS score_fatiga
  FROM events e JOIN customer c ON e.user_id = c.c_custkey),
latest_insp AS (
  SELECT conductor, inspeccion_id, placa, fecha FROM (
    SELECT *, row_number() OVER (PARTITION BY conductor ORDER BY fecha DESC, inspeccion_id DESC) AS rn
    FROM inspecciones WHERE conductor IS NOT NULL) t WHERE rn = 1),
latest_eval AS (
  SELECT conductor, evaluacion_id, fecha_evaluacion, score_fatiga FROM (
    SELECT *, row_number() OVER (PARTITION BY conductor ORDER BY fecha_evaluacion DESC, evaluacion_id DESC) AS rn
    FROM evaluaciones) t WHERE rn = 1),
driver_days AS (
  SELECT r.conductor, l.placa, r.contrato, r.campo_coordinacion, l.fecha AS ultima_inspeccion,
         date_diff('day', CAST(l.fecha AS DATE), DATE '{AS_OF}') AS dias
  FROM conductores r LEFT JOIN latest_insp l ON r.conductor = l.conductor),
driver_status AS (
  SELECT conductor,
         CASE WHEN dias <= 90 THEN 'verde' WHEN dias <= 365 THEN 'amarillo' ELSE 'rojo' END AS estado,
         placa, contrato, campo_coordinacion, dias AS dias_sin_inspeccion, ultima_inspeccion
  FROM driver_days),
vehicle_latest AS (
  SELECT placa, fecha, resultado, cnt FROM (
    SELECT *, row_number() OVER (PARTITION BY placa ORDER BY fecha DESC, inspeccion_id DESC) AS rn,
           count(*) OVER (PARTITION BY placa) AS cnt
    FROM inspecciones) t WHERE rn = 1),
vehicle_days AS (
  SELECT r.placa, coalesce(l.cnt, 0) AS total_inspecciones, l.fecha AS ultima_inspeccion,
         l.resultado AS ultimo_resultado,
         date_diff('day', CAST(l.fecha AS DATE), DATE '{AS_OF}') AS dias
  FROM vehiculos r LEFT JOIN vehicle_latest l ON r.placa = l.placa),
vehicle_status AS (
  SELECT placa,
         CASE WHEN dias <= 20 THEN 'verde' WHEN dias <= 45 THEN 'amarillo'
              WHEN dias <= 90 THEN 'naranja' ELSE 'rojo' END AS estado,
         total_inspecciones, dias AS dias_sin_inspeccion, ultima_inspeccion, ultimo_resultado
  FROM vehicle_days),
fatigue_status AS (
  SELECT e.conductor, p.placa, e.score_fatiga,
         CASE WHEN e.score_fatiga IS NULL THEN NULL
              WHEN e.score_fatiga >= 150 THEN 'crítica' WHEN e.score_fatiga >= 80 THEN 'leve'
              ELSE 'baja' END AS estado_fatiga,
         e.fecha_evaluacion
  FROM latest_eval e LEFT JOIN latest_insp p ON e.conductor = p.conductor),
raw AS (
  SELECT o_orderkey AS fila, CASE WHEN o_orderkey % 97 <> 0 THEN c_name END AS conductor,
         CASE WHEN o_orderkey % 23 = 0 THEN NULL
              WHEN o_orderkey % 17 = 0 THEN 'AB12'
              WHEN o_orderkey % 10 = 0 THEN concat(' ', lower(substr(plate, 1, 3)), '-', substr(plate, 4, 3))
              ELSE plate END AS placa,
         c_mktsegment AS contrato, n_name AS campo_coordinacion,
         CASE WHEN o_orderkey % 29 = 0 THEN NULL
              WHEN o_orderkey % 31 = 0 THEN 'basura'
              ELSE strftime(o_orderdate, '%Y-%m-%d') END AS fecha,
         o_orderstatus AS resultado
  FROM plated),
upload AS (
  SELECT 'inspecciones-1.csv' AS archivo, * FROM raw
  UNION ALL
  SELECT 'inspecciones-2.csv' AS archivo, * FROM raw WHERE fila % 50 = 1)
"""


def sql(body: str) -> str:
    return f"WITH {BINDINGS.strip()}\n{body.strip()}"


def _with(extra: str, body: str) -> str:
    return f"WITH {BINDINGS.strip()},\n{extra.strip()}\n{body.strip()}"


def _ts(day: str) -> str:
    return f"TIMESTAMP '{day} 00:00:00'"


def _date_preds(col: str, desde: str, hasta: str, calendar: bool = False) -> list[str]:
    preds = []
    if desde:
        preds.append(f"({col} IS NULL OR {col} >= {_ts(desde)})")
    if hasta:
        if calendar:
            preds.append(f"({col} IS NULL OR {col} < {_ts(hasta)} + INTERVAL 1 DAY)")
        else:
            preds.append(f"({col} IS NULL OR {col} <= {_ts(hasta)})")
    return preds


def _where(preds: list[str]) -> str:
    return ("WHERE " + " AND ".join(preds)) if preds else ""


def _drivers_where(f) -> str:
    preds = [f"estado = '{f.estado}'"] if f.estado else []
    return _where(preds + _date_preds("ultima_inspeccion", f.fecha_inicio, f.fecha_fin))


def _fatigue_where(f, calendar: bool = False) -> str:
    preds = []
    if f.estado:
        preds.append(f"estado_fatiga = '{f.estado}'")
    if f.fatiga:
        preds.append(f"estado_fatiga = '{f.fatiga}'")
    return _where(preds + _date_preds("fecha_evaluacion", f.fecha_inicio, f.fecha_fin, calendar))


DRIVER_COLS = "conductor, estado, placa, contrato, campo_coordinacion, dias_sin_inspeccion, ultima_inspeccion"
VEHICLE_COLS = "placa, estado, total_inspecciones, dias_sin_inspeccion, ultima_inspeccion"
FATIGUE_COLS = "conductor, placa, score_fatiga, estado_fatiga, fecha_evaluacion"
INSP_COLS = "inspeccion_id, conductor, placa, contrato, campo_coordinacion, fecha, resultado"


def _totals(source: str, column: str, labels: list[tuple[str, str]], where: str = "") -> str:
    parts = ["count(*) AS total"] + [f"count_if({column} = '{label}') AS {name}" for name, label in labels]
    return sql(f"SELECT {', '.join(parts)} FROM {source} {where}")


DRIVER_LABELS = [("amarillo", "amarillo"), ("rojo", "rojo"), ("verde", "verde")]
VEHICLE_LABELS = [("verde", "verde"), ("amarillo", "amarillo"), ("naranja", "naranja"), ("rojo", "rojo")]
FATIGUE_LABELS = [("critica", "crítica"), ("leve", "leve"), ("baja", "baja")]

DISPLAY = "coalesce(strftime({c}, '%d/%m/%Y'), 'Sin datos')"

DASH_LABEL = (
    "CASE estado_fatiga WHEN 'crítica' THEN 'Fatiga' WHEN 'leve' THEN 'Fatiga leve' "
    "WHEN 'baja' THEN 'Apto' END"
)
FILTER_LABEL = (
    "CASE estado_fatiga WHEN 'crítica' THEN 'grave' WHEN 'leve' THEN 'leve' "
    "WHEN 'baja' THEN 'ninguna' END"
)


def _slice(green: str, yellow: str, red: str) -> str:
    return (
        f"CASE WHEN estado = '{green}' THEN '#22c55e' WHEN estado = '{yellow}' THEN '#facc15' "
        f"WHEN estado = '{red}' THEN '#ef4444' ELSE '#a3a3a3' END AS color"
    )


def _search_where(placa="", conductor="", contrato="", campo="", mes="", ano="") -> str:
    preds = []
    for value, col in ((placa, "placa"), (conductor, "conductor"), (contrato, "contrato"),
                       (campo, "campo_coordinacion")):
        if value:
            preds.append(f"strpos(lower({col}), lower('{value}')) > 0")
    if mes:
        preds.append(f"month(fecha) = {int(mes)}")
    if ano:
        preds.append(f"year(fecha) = {int(ano)}")
    return _where(preds)


MULTI = dict(placa="b", mes="3", ano="2000")
PLATE_RE = "^[A-Z]{3}[0-9]{3}$"


def _norm(mode: str) -> str:
    if mode == "strict":
        return "placa"
    if mode == "flexible":
        return "replace(upper(trim(placa)), '-', '')"
    return "upper(trim(placa))"


def _plate_ok(mode: str) -> str:
    if mode == "permissive":
        return f"coalesce({_norm(mode)} <> '', false)"
    return f"coalesce(regexp_matches({_norm(mode)}, '{PLATE_RE}'), false)"


def _ingest_ctes(mode: str) -> str:
    fdate = "CAST(try_strptime(fecha, '%Y-%m-%d') AS DATE)"
    flag = f"""
      SELECT @FILE@ AS archivo, fila, conductor, {_norm(mode)} AS placa, placa AS placa_original, contrato, campo_coordinacion,
             {fdate} AS fecha, fecha AS fecha_original, resultado,
             {_plate_ok(mode)} AS placa_ok, {fdate} IS NOT NULL AS fecha_ok
      FROM @SRC@"""
    return f"""
flag_upload AS ({flag.replace('@SRC@', 'upload').replace('@FILE@', 'archivo')}),
flagged AS (
  SELECT *, placa_ok AND fecha_ok AS valida,
         CASE WHEN NOT (placa_ok AND fecha_ok) THEN printf('Fila %d: %s', fila, concat_ws('; ',
              CASE WHEN NOT placa_ok THEN printf('placa inválida (%s)', coalesce(placa_original, 'vacía')) END,
              CASE WHEN NOT fecha_ok THEN printf('fecha inválida (%s)', coalesce(fecha_original, 'vacía')) END))
         END AS error
  FROM flag_upload),
flag_raw AS ({flag.replace('@SRC@', 'raw').replace('@FILE@', 'NULL')}),
stored AS (
  SELECT fila AS inspeccion_id, conductor, placa, contrato, campo_coordinacion, CAST(fecha AS TIMESTAMP) AS fecha, resultado
  FROM (SELECT *, row_number() OVER (PARTITION BY conductor, placa, fecha ORDER BY fila) AS rn
        FROM flag_raw WHERE placa_ok AND fecha_ok AND fila % 7 = 0) t
  WHERE rn = 1),
valid AS (
  SELECT archivo, fila, conductor, placa, contrato, campo_coordinacion, fecha, resultado FROM flagged WHERE valida),
firsts AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY conductor, placa, fecha ORDER BY archivo, fila) AS rn FROM valid) t
  WHERE rn = 1),
inserted AS (
  SELECT * FROM firsts f WHERE NOT EXISTS (
    SELECT 1 FROM stored s WHERE s.conductor IS NOT DISTINCT FROM f.conductor AND s.placa = f.placa
      AND CAST(s.fecha AS DATE) = f.fecha)),
duplicated AS (
  SELECT v.* FROM (
    SELECT *, row_number() OVER (PARTITION BY conductor, placa, fecha ORDER BY archivo, fila) AS rn FROM valid) v
  WHERE rn > 1 OR EXISTS (
    SELECT 1 FROM stored s WHERE s.conductor IS NOT DISTINCT FROM v.conductor AND s.placa = v.placa
      AND CAST(s.fecha AS DATE) = v.fecha)),
counts AS (
  SELECT count(*) AS total_rows, count_if(valida) AS valid_rows, count_if(NOT valida) AS invalid_rows,
         count_if(valida) - (SELECT count(*) FROM inserted) AS duplicados,
         (SELECT count(*) FROM inserted) AS insertados
  FROM flagged),
first_errors AS (SELECT fila, error FROM flagged WHERE NOT valida ORDER BY fila, archivo LIMIT 5)
"""


def _ingest(mode: str, body: str) -> str:
    return _with(_ingest_ctes(mode), body)


def _summary(mode: str) -> str:
    return _ingest(
        mode,
        """SELECT 'inspecciones.csv' AS filename, total_rows, valid_rows, invalid_rows, duplicados, insertados,
                  (SELECT coalesce(list(error ORDER BY fila), []) FROM first_errors) AS invalid
           FROM counts""",
    )


def _report(inspecciones: str, drivers: str, vehicles: str, fatigue: str) -> str:
    return sql(
        f"""
SELECT 'Inspecciones realizadas' AS indicador, count(*) AS valor FROM {inspecciones}
UNION ALL SELECT 'Conductores en estado crítico', count_if(estado = 'rojo') FROM {drivers}
UNION ALL SELECT 'Vehículos con fallas', count_if(ultimo_resultado = 'F') FROM {vehicles}
UNION ALL SELECT 'Fatiga detectada', count_if(estado_fatiga = 'crítica') FROM {fatigue}"""
    )


def _raw_bound_preds(f) -> list[str]:
    parsed = "try_cast(fecha AS TIMESTAMP)"
    preds = []
    for bound, op in ((f.fecha_inicio, ">="), (f.fecha_fin, "<=")):
        if bound:
            preds.append(
                f"(CASE WHEN fecha IS NULL OR fecha = '' THEN true "
                f"ELSE coalesce({parsed} {op} {_ts(bound)}, false) END)"
            )
    return preds


MONTH = "strftime(fecha, '%Y-%m')"

# The texts of the ten forms, and the day each one means: known from the order, not read from the text.
DATE_FORMS = """
WITH forms AS (
    SELECT o_orderkey AS id, CASE o_orderkey % 10
        WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN strftime(d, '%m/%d/%Y') WHEN 2 THEN strftime(d, '%d/%m/%Y')
        WHEN 3 THEN concat(strftime(d, '%b '), day(d), strftime(d, ', %Y')) WHEN 4 THEN strftime(d, '%a, %d %b %Y %H:%M:%S GMT')
        WHEN 5 THEN strftime(d, '%Y-%m-%dT%H:%M:%S+02:00') WHEN 6 THEN concat(month(d), '/', day(d), strftime(d, '/%y'))
        WHEN 7 THEN strftime(d, '%Y-02-31') WHEN 8 THEN concat(day(d), strftime(d, ' %b %Y 1:30 PM'))
        ELSE strftime(d, '%Y-%m-%d basura') END AS fecha,
        CASE o_orderkey % 10
        WHEN 2 THEN CASE WHEN day(d) <= 12 THEN make_timestamp(year(d), day(d), month(d), 0, 0, 0) END
        WHEN 5 THEN d - INTERVAL 2 HOUR
        WHEN 7 THEN make_timestamp(year(d), 3, 1, 0, 0, 0)
            + to_days(CAST(31 - day(last_day(make_date(year(d), 2, 1))) - 1 AS INTEGER))
        WHEN 8 THEN d + INTERVAL '13 hours 30 minutes'
        WHEN 9 THEN NULL ELSE d END AS leida
    FROM (SELECT o_orderkey, o_orderdate AS d FROM orders) o
)"""

# Cells by position, from the values and not from the JSON texts.
RAGGED = """
SELECT o_orderkey AS id, CASE o_orderkey % 5
    WHEN 0 THEN [CAST(o_orderkey AS VARCHAR), o_orderstatus, price]
    WHEN 1 THEN [CAST(o_orderkey AS VARCHAR), 'true', 'null', price]
    WHEN 2 THEN [concat(o_orderkey, ',,a,[object Object]'), '[object Object]']
    WHEN 3 THEN [price, CAST(o_custkey AS VARCHAR)]
    ELSE CAST([] AS VARCHAR[]) END AS celdas
FROM (SELECT *, regexp_replace(CAST(o_totalprice AS VARCHAR), '\\.0$', '') AS price FROM orders) o"""


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["inspections"] = sql(f"SELECT {INSP_COLS} FROM inspecciones")
    q["latest_inspection_per_driver"] = sql("SELECT * FROM latest_insp")
    q["latest_fatigue_per_driver"] = sql("SELECT * FROM latest_eval")
    q["driver_status"] = sql(f"SELECT {DRIVER_COLS} FROM driver_status")
    q["vehicle_status"] = sql(f"SELECT {VEHICLE_COLS} FROM vehicle_status")
    q["fatigue_status"] = sql(f"SELECT {FATIGUE_COLS} FROM fatigue_status")

    q["drivers_by_estado"] = sql(f"SELECT {DRIVER_COLS} FROM driver_status WHERE estado = 'amarillo'")
    q["drivers_from_date"] = sql(
        f"SELECT {DRIVER_COLS} FROM driver_status {_where(_date_preds('ultima_inspeccion', '2001-01-01', ''))}"
    )
    q["drivers_filtered"] = sql(f"SELECT {DRIVER_COLS} FROM driver_status {_drivers_where(DRIVER_FILTERS)}")
    q["vehicles_by_estado"] = sql(f"SELECT {VEHICLE_COLS} FROM vehicle_status WHERE estado = 'naranja'")
    q["vehicles_filtered"] = sql(f"SELECT {VEHICLE_COLS} FROM vehicle_status {_drivers_where(VEHICLE_FILTERS)}")
    q["fatigue_by_level"] = sql(f"SELECT {FATIGUE_COLS} FROM fatigue_status WHERE estado_fatiga = 'leve'")
    q["fatigue_conflicting_filters"] = sql(
        f"SELECT {FATIGUE_COLS} FROM fatigue_status WHERE estado_fatiga = 'rojo' AND estado_fatiga = 'leve'"
    )
    q["fatigue_same_filters"] = sql(f"SELECT {FATIGUE_COLS} FROM fatigue_status WHERE estado_fatiga = 'leve'")
    q["fatigue_date_range"] = sql(f"SELECT {FATIGUE_COLS} FROM fatigue_status {_fatigue_where(LATE_RANGE)}")
    q["fatigue_filtered"] = sql(f"SELECT {FATIGUE_COLS} FROM fatigue_status {_fatigue_where(FATIGUE_FILTERS)}")
    ev = EVENT_RANGE
    q["evaluations_date_range"] = sql(
        f"SELECT * FROM evaluaciones {_where(_date_preds('fecha_evaluacion', ev.fecha_inicio, ev.fecha_fin))}"
    )
    q["evaluations_calendar_range"] = sql(
        f"SELECT * FROM evaluaciones "
        f"{_where(_date_preds('fecha_evaluacion', ev.fecha_inicio, ev.fecha_fin, calendar=True))}"
    )
    q["raw_date_range"] = sql(f"SELECT * FROM raw {_where(_raw_bound_preds(RAW_RANGE))}")

    q["date_forms"] = f"{DATE_FORMS} SELECT id, fecha, leida FROM forms"
    q["date_forms_desde"] = f"{DATE_FORMS} SELECT id, fecha FROM forms WHERE leida >= TIMESTAMP '{FORMS_FROM.fecha_inicio}'"
    q["search_ragged"] = RAGGED
    q["search_ragged_headers"] = """
WITH first AS (SELECT o_orderkey % 5 AS m FROM orders ORDER BY o_orderkey LIMIT 1)
SELECT CAST(generate_subscripts(keys, 1) - 1 AS INTEGER) AS posicion, unnest(keys) AS encabezado
FROM (SELECT CASE m WHEN 0 THEN ['inspeccion_id', 'resultado', 'valor'] WHEN 1 THEN ['2', '10', 'resultado', 'valor']
    WHEN 2 THEN ['lista', 'objeto'] WHEN 3 THEN ['valor', 'conductor'] ELSE [] END AS keys FROM first) k"""

    q["drivers_totals"] = _totals("driver_status", "estado", DRIVER_LABELS)
    q["drivers_totals_filtered"] = _totals("driver_status", "estado", DRIVER_LABELS, _drivers_where(DRIVER_FILTERS))
    q["vehicles_totals"] = _totals("vehicle_status", "estado", VEHICLE_LABELS)
    q["vehicles_totals_filtered"] = _totals(
        "vehicle_status", "estado", VEHICLE_LABELS, _drivers_where(VEHICLE_FILTERS)
    )
    q["fatigue_totals"] = _totals("fatigue_status", "estado_fatiga", FATIGUE_LABELS)
    q["fatigue_totals_filtered"] = _totals(
        "fatigue_status", "estado_fatiga", FATIGUE_LABELS, _fatigue_where(FATIGUE_FILTERS)
    )

    q["drivers_table"] = sql(
        f"""SELECT conductor, upper(estado) AS estado, placa, contrato, campo_coordinacion, dias_sin_inspeccion,
                   {DISPLAY.format(c='ultima_inspeccion')} AS ultima_inspeccion FROM driver_status"""
    )
    q["driver_color"] = sql(
        """SELECT conductor, estado, CASE WHEN estado = 'rojo' THEN 'red' WHEN estado = 'amarillo' THEN 'yellow'
                  ELSE 'green' END AS color FROM driver_status"""
    )
    q["vehicles_table"] = sql(
        f"""SELECT placa, upper(estado) AS estado, total_inspecciones, dias_sin_inspeccion,
                   {DISPLAY.format(c='ultima_inspeccion')} AS ultima_inspeccion FROM vehicle_status"""
    )
    q["vehicle_color"] = sql(
        """SELECT placa, estado, CASE WHEN estado = 'verde' THEN 'green' WHEN estado = 'amarillo' THEN 'yellow'
                  WHEN estado = 'naranja' THEN 'orange' ELSE 'red' END AS color FROM vehicle_status"""
    )
    q["fatigue_table"] = sql(
        f"""SELECT conductor, placa, score_fatiga, estado_fatiga,
                   {DISPLAY.format(c='fecha_evaluacion')} AS fecha_evaluacion FROM fatigue_status"""
    )
    q["fatigue_level_map"] = sql(
        f"""SELECT conductor, estado_fatiga, {FILTER_LABEL} AS fatiga_filtro, {DASH_LABEL} AS fatiga_dashboard
            FROM fatigue_status"""
    )
    q["evaluation_level_counts"] = sql(
        """SELECT CASE WHEN score_fatiga IS NULL THEN NULL WHEN score_fatiga >= 150 THEN 'crítica'
                       WHEN score_fatiga >= 80 THEN 'leve' ELSE 'baja' END AS estado_fatiga, count(*) AS value
           FROM evaluaciones GROUP BY 1"""
    )

    metrics = """
SELECT (SELECT count(*) FROM inspecciones) AS total_inspecciones,
       (SELECT count(DISTINCT conductor) FROM inspecciones) AS total_conductores,
       (SELECT count(DISTINCT placa) FROM inspecciones) AS total_vehiculos,
       (SELECT count_if(estado_fatiga = 'crítica') FROM fatigue_status) AS fatiga_detectada,
       (SELECT count_if(dias_sin_inspeccion IS NULL OR dias_sin_inspeccion > 90) FROM vehicle_status)
         AS inspecciones_vencidas"""
    q["dashboard_metrics"] = sql(metrics)
    q["dashboard_metrics_text"] = _with(
        f"m AS ({metrics})",
        "SELECT " + ", ".join(
            f"coalesce(CAST({c} AS VARCHAR), '--') AS {c}"
            for c in ("total_inspecciones", "total_conductores", "total_vehiculos", "fatiga_detectada",
                      "inspecciones_vencidas")
        ) + " FROM m",
    )
    q["monthly_series"] = sql(
        f"SELECT {MONTH} AS mes, count(*) AS inspecciones, count(DISTINCT placa) AS vehiculos "
        f"FROM inspecciones GROUP BY 1"
    )
    q["monthly_inspections"] = sql(f"SELECT {MONTH} AS mes, count(*) AS inspecciones FROM inspecciones GROUP BY 1")
    q["monthly_vehicles"] = sql(
        f"SELECT {MONTH} AS mes, count(DISTINCT placa) AS vehiculos FROM inspecciones GROUP BY 1"
    )
    compliance = "SELECT estado, count(*) AS value FROM driver_status GROUP BY estado"
    fatigue_dist = f"SELECT {DASH_LABEL} AS estado, count(*) AS value FROM fatigue_status GROUP BY 1"
    q["driver_compliance"] = sql(compliance)
    q["fatigue_distribution"] = sql(fatigue_dist)
    share = "SELECT estado, value, CAST(value AS DOUBLE) / CAST(sum(value) OVER () AS DOUBLE) AS share FROM d"
    q["driver_compliance_share"] = _with(f"d AS ({compliance})", share)
    q["fatigue_distribution_share"] = _with(f"d AS ({fatigue_dist})", share)
    q["compliance_color"] = _with(
        f"d AS ({compliance})", f"SELECT estado, value, {_slice('verde', 'amarillo', 'rojo')} FROM d"
    )
    q["fatigue_color"] = _with(
        f"d AS ({fatigue_dist})", f"SELECT estado, value, {_slice('Apto', 'Fatiga leve', 'Fatiga')} FROM d"
    )
    q["overdue_inspections"] = sql(
        f"SELECT {VEHICLE_COLS} FROM vehicle_status WHERE dias_sin_inspeccion IS NULL OR dias_sin_inspeccion > 90"
    )

    for name, params in {
        "search_placa": dict(placa="b"),
        "search_conductor": dict(conductor="customer#00000012"),
        "search_contrato": dict(contrato="BUILDING"),
        "search_campo": dict(campo="1"),
        "search_contrato_campo": dict(contrato="BUILDING", campo="1"),
        "search_mes_ano": dict(mes="3", ano="2000"),
        "search_multi": MULTI,
        "search_no_params": {},
    }.items():
        q[name] = sql(f"SELECT {INSP_COLS} FROM inspecciones {_search_where(**params)}")
    q["search_indexed_placa"] = sql(f"SELECT {INSP_COLS} FROM inspecciones WHERE contains(lower(placa), 'b12')")
    q["search_indexed_conductor"] = q["search_conductor"]
    q["search_indexed_multi"] = q["search_multi"]
    q["search_count"] = sql(f"SELECT count(*) AS resultados FROM inspecciones {_search_where(**MULTI)}")
    q["search_as_text"] = sql(
        f"""SELECT CAST(inspeccion_id AS VARCHAR) AS inspeccion_id, coalesce(conductor, 'null') AS conductor,
                   coalesce(placa, 'null') AS placa, coalesce(contrato, 'null') AS contrato,
                   coalesce(campo_coordinacion, 'null') AS campo_coordinacion,
                   coalesce(CAST(fecha AS VARCHAR), 'null') AS fecha, coalesce(resultado, 'null') AS resultado
            FROM inspecciones {_search_where(**MULTI)}"""
    )

    # DuckDB prints these numbers plainly; a whole one without its ".0" is JavaScript's text.
    q["numbers_as_text"] = """
SELECT CAST(id AS VARCHAR) AS id, coalesce(regexp_replace(CAST(number AS VARCHAR), '\\.0$', ''), 'null') AS number
FROM (SELECT event_id AS id, value AS number FROM events UNION ALL SELECT o_orderkey, o_totalprice FROM orders) t"""

    for mode in vocab.PLATE_MODES:
        q[f"ingest_summary_{mode}"] = _summary(mode)
        q[f"ingest_counts_{mode}"] = _ingest(
            mode, "SELECT total_rows, valid_rows, invalid_rows, duplicados, insertados FROM counts"
        )
        q[f"plate_check_{mode}"] = _ingest(
            mode, "SELECT fila, placa_original, placa AS placa_normalizada, valida FROM flagged"
        )
    row_cols = "fila, conductor, placa, contrato, campo_coordinacion, fecha, resultado"
    q["ingest_valid"] = _ingest("flexible", "SELECT * FROM valid")
    q["ingest_two_files_duplicates"] = _ingest("flexible", "SELECT archivo, fila, conductor, placa, fecha FROM duplicated")
    q["ingest_null_driver"] = _ingest(
        "flexible",
        """SELECT count(*) AS total_rows, count_if(valida) AS valid_rows, count_if(NOT valida) AS invalid_rows,
                  count_if(valida) AS duplicados, CAST(0 AS BIGINT) AS insertados
           FROM flagged WHERE conductor IS NULL""",
    )
    q["ingest_invalid"] = _ingest(
        "flexible", "SELECT fila, placa_original AS placa, fecha_original AS fecha, error FROM flagged WHERE NOT valida"
    )
    q["ingest_first_errors"] = _ingest("flexible", "SELECT * FROM first_errors")
    q["ingest_inserted"] = _ingest("flexible", f"SELECT archivo, {row_cols} FROM inserted")
    q["ingest_duplicates"] = _ingest("flexible", f"SELECT {row_cols} FROM duplicated")

    q["report_metrics"] = _report("inspecciones", "driver_status", "vehicle_status", "fatigue_status")
    q["report_text"] = sql(
        """SELECT printf('%s: %d', indicador, valor) AS linea FROM (
             SELECT 'Inspecciones realizadas' AS indicador, count(*) AS valor FROM inspecciones
             UNION ALL SELECT 'Conductores en estado crítico', count_if(estado = 'rojo') FROM driver_status
             UNION ALL SELECT 'Vehículos con fallas', count_if(ultimo_resultado = 'F') FROM vehicle_status
             UNION ALL SELECT 'Fatiga detectada', count_if(estado_fatiga = 'crítica') FROM fatigue_status) r"""
    )
    q["vehicles_with_failures"] = sql(
        f"SELECT {VEHICLE_COLS}, ultimo_resultado FROM vehicle_status WHERE ultimo_resultado = 'F'"
    )
    rf = REPORT_FILTERS
    q["report_metrics_filtered"] = _report(
        f"(SELECT * FROM inspecciones {_where(_date_preds('fecha', rf.fecha_inicio, rf.fecha_fin))})",
        f"(SELECT * FROM driver_status {_drivers_where(rf)})",
        f"(SELECT * FROM vehicle_status {_drivers_where(rf)})",
        f"(SELECT * FROM fatigue_status {_fatigue_where(rf)})",
    )
    q["clustered_table"] = q["inspections"]
    q["maintained_driver_status"] = q["driver_status"]
    q["maintained_vehicle_status"] = q["vehicle_status"]
    q["maintained_monthly_series"] = q["monthly_series"]
    q["maintained_range_totals"] = sql(
        f"""SELECT count(*) AS total_inspecciones, count(DISTINCT conductor) AS total_conductores,
                   count(DISTINCT placa) AS total_vehiculos
            FROM inspecciones {_where(_date_preds('fecha', RAW_RANGE.fecha_inicio, RAW_RANGE.fecha_fin))}"""
    )
    measured = """count(*) AS inspecciones, count(*) FILTER (resultado = 'F') AS fallas, count(DISTINCT placa) AS vehiculos,
        min(fecha) AS primera, max(fecha) AS ultima"""
    q["custom_metrics"] = sql(
        f"""SELECT year(fecha) AS anio, resultado, contrato, campo_coordinacion,
                CAST(GROUPING_ID(year(fecha), resultado, contrato, campo_coordinacion) AS INTEGER) AS nivel, {measured}
            FROM inspecciones GROUP BY CUBE (year(fecha), resultado, contrato, campo_coordinacion)"""
    )
    level = f"""FROM inspecciones {_where(_date_preds('fecha', RAW_RANGE.fecha_inicio, RAW_RANGE.fecha_fin))}"""
    q["custom_metrics_filtered"] = sql(
        f"""SELECT NULL AS anio, resultado, NULL AS contrato, campo_coordinacion, 10 AS nivel, {measured} {level}
              GROUP BY resultado, campo_coordinacion
            UNION ALL SELECT NULL, NULL, NULL, campo_coordinacion, 14, {measured} {level} GROUP BY campo_coordinacion
            UNION ALL SELECT NULL, NULL, NULL, NULL, 15, {measured} {level}"""
    )
    q["monthly_comparison"] = _with(
        f"""s AS (SELECT {MONTH} AS mes, count(*) AS inspecciones, count(DISTINCT placa) AS vehiculos
                  FROM inspecciones WHERE fecha IS NOT NULL GROUP BY 1),
            spine AS (SELECT unnest(generate_series(
                (SELECT date_trunc('month', min(fecha)) FROM inspecciones), (SELECT max(fecha) FROM inspecciones),
                INTERVAL 1 MONTH)) AS day),
            full_ AS (SELECT day, strftime(day, '%Y-%m') AS mes, coalesce(inspecciones, 0) AS inspecciones,
                coalesce(vehiculos, 0) AS vehiculos FROM spine LEFT JOIN s ON s.mes = strftime(day, '%Y-%m')),
            l AS (SELECT a.*, b.inspecciones AS prev FROM full_ a LEFT JOIN full_ b ON b.day = a.day - INTERVAL 1 MONTH)""",
        """SELECT mes, inspecciones, vehiculos, prev AS inspecciones_mes_anterior, inspecciones - prev AS variacion,
                  CASE WHEN prev > 0 THEN CAST(inspecciones - prev AS DOUBLE) / CAST(prev AS DOUBLE) END
                    AS variacion_relativa
           FROM l""",
    )
    from ..streaming.registered import stream_oracle_sql

    q.update(stream_oracle_sql(_ingest_ctes, _with))
    return q
