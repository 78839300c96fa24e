"""

Parameters of the filtered and search variants are fixed here so that every
query has one answer to check against its oracle SQL (``plans/oracle.py``).
Every query reads whole tables; the filters below are the feature under test.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, text, vocab
from ..operators import dashboard, fleet, metrics, pages, ragged, report, search
from ..operators.filters import (
    Filters,
    drivers_totals,
    fatigue_totals,
    filter_dates,
    filter_drivers,
    filter_fatigue,
    filter_raw_dates,
    filter_vehicles,
    vehicles_totals,
)
from ..operators.ingest import LINE, IngestJob, same
from ..session import ensure_utc
from ..sources import tables
from .catalog import Fleet

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

# Fixed parameters of the registered variants.
# D3: the day the statuses are of, the day after the last order.
AS_OF = "2001-08-02"
# The driver page ignores ``fatiga`` (FLT8); it is set to show that.
DRIVER_FILTERS = Filters(estado=vocab.ROJO, fatiga=vocab.LEVE, fecha_inicio="2000-01-01", fecha_fin="2000-06-30")
VEHICLE_FILTERS = Filters(estado=vocab.AMARILLO, fecha_inicio="2001-06-25", fecha_fin="2001-07-05")
FATIGUE_FILTERS = Filters(fatiga=vocab.LEVE, fecha_inicio="2024-01-30", fecha_fin="2024-01-31")
EVENT_RANGE = Filters(fecha_inicio="2024-01-05", fecha_fin="2024-01-10")
LATE_RANGE = Filters(fecha_inicio="2024-01-30", fecha_fin="2024-01-31")
RAW_RANGE = Filters(fecha_inicio="2000-01-01", fecha_fin="2000-06-30")
FORMS_FROM = Filters(fecha_inicio="1998-06-01")
REPORT_FILTERS = Filters(fecha_inicio="2001-07-10", fecha_fin="2024-01-30")
SEARCH_MULTI = search.SearchParams(placa="b", mes="3", ano="2000")


def register(name: str) -> Callable[[Callable[[Fleet], DataFrame]], Callable[[Fleet], DataFrame]]:
    def wrap(fn: Callable[[Fleet], DataFrame]) -> Callable[[Fleet], DataFrame]:
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_utc(spark)
            return fn(Fleet(spark, sf_dir, AS_OF))

        query.__name__ = name
        query.__doc__ = fn.__doc__
        REGISTRY[name] = query
        return fn

    return wrap


# --- step 0/1: inspections, latest rows, status tables -------------------------------------


@register("inspections")
def _inspections(f: Fleet) -> DataFrame:
    """The inspection table bound to the test tables."""
    return f.inspecciones()


@register("latest_inspection_per_driver")
def _latest_insp(f: Fleet) -> DataFrame:
    return f.latest_named()


@register("latest_fatigue_per_driver")
def _latest_eval(f: Fleet) -> DataFrame:
    return f.latest_evaluations_named()


@register("driver_status")
def _driver_status(f: Fleet) -> DataFrame:
    return f.drivers()


@register("vehicle_status")
def _vehicle_status(f: Fleet) -> DataFrame:
    return f.vehicles()


@register("fatigue_status")
def _fatigue_status(f: Fleet) -> DataFrame:
    return f.fatigue()


# --- step 2: filters, totals, tables ---------------------------------------------------------


@register("drivers_by_estado")
def _drivers_by_estado(f: Fleet) -> DataFrame:
    """FLT1: status equality alone."""
    return filter_drivers(f.drivers(), Filters(estado=vocab.AMARILLO))


@register("drivers_from_date")
def _drivers_from_date(f: Fleet) -> DataFrame:
    """FLT4: lower date bound alone; never-inspected drivers pass."""
    return filter_drivers(f.drivers(), Filters(fecha_inicio="2001-01-01"))


@register("drivers_filtered")
def _drivers_filtered(f: Fleet) -> DataFrame:
    """FLT7: status and both date bounds together (187 rows at sf0.01)."""
    return filter_drivers(f.drivers(), DRIVER_FILTERS)


@register("vehicles_by_estado")
def _vehicles_by_estado(f: Fleet) -> DataFrame:
    """FLT2: status equality; the fatigue filter is set too, and ignored."""
    return filter_vehicles(f.vehicles(), Filters(estado=vocab.NARANJA, fatiga=vocab.LEVE))


@register("vehicles_filtered")
def _vehicles_filtered(f: Fleet) -> DataFrame:
    return filter_vehicles(f.vehicles(), VEHICLE_FILTERS)


@register("fatigue_by_level")
def _fatigue_by_level(f: Fleet) -> DataFrame:
    return filter_fatigue(f.fatigue(), Filters(fatiga=vocab.LEVE))


@register("fatigue_conflicting_filters")
def _fatigue_conflict(f: Fleet) -> DataFrame:
    """FLT3: two different set values on the same column give no rows."""
    return filter_fatigue(f.fatigue(), Filters(estado=vocab.ROJO, fatiga=vocab.LEVE))


@register("fatigue_same_filters")
def _fatigue_same(f: Fleet) -> DataFrame:
    """FLT3: both filters set to one value."""
    return filter_fatigue(f.fatigue(), Filters(estado=vocab.LEVE, fatiga=vocab.LEVE))


@register("fatigue_date_range")
def _fatigue_date_range(f: Fleet) -> DataFrame:
    return filter_fatigue(f.fatigue(), LATE_RANGE)


@register("fatigue_filtered")
def _fatigue_filtered(f: Fleet) -> DataFrame:
    return filter_fatigue(f.fatigue(), FATIGUE_FILTERS)


@register("evaluations_date_range")
def _evaluations_date_range(f: Fleet) -> DataFrame:
    """FLT4/FLT5 on every evaluation, faithful midnight bound."""
    return filter_dates(f.evaluaciones(), "fecha_evaluacion", EVENT_RANGE)


@register("evaluations_calendar_range")
def _evaluations_calendar_range(f: Fleet) -> DataFrame:
    """The day-inclusive variant of the same bounds."""
    return filter_dates(f.evaluaciones(), "fecha_evaluacion", EVENT_RANGE, calendar_days=True)


@register("raw_date_range")
def _raw_date_range(f: Fleet) -> DataFrame:
    """FLT6: bounds on dates kept as text."""
    return filter_raw_dates(f.inspecciones_raw(), "fecha", RAW_RANGE)


@register("drivers_totals")
def _drivers_totals(f: Fleet) -> DataFrame:
    return drivers_totals(f.drivers())


@register("drivers_totals_filtered")
def _drivers_totals_filtered(f: Fleet) -> DataFrame:
    return drivers_totals(filter_drivers(f.drivers(), DRIVER_FILTERS))


@register("vehicles_totals")
def _vehicles_totals(f: Fleet) -> DataFrame:
    return vehicles_totals(f.vehicles())


@register("vehicles_totals_filtered")
def _vehicles_totals_filtered(f: Fleet) -> DataFrame:
    return vehicles_totals(filter_vehicles(f.vehicles(), VEHICLE_FILTERS))


@register("fatigue_totals")
def _fatigue_totals(f: Fleet) -> DataFrame:
    return fatigue_totals(f.fatigue())


@register("fatigue_totals_filtered")
def _fatigue_totals_filtered(f: Fleet) -> DataFrame:
    return fatigue_totals(filter_fatigue(f.fatigue(), FATIGUE_FILTERS))


@register("drivers_table")
def _drivers_table(f: Fleet) -> DataFrame:
    return pages.drivers_table(f.drivers())


@register("driver_color")
def _driver_color(f: Fleet) -> DataFrame:
    return pages.drivers_colored(f.drivers())


@register("vehicles_table")
def _vehicles_table(f: Fleet) -> DataFrame:
    return pages.vehicles_table(f.vehicles())


@register("vehicle_color")
def _vehicle_color(f: Fleet) -> DataFrame:
    return pages.vehicles_colored(f.vehicles())


@register("fatigue_table")
def _fatigue_table(f: Fleet) -> DataFrame:
    return pages.fatigue_table(f.fatigue())


# --- step 3: fatigue levels --------------------------------------------------------------------


@register("fatigue_level_map")
def _fatigue_level_map(f: Fleet) -> DataFrame:
    return fleet.fatigue_vocabularies(f.fatigue_levels())


@register("evaluation_level_counts")
def _evaluation_level_counts(f: Fleet) -> DataFrame:
    """Every evaluation (not only the latest) per level."""
    levels = fleet.evaluation_levels(f.evaluaciones())
    return levels.groupBy("estado_fatiga").agg(F.count(F.lit(1)).alias("value"))


# --- step 4: dashboard --------------------------------------------------------------------------


def dashboard_of(f: Fleet) -> DataFrame:
    vehicles = dashboard.vehicle_counts(f.vehiculos(), f.vehicle_summary(), f.as_of, f.vehicle_key)
    return dashboard.dashboard_metrics(vehicles, f.latest(), f.fatigue_levels())


@register("dashboard_metrics")
def _dashboard_metrics(f: Fleet) -> DataFrame:
    return dashboard_of(f)


@register("dashboard_metrics_text")
def _dashboard_metrics_text(f: Fleet) -> DataFrame:
    return dashboard.metrics_text(dashboard_of(f))


@register("monthly_series")
def _monthly_series(f: Fleet) -> DataFrame:
    return dashboard.monthly_series(f.visits(), f.vehicle_key)


@register("monthly_inspections")
def _monthly_inspections(f: Fleet) -> DataFrame:
    return dashboard.monthly_inspections(f.visits(), f.vehicle_key)


@register("monthly_vehicles")
def _monthly_vehicles(f: Fleet) -> DataFrame:
    return dashboard.monthly_vehicles(f.visits(), f.vehicle_key)


@register("driver_compliance")
def _driver_compliance(f: Fleet) -> DataFrame:
    return dashboard.driver_compliance(f.drivers())


@register("fatigue_distribution")
def _fatigue_distribution(f: Fleet) -> DataFrame:
    return dashboard.fatigue_distribution(f.fatigue_levels())


@register("driver_compliance_share")
def _driver_compliance_share(f: Fleet) -> DataFrame:
    return dashboard.with_share(dashboard.driver_compliance(f.drivers()))


@register("fatigue_distribution_share")
def _fatigue_distribution_share(f: Fleet) -> DataFrame:
    return dashboard.with_share(dashboard.fatigue_distribution(f.fatigue_levels()))


@register("compliance_color")
def _compliance_color(f: Fleet) -> DataFrame:
    return dashboard.compliance_colors(dashboard.driver_compliance(f.drivers()))


@register("fatigue_color")
def _fatigue_color(f: Fleet) -> DataFrame:
    return dashboard.fatigue_colors(dashboard.fatigue_distribution(f.fatigue_levels()))


@register("overdue_inspections")
def _overdue(f: Fleet) -> DataFrame:
    return dashboard.overdue_vehicles(f.vehicles())


# --- step 5: search ---------------------------------------------------------------------------


def _search(params: search.SearchParams) -> Callable[[Fleet], DataFrame]:
    return lambda f: search.search(f.inspecciones(), params)


for _name, _params in {
    "search_placa": search.SearchParams(placa="b"),
    "search_conductor": search.SearchParams(conductor="customer#00000012"),
    "search_contrato": search.SearchParams(contrato="BUILDING"),
    "search_campo": search.SearchParams(campo="1"),
    "search_contrato_campo": search.SearchParams(contrato="BUILDING", campo="1"),
    "search_mes_ano": search.SearchParams(mes="3", ano="2000"),
    "search_multi": SEARCH_MULTI,
    "search_no_params": search.SearchParams(),
}.items():
    register(_name)(_search(_params))


@register("search_count")
def _search_count(f: Fleet) -> DataFrame:
    return search.search_count(f.inspecciones(), SEARCH_MULTI)


@register("search_as_text")
def _search_as_text(f: Fleet) -> DataFrame:
    return search.search_as_text(f.inspecciones(), SEARCH_MULTI)


@register("numbers_as_text")
def _numbers_as_text(f: Fleet) -> DataFrame:
    """SCA5 over every number of the events and orders, as the search table prints cells."""
    events = tables.read(f.spark, f.sf_dir, "events", "event_id", "value")
    orders = tables.read(f.spark, f.sf_dir, "orders", "o_orderkey", "o_totalprice")
    return text.as_js_text(events.toDF("id", "number").unionByName(orders.toDF("id", "number")))


# Forms that the pages' dates come in, and what is written there for one day in SQL date patterns.
DATE_FORMS = (
    ("yyyy-MM-dd", None), ("MM/dd/yyyy", None), ("dd/MM/yyyy", None), ("MMM d, yyyy", None),
    ("EEE, dd MMM yyyy HH:mm:ss", " GMT"), ("yyyy-MM-dd'T'HH:mm:ss", "+02:00"), ("M/d/yy", None), ("yyyy", "-02-31"),
    ("d MMM yyyy", " 1:30 PM"), ("yyyy-MM-dd", " basura"),
)


@register("date_forms")
def _date_forms(f: Fleet) -> DataFrame:
    """SCA2: the day of every order written in one of ten forms, and what the pages read there."""
    orders = tables.read(f.spark, f.sf_dir, "orders", "o_orderkey", "o_orderdate")
    # One form a row is written out: a branch that is not taken is not computed.
    branches = [(F.col("o_orderkey") % len(DATE_FORMS) == i, F.concat(F.date_format("o_orderdate", form), F.lit(tail or ""))) for i, (form, tail) in enumerate(DATE_FORMS)]
    text_ = functools.reduce(lambda c, branch: c.when(*branch), branches, F)
    raw = orders.select(F.col("o_orderkey").alias("id"), text_.alias("fecha"))
    return raw.select("id", "fecha", dates.parse_timestamp(F.col("fecha")).cast("timestamp_ntz").alias("leida"))


@register("date_forms_desde")
def _date_forms_desde(f: Fleet) -> DataFrame:
    """FLT6 over the same texts: those the pages keep from a day on; what is no date drops."""
    return filter_raw_dates(_date_forms(f).select("id", "fecha"), "fecha", FORMS_FROM)


def api_rows(f: Fleet) -> DataFrame:
    """(id, fila): rows of unlike keys as an interface would send them, one JSON text per order."""
    orders = tables.read(f.spark, f.sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    key, price = F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("string")
    rows = [
        F.concat(F.lit('{"inspeccion_id":'), key, F.lit(',"resultado":"'), F.col("o_orderstatus"), F.lit('","valor":'), price, F.lit("}")),
        F.concat(F.lit('{"resultado":null,"10":true,"2":"'), key, F.lit('","valor":'), price, F.lit("}")),
        F.concat(F.lit('{"lista":['), key, F.lit(',[null,"a"],{"q":1}],"objeto":{"k":'), key, F.lit("}}")),
        F.concat(F.lit('{"valor":1,"conductor":'), F.col("o_custkey").cast("string"), F.lit(',"valor":'), price, F.lit("}")),
        F.lit("{}"),
    ]
    return orders.select(F.col("o_orderkey").alias("id"), F.get(F.array(*rows), (F.col("o_orderkey") % 5).cast("int")).alias("fila"))


@register("search_ragged")
def _search_ragged(f: Fleet) -> DataFrame:
    """PRJ6: the cells of rows of unlike keys, by position."""
    return ragged.ragged_cells(api_rows(f), "fila", "id")


@register("search_ragged_headers")
def _search_ragged_headers(f: Fleet) -> DataFrame:
    """PRJ6: the headers, from the first row's keys."""
    return ragged.ragged_headers(api_rows(f), "fila", "id")


# --- step 6: ingest ---------------------------------------------------------------------------


def ingest_job(f: Fleet, mode: str = vocab.DEFAULT_PLATE_MODE) -> IngestJob:
    """The fixture upload, two files, against the fixture's stored rows."""
    return IngestJob(f.upload(), f.stored(mode), mode, filename="inspecciones.csv")


for _mode in vocab.PLATE_MODES:
    register(f"ingest_summary_{_mode}")(lambda f, m=_mode: ingest_job(f, m).summary())
    register(f"ingest_counts_{_mode}")(lambda f, m=_mode: ingest_job(f, m).counts())
    register(f"plate_check_{_mode}")(
        lambda f, m=_mode: ingest_job(f, m).flagged.select(
            "fila", "placa_original", F.col("placa").alias("placa_normalizada"), "valida"
        )
    )


@register("ingest_valid")
def _ingest_valid(f: Fleet) -> DataFrame:
    return ingest_job(f).valid()


@register("ingest_invalid")
def _ingest_invalid(f: Fleet) -> DataFrame:
    return ingest_job(f).invalid()


@register("ingest_first_errors")
def _ingest_first_errors(f: Fleet) -> DataFrame:
    return ingest_job(f).first_errors()


@register("ingest_inserted")
def _ingest_inserted(f: Fleet) -> DataFrame:
    return ingest_job(f).inserted()


@register("ingest_duplicates")
def _ingest_duplicates(f: Fleet) -> DataFrame:
    return ingest_job(f).duplicates()


@register("ingest_two_files_duplicates")
def _ingest_two_files(f: Fleet) -> DataFrame:
    """WIN3 over two files that number their lines alike: the duplicates with their file."""
    job = ingest_job(f)
    valid, lines = job.valid(), job.inserted().select(*LINE)
    return valid.join(lines, same(valid, lines, LINE), "left_anti").select("archivo", "fila", "conductor", "placa", "fecha")


@register("ingest_null_driver")
def _ingest_null_driver(f: Fleet) -> DataFrame:
    """JOI3 with missing drivers: the upload against its own inserted rows inserts nothing."""
    first = ingest_job(f)
    again = IngestJob(f.upload().where(F.col("conductor").isNull()), first.result_table(), first.mode)
    return again.counts()


@register("ingest_result_table")
def _ingest_result_table(f: Fleet) -> DataFrame:
    return ingest_job(f).result_table()


# --- step 7/8: report, tier P ---------------------------------------------------------------


@register("report_metrics")
def _report_metrics(f: Fleet) -> DataFrame:
    inspections = report.inspections_and_failures(f.vehicle_summary(), f.vehiculos(), f.vehicle_key)
    return report.report_of_aggregates(inspections, f.drivers(), f.fatigue_levels())


@register("report_text")
def _report_text(f: Fleet) -> DataFrame:
    return report.report_lines(_report_metrics(f))


@register("vehicles_with_failures")
def _vehicles_with_failures(f: Fleet) -> DataFrame:
    return report.failed_vehicles(f.vehicles(with_result=True))


@register("report_metrics_filtered")
def _report_metrics_filtered(f: Fleet) -> DataFrame:
    """PRS2: the report with the global filters applied to its inputs."""
    flt = REPORT_FILTERS
    return report.report_metrics(
        report.inspections_done(filter_dates(f.visits(), "fecha", flt)),
        filter_drivers(f.drivers(), flt),
        filter_vehicles(f.vehicles(with_result=True), flt),
        filter_fatigue(f.fatigue_levels(), flt),
    )


def inspection_metrics(rows: DataFrame, levels: list | None = None) -> DataFrame:
    """Inspections, failures, vehicles and the span of dates by year, result, contract and field."""
    dimensions = {"anio": F.year("fecha"), **{c: F.col(c) for c in ("resultado", "contrato", "campo_coordinacion")}}
    measures = {
        "inspecciones": metrics.Measure("count"),
        "fallas": metrics.Measure("count", where=F.col("resultado") == F.lit(vocab.RESULTADO_FALLA)),
        "vehiculos": metrics.Measure("distinct", F.col("placa")),
        "primera": metrics.Measure("min", F.col("fecha")),
        "ultima": metrics.Measure("max", F.col("fecha")),
    }
    return metrics.custom_metrics(rows, dimensions, measures, levels)


@register("custom_metrics")
def _custom_metrics(f: Fleet) -> DataFrame:
    """PRS2: four dimensions, totals at all sixteen levels."""
    return inspection_metrics(f.inspecciones())


@register("custom_metrics_filtered")
def _custom_metrics_filtered(f: Fleet) -> DataFrame:
    """PRS2: the same with the global date filter, rolled up."""
    return inspection_metrics(filter_dates(f.inspecciones(), "fecha", RAW_RANGE), metrics.rollup(["campo_coordinacion", "resultado"]))


@register("monthly_comparison")
def _monthly_comparison(f: Fleet) -> DataFrame:
    return dashboard.monthly_comparison(f.visits(), f.vehicle_key)


def queries() -> dict[str, Query]:
    from ..streaming import registered as _streams  # noqa: F401  (registers stream queries)

    return dict(REGISTRY)


__all__ = ["REGISTRY", "queries", "register"]
