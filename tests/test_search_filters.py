"""Search parameter domain (FLT11, FLT14) and fatigue filter semantics (FLT3)."""

import pytest

from flotilla.operators import search
from flotilla.operators.filters import Filters, filter_fatigue


@pytest.mark.parametrize("kw", [dict(mes="0"), dict(mes="13"), dict(ano="1999"), dict(ano="2101"), dict(mes="x")])
def test_out_of_domain_raises(kw):
    with pytest.raises(ValueError):
        search.SearchParams(**kw)


def test_empty_params_return_all(fleet01):
    insp = fleet01.inspecciones()
    assert search.search(insp, search.SearchParams()).count() == insp.count() == 15000


def test_blank_and_zero_are_kept_as_parameters():
    assert search.SearchParams(placa=" ", conductor="0").active() == {"placa": " ", "conductor": "0"}


def test_search_sanity_numbers(fleet01):
    insp = fleet01.inspecciones()
    assert search.search(insp, search.SearchParams(placa="b", mes="3", ano="2000")).count() == 26
    assert search.search(insp, search.SearchParams(contrato="BUILDING", campo="1")).count() == 1533
    assert search.search(insp, search.SearchParams(contrato="building", campo="1")).count() == 1533


def test_partition_columns_used_when_present(fleet01):
    from pyspark.sql import functions as F

    insp = fleet01.inspecciones().withColumn("anio", F.year("fecha")).withColumn("mes_num", F.month("fecha"))
    plan = search.search(insp, search.SearchParams(mes="3", ano="2000"))._jdf.queryExecution().analyzed().toString()
    assert "anio" in plan and "mes_num" in plan


def test_fatigue_conflicting_filters_empty(fleet01):
    fat = fleet01.fatigue()
    assert filter_fatigue(fat, Filters(estado="rojo", fatiga="leve")).count() == 0
    leve = filter_fatigue(fat, Filters(fatiga="leve"))
    assert leve.count() == fat.where("estado_fatiga = 'leve'").count() == 12


def test_filters_merge_last_write_wins():
    f = Filters(estado="rojo").merge(estado="verde", fecha_fin="2001-01-01")
    assert f == Filters(estado="verde", fecha_fin="2001-01-01")
