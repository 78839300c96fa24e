"""Plan shape: pushdown, pruning, partial aggregation, no cross products."""

import pytest
from pyspark.sql import functions as F

from flotilla.operators.filters import Filters, filter_dates
from flotilla.operators.latest import latest_per_key
from flotilla.plans.queries import AS_OF, REGISTRY

from .conftest import SF001


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_date_bound_pushed_to_parquet(fleet001):
    df = filter_dates(fleet001.evaluaciones(), "fecha_evaluacion", Filters(fecha_inicio="2024-01-05"))
    p = plan(df)
    assert "PushedFilters" in p and "Or(IsNull(ts),GreaterThanOrEqual(ts," in p


def test_scan_reads_only_needed_columns(fleet001):
    p = plan(fleet001.inspecciones())
    orders_scan = [line for line in p.splitlines() if "orders.parquet" in line or "o_orderkey" in line]
    assert orders_scan
    assert "o_totalprice" not in p and "o_orderpriority" not in p


def test_latest_is_partial_aggregate_not_window(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("ts"), F.col("id").alias("v"))
    out = latest_per_key(df, "k", ["ts"], ["v"])
    p = plan(out)
    assert "Window" not in p and "partial_max" in p
    assert sorted(tuple(r) for r in out.collect()) == [(0, 999, 999), (1, 997, 997), (2, 998, 998)]


def test_latest_with_hot_key(spark):
    # a third of all rows on one key
    df = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"),
        (F.col("id") % 1000).alias("ts"),
        F.col("id").alias("v"),
    )
    hot = latest_per_key(df, "k", ["ts", "v"]).where("k = 0").first()
    brute = df.where("k = 0").orderBy(F.desc("ts"), F.desc("v")).first()
    assert (hot.ts, hot.v) == (brute.ts, brute.v)


@pytest.mark.parametrize(
    "name",
    ["dashboard_metrics", "ingest_summary_flexible", "report_metrics", "driver_status", "monthly_series"],
)
def test_no_cross_products(spark, name):
    p = plan(REGISTRY[name](spark, SF001))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_ingest_has_no_row_window(spark):
    p = plan(REGISTRY["ingest_inserted"](spark, SF001))
    assert "Window" not in p


def test_search_on_stored_table_prunes_partitions(spark, fleet001, tmp_path):
    from flotilla.operators import search
    from flotilla.sources import files

    out = str(tmp_path / "inspecciones")
    insp = fleet001.inspecciones()
    files.with_partition_columns(insp).write.partitionBy("anio", "mes_num").parquet(out)
    stored = spark.read.parquet(out)
    params = search.SearchParams(placa="b", mes="3", ano="2000")
    found = search.search(stored, params)
    p = plan(found)
    assert "PartitionFilters: [" in p and "anio" in p.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    assert found.count() == search.search(insp, params).count()


def test_stored_inspections_give_same_answers(spark, tmp_path):
    from flotilla.operators import dashboard, search
    from flotilla.plans.catalog import Fleet
    from flotilla.sources import tables

    derived = Fleet(spark, SF001, AS_OF)
    path = str(tmp_path / "inspecciones")
    tables.write_inspections(derived.inspecciones(), path)
    stored = Fleet(spark, SF001, AS_OF, inspections_path=path)

    def rows(df):
        return sorted(tuple(r) for r in df.collect())

    assert rows(stored.drivers()) == rows(derived.drivers())
    assert rows(stored.vehicles()) == rows(derived.vehicles())
    assert rows(dashboard.monthly_series(stored.inspecciones())) == rows(dashboard.monthly_series(derived.inspecciones()))
    params = search.SearchParams(mes="3", ano="2000")
    found = search.search(stored.inspecciones(), params)
    assert found.columns == derived.inspecciones().columns
    assert rows(found) == rows(search.search(derived.inspecciones(), params))
    assert "anio" in plan(found).split("PartitionFilters: [", 1)[1].split("]", 1)[0]


def test_cluster_settings_scale_with_input():
    from flotilla.session import cluster_settings

    big = cluster_settings(100 << 40, 8000)
    small = cluster_settings(1 << 30, 64)
    assert int(big["spark.sql.shuffle.partitions"]) == 204_800
    assert int(small["spark.sql.shuffle.partitions"]) == 128
    assert int(cluster_settings(100 << 40, 8000, most_partitions=50_000)["spark.sql.shuffle.partitions"]) == 50_000
    assert int(cluster_settings(10 << 40, 8000)["spark.sql.shuffle.partitions"]) == 20480


@pytest.mark.parametrize("name", ["vehicle_status", "monthly_series", "monthly_vehicles", "monthly_comparison"])
def test_no_join_to_customers_where_no_driver_is_read(spark, name):
    p = plan(REGISTRY[name](spark, SF001))
    assert "customer.parquet" not in p and "c_custkey" not in p


@pytest.mark.parametrize("name", ["dashboard_metrics", "report_metrics"])
def test_metrics_scan_the_orders_twice_at_most(spark, name):
    from tools.plan_report import fact_scans

    # One for the vehicles, one for the drivers.
    assert fact_scans(REGISTRY[name](spark, SF001), r"o_\w+") == 2


@pytest.mark.parametrize("mode", ["strict", "flexible", "permissive"])
def test_ingest_counts_read_the_upload_once(spark, mode):
    from flotilla.operators.ingest import IngestJob

    from flotilla.sources import files

    upload = spark.read.schema(files.UPLOAD_SCHEMA).parquet(SF001 + "/orders.parquet")
    stored = spark.createDataFrame([], "conductor string, placa string, fecha timestamp_ntz")
    p = plan(IngestJob(upload, stored, mode).counts())
    assert p.count("FileScan parquet") == 1


def test_year_search_reaches_the_scan(spark):
    p = plan(REGISTRY["search_mes_ano"](spark, SF001))
    assert "GreaterThanOrEqual(o_orderdate,2000-03-01" in p and "LessThan(o_orderdate,2" in p  # the plan's text is cut there


def test_checkpoint_folder_is_required_on_a_cluster(spark, monkeypatch):
    from flotilla import session

    class Bare:
        def __init__(self, master):
            self.master = master

        def getConf(self):
            return {}

    class Session:
        sparkContext = Bare("spark://host:7077")
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_root(Session())
