"""The stored-table catalogue: what is current is read, what is not is derived."""
import os
import shutil

from urllib.parse import urlparse

import pytest

from carelake.plans import queries  # noqa: F401
from carelake.plans.pipeline import build, output_paths
from carelake.plans.queries import DASHBOARD_TABLES, PROCUREMENT_TABLES, _dashboard, _mart_proc, _procurement_totals
from carelake.plans.store import ROOT_SETTING, Store, StoredWarehouse, built_warehouse, open_warehouse
from carelake.plans.warehouse import Warehouse
from carelake.sources.fixtures import SOURCE_TABLES, Lake

from tests.conftest import SF_SMALL


@pytest.fixture
def source(tmp_path):
    """A copy of the source tables that a test may change."""
    for t in SOURCE_TABLES:
        shutil.copy(f"{SF_SMALL}/{t}.parquet", tmp_path / f"{t}.parquet")
    return str(tmp_path)


@pytest.fixture
def root(spark, tmp_path):
    spark.conf.set(ROOT_SETTING, str(tmp_path / "store"))
    yield str(tmp_path / "store")
    spark.conf.unset(ROOT_SETTING)


def rows(df):
    return sorted(map(str, df.collect()))


def scans(spark, make):
    """Scans of the physical plan; reused shuffles and subqueries do not count again."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")      # else reuse shows only at run time
    try:
        return make()._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_queries_read_stored_tables_and_equal_derived_ones(spark, root):
    lake = lambda: Lake.from_testdata(spark, SF_SMALL)
    tables = [*DASHBOARD_TABLES, *PROCUREMENT_TABLES, "mart_material_price_stats"]
    w = stored = built_warehouse(lake(), tables)
    for make in (_dashboard, _procurement_totals, lambda w: _mart_proc(w.lake, w)):
        got, want = make(stored), make(Warehouse(lake()))
        assert rows(got) == rows(want)
        paths = {p for p, _ in stored.known.values()}
        files = {urlparse(f).path for f in make(open_warehouse(lake())).inputFiles()}
        assert all(any(f.startswith(p) for p in paths) for f in files)
    assert built_warehouse(lake(), tables).build(tables) == []      # all current: nothing is written again
    # every stored table is read once
    assert scans(spark, lambda: _mart_proc(w.lake, w)) == 4      # receipts, materials, prices, vendors
    assert scans(spark, lambda: _dashboard(w)) == len(DASHBOARD_TABLES)
    assert scans(spark, lambda: _procurement_totals(w)) == len(PROCUREMENT_TABLES)


def test_changed_input_parameter_or_folder_is_not_read(spark, source, root):
    lake = lambda **p: _with(Lake.from_testdata(spark, source), **p)
    first = built_warehouse(lake(), ["kpi_stock_value"])
    assert "kpi_stock_value" in open_warehouse(lake()).known
    assert "kpi_stock_value" not in open_warehouse(lake(horizon=5)).known
    shutil.copy(f"{SF_SMALL}/customer.parquet", f"{source}/customer.parquet")      # newer time of change

    os.utime(f"{source}/customer.parquet", (2_000_000_000, 2_000_000_000))
    later = open_warehouse(lake())
    assert "kpi_stock_value" not in later.known and rows(later["kpi_stock_value"]) == rows(first["kpi_stock_value"])
    again = built_warehouse(lake(), ["kpi_stock_value"])
    assert again.known["kpi_stock_value"][0] != first.known["kpi_stock_value"][0]


def _with(lake, **params):
    for k, v in params.items():
        setattr(lake, k, v)
    return lake


def test_staged_build_is_recorded_and_taken_back(spark, tmp_path):
    out = str(tmp_path / "out")
    build(spark, Lake.from_testdata(spark, SF_SMALL), out, "all")
    lake = Lake.from_testdata(spark, SF_SMALL)
    w = StoredWarehouse(lake, Store(spark, out))
    assert set(w.known) == set(output_paths(out))
    fresh = Lake.from_testdata(spark, SF_SMALL)
    assert w["fact_grn"].dtypes == fresh.fact_grn.dtypes and w["kpi_fulfillment"].count() == Warehouse(fresh)["kpi_fulfillment"].count()
    assert rows(_dashboard(w)) == rows(_dashboard(Warehouse(fresh)))
    w.take_back([w.known["kpi_doh"][0]])      # a rebuild that died after it started
    left = StoredWarehouse(Lake.from_testdata(spark, SF_SMALL), Store(spark, out))
    assert "kpi_doh" not in left.known and "kpi_stock_value" in left.known
    assert left["kpi_doh"].count() == Warehouse(fresh)["kpi_doh"].count()


def test_plans_of_several_tables_read_a_line_that_is_written_once(spark):
    from carelake.operators.reaimed import item_footprint
    from carelake.plans.queries import FOOTPRINT_TABLES
    from carelake.plans.registry import all_queries
    for name in ("item_footprint", "portfolio_consumption"):
        got = all_queries()[name](spark, SF_SMALL)
        assert not any(f"/{t}.parquet" in f for f in got.inputFiles() for t in SOURCE_TABLES), name
    lake = Lake.from_testdata(spark, SF_SMALL)
    plain = Warehouse(lake)
    want = item_footprint(lake.dim_material, {t: plain[t] for t in FOOTPRINT_TABLES}, "gear")
    assert rows(all_queries()["item_footprint"](spark, SF_SMALL)) == rows(want)


def test_a_written_line_gives_the_same_facts(spark):
    from carelake.plans.store import line_warehouse
    lake = Lake.from_testdata(spark, SF_SMALL)
    w = line_warehouse(lake)
    for t in [*lake.tables, "dim_material"]:
        assert w[t].schema == getattr(lake, t).schema and rows(w[t]) == rows(getattr(lake, t)), t


def test_forecasting_portfolio_makes_its_common_table_once(spark):
    from glob import glob

    from carelake.operators import generic as gen
    from carelake.plans.registry import all_queries
    from carelake.schemas import PORTFOLIOS, REGISTRY
    from carelake.session import ensure_checkpoint_dir
    made = lambda: glob(f"{urlparse(ensure_checkpoint_dir(spark)).path}/portfolio-forecasting-*-stock_replenishment_and_aging_risk")
    before = len(made())
    got, plain, keys = all_queries()["portfolio_forecasting"](spark, SF_SMALL), Warehouse(Lake.from_testdata(spark, SF_SMALL)), PORTFOLIOS["forecasting"]
    want = gen.portfolio_summary({k: plain[REGISTRY[k][0]] for k in keys}, keys)
    number = lambda df: sorted((r["key"], r["column_name"], r["stat"], f"{r['value']:.6g}" if r["value"] is not None else "") for r in df.collect())
    assert number(got) == number(want) and len(made()) == before + 1


def test_tables_of_a_catalogue_share_what_they_are_made_from(spark, source, root, monkeypatch):
    from carelake.operators import forecast as fc
    from carelake.operators import kpi
    from carelake.operators import sales
    calls = []
    for module, name in ((fc, "demand_matrix"), (kpi, "kpi_inventory_aging"), (sales, "sales_aggregates"), (sales, "grain_aggregate")):
        made = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, _made=made, _name=name, **k: calls.append(_name) or _made(*a, **k))
    names = ["kpi_inventory_aging", "kpi_non_moving", "kpi_risk_classification", "sales_totals", "sales_by_hospital",
             "stock_replenishment_and_aging_risk", "forecast_sales", "forecast_accuracy"]
    built_warehouse(Lake.from_testdata(spark, source), names)
    assert sorted(calls) == ["demand_matrix", "kpi_inventory_aging", "sales_aggregates"]


def test_stock_tables_share_their_items_and_receipts_need_no_materials(spark, root, monkeypatch):
    from carelake.operators import forecast as fc
    from carelake.operators import kpi
    from carelake.plans.store import ITEM_TABLES, MATRIX_TABLES, line_warehouse
    from carelake.sources.fixtures import LINE_COLUMNS
    calls = []
    for module, name in ((kpi, "stock_items"), (fc, "demand_matrix"), (fc, "demand_spread")):
        made = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, _made=made, _name=name, **k: calls.append(_name) or _made(*a, **k))
    lake = lambda: Lake.from_testdata(spark, SF_SMALL)
    first = built_warehouse(lake(), PROCUREMENT_TABLES)
    assert "dim_material" not in first.known and first.stored("line").columns == LINE_COLUMNS
    stored = built_warehouse(lake(), [*ITEM_TABLES, "kpi_non_moving"])
    assert calls == ["stock_items"] and "dim_material" in stored.known
    spark.conf.unset(ROOT_SETTING)
    calls.clear()
    lazy, plain = line_warehouse(lake(), [*ITEM_TABLES, *MATRIX_TABLES]), Warehouse(lake())
    made = {t: lazy[t] for t in [*ITEM_TABLES, *MATRIX_TABLES]}
    assert sorted(calls) == ["demand_matrix", "demand_spread", "stock_items"]
    for t in ITEM_TABLES:
        assert made[t].dtypes == plain[t].dtypes == stored[t].dtypes and rows(made[t]) == rows(plain[t]) == rows(stored[t]), t


def test_a_build_makes_once_what_its_tables_share(spark, tmp_path, monkeypatch):
    from carelake.operators import dims, kpi
    from carelake.operators import forecast as fc
    calls = []
    for module, name in ((dims, "dim_material"), (dims, "dim_costcenter"), (kpi, "stock_items"), (fc, "demand_spread"), (fc, "demand_matrix")):
        made = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, _made=made, _name=name, **k: calls.append(_name) or _made(*a, **k))
    out = str(tmp_path / "out")
    build(spark, Lake.from_testdata(spark, SF_SMALL), out, "all")
    assert sorted(calls) == ["demand_matrix", "demand_spread", "dim_costcenter", "dim_material", "stock_items"]
    paths, plain = output_paths(out), Warehouse(Lake.from_testdata(spark, SF_SMALL))
    for t in ("dim_material", "kpi_health_score", "stock_replenishment_and_aging_risk", "kpi_stock_change_by_group", "sales_by_material"):
        assert rows(spark.read.parquet(paths[t]).select(*plain[t].columns)) == rows(plain[t]), t
    assert "demand_std" not in spark.read.parquet(f"{out}/kpi/demand_matrix").columns


def test_a_table_that_fails_fails_the_build(spark, tmp_path):
    from carelake.plans.pipeline import write_together
    bad = spark.range(3).selectExpr("assert_true(id < 2) AS x", "id")
    with pytest.raises(Exception, match="id < 2"):
        write_together({str(tmp_path / "good"): spark.range(3), str(tmp_path / "bad"): bad})
    assert spark.read.parquet(str(tmp_path / "good")).count() == 3


def test_each_fact_needs_only_its_columns_of_the_line(spark):
    from carelake.sources.fixtures import FACT_COLUMNS, LINE_COLUMNS, facts_of
    lake = Lake.from_testdata(spark, SF_SMALL)
    assert set().union(*FACT_COLUMNS.values()) == set(LINE_COLUMNS)
    for name, columns in FACT_COLUMNS.items():
        got = facts_of(lake.line.select(*columns), [name])
        assert list(got) == [name] and got[name].schema == lake.tables[name].schema
        assert rows(got[name]) == rows(lake.tables[name]), name


def test_procurement_lines_are_not_shuffled_for_their_vendor(spark):
    from carelake.operators import marts
    lake = Lake.from_testdata(spark, SF_SMALL)
    plain = Warehouse(lake)
    want = rows(marts.mart_procurement(plain["fact_grn"], lake.dim_material, plain["mart_material_price_stats"], plain["kpi_vendor_lead_time"]))
    key = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(key)
    spark.conf.set(key, "16k")      # no line and no material fits, the written vendors do
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = _mart_proc(Lake.from_testdata(spark, SF_SMALL))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert any("BroadcastHashJoin [vendor_name" in x for x in plan.splitlines())
        assert "plant_name" not in plan and any("kpi_vendor_lead_time" in f for f in got.inputFiles())
        assert rows(got) == want
    finally:
        spark.conf.set(key, was)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_a_catalogue_is_written_in_groups_and_later_tables_read_the_written_ones(spark, root, monkeypatch):
    added = []
    add = Store.add
    monkeypatch.setattr(Store, "add", lambda self, tables, *a: added.append([t[0] for t in tables]) or add(self, tables, *a))
    names = ["kpi_stock_change_by_group", "kpi_cycle_time", "kpi_stock_change", "dim_costcenter", "kpi_consumption_by_department", "kpi_fill_rate"]
    w = built_warehouse(Lake.from_testdata(spark, SF_SMALL), names)
    assert added == [["line"], ["dim_material"], ["dim_costcenter"],
                     ["kpi_cycle_time", "kpi_stock_change", "kpi_consumption_by_department", "kpi_fill_rate"], ["kpi_stock_change_by_group"]]
    assert set(w.known) == {"line", "dim_material", *names} and w.build(names) == []
    plain = Warehouse(Lake.from_testdata(spark, SF_SMALL))
    for t in names:
        assert rows(w[t]) == rows(plain[t]), t
