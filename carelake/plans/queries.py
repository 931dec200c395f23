"""Registration of every operator as a named query over the test tables."""
from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from carelake.operators import dims, kpi
from carelake.plans.registry import register
from carelake.plans.store import built_warehouse, line_warehouse, open_warehouse, written

# ------------------------------------------------------------------ facts / dims
for _name in ["fact_consumption", "fact_inventory", "sales_line"]:
    register(_name)(lambda lake, _n=_name: getattr(lake, _n))

register("dim_plant")(lambda lake: lake.dim_plant)
register("dim_material")(lambda lake: lake.dim_material)
register("dim_sloc")(lambda lake: lake.dim_sloc)
register("dim_vendor")(lambda lake: lake.dim_vendor)
register("dim_costcenter")(lambda lake: lake.dim_costcenter)
register("plant_domains")(lambda lake: dims.plant_domains(
    lake.dim_plant, lake.fact_inventory, lake.fact_consumption, lake.fact_grn))

# ------------------------------------------------------------------ KPI
register("kpi_stock_value")(lambda l: kpi.kpi_stock_value(l.fact_inventory))
register("kpi_aging_distribution")(lambda l: kpi.kpi_aging_distribution(l.fact_inventory))
register("kpi_inventory_aging")(lambda l: kpi.kpi_inventory_aging(l.fact_inventory, l.fact_consumption, l.snapshot_col))
register("kpi_doh")(lambda l: kpi.kpi_doh(l.fact_inventory, l.fact_consumption))
register("kpi_health_score")(lambda l: kpi.kpi_health_score(l.fact_inventory, l.fact_consumption))
register("kpi_non_moving")(lambda l: kpi.kpi_non_moving(l.fact_inventory, l.fact_consumption, l.snapshot_col))
register("kpi_risk_classification")(lambda l: kpi.kpi_risk_classification(l.fact_inventory, l.fact_consumption, l.snapshot_col))
register("kpi_near_expiry")(lambda l: kpi.kpi_near_expiry(l.fact_inventory, l.snapshot_col))
register("kpi_stock_change")(lambda l: kpi.kpi_stock_change(l.fact_grn, l.fact_consumption, l.dim_material))
register("kpi_stock_change_by_group")(lambda l: kpi.kpi_stock_change_by_group(
    kpi.kpi_stock_change(l.fact_grn, l.fact_consumption, l.dim_material)))
register("kpi_purchase_value")(lambda l: kpi.kpi_purchase_value(l.fact_po))
register("kpi_monthly_purchase_value")(lambda l: kpi.kpi_monthly_purchase_value(l.fact_po, l.dim_material))
register("kpi_procurement_variance")(lambda l: kpi.kpi_procurement_variance(l.fact_po))
register("kpi_vendor_volume")(lambda l: kpi.kpi_vendor_volume(l.fact_po))
register("kpi_purchase_by_location")(lambda l: kpi.kpi_purchase_by_location(l.fact_po))
register("kpi_units_consumed")(lambda l: kpi.kpi_units_consumed(l.fact_consumption, l.dim_material))
register("kpi_consumption_by_department")(lambda l: kpi.kpi_consumption_by_department(
    l.fact_consumption, l.dim_costcenter))
register("kpi_cycle_time")(lambda l: kpi.kpi_cycle_time(l.fact_grn))
register("kpi_vendor_lead_time")(lambda l: kpi.kpi_vendor_lead_time(l.fact_grn))
register("kpi_fill_rate")(lambda l: kpi.kpi_fill_rate(l.fact_po))

# ------------------------------------------------------------------ forecast
from carelake.functions.expr import r6  # noqa: E402
from carelake.operators import forecast as fc  # noqa: E402


def _matrix(l):
    return fc.demand_matrix(l.fact_consumption, l.history_end, l.history_months)


def _rep(l):
    return fc.replenishment(l.fact_inventory, l.fact_consumption, l.fact_grn, l.dim_material,
                            l.history_end, l.history_months, l.horizon)


def _fs(l):
    return fc.forecast_sales(_matrix(l), l.dim_material, l.history_end, l.history_months, l.horizon)


register("demand_matrix")(_matrix)
register("demand_forecast")(lambda l: fc.demand_forecast(_matrix(l), l.history_months, l.horizon))
register("forecast_sales")(_fs)
register("demand_next")(lambda l: fc.demand_next(_matrix(l), l.dim_material, l.history_months, l.horizon)
                        .select("plant", "material", "material_group", r6("demand_forecast").alias("demand_forecast"),
                                r6("demand_monthly").alias("demand_monthly")))
register("material_lead_time")(lambda l: fc.material_lead_time(l.fact_grn)
                               .select("material", r6("lead_time_days").alias("lead_time_days")))
register("stock_replenishment_and_aging_risk")(_rep)
register("kpi_fulfillment")(lambda l: fc.kpi_fulfillment(_rep(l)))
register("kpi_stock_radar")(lambda l: fc.kpi_stock_radar(_rep(l), l.horizon))
register("kpi_aging_risk_forecast")(lambda l: fc.kpi_aging_risk_forecast(_rep(l)))
register("forecast_accuracy")(lambda l: fc.forecast_accuracy(_matrix(l), l.dim_material, l.history_months))
register("sales_forecast_series")(lambda l: fc.forecast_series(_fs(l), "qty"))
register("cashflow_forecast_series")(lambda l: fc.forecast_series(_fs(l), "cash"))
register("weekly_forecast")(lambda l: fc.weekly_forecast(_rep(l), "week_1"))
for _w in ["week_2", "week_3", "week_4"]:
    register(f"weekly_forecast_{_w}")(lambda l, _w=_w: fc.weekly_forecast(_rep(l), _w))
register("replenishment_summary")(lambda l: fc.replenishment_summary(_rep(l)))
register("replenishment_top")(lambda l: fc.replenishment_top(_rep(l)))
register("aging_top")(lambda l: fc.aging_top(_rep(l)))

# ------------------------------------------------------------------ sales
from carelake.operators import cookbook as cb  # noqa: E402
from carelake.operators import marts  # noqa: E402
from carelake.operators import sales  # noqa: E402
from carelake.sources.fixtures import CAPEX_DOC_TYPES  # noqa: E402


def _grain(l, g):
    return sales.sales_grain(sales.grain_aggregate(l.sales_line, g), g, l.dim_material)


for _g in sales.GRAINS:
    register(_g)(lambda l, _g=_g: _grain(l, _g))

register("sales_by_material_dedup")(lambda l: sales.sales_by_material_dedup(_grain(l, "sales_by_material")))


register("revenue_totals")(lambda l: sales.revenue_totals(
    _grain(l, "sales_totals"), _grain(l, "sales_by_material"), _grain(l, "sales_by_manufacturer"),
    _grain(l, "sales_by_hospital"), _grain(l, "sales_monthly"), l.fact_consumption))
register("revenue_timeline")(lambda l: sales.revenue_timeline(_grain(l, "sales_monthly")))
register("revenue_top_hospitals")(lambda l: sales.revenue_top(_grain(l, "sales_by_hospital"), "hospital", 8))
register("revenue_top_manufacturers")(lambda l: sales.revenue_top(_grain(l, "sales_by_manufacturer"), "manufacturer", 10))
register("revenue_top_items")(lambda l: sales.revenue_top(_grain(l, "sales_by_material"), "material", 12))
register("revenue_by_category")(lambda l: sales.revenue_by_category(_grain(l, "sales_by_material")))
register("revenue_items")(lambda l: sales.revenue_items(_grain(l, "sales_by_material"), "revenue"))

# ------------------------------------------------------------------ marts
def _price_stats(l):
    return marts.material_price_stats(l.fact_grn, l.dim_material)


def _vendor_stats(l):
    return marts.material_vendor_price_stats(l.fact_grn, l.dim_material)


def _mart_proc(l, w=None):
    w = w or line_warehouse(l, facts=["fact_consumption", "fact_inventory", "fact_grn"])
    return marts.mart_procurement(w["fact_grn"], w["dim_material"], w["mart_material_price_stats"], written(w, "kpi_vendor_lead_time"))


register("mart_material_price_stats")(_price_stats)
register("mart_material_vendor_price_stats")(_vendor_stats)
register("mart_procurement")(_mart_proc)
register("mart_procurement_stored")(lambda l: _mart_proc(l, built_warehouse(l, [
    "fact_grn", "mart_material_price_stats", "kpi_vendor_lead_time"])))

# ------------------------------------------------------------------ cookbook
register("sql_revenue_margin")(lambda l: cb.revenue_margin(_grain(l, "sales_totals")))
register("sql_expiring_by_manufacturer")(lambda l: cb.expiring_by_manufacturer(
    l.fact_inventory, l.dim_material, l.snapshot_col))
register("sql_price_deviation")(lambda l: cb.price_deviation(l.fact_grn))
register("sql_overpay")(lambda l: cb.price_deviation(l.fact_grn, one_directional=True))
register("sql_price_by_plant")(lambda l: cb.price_by_plant(_mart_proc(l)))
register("sql_cheapest_vendor")(lambda l: cb.cheapest_vendor(_vendor_stats(l)))
register("sql_consolidation_saving")(lambda l: cb.consolidation_saving(_vendor_stats(l)))
register("sql_price_dispersion")(lambda l: cb.price_dispersion(_price_stats(l)))
register("sql_vendor_inconsistency")(lambda l: cb.vendor_inconsistency(_mart_proc(l)))
register("sql_capex_split")(lambda l: cb.capex_split(l.fact_po, CAPEX_DOC_TYPES))
register("sql_median_doh")(lambda l: cb.median_doh(kpi.kpi_doh(l.fact_inventory, l.fact_consumption)))
register("sql_vendor_spend")(lambda l: cb.vendor_spend(kpi.kpi_vendor_volume(l.fact_po)))
register("sql_category_spend")(lambda l: cb.category_spend(l.fact_po, l.dim_material))
register("sql_true_variance")(lambda l: cb.true_variance(kpi.kpi_procurement_variance(l.fact_po)))
register("sql_dead_stock")(lambda l: cb.dead_stock(l.fact_inventory, l.sales_line, l.fact_po, l.fact_grn,
                                                   l.snapshot_col))
register("sql_received_vs_ordered")(lambda l: cb.received_vs_ordered(l.spark, l.fact_po, l.fact_grn))
register("sql_unit_cost")(lambda l: cb.unit_cost(l.fact_consumption))
register("inventory_by_ward_class")(lambda l: cb.inventory_by_ward_class(l.fact_inventory, l.dim_sloc))
register("sql_proxy_margin")(lambda l: cb.proxy_margin(l.fact_grn))
register("sql_manufacturer_coverage")(lambda l: cb.manufacturer_coverage(l.fact_po, l.dim_material))
register("sql_out_of_formulary")(lambda l: cb.out_of_formulary(l.fact_inventory))
register("sql_redistribution")(lambda l: cb.redistribution(l.fact_inventory, l.fact_consumption,
                                                           l.snapshot_col))
register("sql_inactive_items")(lambda l: cb.inactive_items(
    l.dim_material, [l.sales_line, l.fact_po, l.fact_grn, l.fact_consumption]))

# ------------------------------------------------------------------ inventory insights
from carelake.operators import insights_inventory as ii  # noqa: E402


def _hs(l):
    return kpi.kpi_health_score(l.fact_inventory, l.fact_consumption)


def _doh2(l):
    return kpi.kpi_doh(l.fact_inventory, l.fact_consumption), kpi.kpi_stock_value(l.fact_inventory)


def _snap(l):
    return l.snapshot_col


register("monthly_series")(lambda l: ii.monthly_series(
    kpi.kpi_stock_change(l.fact_grn, l.fact_consumption, l.dim_material), "stock_change"))
register("inventory_valuation")(lambda l: ii.inventory_valuation(kpi.kpi_stock_value(l.fact_inventory)))
register("valuation_age")(lambda l: ii.valuation_age(l.fact_inventory))
register("valuation_categories")(lambda l: ii.valuation_categories(l.fact_inventory))
register("itr_totals")(lambda l: ii.itr_totals(_hs(l)))
register("itr_categories")(lambda l: ii.itr_categories(_hs(l)))
register("itr_bands")(lambda l: ii.itr_bands(_hs(l)))
register("itr_timeline")(lambda l: ii.itr_timeline(l.fact_consumption))
register("itr_by_group")(lambda l: ii.itr_by_group(_hs(l)))
register("doh_bands")(lambda l: ii.doh_bands(*_doh2(l)))
register("doh_categories")(lambda l: ii.doh_categories(*_doh2(l)))
register("doh_reorder")(lambda l: ii.doh_reorder(*_doh2(l)))
register("doh_overstock")(lambda l: ii.doh_overstock(*_doh2(l)))
register("health_tiers")(lambda l: ii.health_tiers(_hs(l)))
register("health_bands")(lambda l: ii.health_bands(_hs(l)))
register("health_categories")(lambda l: ii.health_categories(_hs(l)))
register("stock_flow_monthly")(lambda l: ii.stock_flow_monthly(
    kpi.kpi_stock_change(l.fact_grn, l.fact_consumption, l.dim_material)))
register("stock_risers")(lambda l: ii.stock_risers(kpi.kpi_stock_change(l.fact_grn, l.fact_consumption, l.dim_material)))
register("non_moving_reasons")(lambda l: ii.non_moving_reasons(kpi.kpi_non_moving(l.fact_inventory, l.fact_consumption, l.snapshot_col)))
register("non_moving_aging")(lambda l: ii.non_moving_aging(kpi.kpi_non_moving(l.fact_inventory, l.fact_consumption, l.snapshot_col)))
register("risk_tiers")(lambda l: ii.risk_tiers(kpi.kpi_risk_classification(l.fact_inventory, l.fact_consumption, l.snapshot_col)))
register("risk_matrix")(lambda l: ii.risk_matrix(kpi.kpi_risk_classification(l.fact_inventory, l.fact_consumption, l.snapshot_col)))
register("risk_factors")(lambda l: ii.risk_factors(kpi.kpi_risk_classification(l.fact_inventory, l.fact_consumption, l.snapshot_col)))
register("expiry_ladder")(lambda l: ii.expiry_ladder(l.fact_inventory, _snap(l)))
register("near_expiry_buckets")(lambda l: ii.near_expiry_buckets(kpi.kpi_near_expiry(l.fact_inventory, l.snapshot_col)))
register("expiry_calendar")(lambda l: ii.expiry_calendar(kpi.kpi_near_expiry(l.fact_inventory, l.snapshot_col)))
register("expiry_items")(lambda l: ii.expiry_items(l.fact_inventory, _snap(l)))
register("expiry_items_search")(lambda l: ii.expiry_items(l.fact_inventory, _snap(l), slab="Expired", q="1", plant="P03"))
register("inventory_aging_top")(lambda l: ii.inventory_aging_top(kpi.kpi_inventory_aging(l.fact_inventory, l.fact_consumption, l.snapshot_col)))

# ------------------------------------------------------------------ procurement insights
from carelake.operators import insights_procurement as ip  # noqa: E402
from carelake.operators.forecast import history_slots  # noqa: E402


def _pv(l):
    return kpi.kpi_purchase_value(l.fact_po)


def _vv(l):
    return kpi.kpi_vendor_volume(l.fact_po)


def _window(l):
    s = history_slots(l.history_end, l.history_months)
    return s[0], s[-1]


PROCUREMENT_TABLES = ["kpi_purchase_value", "kpi_vendor_volume", "kpi_cycle_time", "kpi_fill_rate", "kpi_purchase_by_location",
                      "kpi_vendor_lead_time", "fact_grn"]
register("procurement_totals")(lambda l: _procurement_totals(open_warehouse(l)))
register("procurement_totals_stored")(lambda l: _procurement_totals(built_warehouse(l, PROCUREMENT_TABLES)))


def _procurement_totals(w):
    return ip.procurement_totals(w.lake.spark, *[w[t] for t in PROCUREMENT_TABLES])


register("open_po_by_category")(lambda l: ip.open_po_by_category(l.fact_po))
register("procurement_savings")(lambda l: ip.procurement_savings(l.fact_grn))
register("purchase_categories")(lambda l: ip.purchase_categories(_pv(l)))
register("purchase_vendors")(lambda l: ip.purchase_vendors(_pv(l), _vv(l)))
register("variance_timeline")(lambda l: ip.variance_timeline(_pv(l)))
register("variance_totals")(lambda l: ip.variance_totals(_pv(l)))
register("vendor_concentration")(lambda l: ip.vendor_concentration(_vv(l)))
register("vendor_pareto")(lambda l: ip.vendor_pareto(_vv(l)))
register("location_share")(lambda l: ip.location_share(kpi.kpi_purchase_by_location(l.fact_po)))
register("cycle_timeline")(lambda l: ip.cycle_timeline(kpi.kpi_cycle_time(l.fact_grn), *_window(l)))
register("cycle_plants")(lambda l: ip.cycle_plants(kpi.kpi_cycle_time(l.fact_grn), *_window(l)))
register("lead_time_dist")(lambda l: ip.lead_time_dist(kpi.kpi_vendor_lead_time(l.fact_grn)))
register("lead_time_slow")(lambda l: ip.lead_time_slow(kpi.kpi_vendor_lead_time(l.fact_grn)))
register("fill_rate_plants")(lambda l: ip.fill_rate_plants(kpi.kpi_fill_rate(l.fact_po)))
register("fill_rate_dist")(lambda l: ip.fill_rate_dist(kpi.kpi_fill_rate(l.fact_po)))
register("purchase_month_matrix")(lambda l: ip.purchase_month_matrix(kpi.kpi_monthly_purchase_value(l.fact_po, l.dim_material)))
register("margin_month_matrix")(lambda l: ip.margin_month_matrix(
    kpi.kpi_monthly_purchase_value(l.fact_po, l.dim_material), l.fact_grn, l.dim_material))
register("vendor_margin")(lambda l: ip.vendor_margin(l.fact_grn))

# ------------------------------------------------------------------ consumption / forecast / summary insights
from carelake.operators import insights_consumption as ic  # noqa: E402


def _uc(l):
    return kpi.kpi_units_consumed(l.fact_consumption, l.dim_material)


def _dp(l):
    return kpi.kpi_consumption_by_department(l.fact_consumption, l.dim_costcenter)


register("revenue_distribution")(lambda l: ic.revenue_distribution(_uc(l)))
register("consumption_timeline")(lambda l: ic.consumption_timeline(_uc(l)))
register("consumption_categories")(lambda l: ic.consumption_categories(_uc(l)))
register("consumption_departments")(lambda l: ic.consumption_departments(_dp(l)))
register("units_top")(lambda l: ic.units_top(_uc(l)))
register("units_month_matrix")(lambda l: ic.units_month_matrix(_uc(l)))
register("department_pareto")(lambda l: ic.department_pareto(_dp(l)))
register("forecast_timeline")(lambda l: ic.forecast_timeline(_fs(l), kind="qty"))
register("reorder_top")(lambda l: ic.reorder_top(_rep(l)))
register("demand_top_items")(lambda l: ic.demand_top_items(_fs(l), l.dim_material))
register("demand_categories")(lambda l: ic.demand_categories(_fs(l), l.dim_material))
register("cashflow_timeline")(lambda l: ic.forecast_timeline(_fs(l), kind="cash", cumulative=True))
register("cashflow_top_items")(lambda l: ic.cashflow_top_items(_fs(l), l.dim_material))
register("replenishment_spectrum")(lambda l: ic.replenishment_spectrum(_rep(l)))
register("reorder_by_category")(lambda l: ic.reorder_by_category(_rep(l)))
register("aging_ladder")(lambda l: ic.aging_ladder(_rep(l)))
register("risk_items")(lambda l: ic.risk_items(_rep(l)))
register("stock_age_mix")(lambda l: ic.stock_age_mix(kpi.kpi_aging_distribution(l.fact_inventory)))
DASHBOARD_TABLES = ["kpi_stock_value", "kpi_doh", "kpi_health_score", "kpi_units_consumed", "kpi_non_moving",
                    "kpi_purchase_value", "stock_replenishment_and_aging_risk", "kpi_near_expiry", "kpi_fill_rate"]
register("dashboard_summary")(lambda l: _dashboard(line_warehouse(l, DASHBOARD_TABLES)))
register("dashboard_summary_stored")(lambda l: _dashboard(built_warehouse(l, DASHBOARD_TABLES)))


def _dashboard(w):
    return ic.dashboard_summary(w.lake.spark, *[w[t] for t in DASHBOARD_TABLES])


register("period_change")(lambda l: ic.period_change(ic.monthly_plant_cost(l.fact_consumption)))
register("age_card")(lambda l: ic.age_card(l.fact_inventory))

# ------------------------------------------------------------------ generic surface (GEN-*)
from carelake.operators import catalog as cat  # noqa: E402
from carelake.operators import generic as gen  # noqa: E402
from carelake.plans.warehouse import Warehouse  # noqa: E402
from carelake.schemas import PORTFOLIOS, REGISTRY  # noqa: E402

# Columns of the served table and the names that they are shown by.
STOCK_CHANGE_CONTRACT = {"year": "year", "month": "period", "material": "materialId", "material_desc": "materialName",
                         "material_group": "materialGroup", "stock_change": "stockChange"}
ADHOC_TEXT = ("SELECT vendor_name, sum(vendor_value) AS spend, count(DISTINCT plant) AS plants "
              "FROM kpi_vendor_volume GROUP BY vendor_name ORDER BY spend DESC")


ADHOC_JOIN = """
WITH spend AS (SELECT plant, sum(purchase_value) AS spend, count(DISTINCT vendor_name) AS vendors FROM kpi_purchase_value GROUP BY plant),
     stock AS (SELECT plant, sum(stock_value_cost) AS stock FROM kpi_stock_value GROUP BY plant)
SELECT p.plant, p.plant_name, round(s.spend, 4) AS spend, s.vendors, round(k.stock, 4) AS stock
FROM dim_plant p LEFT JOIN spend s ON p.plant = s.plant LEFT JOIN stock k ON p.plant = k.plant
WHERE p.plant IN (SELECT plant FROM kpi_fill_rate WHERE ordered_qty > 0)"""
ADHOC_CAPPED = ("SELECT material, round(sum(stock_value_cost), 4) AS stock FROM kpi_stock_value GROUP BY material "
                "ORDER BY stock DESC, material")
register("adhoc_sql_join")(lambda l: gen.adhoc_sql(l.spark, ADHOC_JOIN, catalogue=_wh(l)))
register("adhoc_sql_capped")(lambda l: gen.adhoc_sql(l.spark, ADHOC_CAPPED, cap=40, catalogue=_wh(l)))


def _adhoc(l):
    return gen.adhoc_sql(l.spark, ADHOC_TEXT, catalogue=_wh(l))


register("gen_query")(lambda l: gen.gen_query(Warehouse(l)["kpi_units_consumed"]))
register("gen_chart_series")(lambda l: gen.chart_series(Warehouse(l)["kpi_units_consumed"], group_by="year,month"))
register("gen_summarize")(lambda l: gen.summarize(Warehouse(l)["kpi_stock_value"]))
register("table_filter")(lambda l: gen.apply_filters(Warehouse(l)["kpi_purchase_value"],
                                                     [("purchase_value", "1000,"), ("vendor_name", "supplier#0000000")]))
register("table_global_search")(lambda l: gen.apply_filters(Warehouse(l)["kpi_stock_value"], global_filter="GEAR"))
register("table_page")(lambda l: gen.paginate(Warehouse(l)["kpi_stock_change"], sort_field="stockChange",
                                              sort_order="desc", page=1, page_size=25,
                                              columns=list(STOCK_CHANGE_CONTRACT), rename=STOCK_CHANGE_CONTRACT,
                                              col_map={v: k for k, v in STOCK_CHANGE_CONTRACT.items()}))
def _portfolio(l, name):
    """GEN-05, one table after another: a table's summary is written before the next is planned, so that the driver
    holds the stages and broadcasts of one table, not of the whole portfolio."""
    w, out = line_warehouse(l, [REGISTRY[k][0] for k in PORTFOLIOS[name]]), work_dir(l.spark, f"portfolio-{name}")
    if name == "forecasting":      # its tables are all made from this one
        rep = "stock_replenishment_and_aging_risk"
        w[rep].write.parquet(f"{out}-{rep}")
        w._cache[rep] = l.spark.read.schema(w[rep].schema).parquet(f"{out}-{rep}")
    for k in PORTFOLIOS[name]:
        gen.portfolio_summary({k: w[REGISTRY[k][0]]}, [k]).write.mode("append").parquet(out)
    return l.spark.read.parquet(out)


register("portfolio_summary")(lambda l: _portfolio(l, "procurement"))
register("adhoc_sql")(_adhoc)

# ------------------------------------------------------------------ analyst catalogue (CAT-*)
def _wh(l):
    return open_warehouse(l)


for _dim in ["manufacturer", "hospital", "category", "material", "month"]:
    register(f"cat_revenue_{_dim}")(lambda l, _d=_dim: cat.revenue(_wh(l), _d, "revenue", 10))


def _cat_proc(l, view, dim):
    w = _wh(l)
    return cat.procurement(w["kpi_vendor_volume"], w["kpi_purchase_value"], w["kpi_purchase_by_location"],
                           l.fact_po, l.fact_grn, view, dim, 10)


for _name, _view, _dim in [("vendors", "vendors", "vendor"), ("category", "spend", "category"),
                           ("location", "spend", "location"), ("month", "spend", "month"),
                           ("open_po", "open_po", "vendor"), ("savings", "savings", "vendor")]:
    register(f"cat_procurement_{_name}")(lambda l, _v=_view, _d=_dim: _cat_proc(l, _v, _d))
register("cat_inventory_expiry")(lambda l: cat.inventory({"fact_inventory_expiry": ii.inventory_expiry(l.fact_inventory, _snap(l))}, "expiry"))
for _view in ["stock_value", "doh", "aging", "non_moving", "health"]:
    register(f"cat_inventory_{_view}")(lambda l, _v=_view: cat.inventory(_wh(l), _v, 10))
register("cat_expiry")(lambda l: cat.expiry(ii.inventory_expiry(l.fact_inventory, _snap(l))))
register("cat_stock_risk")(lambda l: cat.stock_risk(_wh(l)["stock_replenishment_and_aging_risk"]))
register("cat_stock_risk_reorder")(lambda l: cat.stock_risk(_wh(l)["stock_replenishment_and_aging_risk"], "reorder"))
register("cat_forecast")(lambda l: cat.forecast(_wh(l)["kpi_stock_radar"]))
register("cat_forecast_fulfillment")(lambda l: cat.forecast_fulfillment(_wh(l)["kpi_fulfillment"]))
register("cat_overview")(lambda l: cat.overview(l.spark, _wh(l)["sales_totals"], _wh(l)["kpi_stock_value"],
                                                _wh(l)["kpi_purchase_value"],
                                                ii.inventory_expiry(l.fact_inventory, _snap(l))))

# ------------------------------------------------------------------ re-aimed helpers (RE-*)
from carelake.operators import reaimed as re_  # noqa: E402
from carelake.plans.pipeline import (DIMS, FACT_PARTITIONS, FORECAST_TABLES, KPI_TABLES, MART_TABLES,  # noqa: E402
                                      SALES_TABLES, build, output_paths)
from carelake.plans.registry import register_raw  # noqa: E402
from carelake.sources.fixtures import read_table  # noqa: E402


FOOTPRINT_TABLES = ["fact_consumption", "fact_inventory", "fact_grn", "fact_po", "sales_line", "sales_by_material",
                    "kpi_stock_value", "kpi_units_consumed", "kpi_monthly_purchase_value",
                    "stock_replenishment_and_aging_risk"]
PROFILE_TABLES = ["fact_consumption", "fact_inventory", "dim_plant", "dim_sloc", "kpi_stock_value", "kpi_vendor_volume",
                  "sales_by_hospital"]


def _vendor_spend(l):
    return _wh(l)["kpi_vendor_volume"].groupBy("vendor_name").agg(F.sum("vendor_value").alias("spend"))


register("top_n_other")(lambda l: re_.top_n_other(_vendor_spend(l), "vendor_name", "spend", cap=re_.CAT_CAPS["pie"]))
register("heat_matrix")(lambda l: re_.heat_matrix(_wh(l)["kpi_stock_value"], "material_group", "plant", "stock_value_cost"))
register("hierarchy_rollup")(lambda l: re_.hierarchy_rollup(_wh(l)["kpi_stock_value"], "material_group", "material",
                                                            "stock_value_cost"))
register("box_stats")(lambda l: re_.box_stats(l.fact_grn, "plant", "net_price"))
register("histogram_bins")(lambda l: re_.histogram_bins(l.fact_grn, "net_price"))


def _entity_sources(l):
    w = _wh(l)
    return {"item": (w["sales_by_material"], "material_desc", False),
            "category": (l.dim_material, "material_group", True),
            "manufacturer": (l.dim_material, "manufacturer_desc", False),
            "vendor": (l.dim_vendor, "vendor_name", False),
            "hospital": (w["sales_by_hospital"], "hospital", False)}


register("entity_search")(lambda l: re_.entity_search(_entity_sources(l), "e"))


@register("item_footprint")
def _footprint(l):
    w = line_warehouse(l)
    return re_.item_footprint(w.lake.dim_material, {t: w[t] for t in FOOTPRINT_TABLES}, "gear")


# tables of the whole catalogue, stored so that each is derived once
ALL_TABLES = [*DIMS, *KPI_TABLES, *SALES_TABLES, *MART_TABLES, "stock_replenishment_and_aging_risk",
              *[t for t in FORECAST_TABLES if t != "stock_replenishment_and_aging_risk"]]


def _catalogue(l):
    w = built_warehouse(l, ALL_TABLES)
    return {t: w[t] for t in [*FACT_PARTITIONS, *ALL_TABLES]}


register("item_footprint_all")(lambda l: re_.item_footprint(l.dim_material, _catalogue(l), "gear"))
register("catalog_profile_all")(lambda l: re_.catalog_profile(l.spark, _catalogue(l)))
register("catalog_profile")(lambda l: re_.catalog_profile(l.spark, {t: _wh(l)[t] for t in PROFILE_TABLES}))
register("nonzero_fraction")(lambda l: re_.nonzero_fraction(_wh(l)["kpi_stock_value"]))


@register_raw("cosine_topk")
def _cosine(spark, sf_dir):
    emb = read_table(spark, sf_dir, "embeddings")
    return re_.cosine_topk(emb, re_.label_exemplars(emb))


@register_raw("intent_tags")
def _intent(spark, sf_dir):
    return re_.intent_tags(read_table(spark, sf_dir, "conversations"))


@register_raw("followup_turns")
def _followup(spark, sf_dir):
    return re_.followup_turns(read_table(spark, sf_dir, "conversations"))


@register_raw("scope_carry")
def _scope(spark, sf_dir):
    return re_.scope_carry(read_table(spark, sf_dir, "conversations"))

# ------------------------------------------------------------------ streaming (STR-*)
from carelake.streaming import incremental as stream  # noqa: E402

register("stream_sales_monthly")(lambda l: stream.stream_sales_monthly(l.spark, l.sales_line))


@register_raw("stream_daily_totals")
def _daily(spark, sf_dir):
    return stream.stream_daily_totals(spark, read_table(spark, sf_dir, "events"))


@register_raw("stream_daily_late")
def _daily_late(spark, sf_dir):
    return stream.stream_daily_late(spark, read_table(spark, sf_dir, "events"))

# ------------------------------------------------------------------ raw-extract loaders (SRC-*)
from carelake.sources import landing, loaders  # noqa: E402
from carelake.streaming.incremental import work_dir  # noqa: E402

register("fact_grn")(lambda l: l.fact_grn)
register("fact_po")(lambda l: l.fact_po)


def _land_and_load(l, name, extract, loader, partition_by=None):
    path = landing.write_csv(extract(getattr(l, name)), work_dir(l.spark, f"raw-{name}"), partition_by, packed=bool(partition_by))
    raw = loaders.read_raw(l.spark, path)
    return loader(raw.drop(partition_by) if partition_by else raw)


register("src_consumption")(lambda l: _land_and_load(l, "fact_consumption", landing.consumption_extract,
                                                     loaders.load_consumption))
register("src_inventory")(lambda l: _land_and_load(l, "fact_inventory", landing.inventory_extract, loaders.load_inventory))
register("src_grn")(lambda l: _land_and_load(l, "fact_grn", landing.grn_extract, loaders.load_grn, "ym"))
register("src_po")(lambda l: _land_and_load(l, "fact_po", landing.po_extract, loaders.load_po, "ym"))


def _sales_landing(l):
    """IP / OP sales files with drifting headers + one file lacking a required column."""
    base = work_dir(l.spark, "raw-sales")
    ip = l.sales_line.where(F.col("patient_type") == "IP")
    op = l.sales_line.where(F.col("patient_type") == "OP")
    landing.write_csv(landing.sales_extract(ip, landing.IP_HEADERS, "yyyy-MM-dd HH:mm:ss"), f"{base}/ip", "ym")
    landing.write_csv(landing.sales_extract(op, landing.OP_HEADERS, "dd.MM.yyyy"), f"{base}/op", "ym")
    landing.write_csv(landing.sales_extract(op, landing.OP_HEADERS, "dd.MM.yyyy").drop("TOTALMRP"), f"{base}/op_bad")
    files = [("IP", f"{base}/ip"), ("OP", f"{base}/op"), ("OP", f"{base}/op_bad")]
    raw, skipped = sales.read_sales_files(l.spark, files)
    return raw, skipped


def _window_of(l):
    s = history_slots(l.history_end, l.history_months)
    import datetime as _dt
    return s[0], l.snapshot_date if l.snapshot_date >= s[-1] else _dt.date(s[-1].year, s[-1].month, 28)


register("sales_line_loaded")(lambda l: sales.canonical_sales_lines(_sales_landing(l)[0], _window_of(l)))
register("sales_file_audit")(lambda l: sales.sales_file_audit(_sales_landing(l)[0], _window_of(l), by="folder"))



def _listed_sales(l):
    """A landing zone with IP and OP folders, a file without the revenue column and one of only a header."""
    base = work_dir(l.spark, "landed-sales")
    op = l.sales_line.where(F.col("patient_type") == "OP").repartition("month", "year")
    ip = l.sales_line.where(F.col("patient_type") == "IP").repartition("month", "year")      # one file a month
    landing.write_csv(landing.sales_extract(ip, landing.IP_HEADERS, "yyyy-MM-dd HH:mm:ss"), f"{base}/IP Sales", "ym")
    landing.write_csv(landing.sales_extract(op, landing.OP_HEADERS, "dd.MM.yyyy"), f"{base}/OP Sales", "ym")
    bad = landing.sales_extract(op, landing.OP_HEADERS, "dd.MM.yyyy").drop("ym")
    landing.write_csv(bad.drop("TOTALMRP", "QTY").coalesce(1), f"{base}/OP Sales/no-revenue")
    landing.write_csv(bad.limit(0).coalesce(1), f"{base}/OP Sales/header-only")
    return loaders.sales_folders(base)


@register("sales_line_listed")
def _sales_line_listed(l):
    return sales.canonical_sales_lines(sales.read_sales_files(l.spark, _listed_sales(l))[0], _window_of(l))


@register("sales_landed_audit")
def _sales_landed_audit(l):
    folders = _listed_sales(l)
    return sales.landed_file_audit(l.spark, folders, sales.read_sales_files(l.spark, folders)[0], _window_of(l), by="folder")


def _mixed(l, name, columns, loader, spoilt=None):
    path = landing.write_csv(landing.mixed_dates(getattr(l, name), columns, spoilt), work_dir(l.spark, f"mixed-{name}"))
    return loader(loaders.read_raw(l.spark, path))


register("src_consumption_mixed")(lambda l: _mixed(l, "fact_consumption", loaders.CONSUMPTION_COLUMNS, loaders.load_consumption))
register("src_inventory_mixed")(lambda l: _mixed(l, "fact_inventory", loaders.INVENTORY_COLUMNS, loaders.load_inventory))
register("src_grn_mixed")(lambda l: _mixed(l, "fact_grn", loaders.GRN_COLUMNS, loaders.load_grn))
register("src_date_rejects")(lambda l: _mixed(l, "fact_grn", loaders.GRN_COLUMNS, lambda raw: loaders.date_rejects(
    raw, loaders.GRN_COLUMNS), {"gr_date": F.col("month_num") == 3}))


@register("period_card")
def _period_card(l):
    wide = landing.card_extract(ic.monthly_plant_cost(l.fact_consumption), "plant")
    path = landing.write_csv(wide, work_dir(l.spark, "card"))
    return ic.period_card(loaders.read_card(l.spark, path, ["Location"]))


from carelake.sources.quality import dq_report  # noqa: E402

register("dq_report")(lambda l: dq_report(
    {"fact_consumption": l.fact_consumption, "fact_inventory": l.fact_inventory, "fact_grn": l.fact_grn,
     "fact_po": l.fact_po},
    {"dim_plant": l.dim_plant, "dim_material": l.dim_material, "dim_vendor": l.dim_vendor,
     "dim_costcenter": l.dim_costcenter}, l.fact_consumption))

# ------------------------------------------------------------------ option lists (DIM-07) and SQL-02
register("material_options")(lambda l: dims.material_options(l.dim_material))
register("group_options")(lambda l: dims.group_options(l.dim_material))
register("vendor_options")(lambda l: dims.vendor_options(kpi.kpi_vendor_volume(l.fact_po)))
register("sql_top_manufacturers")(lambda l: cb.top_manufacturers(_grain(l, "sales_by_manufacturer")))

# ------------------------------------------------------------------ remaining insight sub-blocks
from carelake.operators import insights_extra as ix  # noqa: E402

register("valuation_totals")(lambda l: ix.valuation_totals(l.fact_inventory))
register("doh_totals")(lambda l: ix.doh_totals(ii._doh_frame(*_doh2(l), None)))
register("health_totals")(lambda l: ix.health_totals(_hs(l)))
register("non_moving_categories")(lambda l: ix.group_value_top(
    kpi.kpi_non_moving(l.fact_inventory, l.fact_consumption, l.snapshot_col), "closing_stock_value", 12, qty="closing_stock_quantity"))
register("risk_categories")(lambda l: ix.group_value_top(
    kpi.kpi_risk_classification(l.fact_inventory, l.fact_consumption, l.snapshot_col), "closing_stock_value", 10,
    where=F.col("risk_level") == "High"))
register("near_expiry_categories")(lambda l: ix.group_value_top(kpi.kpi_near_expiry(l.fact_inventory, l.snapshot_col), "total_cost", 10))
register("lead_time_totals")(lambda l: ix.lead_time_totals(kpi.kpi_vendor_lead_time(l.fact_grn)))
register("purchase_top_skus")(lambda l: ix.purchase_top_skus(kpi.kpi_monthly_purchase_value(l.fact_po, l.dim_material)))
register("consumption_totals")(lambda l: ix.consumption_totals(_uc(l), _dp(l)))
register("units_scatter")(lambda l: ix.units_scatter(_uc(l)))
register("department_month_matrix")(lambda l: ix.department_month_matrix(_dp(l)))
register("forecast_status_counts")(lambda l: ix.forecast_status_counts(
    _wh(l)["kpi_stock_radar"], _wh(l)["kpi_aging_risk_forecast"]))

# ------------------------------------------------------------------ filters, drills and lookups
register("gen_query_region")(lambda l: gen.gen_query(
    gen.region_filter(_wh(l)["kpi_units_consumed"], l.dim_plant, "NATION_3"), material_group="MEDIUM"))
register("gen_query_materials")(lambda l: gen.gen_query(_wh(l)["kpi_stock_change"], plant="P03", material="1, 2,30"))
register("gen_chart_top")(lambda l: gen.chart_series(_wh(l)["kpi_units_consumed"], group_by="material_group",
                                                     measures="consumption_cost", top=3))
register("kpi_stock_value_region")(lambda l: gen.region_filter(_wh(l)["kpi_stock_value"], l.dim_plant, "P05"))
for _key, _grain_name, _one in [("manufacturer", "sales_by_material_mfr", "Brand#17"),
                                ("hospital", "sales_by_material_hospital", "P03")]:
    register(f"revenue_items_{_key}")(lambda l, _k=_key, _g=_grain_name, _v=_one: sales.revenue_items(
        _grain(l, _g), "margin", **{_k: _v}))
register("revenue_items_category")(lambda l: sales.revenue_items(_grain(l, "sales_by_material"), group="Medium"))
for _name, _cut in [("order_now", {"kind": "order_now"}), ("aging", {"kind": "aging"}),
                    ("dead_stock", {"status": "Dead stock"}), ("bucket", {"aging": "6-12 Months", "plant": "P03"})]:
    register(f"risk_items_{_name}")(lambda l, _c=_cut: ic.risk_items(_rep(l), **_c))
register("item_risk")(lambda l: ic.item_risk(_rep(l), "30"))
register("reorder_totals")(lambda l: ic.reorder_totals(_rep(l)))
register("reorder_order_now")(lambda l: ic.risk_items(_rep(l), kind="order_now", limit=8))
register("reorder_aged")(lambda l: ic.risk_items(_rep(l), kind="aging", limit=8))
register("department_totals")(lambda l: ic.department_totals(_dp(l)))
register("completion_totals")(lambda l: ip.completion_totals(kpi.kpi_fill_rate(l.fact_po)))
register("completion_plants")(lambda l: ip.completion_plants(kpi.kpi_fill_rate(l.fact_po)))
register("cycle_totals")(lambda l: ip.cycle_totals(kpi.kpi_cycle_time(l.fact_grn), *_window(l)))
register("location_diversity")(lambda l: ip.location_diversity(kpi.kpi_purchase_by_location(l.fact_po)))
register("location_totals")(lambda l: ip.location_totals(kpi.kpi_purchase_by_location(l.fact_po)))
for _p in ["inventory", "consumption", "forecasting"]:
    register(f"portfolio_{_p}")(lambda l, _p=_p: _portfolio(l, _p))


def _browse_sources(l):
    named = lambda df, label, weight: df.select(F.col(label).alias("label"), weight.cast("double").alias("weight"))
    groups = l.dim_material.groupBy("material_group").agg(F.count(F.lit(1)).alias("n"))
    return {"item": (named(_grain(l, "sales_by_material"), "material_desc", F.col("revenue")), False),
            "category": (named(groups, "material_group", F.col("n")), True),
            "manufacturer": (named(_grain(l, "sales_by_manufacturer"), "manufacturer", F.col("revenue")), False),
            "vendor": (named(_vendor_spend(l), "vendor_name", F.col("spend")), False),
            "hospital": (named(_grain(l, "sales_by_hospital"), "hospital", F.col("revenue")), False)}


register("entity_browse")(lambda l: re_.entity_browse(_browse_sources(l)))


def _mixed_grain(l, name):
    return sales.sales_grain(sales.grain_aggregate(sales.with_spreadsheet_keys(l.sales_line), name), name, l.dim_material)


for _name, _grain_name, _extra in [("plain", "sales_by_material", ()), ("mfr", "sales_by_material_mfr", ("manufacturer",)),
                                   ("hospital", "sales_by_material_hospital", ("hospital",))]:
    register(f"sales_dedup_{_name}")(lambda l, _g=_grain_name, _e=_extra: sales.sales_by_material_dedup(_mixed_grain(l, _g), _e))


# ------------------------------------------------------------------ totals of the insight views
from carelake.operators import insight_totals as it  # noqa: E402

register("stock_flow_totals")(lambda l: it.stock_flow_totals(_wh(l)["kpi_stock_change"]))
register("non_moving_totals")(lambda l: it.non_moving_totals(_wh(l)["kpi_non_moving"]))
register("risk_totals")(lambda l: it.risk_totals(_wh(l)["kpi_risk_classification"]))
register("near_expiry_totals")(lambda l: it.near_expiry_totals(_wh(l)["kpi_near_expiry"]))
register("cat_expiry_items")(lambda l: it.expiry_items(ii.inventory_expiry(l.fact_inventory, _snap(l)), "91-180d"))
register("cat_expiry_within")(lambda l: it.expiry_within(ii.inventory_expiry(l.fact_inventory, _snap(l))))
register("open_po_totals")(lambda l: it.open_po_totals(l.fact_po))
register("savings_totals")(lambda l: it.savings_totals(l.fact_grn))
register("purchase_totals")(lambda l: it.purchase_totals(_wh(l)["kpi_monthly_purchase_value"]))
register("purchase_series")(lambda l: ip.purchase_month_matrix(_wh(l)["kpi_monthly_purchase_value"], k=4))
register("purchase_margins")(lambda l: it.purchase_margins(_wh(l)["kpi_monthly_purchase_value"]))
register("consumption_items")(lambda l: it.consumption_items(_uc(l)))
register("units_categories")(lambda l: it.units_categories(_uc(l)))
register("units_totals")(lambda l: it.units_totals(_uc(l)))


@register("forecast_totals")
def _forecast_totals(l):
    w = line_warehouse(l, ["forecast_sales", "stock_replenishment_and_aging_risk", "forecast_accuracy"])
    return it.forecast_totals(w["forecast_sales"], w["stock_replenishment_and_aging_risk"], w["forecast_accuracy"])


register("demand_totals")(lambda l: it.forecast_headline(_wh(l)["forecast_sales"], _wh(l)["forecast_accuracy"]))
register("cashflow_totals")(lambda l: it.forecast_headline(_wh(l)["forecast_sales"], _wh(l)["forecast_accuracy"], "cash"))
register("cashflow_categories")(lambda l: it.cashflow_categories(_wh(l)["forecast_sales"], l.dim_material))


# ------------------------------------------------------------------ table contracts (GEN-06)
# Columns of the served tables and the names that they are shown by.
_ITEM = {"material": "materialId", "material_desc": "materialName", "material_group": "materialGroup"}
_MONTH = {"year": "year", "month": "period"}
_SNAPSHOT = {"year": "year", "period": "period"}
CONTRACTS = {
    "inventory_valuation": ("kpi_stock_value", {**_SNAPSHOT, **_ITEM, "stock_value_cost": "inventoryValuation"}),
    "turnover": ("kpi_health_score", {**_SNAPSHOT, **_ITEM, "consumption_cost": "cogs", "closing_stock_value": "averageInventoryValue",
                                      "turnover_annualized": "inventoryTurnOverRatio"}),
    "inventory_aging": ("kpi_inventory_aging", {"material": "materialId", "material_desc": "materialName",
                                                "age_since_last_sale_days": "ageSinceLastSale",
                                                "age_since_last_purchase_days": "ageSinceLastPurchase", "aging_days": "aging"}),
    "monthly_purchase": ("kpi_monthly_purchase_value", {**_MONTH, **_ITEM, "monthly_purchase_value": "monthlyPurchaseValue"}),
    "vendor_margin": ("vendor_margin", {**_MONTH, "vendor_name": "vendorName", "grn_volume": "grnVolume", "unit_cost": "averageUnitCost",
                                        "unit_mrp": "sellingPrice", "margin": "margin"}),
    "units_sold": ("kpi_units_consumed", {**_MONTH, **_ITEM, "total_units": "totalUnitsSold"}),
    "return_rate": ("kpi_units_consumed", {**_MONTH, **_ITEM, "total_units": "soldUnits", "returned": "returnedUnits", "rate": "returnRate"}),
    "revenue_distribution": ("revenue_distribution", {**_MONTH, "op": "opSales", "ip": "ipIssue", "internal_consumption": "internalConsumption"}),
}


def _contract(l, name, sort_field=None, sort_order="asc", page=0, page_size=40):
    table, names = CONTRACTS[name]
    df = {"vendor_margin": lambda: ip.vendor_margin(l.fact_grn), "revenue_distribution": lambda: ic.revenue_distribution(_uc(l))}.get(
        table, lambda: _wh(l)[table])()
    zero = F.lit(0.0)      # there are no returns and no split of revenue in these data
    given = {"year": F.year(_snap(l)), "period": F.date_format(_snap(l), "MMMM"), "returned": F.lit(0), "rate": zero, "op": zero, "ip": zero}
    for c in names:
        if c in given and c not in df.columns:
            df = df.withColumn(c, given[c])
    return gen.paginate(df, sort_field=sort_field, sort_order=sort_order, page=page, page_size=page_size, columns=list(names), rename=names,
                        col_map={v: k for k, v in names.items()})


for _name, _sort in [("inventory_valuation", "inventoryValuation"), ("turnover", "inventoryTurnOverRatio"), ("inventory_aging", "ageSinceLastSale"),
                     ("monthly_purchase", "monthlyPurchaseValue"), ("vendor_margin", "grnVolume"), ("units_sold", "totalUnitsSold"),
                     ("return_rate", "soldUnits"), ("revenue_distribution", "internalConsumption")]:
    register(f"contract_{_name}")(lambda l, _n=_name, _s=_sort: _contract(l, _n, _s, "desc"))

# ------------------------------------------------------------------ filtered forms, look-ups, coercions
register("monthly_series_purchase")(lambda l: ii.monthly_series(_wh(l)["kpi_monthly_purchase_value"], "monthly_purchase_value"))
register("monthly_series_units")(lambda l: ii.monthly_series(_wh(l)["kpi_units_consumed"], "total_units", keep_group=False))
for _name, _cut in [("plant", {"plant": "P03"}), ("material", {"material": "30"}), ("group", {"material_group": "MEDIUM"})]:
    register(f"sales_forecast_series_{_name}")(lambda l, _c=_cut: fc.forecast_series(_fs(l), "qty", **_c))
register("material_options_plant")(lambda l: dims.material_options(l.dim_material, _wh(l)["kpi_stock_value"], "P03"))
register("vendor_options_plant")(lambda l: dims.vendor_options(_wh(l)["kpi_vendor_volume"], "P03"))
register("sql_price_lookup")(lambda l: cb.price_lookup(_wh(l)["mart_material_price_stats"], "gear"))
register("sql_category_spend_cut")(lambda l: cb.category_spend(
    l.fact_po, l.dim_material, window=(l.history_end.replace(year=l.history_end.year - 1), l.history_end), material_types=["ZMED"],
    group_pattern="%m%"))
MOVED_SINCE = datetime.date(2001, 9, 1)
register("sql_dead_stock_since")(lambda l: cb.dead_stock(l.fact_inventory, l.sales_line, l.fact_po, l.fact_grn, l.snapshot_col, MOVED_SINCE))
register("sql_active_alternatives")(lambda l: cb.active_alternatives(
    l.dim_material, [(l.sales_line, "sale_date"), (l.fact_po, "po_date"), (l.fact_grn, "gr_date"), (l.fact_consumption, "posting_date")],
    MOVED_SINCE))
register("safe_columns")(lambda l: gen.safe_columns(ic.units_top(_uc(l))))
register("clean_output")(lambda l: gen.clean_output(_wh(l)["kpi_inventory_aging"]))


@register("src_numbers")
def _src_numbers(l):
    """COL-01 on a landed text file: what is a number, and its sum."""
    from carelake.functions.expr import to_number
    raw = _mixed(l, "fact_grn", loaders.GRN_COLUMNS, lambda raw: raw)
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), to_number(F.col(f"`{c}`")).alias("v")) for c in ("GR Qty", "Net Price", "Material Description")])
    return raw.select(F.explode(cells).alias("c")).groupBy("c.column_name").agg(
        F.count("c.v").alias("numbers"), F.round(F.coalesce(F.sum("c.v"), F.lit(0.0)), 2).alias("total"))


@register("staged_build")
def _staged_build(l):
    """SRC-10 / SRC-15: the whole staged build, and the rows of every table that it wrote."""
    from functools import reduce
    out = work_dir(l.spark, "staged-build")
    build(l.spark, l, out, "all")
    counts = [l.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(t).alias("table_name"), "rows")
              for t, path in output_paths(out).items() if t != "line"]
    return reduce(lambda a, b: a.unionByName(b), counts)
