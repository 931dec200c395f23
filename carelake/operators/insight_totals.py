"""Headline totals and remaining lists of the insight views (INS-08..12, 15, 16, 24, 27, 28, 30..32, CAT-04).

Each block is one aggregate row, or one short list, over a stored KPI table; what it needs from a
second table comes as a scalar subquery.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelake.functions.expr import UNCAT_LABELS, clean_category, money, month_index, r6
from carelake.operators.common import for_plant, key_medians, top_n

# Names of the accuracy metrics.
ACCURACY = {"accuracy": "Aggregate Forecast Accuracy %", "weighted_acc": "Weighted Forecast Accuracy %", "series": "Series count"}


def _sum(c, name: str, where: Column | None = None) -> Column:
    x = c if isinstance(c, Column) else F.col(c)
    return F.round(F.coalesce(F.sum(x if where is None else F.when(where, x)), F.lit(0)).cast("double"), 4).alias(name)


def _rows(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)


def _ym() -> Column:
    return F.format_string("%04d-%02d", F.col("year"), month_index("month") + 1)


# ------------------------------------------------------------------ inventory
def stock_flow_totals(sc: DataFrame, plant: str | None = None) -> DataFrame:
    """INS-08: inflow, outflow, net, items and months (a month of two years counts twice, D3)."""
    return for_plant(sc, plant).agg(_sum("inflow", "inflow"), _sum("outflow", "outflow"), _sum("stock_change", "net"),
                                    F.countDistinct("material").alias("skus"), F.countDistinct("year", "month").alias("months"))


def non_moving_totals(nm: DataFrame, plant: str | None = None) -> DataFrame:
    """INS-09: blocked value, lines and quantity."""
    return for_plant(nm, plant).agg(_sum("closing_stock_value", "blocked_value"), _rows("blocked_skus"), _sum("closing_stock_quantity", "qty"))


def risk_totals(rc: DataFrame, plant: str | None = None) -> DataFrame:
    """INS-10: value and lines over all tiers."""
    return for_plant(rc, plant).agg(_sum("closing_stock_value", "total_value"), _rows("total_skus"))


def near_expiry_totals(ne: DataFrame, plant: str | None = None) -> DataFrame:
    """INS-12: exposure at cost and MRP, lines, and what is expired or due within 30 days."""
    b = F.col("expiry_bucket")
    return for_plant(ne, plant).agg(_sum("total_cost", "exposure"), _rows("skus"), _sum("total_cost", "expired_value", b == "Expired"),
                                    _sum("total_cost", "urgent_value", b == "0-30d"), _sum("total_mrp", "mrp_exposure"))


def expiry_items(inv_expiry: DataFrame, slab: str, n: int = 15) -> DataFrame:
    """CAT-04: the costliest batches of one slab, and the value of the whole slab."""
    rows = inv_expiry.where(F.col("slab") == slab)
    top = top_n(rows, n, F.desc("total_cost"), "material", "plant", "batch", "dte", "sloc")
    return top.select(F.col("material_desc").alias("name"), money("total_cost").alias("value"), F.col("dte").alias("days_left"),
                      F.col("expiry_date").alias("expiry"), rows.select(_sum("total_cost", "v")).scalar().alias("band_value"))


def expiry_within(inv_expiry: DataFrame, days: int = 180) -> DataFrame:
    """CAT-04: value and items that are expired or expire within ``days``."""
    return inv_expiry.where(F.col("dte") <= days).agg(_sum("total_cost", "actionable"), F.countDistinct("material").alias("items"))


# ------------------------------------------------------------------ procurement
def open_po_totals(po: DataFrame, plant: str | None = None) -> DataFrame:
    """INS-15: undelivered order value, orders and lines."""
    return for_plant(po, plant).where(F.col("open_qty") > 0).agg(
        _sum(F.col("open_qty") * F.col("net_price"), "total_value"), F.countDistinct("po_no").alias("total_pos"), _rows("total_lines"))


def savings_totals(grn: DataFrame, plant: str | None = None, min_buys: int = 4, max_ratio: float = 2.5) -> DataFrame:
    """INS-16: spend above the items' own medians, how many items have any, and the spend they are part of."""
    d = (for_plant(grn, plant).where((F.col("net_price") > 0) & (F.col("gr_qty") > 0) & F.col("material").isNotNull())
         .withColumn("price", F.col("net_price").cast("double")))
    spread = d.groupBy("material").agg(F.min("price").alias("lo"), F.max("price").alias("hi"))
    steady = (key_medians(d, ["material"], "price", "med", "buys").join(spread, "material")
              .where((F.col("buys") >= min_buys) & (F.col("hi") / F.col("lo") <= max_ratio)).select("material", "med"))
    qty = F.col("gr_qty").cast("double")
    lines = d.join(steady, "material").groupBy("material", "material_desc").agg(
        F.sum(F.greatest(F.col("price") - F.col("med"), F.lit(0.0)) * qty).alias("over"), F.sum(F.col("price") * qty).alias("spend"))
    flagged = F.col("material_desc").isNotNull() & (F.col("over") > 0)
    return lines.agg(_sum("over", "opportunity", flagged), F.count_if(flagged).alias("items_flagged"), _sum("spend", "spend_base"))


def purchase_totals(mp: DataFrame, plant: str | None = None) -> DataFrame:
    """INS-24: spend, mean per month, leading category and items."""
    d = for_plant(mp, plant)
    groups = d.where(F.col("material_group").isNotNull()).groupBy("material_group").agg(F.sum("monthly_purchase_value").alias("v"))
    top = top_n(groups, 1, F.desc("v"), "material_group").select(F.max("material_group")).scalar()
    total, months = F.sum("monthly_purchase_value"), F.countDistinct("year", "month")
    return d.agg(_sum("monthly_purchase_value", "total"),
                 F.round(F.coalesce(total / F.greatest(months, F.lit(1)), F.lit(0.0)), 4).alias("avg"),
                 F.countDistinct("material").alias("skus")).select("*", top.alias("top_group"))


def purchase_margins(mp: DataFrame, plant: str | None = None, k: int = 8) -> DataFrame:
    """INS-24: the row totals of the k leading categories and the column totals of the months."""
    d = for_plant(mp, plant).withColumn("ym", _ym())
    v = F.round(F.sum("monthly_purchase_value").cast("double"), 4).alias("total")
    rows = top_n(d.groupBy(F.col("material_group").alias("name")).agg(v), k, F.desc("total"), F.asc_nulls_last("name"))
    return rows.select(F.lit("row").alias("kind"), "name", "total").unionByName(
        d.groupBy(F.col("ym").alias("name")).agg(v).select(F.lit("month").alias("kind"), "name", "total"))


# ------------------------------------------------------------------ consumption
def _items(uc: DataFrame) -> DataFrame:
    return uc.where(F.col("material").isNotNull() & F.col("material_desc").isNotNull()).groupBy("material", "material_desc").agg(
        F.sum("total_units").alias("u"), F.sum("consumption_cost").alias("c"))


def consumption_items(uc: DataFrame, plant: str | None = None, n: int = 8) -> DataFrame:
    """INS-27: the items that cost most."""
    return top_n(_items(for_plant(uc, plant)), n, F.desc("c"), "material").select(
        "material", F.col("material_desc").alias("desc"), F.round("u", 4).alias("units"), F.round("c", 4).alias("cost"))


def units_categories(uc: DataFrame, plant: str | None = None, n: int = 9) -> DataFrame:
    """INS-28: the leading categories by units with their share of all units."""
    g = for_plant(uc, plant).groupBy(F.coalesce("material_group", F.lit("Uncategorized")).alias("name")).agg(
        F.sum("total_units").alias("u"), F.sum("consumption_cost").alias("c"))
    total = g.select(F.sum("u")).scalar()
    return top_n(g, n, F.desc("u"), "name").select(
        "name", F.round("u", 4).alias("units"), F.round("c", 4).alias("cost"),
        r6(F.when(total != 0, F.col("u") / total * 100).otherwise(F.lit(0.0))).alias("share"), F.lower(F.trim("name")).isin(UNCAT_LABELS).alias("uncat"))


def units_totals(uc: DataFrame, plant: str | None = None) -> DataFrame:
    """INS-28: units, cost, items, cost per unit and the item with most units."""
    d = for_plant(uc, plant)
    top = top_n(_items(d), 1, F.desc("u"), "material").select(F.max("material_desc")).scalar()
    u, c = F.sum("total_units"), F.sum("consumption_cost")
    return d.agg(_sum("total_units", "units"), _sum("consumption_cost", "cost"), F.countDistinct("material").alias("materials"),
                 r6(F.when(u != 0, c / u).otherwise(F.lit(0.0))).alias("cpu")).select("*", top.alias("top_material"))


# ------------------------------------------------------------------ forecast
FORECAST = {"qty": ("sales_quantity_forecast", "lower_bound_sales_quantity_forecast", "upper_bound_sales_quantity_forecast"),
            "cash": ("cashflow_forecast", "lower_bound_cashflow_forecast", "upper_bound_cashflow_forecast")}


def _accuracy(acc: DataFrame) -> list[Column]:
    row = acc.select(F.struct(*[F.coalesce(F.max(F.when(F.col("metric") == m, F.col("value"))), F.lit(0.0)).alias(n)
                                for n, m in ACCURACY.items()])).scalar()
    return [F.round(row["accuracy"], 4).alias("accuracy"), F.round(row["weighted_acc"], 4).alias("weighted_acc"),
            row["series"].cast("int").alias("series")]


def forecast_headline(fs: DataFrame, acc: DataFrame, kind: str = "qty", plant: str | None = None) -> DataFrame:
    """INS-31 / INS-32: the first forecast month with its bounds, the whole horizon, and the accuracy.

    Months are summed first (a row a month), the first one with a forecast leads.
    """
    f, lo, hi = FORECAST[kind]
    d = for_plant(fs, plant)
    months = d.groupBy("posting_date").agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(n) for c, n in ((f, "f"), (lo, "lo"), (hi, "hi"))])
    ahead = months.where(F.col("f") > 0).agg(F.min_by(F.struct("f", "lo", "hi"), "posting_date").alias("n"), _rows("horizon"))
    rows = d.where(F.col(f) > 0)
    each = rows.select(F.struct(F.coalesce(F.sum(f), F.lit(0.0)).alias("total"), F.countDistinct("material_id").alias("materials"))).scalar()
    at = lambda c: F.round(F.coalesce(F.col(f"n.{c}"), F.lit(0.0)), 4)
    return ahead.select(at("f").alias("next"), at("lo").alias("next_lower"), at("hi").alias("next_upper"), "horizon",
                        F.round(each["total"], 4).alias("total_horizon"),
                        F.round(F.when(F.col("horizon") > 0, each["total"] / F.col("horizon")).otherwise(F.lit(0.0)), 4).alias("avg_month"),
                        each["materials"].alias("materials"), *_accuracy(acc))


def forecast_totals(fs: DataFrame, rep: DataFrame, acc: DataFrame, plant: str | None = None) -> DataFrame:
    """INS-30: next month's demand and cash, and what has to be reordered."""
    need = F.col("replenishment_quantity") > 0
    order = for_plant(rep, plant).select(F.struct(
        F.count_if(need).alias("n"), _sum("replenishment_quantity", "q", need),
        _sum(F.col("replenishment_quantity") * F.coalesce("unit_cost", F.lit(0.0)), "v", need))).scalar()
    cash = forecast_headline(fs, acc, "cash", plant).select("next").scalar()
    return forecast_headline(fs, acc, "qty", plant).select(
        F.col("next").alias("next_demand"), "next_lower", "next_upper", "accuracy", "weighted_acc", "series", "horizon",
        order["n"].alias("replen_skus"), order["q"].alias("replen_qty"), order["v"].alias("replen_value"), cash.alias("cashflow_next"))


def cashflow_categories(fs: DataFrame, dim_material: DataFrame, plant: str | None = None, n: int = 10) -> DataFrame:
    """INS-32: forecast spend by category."""
    groups = dim_material.select(F.col("material").alias("material_id"), F.col("material_group").alias("grp"))
    g = (for_plant(fs, plant).where(F.col("cashflow_forecast") > 0).join(groups, "material_id").where(F.length("grp") > 0)
         .groupBy("grp").agg(F.sum("cashflow_forecast").alias("v")))
    return top_n(g, n, F.desc("v"), "grp").select(clean_category("grp").alias("group"), "grp", r6("v").alias("forecast"))
