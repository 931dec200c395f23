"""CAT-01..07: parameterised analyses (the analyst tool registry as plain functions).

``run_tool(name, lake, **params)`` ignores unknown parameters, like the reference's
registry; each function returns one DataFrame.
"""
from __future__ import annotations

import inspect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.functions.expr import EXPIRY_SLABS, aging_bucket_rank, clean_category, month_index, r6, round_half_even
from carelake.operators.common import band_table, for_plant, top_n


def _margins(df: DataFrame) -> DataFrame:
    return (df.withColumn("margin", F.round(F.col("revenue") - F.col("cost"), 4))
              .withColumn("margin_pct", r6(F.when(F.col("revenue") > 0, (F.col("revenue") - F.col("cost"))
                                                  / F.col("revenue") * 100).otherwise(F.lit(0.0)))))


def revenue(grains: dict, dimension: str = "manufacturer", metric: str = "revenue", top_n_: int = 10) -> DataFrame:
    """CAT-01: revenue / margin by manufacturer, hospital, category, material or month."""
    dimension = (dimension or "manufacturer").lower().strip()
    sortcol = metric if metric in ("revenue", "margin", "margin_pct", "qty") else "revenue"
    if dimension == "month":
        m = grains["sales_monthly"].groupBy("month").agg(*[F.round(F.sum(c), 4).alias(c) for c in ("revenue", "cost", "qty")])
        return _margins(m).select(F.date_format(F.to_date(F.concat(F.col("month"), F.lit("-01"))), "MMM yy").alias("name"),
                                  "month", "revenue", "margin", "margin_pct", "qty")
    src = {"manufacturer": "sales_by_manufacturer", "hospital": "sales_by_hospital",
           "material": "sales_by_material", "category": "sales_by_material"}.get(dimension, "sales_by_manufacturer")
    df = grains[src]
    if dimension == "category":
        g = (df.withColumn("name", clean_category("material_group")).groupBy("name")
               .agg(*[F.round(F.sum(c), 4).alias(c) for c in ("revenue", "cost", "qty")]))
    elif dimension == "material":
        g = df.select(F.col("material_desc").alias("name"), "material", "revenue", "cost", "qty")
    else:
        g = df.select(F.col("manufacturer" if dimension == "manufacturer" else "hospital").alias("name"),
                      "revenue", "cost", "qty")
    tie = ["name"] + (["material"] if "material" in g.columns else [])
    return top_n(_margins(g), top_n_, F.desc(sortcol), *tie).select("name", "revenue", "margin", "margin_pct", "qty")


def procurement(vv: DataFrame, pv: DataFrame, loc: DataFrame, po: DataFrame, grn: DataFrame,
                view: str = "spend", dimension: str = "vendor", top_n_: int = 10) -> DataFrame:
    """CAT-02: vendor / category / location / month spend, open POs, savings."""
    view, dimension = (view or "spend").lower().strip(), (dimension or "vendor").lower().strip()
    if view in ("vendors", "spend") and dimension == "vendor":
        total = vv.select(F.sum("vendor_value")).scalar()
        v = vv.groupBy("vendor_name").agg(F.sum("vendor_value").alias("s"), F.sum("po_lines").alias("po_lines"))
        return (top_n(v, top_n_, F.desc("s"), F.asc_nulls_last("vendor_name"))
                .select(F.col("vendor_name").alias("name"), F.round("s", 4).alias("spend"),
                        r6(F.when(total > 0, F.col("s") / total * 100).otherwise(F.lit(0.0))).alias("share_pct"), "po_lines"))
    if view == "spend" and dimension == "category":
        g = pv.withColumn("name", clean_category("category")).groupBy("name").agg(F.sum("purchase_value").alias("s"))
        return top_n(g, top_n_, F.desc("s"), "name").select("name", F.round("s", 4).alias("spend"))
    if view == "spend" and dimension == "location":
        return top_n(loc, top_n_, F.desc("purchase_value"), "plant").select(F.col("plant").alias("name"),
                                                                           F.col("purchase_value").alias("spend"))
    if view == "spend" and dimension == "month":
        ym = F.format_string("%04d-%02d", F.col("year"), month_index("month") + 1)      # D5: month number
        return pv.groupBy(ym.alias("ym")).agg(F.round(F.sum("purchase_value"), 4).alias("spend")).select(
            F.date_format(F.to_date(F.concat("ym", F.lit("-01"))), "MMM yy").alias("name"), "ym", "spend")
    if view == "open_po":
        op = (po.where(F.col("open_qty") > 0).withColumn("ov", F.col("open_qty") * F.col("net_price"))
                .withColumn("name", clean_category("major_group")))
        g = op.groupBy("name").agg(F.sum("ov").alias("ov"), F.countDistinct("po_no").alias("open_pos"))
        return top_n(g, top_n_, F.desc("ov"), "name").select("name", F.round(F.col("ov").cast("double"), 4)
                                                             .alias("open_value"), "open_pos")
    if view == "savings":
        from carelake.operators.insights_procurement import procurement_savings
        s = procurement_savings(grn, limit=top_n_)
        return s.select(F.col("desc").alias("name"), F.col("over").alias("overpay"),
                        F.col("median").alias("median_price"), F.col("max").alias("max_price"))
    return procurement(vv, pv, loc, po, grn, "vendors", "vendor", top_n_)


def inventory(k: dict, view: str = "stock_value", top_n_: int = 10, plant: str | None = None) -> DataFrame:
    """CAT-03: stock value, days of cover, aging, non-moving, health, expiry."""
    view = (view or "stock_value").lower().strip()
    if view == "expiry":
        return expiry(for_plant(k["fact_inventory_expiry"], plant))
    if view == "stock_value":
        sv = for_plant(k["kpi_stock_value"], plant).withColumn("name", clean_category("material_group"))
        g = sv.groupBy("name").agg(F.round(F.sum("stock_value_cost"), 4).alias("value"),
                                   F.countDistinct("material").alias("skus"))
        return top_n(g, top_n_, F.desc("value"), "name")
    if view == "doh":
        d = for_plant(k["kpi_doh"], plant).withColumn("name", clean_category("material_group"))
        g = (d.groupBy("name").agg(F.sum("stock_qty").alias("q"), F.sum("avg_daily_consumption").alias("daily"))
              .withColumn("doh", F.when(F.col("daily") > 0, F.col("q") / F.col("daily"))).where(F.col("doh").isNotNull()))
        return top_n(g, top_n_, F.desc("doh"), "name").select("name", round_half_even("doh", 1).alias("doh_days"))
    if view == "aging":
        ag = for_plant(k["kpi_aging_distribution"], plant)
        return (ag.groupBy("aging_bucket").agg(F.round(F.sum("stock_value"), 4).alias("value"),
                                               F.sum("sku_count").alias("skus"))
                  .select(F.col("aging_bucket").alias("name"), "value", "skus",
                          aging_bucket_rank("aging_bucket").alias("ord")))          # D6: bucket rank
    if view == "non_moving":
        nm = for_plant(k["kpi_non_moving"], plant)
        return (top_n(nm, top_n_, F.desc("closing_stock_value"), "material", "plant")
                .select(F.col("material_desc").alias("name"), F.col("closing_stock_value").alias("value"),
                        F.col("aging_days").cast("int").alias("aging_days")))
    if view == "health":
        hs = for_plant(k["kpi_health_score"], plant)
        return hs.groupBy("health_tier").agg(F.countDistinct("material").alias("skus"),
                                             F.round(F.sum("closing_stock_value"), 4).alias("value")).withColumnRenamed(
            "health_tier", "name")
    raise ValueError(f"unknown inventory view: {view}")


def expiry(inv_expiry: DataFrame) -> DataFrame:
    """CAT-04: the six-band expiry ladder (value and items)."""
    return band_table(inv_expiry, F.col("slab"), EXPIRY_SLABS,
                      {"value": ("sum", "total_cost"), "items": ("nunique", "material")}).withColumnRenamed("label", "name")


def stock_risk(rep: DataFrame, status: str | None = None, top_n_: int = 15, plant: str | None = None) -> DataFrame:
    """CAT-05: reorder list, or the aging-risk summary."""
    df = for_plant(rep, plant)
    status = (status or "").lower().strip()
    if status in ("stock-out", "stockout", "reorder", "order"):
        risk = df.where(F.col("replenishment_quantity") > 0)
        return (top_n(risk, top_n_, F.desc("replenishment_quantity"), "material_id", "plant")
                .select(F.col("material_desc").alias("name"), F.col("replenishment_quantity").alias("reorder_qty"),
                        F.col("closing_stock").alias("on_hand"), F.col("demand_monthly").alias("monthly_demand")))
    return df.groupBy("aging_risk").agg(F.countDistinct("material_id").alias("skus"),
                                        F.round(F.sum("closing_stock_value"), 4).alias("value")).withColumnRenamed(
        "aging_risk", "name")


def forecast(radar: DataFrame, plant: str | None = None) -> DataFrame:
    """CAT-06: radar status mix with forecast demand."""
    return (for_plant(radar, plant).groupBy("radar_status")
            .agg(F.countDistinct("material_id").alias("skus"), F.round(F.sum("demand_forecast"), 4).alias("forecast_demand"))
            .withColumnRenamed("radar_status", "name"))


def forecast_fulfillment(ful: DataFrame, plant: str | None = None) -> DataFrame:
    """CAT-06 (decision D7): mean fulfilment, returned separately from the radar mix."""
    return for_plant(ful, plant).agg(round_half_even(F.avg("fulfillment_rate"), 1).alias("fulfillment_pct"),
                                     F.count(F.lit(1)).alias("skus"))


def overview(spark, sales_totals: DataFrame, stock_value: DataFrame, pv: DataFrame, inv_expiry: DataFrame) -> DataFrame:
    """CAT-07: headline scalars (scalar subqueries), stacked to (name, value) rows."""
    rev = sales_totals.select(F.sum("revenue")).scalar()
    cost = sales_totals.select(F.sum("cost")).scalar()
    within = inv_expiry.where(F.col("slab").isin("Expired", "0-30d", "31-90d", "91-180d")).select(
        F.coalesce(F.sum("total_cost"), F.lit(0)).cast("double")).scalar()
    row = spark.range(1).select(
        F.round(rev, 4).alias("v0"), F.round(rev - cost, 4).alias("v1"),
        r6(F.when(rev != 0, (rev - cost) / rev * 100).otherwise(F.lit(0.0))).alias("v2"),
        F.round(stock_value.select(F.sum("stock_value_cost")).scalar(), 4).alias("v3"),
        F.round(pv.select(F.sum("purchase_value")).scalar(), 4).alias("v4"), F.round(within, 4).alias("v5"))
    return row.selectExpr("stack(6, 'Revenue', v0, 'Margin', v1, 'Margin Pct', v2, 'Stock Value', v3, "
                          "'Purchase Value', v4, 'Expiry Within 180D', v5) AS (name, value)")


TOOLS = {"revenue": revenue, "procurement": procurement, "inventory": inventory, "expiry": expiry,
         "stock_risk": stock_risk, "forecast": forecast, "overview": overview}


def run_tool(fn, *inputs, **params):
    """Call an analysis with only the parameters it accepts (unknown ones are ignored)."""
    ok = {k: v for k, v in params.items() if k in inspect.signature(fn).parameters}
    return fn(*inputs, **ok)
