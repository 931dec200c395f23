"""Remaining insight sub-blocks (totals and category lists of INS-03/06/07/09/10/12/22/24/27/28/29/30)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carelake.functions.expr import month_index, r6
from carelake.operators.common import for_plant, key_month_grid, top_n
from carelake.operators.order_stats import median


def valuation_totals(inv: DataFrame, plant: str | None = None) -> DataFrame:
    """INS-03 totals: cost, MRP, markup and markup %, SKUs, quantity."""
    d = for_plant(inv, plant)
    c, m = F.sum("total_cost"), F.sum("total_mrp")
    return d.agg(F.round(F.coalesce(c, F.lit(0)).cast("double"), 4).alias("cost"),
                 F.round(F.coalesce(m, F.lit(0)).cast("double"), 4).alias("mrp"),
                 F.round(F.coalesce(m - c, F.lit(0)).cast("double"), 4).alias("markup"),
                 r6(F.when(c != 0, (m - c).cast("double") / c.cast("double") * 100).otherwise(F.lit(0.0))).alias("markup_pct"),
                 F.countDistinct("material").alias("skus"), F.round(F.coalesce(F.sum("qty"), F.lit(0)).cast("double"), 4).alias("qty"))


def doh_totals(doh_frame: DataFrame) -> DataFrame:
    """INS-06 totals: SKU counts, median / mean cover of moving SKUs, values at risk and overstock."""
    d = F.col("doh_days")
    v = F.col("stock_value_cost")
    return doh_frame.agg(
        F.count(F.lit(1)).alias("total_skus"), F.count(d).alias("moving_skus"), F.count_if(d.isNull()).alias("nonmoving_skus"),
        r6(F.coalesce(median(doh_frame, d), F.lit(0.0))).alias("median_doh"), r6(F.coalesce(F.avg(d), F.lit(0.0))).alias("mean_doh"),
        F.round(F.sum(v), 4).alias("total_value"),
        F.round(F.coalesce(F.sum(F.when((d >= 0) & (d < 30), v)), F.lit(0.0)), 4).alias("risk_value"),
        F.count_if((d >= 0) & (d < 30)).alias("risk_count"),
        F.round(F.coalesce(F.sum(F.when((d >= 30) & (d < 90), v)), F.lit(0.0)), 4).alias("healthy_value"),
        F.round(F.coalesce(F.sum(F.when(d >= 365, v)), F.lit(0.0)), 4).alias("overstock_value"),
        F.count_if(d >= 365).alias("overstock_count"),
        F.round(F.coalesce(F.sum(F.when(d.isNull(), v)), F.lit(0.0)), 4).alias("nonmoving_value"))


def health_totals(hs: DataFrame, plant: str | None = None) -> DataFrame:
    """INS-07 totals: mean / median score, SKUs, value, moving and fresh shares."""
    d = for_plant(hs, plant)
    return d.agg(r6(F.coalesce(F.avg("health_score"), F.lit(0.0))).alias("avg_score"),
                 r6(F.coalesce(median(d, F.col("health_score")), F.lit(0.0))).alias("median_score"),
                 F.count(F.lit(1)).alias("total_skus"), F.round(F.sum("closing_stock_value"), 4).alias("total_value"),
                 r6(F.coalesce(F.avg(F.when(F.col("consumption_cost") > 0, 1.0).otherwise(0.0)), F.lit(0.0))).alias("moving_pct"),
                 r6(F.coalesce(F.avg(F.when(F.col("aging_days") <= 90, 1.0).otherwise(0.0)), F.lit(0.0))).alias("fresh_pct"))


def group_value_top(df: DataFrame, value: str, n: int, qty: str | None = None, plant: str | None = None,
                    where=None) -> DataFrame:
    """Category list used by INS-09/10/12: value and SKUs per material group, top-n by value."""
    d = for_plant(df, plant)
    if where is not None:
        d = d.where(where)
    aggs = [F.sum(value).alias("v"), F.countDistinct("material").alias("skus")]
    if qty:
        aggs.append(F.round(F.sum(qty), 4).alias("qty"))
    g = d.groupBy("material_group").agg(*aggs)
    return top_n(g, n, F.desc("v"), F.asc_nulls_last("material_group")).select(
        F.col("material_group").alias("name"), F.round("v", 4).alias("value"), *(["skus", "qty"] if qty else ["skus"]))


def lead_time_totals(lt: DataFrame) -> DataFrame:
    """INS-22 totals: line-weighted median lead time, share of lines with <= 7 days, vendors."""
    gl = F.sum("gr_lines")
    return lt.agg(r6(F.when(gl > 0, F.sum(F.col("median_lead_time_days") * F.col("gr_lines")) / gl).otherwise(F.lit(0.0)))
                  .alias("median"),
                  r6(F.when(gl > 0, 100 * F.coalesce(F.sum(F.when(F.col("median_lead_time_days") <= 7, F.col("gr_lines"))),
                                                     F.lit(0)) / gl).otherwise(F.lit(0.0))).alias("under7"),
                  F.countDistinct("vendor_name").alias("vendors"))


def purchase_top_skus(mp: DataFrame, plant: str | None = None, n: int = 8) -> DataFrame:
    """INS-24 top SKUs by purchase value."""
    g = (for_plant(mp, plant).where(F.col("material").isNotNull() & F.col("material_desc").isNotNull()
                                    & F.col("material_group").isNotNull())
         .groupBy("material", "material_desc", "material_group").agg(F.sum("monthly_purchase_value").alias("v")))
    return top_n(g, n, F.desc("v"), "material").select("material", F.col("material_desc").alias("desc"),
                                                       F.col("material_group").alias("group"), F.round("v", 4).alias("value"))


def consumption_totals(uc: DataFrame, dp: DataFrame, plant: str | None = None) -> DataFrame:
    """INS-27 totals: cost, units, materials, departments, plants, mean per month, last change, top-5 dept share."""
    u, d = for_plant(uc, plant), for_plant(dp, plant)
    o = F.col("year") * 12 + month_index("month")
    m = u.groupBy("year", "month").agg(F.sum("consumption_cost").alias("c")).withColumn("o", o)
    w = Window.orderBy(F.desc("o"))
    r = m.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= 2)
    b = r.where(F.col("rk") == 1).select(F.first("c")).scalar()
    a = r.where(F.col("rk") == 2).select(F.first("c")).scalar()
    dg = d.groupBy("cost_ctr").agg(F.sum("consumption_cost").alias("v"))
    dtot = dg.select(F.sum("v")).scalar()
    top5 = top_n(dg, 5, F.desc("v"), "cost_ctr").select(F.sum("v")).scalar()
    n_months = m.select(F.count(F.lit(1))).scalar()
    cost = u.select(F.sum("consumption_cost")).scalar()
    return u.agg(F.round(F.sum("consumption_cost"), 4).alias("cost"), F.round(F.sum("total_units"), 4).alias("units"),
                 F.countDistinct("material").alias("materials"), F.countDistinct("plant").alias("plants")).select(
        "*", d.select(F.countDistinct("cost_ctr")).scalar().alias("departments"),
        r6(cost / F.greatest(n_months, F.lit(1))).alias("avg_month"),
        r6(F.when(a.isNotNull() & (a != 0), (b - a) / a * 100).otherwise(F.lit(0.0))).alias("last_mom"),
        r6(F.when(dtot != 0, top5 / dtot * 100).otherwise(F.lit(0.0))).alias("dept_top5"))


def units_scatter(uc: DataFrame, plant: str | None = None, n: int = 45) -> DataFrame:
    """INS-28 cost vs units scatter: items with >= 1 unit, top 45 by cost."""
    g = (for_plant(uc, plant).where(F.col("material").isNotNull() & F.col("material_desc").isNotNull())
         .groupBy("material", "material_desc").agg(F.sum("total_units").alias("u"), F.sum("consumption_cost").alias("c"))
         .where(F.col("u") >= 1))
    return top_n(g, n, F.desc("c"), "material").select(
        "material", F.col("material_desc").alias("desc"), F.round("u", 4).alias("units"), F.round("c", 4).alias("cost"),
        r6(F.when(F.col("u") > 0, F.col("c") / F.col("u")).otherwise(F.lit(0.0))).alias("cpu"))


def department_month_matrix(dp: DataFrame, plant: str | None = None, k: int = 6) -> DataFrame:
    """INS-29 top-6 cost centres x month stream, zero-filled."""
    d = for_plant(dp, plant).withColumn("ym", F.format_string("%04d-%02d", F.col("year"), month_index("month") + 1))
    top = top_n(d.groupBy("cost_ctr").agg(F.sum("consumption_cost").alias("t")), k, F.desc("t"), "cost_ctr")
    grid = key_month_grid(top, "cost_ctr", d.select("ym").distinct())
    cells = d.groupBy("cost_ctr", "ym").agg(F.sum("consumption_cost").alias("v"))
    return grid.join(cells, ["cost_ctr", "ym"], "left").select(
        F.col("cost_ctr").alias("name"), "ym", F.round(F.coalesce("v", F.lit(0.0)), 4).alias("value"))


def forecast_status_counts(radar: DataFrame, arf: DataFrame, plant: str | None = None) -> DataFrame:
    """INS-30 radar and aging-forecast value counts (AGG-10)."""
    a = for_plant(radar, plant).groupBy(F.col("radar_status").alias("status")).agg(F.count(F.lit(1)).alias("count"))
    b = for_plant(arf, plant).groupBy(F.col("aging_risk_forecast").alias("status")).agg(F.count(F.lit(1)).alias("count"))
    return a.withColumn("kind", F.lit("radar")).unionByName(b.withColumn("kind", F.lit("aging")))
