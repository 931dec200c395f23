"""KPI-*: batch KPI aggregates over the curated facts.

Every builder is DataFrame-in / DataFrame-out and lazy. Sums run on the DECIMAL fact
columns (exact and order-independent) and are converted to DOUBLE only at the edge.
Scalars that the reference computes globally (snapshot date, consumption span) are
scalar subqueries (``DataFrame.scalar()``): Spark runs them as a one-row aggregate
with map-side partials, never as a collect or a single-partition window.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carelake.functions.expr import (aging_bucket, fill_category, health_score, health_tier,
                                     month_index, money, near_expiry_bucket, non_moving_reason,
                                     plausible_days, r6, risk_level, safe_div)

KEY4 = ["plant", "material", "material_desc", "material_group"]


# ------------------------------------------------------------------ scalars
def snapshot_of(inv: DataFrame) -> Column:
    """Inventory snapshot date = max(snapshot_date), as a scalar subquery."""
    return inv.select(F.max("snapshot_date")).scalar()


def consumption_span_days(cons: DataFrame) -> Column:
    """max - min posting date, at least 1 (days)."""
    return cons.select(F.greatest(F.datediff(F.max("posting_date"), F.min("posting_date")),
                                  F.lit(1))).scalar()


def material_meta(dim_material: DataFrame) -> DataFrame:
    return dim_material.select("material", "material_desc", "material_group")


# ------------------------------------------------------------------ inventory
def stock_items(inv: DataFrame, cons: DataFrame | None = None, sums: tuple = ("qty", "cost", "mrp", "age", "grn")) -> DataFrame:
    """What the stock KPIs sum per plant x material, in one pass, or some of these ``sums``; with ``cons`` also
    what was consumed of it. KPI-A1, A2, A3 and A8 take this frame as ``items`` if it is at hand."""
    made = {"qty": lambda: F.sum("qty"), "cost": lambda: F.sum("total_cost"), "mrp": lambda: F.sum("total_mrp"),
            "age": lambda: _weighted_age(inv), "grn": lambda: F.max("grn_date")}
    items = inv.groupBy(*KEY4).agg(*[made[s]().alias(f"item_{s}") for s in sums])
    return items if cons is None else _with_consumption(items, cons, "qty", "amount_lc")


def kpi_stock_value(inv: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """KPI-A1: qty, cost, MRP by plant x material (null keys kept, N2)."""
    items = items if items is not None else stock_items(inv, sums=("qty", "cost", "mrp"))
    return items.select(*KEY4, money("item_qty").alias("stock_qty"), money("item_cost").alias("stock_value_cost"),
                        money("item_mrp").alias("stock_value_mrp"))


def kpi_aging_distribution(inv: DataFrame) -> DataFrame:
    """KPI-A7: value, qty and distinct SKUs by plant x group x aging bucket."""
    return (inv.withColumn("aging_bucket", aging_bucket("aging_days"))
               .groupBy("plant", "material_group", "aging_bucket")
               .agg(money(F.sum("total_cost")).alias("stock_value"),
                    money(F.sum("qty")).alias("stock_qty"),
                    F.countDistinct("material").alias("sku_count")))


def _weighted_age(inv: DataFrame) -> Column:
    """AGG-02 with N7: qty-weighted age, weights clipped at 0.0001; any NULL age -> NULL."""
    w = F.greatest(F.col("qty").cast("decimal(16,4)"), F.lit(0.0001).cast("decimal(16,4)"))
    num = F.sum(F.col("aging_days").cast("decimal(12,0)") * w)
    return F.when(F.count(F.lit(1)) == F.count("aging_days"),
                  num.cast("double") / F.sum(w).cast("double"))


def last_sale(cons: DataFrame) -> DataFrame:
    return cons.groupBy("material").agg(F.max("posting_date").alias("last_sale_date"))


def last_purchase(inv: DataFrame) -> DataFrame:
    return inv.groupBy("material").agg(F.max("grn_date").alias("last_purchase_date"))


def _snap(inv: DataFrame, snapshot: Column | None) -> Column:
    """The run's snapshot date: the given parameter, else max(snapshot_date) of the data."""
    return snapshot if snapshot is not None else snapshot_of(inv)


def kpi_inventory_aging(inv: DataFrame, cons: DataFrame, snapshot: Column | None = None,
                        items: DataFrame | None = None) -> DataFrame:
    """KPI-A2: closing stock, qty-weighted age, days since last issue / receipt."""
    snap = _snap(inv, snapshot)
    a2 = (items if items is not None else stock_items(inv, sums=("qty", "cost", "age", "grn"))).select(
        *KEY4, money("item_qty").alias("closing_stock_quantity"), money("item_cost").alias("closing_stock_value"),
        r6("item_age").alias("aging_days"), F.col("item_grn").alias("_lp"))
    # last receipt per material across plants: a window over the aggregated rows instead
    # of a second inventory scan (NULL material never matches, as in a keyed lookup)
    lp = F.when(F.col("material").isNotNull(), F.max("_lp").over(Window.partitionBy("material")))
    return (a2.withColumn("last_purchase_date", lp).drop("_lp")
              .join(last_sale(cons), "material", "left")
              .withColumn("age_since_last_sale_days", F.datediff(snap, "last_sale_date"))
              .withColumn("age_since_last_purchase_days", F.datediff(snap, "last_purchase_date"))
              .withColumn("aging_category", aging_bucket("aging_days"))
              .select(*KEY4, "closing_stock_quantity", "closing_stock_value", "aging_days", "last_sale_date",
                      "last_purchase_date", "age_since_last_sale_days", "age_since_last_purchase_days",
                      "aging_category"))


def _with_consumption(items: DataFrame, cons: DataFrame, *measures: str) -> DataFrame:
    """``items`` and the consumption of their plant x material, 0 where there is none."""
    names = {"qty": "consumption_qty", "amount_lc": "consumption_cost"}
    used = (cons.where(F.col("plant").isNotNull() & F.col("material").isNotNull())
                .groupBy("plant", "material").agg(*[F.sum(m).alias(names[m]) for m in measures]))
    return items.join(used, ["plant", "material"], "left").withColumns(
        {names[m]: F.coalesce(names[m], F.lit(0)) for m in measures})


def kpi_doh(inv: DataFrame, cons: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """KPI-A3: days on hand = stock / (consumption / span days); NULL without demand."""
    span = consumption_span_days(cons)
    items = items if items is not None else _with_consumption(stock_items(inv, sums=("qty",)), cons, "qty")
    daily = F.col("consumption_qty").cast("double") / span
    return items.select(*KEY4, money("item_qty").alias("stock_qty"),
                        money("consumption_qty").alias("consumption_qty"),
                        r6(daily).alias("avg_daily_consumption"),
                        r6(F.when(daily > 0, F.col("item_qty").cast("double") / daily)).alias("doh_days"))


def kpi_health_score(inv: DataFrame, cons: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """KPI-A8: annualised turnover and the weighted health score with tiers."""
    span = consumption_span_days(cons)
    months = F.greatest(span / F.lit(30.0), F.lit(1.0))
    items = items if items is not None else _with_consumption(stock_items(inv, sums=("cost", "age")), cons, "amount_lc")
    a8 = items.select(*KEY4, F.col("item_cost").alias("closing_stock_value"), F.col("item_age").alias("aging_days"),
                      "consumption_cost")
    turnover = F.when(F.col("closing_stock_value") > 0,
                      F.col("consumption_cost").cast("double") / F.col("closing_stock_value").cast("double")
                      * (F.lit(12.0) / months)).otherwise(F.lit(0.0))
    score = health_score("aging_days", "turnover_annualized", "consumption_cost")
    return (a8.withColumn("turnover_annualized", turnover)
              .withColumn("health_score", score)
              .select(*KEY4, money("closing_stock_value").alias("closing_stock_value"),
                      r6("aging_days").alias("aging_days"),
                      money("consumption_cost").alias("consumption_cost"),
                      r6("turnover_annualized").alias("turnover_annualized"),
                      "health_score", health_tier("health_score").alias("health_tier")))


def consumed_flag(df: DataFrame, cons: DataFrame, name: str = "consumed") -> DataFrame:
    """JON-06: membership of material in the consumed set, as a boolean column.

    The consumed-material list is a distinct projection (bounded by the material
    master), joined with a left join; AQE broadcasts it when it is small.
    """
    mats = (cons.where(F.col("material").isNotNull()).select("material").distinct()
                .withColumn("_hit", F.lit(True)))
    return (df.join(mats, "material", "left")
              .withColumn(name, F.coalesce("_hit", F.lit(False))).drop("_hit"))


def kpi_non_moving(inv: DataFrame, cons: DataFrame, snapshot: Column | None = None, aging: DataFrame | None = None) -> DataFrame:
    """KPI-A9: not consumed anywhere in the window, or qty-weighted age > 180; ``aging`` is KPI-A2 if it is at hand."""
    a2 = aging if aging is not None else kpi_inventory_aging(inv, cons, snapshot)
    a9 = consumed_flag(a2, cons, "consumed_in_window")
    return (a9.where(~F.col("consumed_in_window") | (F.col("aging_days") > 180))
              .select(*KEY4, "closing_stock_quantity", "closing_stock_value", "aging_days",
                      "last_sale_date", non_moving_reason("consumed_in_window").alias("reason")))


def kpi_risk_classification(inv: DataFrame, cons: DataFrame, snapshot: Column | None = None, aging: DataFrame | None = None) -> DataFrame:
    """KPI-A10: High / Medium / Low with the nearest batch expiry; ``aging`` is KPI-A2 if it is at hand."""
    snap = _snap(inv, snapshot)
    a2 = aging if aging is not None else kpi_inventory_aging(inv, cons, snap)
    a2 = a2.select(*KEY4, "closing_stock_quantity", "closing_stock_value", "aging_days")
    exp = (inv.where(F.col("plant").isNotNull() & F.col("material").isNotNull())
              .groupBy("plant", "material").agg(F.min("expiry_date").alias("nearest_expiry")))
    a10 = (a2.join(exp, ["plant", "material"], "left")
             .withColumn("days_to_expiry", F.datediff("nearest_expiry", snap)))
    a10 = consumed_flag(a10, cons)
    return a10.withColumn("risk_level", risk_level("days_to_expiry", "aging_days", "consumed"))


def kpi_near_expiry(inv: DataFrame, snapshot: Column | None = None) -> DataFrame:
    """KPI-E1: batch rows expiring within 180 days (or expired)."""
    snap = _snap(inv, snapshot)
    return (inv.where(F.col("expiry_date").isNotNull())
               .withColumn("days_to_expiry", F.datediff("expiry_date", snap))
               .where(F.col("days_to_expiry") <= 180)
               .select(*KEY4, "batch", "expiry_date", "days_to_expiry",
                       near_expiry_bucket("days_to_expiry").alias("expiry_bucket"),
                       money("qty").alias("qty"), money("total_cost").alias("total_cost"),
                       money("total_mrp").alias("total_mrp")))


# ------------------------------------------------------------------ stock change
def kpi_stock_change(grn: DataFrame, cons: DataFrame, dim_material: DataFrame) -> DataFrame:
    """KPI-A6: inflow (GRN) - outflow (consumption) per plant x material x month."""
    k = ["plant", "material", "year", "month"]
    # JON-04 as union + ONE groupBy: identical to a full outer join of the two per-key sums
    # with missing sides = 0, NULL keys (capex lines) group together, and a single shuffle
    # replaces two aggregations plus a null-safe join (which would re-shuffle both sides).
    zero = F.lit(0).cast("decimal(12,2)")
    flows = (grn.select(*k, F.col("gr_qty").alias("inflow"), zero.alias("outflow"))
                .unionByName(cons.select(*k, zero.alias("inflow"), F.col("qty").alias("outflow"))))
    m = flows.groupBy(*k).agg(F.sum("inflow").alias("inflow"), F.sum("outflow").alias("outflow"))
    meta = material_meta(dim_material)
    return (m.join(meta, "material", "left")
             .select("year", "month", "plant", "material", "material_desc",
                     F.coalesce("material_group", F.lit("")).alias("material_group"),
                     money("inflow").alias("inflow"), money("outflow").alias("outflow"),
                     money(F.col("inflow") - F.col("outflow")).alias("stock_change")))


def kpi_stock_change_by_group(stock_change: DataFrame) -> DataFrame:
    return (stock_change.groupBy("year", "month", "plant", "material_group")
                        .agg(F.round(F.sum("stock_change"), 4).alias("stock_change")))


# ------------------------------------------------------------------ procurement
def kpi_purchase_value(po: DataFrame) -> DataFrame:
    """KPI-B1: purchase value by plant x vendor x category x month."""
    return (po.withColumn("category", fill_category("major_group"))
              .groupBy("plant", "vendor_name", "category", "year", "month")
              .agg(money(F.sum("total_value_wo_tax")).alias("purchase_value"),
                   money(F.sum("po_qty")).alias("purchase_qty"),
                   F.count("po_no").alias("po_lines")))


def kpi_monthly_purchase_value(po: DataFrame, dim_material: DataFrame) -> DataFrame:
    """KPI-B2."""
    b2 = (po.groupBy("plant", "material", "year", "month")
            .agg(F.sum("total_value_wo_tax").alias("v"), F.sum("po_qty").alias("q")))
    return (b2.join(material_meta(dim_material), "material", "left")
              .select("year", "month", "plant", "material", "material_desc", "material_group",
                      money("v").alias("monthly_purchase_value"), money("q").alias("purchase_qty")))


def kpi_procurement_variance(po: DataFrame) -> DataFrame:
    """KPI-B3: month-on-month change of plant purchase value (WIN-01)."""
    monthly = (po.groupBy("plant", "year", "month")
                 .agg(F.sum("total_value_wo_tax").alias("pv")))
    w = Window.partitionBy("plant").orderBy("year", month_index("month"))
    prev = F.lag("pv", 1).over(w)
    return (monthly.withColumn("prev", prev)
                   .select("plant", "year", "month", money("pv").alias("purchase_value"),
                           money("prev").alias("prev_value"),
                           money(F.col("pv") - F.col("prev")).alias("variance_abs"),
                           r6(F.when(F.coalesce("prev", F.lit(0)) > 0,
                                     (F.col("pv") - F.col("prev")).cast("double")
                                     / F.col("prev").cast("double") * 100.0)).alias("variance_pct")))


def kpi_vendor_volume(po: DataFrame) -> DataFrame:
    """KPI-B4: vendor value and its share of the plant total (WIN-02 on aggregated rows)."""
    vend = (po.groupBy("plant", "vendor_name")
              .agg(F.sum("total_value_wo_tax").alias("v"), F.sum("po_qty").alias("q"),
                   F.count("po_no").alias("po_lines")))
    tot = F.sum("v").over(Window.partitionBy("plant"))
    return vend.select("plant", "vendor_name", money("v").alias("vendor_value"),
                       money("q").alias("vendor_qty"), "po_lines",
                       r6(safe_div(F.col("v") * 100, tot, 0.0)).alias("value_share_pct"))


def kpi_purchase_by_location(po: DataFrame) -> DataFrame:
    """KPI-B7."""
    return (po.groupBy("plant")
              .agg(money(F.sum("total_value_wo_tax")).alias("purchase_value"),
                   money(F.sum("po_qty")).alias("purchase_qty"),
                   F.countDistinct("vendor_name").alias("vendor_count"),
                   F.count("po_no").alias("po_lines")))


# ------------------------------------------------------------------ consumption
def kpi_units_consumed(cons: DataFrame, dim_material: DataFrame) -> DataFrame:
    """KPI-C8."""
    c8 = (cons.groupBy("plant", "material", "year", "month")
              .agg(F.sum("qty").alias("u"), F.sum("amount_lc").alias("v")))
    return (c8.join(material_meta(dim_material), "material", "left")
              .select("year", "month", "plant", "material", "material_desc", "material_group",
                      money("u").alias("total_units"), money("v").alias("consumption_cost")))


def kpi_consumption_by_department(cons: DataFrame, dim_costcenter: DataFrame) -> DataFrame:
    """KPI-C9 (JON-03: cost-centre name falls back to the code)."""
    c9 = (cons.groupBy("plant", "cost_ctr", "year", "month")
              .agg(money(F.sum("qty")).alias("consumption_qty"),
                   money(F.sum("amount_lc")).alias("consumption_cost")))
    return (c9.join(dim_costcenter, "cost_ctr", "left")
              .withColumn("department_name", F.coalesce("department_name", "cost_ctr")))


# ------------------------------------------------------------------ cycle / lead / fill
def clean_tat(grn: DataFrame) -> DataFrame:
    """COL-16 on both turnaround columns."""
    return (grn.withColumn("po_to_gr_tat", plausible_days("po_to_gr_tat"))
               .withColumn("pr_to_gr_tat", plausible_days("pr_to_gr_tat")))


def kpi_cycle_time(grn: DataFrame) -> DataFrame:
    """KPI-E2."""
    return (clean_tat(grn).groupBy("plant", "year", "month")
                          .agg(r6(F.avg("po_to_gr_tat")).alias("avg_po_to_gr_tat"),
                               r6(F.avg("pr_to_gr_tat")).alias("avg_pr_to_gr_tat"),
                               F.count("gr_no").alias("gr_lines")))


def kpi_vendor_lead_time(grn: DataFrame, min_lines: int = 3) -> DataFrame:
    """KPI-E3: mean and exact median lead time per vendor, >= 3 receipt lines."""
    days = F.col("po_to_gr_tat")
    counted = clean_tat(grn).groupBy("vendor_name", days).agg(F.count(F.lit(1)).alias("n"),
                                                              F.count("gr_no").alias("lines"))
    known = F.sum(F.when(days.isNotNull(), F.col("n")))
    return (counted.groupBy("vendor_name")
                   .agg(r6(F.sum(days * F.col("n")) / known).alias("avg_lead_time_days"),
                        r6(F.percentile(days, F.lit(0.5), F.col("n"))).alias("median_lead_time_days"),
                        F.sum("lines").alias("gr_lines"))
                   .where(F.col("gr_lines") >= min_lines))


def kpi_fill_rate(po: DataFrame) -> DataFrame:
    """KPI-E4: (1 - open / ordered) * 100 per plant."""
    fr = po.groupBy("plant").agg(F.sum("po_qty").alias("o"), F.sum("open_qty").alias("op"))
    return fr.select("plant", money("o").alias("ordered_qty"), money("op").alias("open_qty"),
                     r6(F.when(F.col("o") > 0, (F.lit(1.0) - F.col("op").cast("double")
                                                 / F.col("o").cast("double")) * 100.0))
                     .alias("fill_rate_pct"))
