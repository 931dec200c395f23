"""SQL-01..23: the analyst cookbook, re-expressed as DataFrame operators.

Item-parameterised recipes (one named material, one category) take the parameter as
an optional filter; without it they run over every item, which is the form registered
as a query. Nothing here emits all pairs within a group: "same material at other
plants" is answered with per-material totals minus the plant's own share.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carelake.functions.expr import CAPEX_DOC_TYPES, is_capex, money, r6
from carelake.operators.common import key_medians
from carelake.operators.order_stats import medians
from carelake.operators.marts import BAND, PRICE_FLOOR, STABLE_N, _raw_prices, clean_band


def revenue_margin(sales_totals: DataFrame) -> DataFrame:
    """SQL-01: company revenue, margin and margin %."""
    r, c = F.sum("revenue"), F.sum("cost")
    return sales_totals.agg(F.round(r, 4).alias("revenue"), F.round(r - c, 4).alias("margin"),
                            r6(F.when(r > 0, (r - c) / r * 100)).alias("margin_pct"))


def top_manufacturers(by_mfr: DataFrame, n: int = 10) -> DataFrame:
    """SQL-02."""
    return (by_mfr.orderBy(F.desc("revenue"), "manufacturer").limit(n)
                  .select("manufacturer", "revenue", F.round(F.col("revenue") - F.col("cost"), 4).alias("margin"),
                          r6(F.when(F.col("revenue") > 0, (F.col("revenue") - F.col("cost")) / F.col("revenue") * 100))
                          .alias("margin_pct")))


def expiring_by_manufacturer(inv: DataFrame, dim_material: DataFrame, snapshot, days: int = 90,
                             n: int = 10) -> DataFrame:
    """SQL-03: manufacturers with positive stock expiring within ``days`` of the snapshot."""
    d = F.datediff("expiry_date", snapshot)
    e = inv.where((F.col("qty") > 0) & F.col("expiry_date").isNotNull() & d.between(0, days)).drop("manufacturer_desc")
    return (e.join(dim_material.select("material", "manufacturer_desc"), "material")
             .groupBy(F.col("manufacturer_desc").alias("manufacturer"))
             .agg(F.sum("total_cost").alias("v"), F.countDistinct("material").alias("items"))
             .orderBy(F.desc("v"), F.asc_nulls_last("manufacturer")).limit(n)
             .select("manufacturer", money("v").alias("expiring_value"), "items"))


def _clean_with_median(grn: DataFrame) -> DataFrame:
    raw = _raw_prices(grn)
    clean = clean_band(raw, ["material"])
    med = key_medians(clean, ["material"], "price", "med_price").where(F.col("n") >= STABLE_N)
    return clean.join(med, "material")


def price_deviation(grn: DataFrame, one_directional: bool = False, n: int = 10) -> DataFrame:
    """SQL-04: sum |price - clean median| * qty (or only the overpaid side) per material."""
    g = _clean_with_median(grn)
    dev = F.col("price") - F.col("med_price")
    term = F.greatest(dev, F.lit(0.0)) if one_directional else F.abs(dev)
    name = "overpay_impact" if one_directional else "price_deviation_impact"
    return (g.groupBy("material")
             .agg(F.min("material_desc").alias("item"), F.sum(term * F.col("gr_qty").cast("double")).alias("v"))
             .orderBy(F.desc("v"), "material").limit(n)
             .select("material", "item", r6("v").alias(name)))


def price_by_plant(mart_proc: DataFrame, material: str | None = None) -> DataFrame:
    """SQL-05: per-unit price of an item across plants, with an anomaly flag."""
    df = mart_proc.where(F.col("material").isNotNull())
    if material:
        df = df.where(F.col("material") == material)
    prices = df.groupBy("material", "plant", "unit_price").agg(
        F.count(F.lit(1)).alias("n"), F.sum("qty").alias("q"), F.bool_or("is_price_outlier").alias("out"))
    return (prices.groupBy("material", "plant")
                  .agg(r6(F.percentile("unit_price", F.lit(0.5), F.col("n"))).alias("unit_price"),
                       F.round(F.sum("q"), 4).alias("qty"), F.bool_or("out").alias("looks_anomalous")))


def cheapest_vendor(vendor_stats: DataFrame, material: str | None = None) -> DataFrame:
    """SQL-06: cheapest stable vendor per material (ties -> vendor name)."""
    df = vendor_stats.where(F.col("price_is_stable"))
    if material:
        df = df.where(F.col("material") == material)
    best = F.min(F.struct("clean_median_price", "vendor_name", "clean_n", "total_qty"))
    return (df.groupBy("material").agg(best.alias("b"), F.count(F.lit(1)).alias("stable_vendors"))
              .select("material", F.col("b.vendor_name").alias("vendor_name"),
                      F.col("b.clean_median_price").alias("clean_median_price"),
                      F.col("b.clean_n").alias("clean_n"), F.col("b.total_qty").alias("total_qty"),
                      "stable_vendors"))


def consolidation_saving(vendor_stats: DataFrame) -> DataFrame:
    """SQL-06: (current weighted price - cheapest stable price) * qty, stable alternatives only."""
    cur = vendor_stats.groupBy("material").agg(F.sum("total_value").alias("tv"), F.sum("total_qty").alias("tq"))
    best = cheapest_vendor(vendor_stats).select("material", F.col("clean_median_price").alias("best_price"),
                                                F.col("vendor_name").alias("best_vendor"))
    j = cur.join(best, "material").where(F.col("tq") > 0)
    saving = F.col("tv") - F.col("best_price") * F.col("tq")
    return (j.withColumn("saving", saving).where(F.col("saving") > 0)
             .select("material", "best_vendor", r6("best_price").alias("best_price"),
                     r6(F.col("tv") / F.col("tq")).alias("current_price"), F.round("tq", 4).alias("qty"),
                     r6("saving").alias("saving")))


def price_dispersion(price_stats: DataFrame, min_price: float = 100, n: int = 10) -> DataFrame:
    """SQL-07: the dispersion audit inside the clean band."""
    return (price_stats.where((F.col("clean_n") >= STABLE_N) & (F.col("clean_median_price") >= min_price))
                       .orderBy(F.desc("clean_price_spread"), "material").limit(n)
                       .select("material_desc", "category", "clean_median_price", "clean_min_price",
                               "clean_max_price", "clean_n", "clean_price_spread",
                               r6(F.col("clean_max_price") / F.nullif(F.col("clean_min_price"), F.lit(0.0)))
                               .alias("price_ratio")))


def vendor_inconsistency(mart_proc: DataFrame, min_lines: int = 20, n: int = 10) -> DataFrame:
    """SQL-08: vendors with the most outlier lines among repeat suppliers."""
    return (mart_proc.groupBy("vendor_name")
                     .agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("material").alias("items"),
                          F.count_if("is_price_outlier").alias("flagged"))
                     .where((F.col("lines") >= min_lines) & (F.col("flagged") > 0))
                     .orderBy(F.desc("flagged"), "vendor_name").limit(n))


def capex_split(po: DataFrame, types: list = CAPEX_DOC_TYPES) -> DataFrame:
    """SQL-09 / COL-32; ``types`` are the document types that are capital or service orders."""
    t = F.when(is_capex("doc_type", "material", types), "Capex/Service").otherwise("Supply")
    return po.groupBy(t.alias("spend_type")).agg(F.count(F.lit(1)).alias("lines"),
                                                 money(F.sum("total_value_wo_tax")).alias("value"))


def price_lookup(price_stats: DataFrame, pattern: str) -> DataFrame:
    """SQL-10: price of a named item (ILIKE on the description)."""
    return price_stats.where(F.col("material_desc").ilike(f"%{pattern}%")).select(
        "material_desc", "clean_median_price", "raw_n")


def median_doh(doh: DataFrame) -> DataFrame:
    """SQL-11: median days of cover over rows with a positive cover."""
    d = F.col("doh_days")
    return medians(doh, [], F.when(d > 0, d), "m").agg(r6(F.max("m")).alias("median_doh"))


def vendor_spend(vendor_volume: DataFrame, n: int = 10) -> DataFrame:
    """SQL-12: vendor spend summed across plants, top-n."""
    return (vendor_volume.groupBy("vendor_name").agg(F.round(F.sum("vendor_value"), 4).alias("spend"))
                         .orderBy(F.desc("spend"), F.asc_nulls_last("vendor_name")).limit(n))


def category_spend(po: DataFrame, dim_material: DataFrame, window=None, material_types=None,
                   group_pattern: str | None = None) -> DataFrame:
    """SQL-13: PO spend by material type x group (optional type list / group ILIKE / date window)."""
    df = po.join(dim_material.select("material", "material_type", "material_group"), "material")
    if material_types:
        df = df.where(F.col("material_type").isin(list(material_types)))
    if group_pattern:
        df = df.where(F.col("material_group").ilike(group_pattern))
    if window:
        df = df.where((F.col("po_date") >= F.lit(window[0])) & (F.col("po_date") < F.lit(window[1])))
    return df.groupBy("material_type", "material_group").agg(money(F.sum("total_value_wo_tax")).alias("spend"))


def true_variance(variance: DataFrame) -> DataFrame:
    """SQL-14: spend change from sums, never a mean of ratios (AGG-14)."""
    s, p = F.sum("purchase_value"), F.sum("prev_value")
    return variance.groupBy("year", "month").agg(
        F.round(s, 4).alias("spend"), F.round(p, 4).alias("prev_spend"),
        r6((s - p) / F.nullif(p, F.lit(0.0)) * 100).alias("true_variance_pct"))


def dead_stock(inv: DataFrame, sales: DataFrame, po: DataFrame, grn: DataFrame, snapshot, since=None) -> DataFrame:
    """SQL-15: stock of items with no sale, order or receipt (left_anti x3), at all or ``since`` a date."""
    df = inv.where(F.col("qty") > 0)
    for other, date in ((sales, "sale_date"), (po, "po_date"), (grn, "gr_date")):
        other = other if since is None else other.where(F.col(date) >= F.lit(since))
        df = df.join(other.where(F.col("material").isNotNull()).select("material").distinct(), "material", "left_anti")
    return df.select("plant", "material", "batch", money("qty").alias("qty"), money("total_cost").alias("total_cost"),
                     "aging_days", "expiry_date", "formulary",
                     F.coalesce(F.col("expiry_date") < snapshot, F.lit(False)).alias("expired"))


def received_vs_ordered(spark: SparkSession, po: DataFrame, grn: DataFrame) -> DataFrame:
    """SQL-16: ordered vs received value; two scalar subqueries in one row (no cross join)."""
    o = po.select(F.sum("total_value_wo_tax").cast("double")).scalar()
    r = grn.select(F.sum("total_amount_wo_tax").cast("double")).scalar()
    return spark.range(1).select(F.round(o, 4).alias("ordered_value"), F.round(r, 4).alias("received_value"),
                                 r6(F.when(o > 0, r / o * 100)).alias("received_pct"))


def unit_cost(cons: DataFrame) -> DataFrame:
    """SQL-17: clean cost per unit consumed (floor 10, 8x band, >= 5 clean lines)."""
    raw = (cons.where(F.col("material").isNotNull() & (F.col("qty") > 0))
               .withColumn("rate", F.col("amount_lc").cast("double") / F.col("qty").cast("double"))
               .where(F.col("rate") >= PRICE_FLOOR))
    clean = clean_band(raw, ["material"], "rate")
    rates = clean.groupBy("material", "rate").agg(F.count(F.lit(1)).alias("n"), F.sum("qty").alias("q"),
                                                  F.sum("amount_lc").alias("c"))
    return (rates.groupBy("material")
                 .agg(r6(F.percentile("rate", F.lit(0.5), F.col("n"))).alias("median_unit_cost"),
                      F.sum("n").alias("clean_n"), money(F.sum("q")).alias("qty"), money(F.sum("c")).alias("cost"))
                 .where(F.col("clean_n") >= STABLE_N))


def inventory_by_ward_class(inv: DataFrame, dim_sloc: DataFrame) -> DataFrame:
    """SQL-18 / JON-11: composite (plant, sloc) join, never sloc alone."""
    j = inv.join(dim_sloc.select("plant", "sloc", "ip_op_class"), ["plant", "sloc"], "left")
    return (j.groupBy(F.coalesce("ip_op_class", F.lit("OTHER")).alias("ip_op_class"))
             .agg(money(F.sum("total_cost")).alias("stock_value"), money(F.sum("qty")).alias("stock_qty"),
                  F.countDistinct("material").alias("sku_count")))


def proxy_margin(grn: DataFrame) -> DataFrame:
    """SQL-19: MRP-proxy margin on clean rows; the denominator is always the MRP value."""
    g = _clean_with_median(grn).where(F.col("unit_mrp") >= PRICE_FLOOR)
    mrp = F.sum(F.col("gr_qty") * F.col("unit_mrp"))
    cost = F.sum(F.col("gr_qty") * F.col("net_price"))
    return g.agg(money(mrp).alias("mrp_value"), money(cost).alias("cost_value"),
                 r6(F.when(mrp > 0, (mrp - cost).cast("double") / mrp.cast("double") * 100)).alias("margin_pct"))


def manufacturer_coverage(po: DataFrame, dim_material: DataFrame) -> DataFrame:
    """SQL-20: purchases by manufacturer and the share of value the mapping covers."""
    j = po.join(dim_material.select("material", "manufacturer_desc"), "material", "left")
    total = po.select(F.sum("total_value_wo_tax").cast("double")).scalar()
    mapped = j.where(F.col("manufacturer_desc").isNotNull()).select(
        F.sum("total_value_wo_tax").cast("double")).scalar()
    return (j.groupBy(F.coalesce("manufacturer_desc", F.lit("Unmapped")).alias("manufacturer"))
             .agg(F.sum("total_value_wo_tax").cast("double").alias("v"))
             .select("manufacturer", F.round("v", 4).alias("value"),
                     r6(F.when(total > 0, F.col("v") / total * 100)).alias("share_pct"),
                     r6(F.when(total > 0, F.coalesce(mapped, F.lit(0.0)) / total * 100)).alias("coverage_pct")))


def out_of_formulary(inv: DataFrame) -> DataFrame:
    """SQL-21."""
    return (inv.where(F.col("formulary") == "OUT OF FORMULARY").groupBy("plant")
               .agg(money(F.sum("total_cost")).alias("stock_value"), money(F.sum("qty")).alias("stock_qty"),
                    F.countDistinct("material").alias("items")))


def redistribution(inv: DataFrame, cons: DataFrame, snapshot, days: int = 90) -> DataFrame:
    """SQL-22: stock expiring at one plant while the same material is consumed elsewhere.

    Per-material consumption totals minus the plant's own share: two aggregations and
    equi-joins, no plant x plant pairs.
    """
    d = F.datediff("expiry_date", snapshot)
    exp = (inv.where((F.col("qty") > 0) & d.between(0, days))
              .groupBy("plant", "material")
              .agg(F.sum("qty").alias("eq"), F.sum("total_cost").alias("ev")))
    own = cons.groupBy("plant", "material").agg(F.sum("qty").alias("own_qty"))
    tot = (cons.groupBy("material")
               .agg(F.sum("qty").alias("all_qty"), F.countDistinct("plant").alias("all_plants")))
    j = (exp.join(tot, "material").join(own, ["plant", "material"], "left")
            .withColumn("other_qty", F.col("all_qty") - F.coalesce("own_qty", F.lit(0)))
            .withColumn("other_plants", F.col("all_plants") - F.when(F.col("own_qty").isNotNull(), 1).otherwise(0)))
    return (j.where(F.col("other_plants") > 0)
             .select("plant", "material", money("eq").alias("expiring_qty"), money("ev").alias("expiring_value"),
                     "other_plants", money("other_qty").alias("other_plants_consumption")))


def active_alternatives(dim_material: DataFrame, facts: list[tuple[DataFrame, str]], since=None, n: int = 5) -> DataFrame:
    """SQL-23: catalogue items with no transaction (at all or ``since`` a date), each with up to ``n`` active
    items of the same generic name, else of its group, in item order."""
    moved = [(f if since is None else f.where(F.col(date) >= F.lit(since))).where(F.col("material").isNotNull()).select("material")
             for f, date in facts]
    active = reduce(lambda a, b: a.union(b), moved).distinct()
    inactive, live = dim_material.join(active, "material", "left_anti"), dim_material.join(active, "material", "left_semi")

    def first(key: str, name: str) -> DataFrame:      # at most n items of a key leave the window
        w = Window.partitionBy(key).orderBy("material")
        rows = live.where(F.col(key).isNotNull()).select(key, "material", F.row_number().over(w).alias("rk")).where(F.col("rk") <= n)
        return rows.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list("material")), ",").alias(name))
    return (inactive.join(first("generic_name", "g"), "generic_name", "left").join(first("material_group", "m"), "material_group", "left")
            .select("material", "material_desc", "generic_name", "material_group",
                    F.coalesce("g", "m", F.lit("")).alias("alternatives"), F.col("g").isNotNull().alias("same_generic")))


def inactive_items(dim_material: DataFrame, facts: list[DataFrame]) -> DataFrame:
    """SQL-23: catalogue items with no transaction, and counts of active siblings."""
    active = None
    for f in facts:
        m = f.where(F.col("material").isNotNull()).select("material")
        active = m if active is None else active.union(m)
    active = active.distinct()
    inactive = dim_material.join(active, "material", "left_anti")
    act_dim = dim_material.join(active, "material", "left_semi")
    by_gen = act_dim.groupBy("generic_name").agg(F.count(F.lit(1)).alias("active_same_generic"))
    by_grp = act_dim.groupBy("material_group").agg(F.count(F.lit(1)).alias("active_same_group"))
    return (inactive.join(by_gen, "generic_name", "left").join(by_grp, "material_group", "left")
                    .select("material", "material_desc", "generic_name", "material_group",
                            F.coalesce("active_same_generic", F.lit(0)).alias("active_same_generic"),
                            F.coalesce("active_same_group", F.lit(0)).alias("active_same_group")))
