"""MRT-02..04: outlier-clean price statistics and the enriched receipt line.

Two-pass clean (FLT-09): a first median per key, then keep rows inside median/8 ..
median*8. The marts first aggregate the lines to (key, price, count, sums), which spreads a hot
key by its prices; both passes run over those rows in one order, so they are shuffled and sorted once.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.functions.expr import r6
from carelake.operators.common import key_medians
from carelake.operators.order_stats import with_median

BAND = 8.0
PRICE_FLOOR = 10
STABLE_N = 5


def _raw_prices(grn: DataFrame) -> DataFrame:
    return grn.where(F.col("material").isNotNull() & (F.col("net_price") >= PRICE_FLOOR)
                     & (F.col("gr_qty") > 0)).withColumn("price", F.col("net_price").cast("double"))


def _in_band(value: str, median: str):
    return F.col(value).between(F.col(median) / BAND, F.col(median) * BAND)


def clean_band(raw: DataFrame, keys: list[str], value: str = "price") -> DataFrame:
    """FLT-09: keep rows within an 8x band of their key's first-pass median."""
    p1 = key_medians(raw, keys, value, "_m1", "_n1")
    return (raw.join(p1, keys)
               .where(_in_band(value, "_m1")).drop("_m1", "_n1"))


def _banded(prices: DataFrame, keys: list[str]) -> DataFrame:
    """``prices`` with ``in_band`` (first pass) and the median of the rows in the band (second pass)."""
    first = with_median(prices, keys, "price", F.col("n"), "_m1").withColumn("in_band", _in_band("price", "_m1")).drop("_m1")
    return with_median(first, keys, "price", F.when(F.col("in_band"), F.col("n")).otherwise(F.lit(0)), "clean_median_price")


def material_price_stats(grn: DataFrame, dim_material: DataFrame) -> DataFrame:
    """MRT-02 (q ``mart_material_price_stats``)."""
    prices = _raw_prices(grn).groupBy("material", "price").agg(F.count(F.lit(1)).alias("n"))
    kept = F.when(F.col("in_band"), F.col("price"))
    stat = _banded(prices, ["material"]).groupBy("material").agg(
        F.sum("n").alias("raw_n"), F.min("price").alias("raw_min_price"), F.max("price").alias("raw_max_price"),
        F.max("clean_median_price").alias("clean_median_price"), F.sum(F.when(F.col("in_band"), F.col("n"))).alias("clean_n"),
        F.min(kept).alias("clean_min_price"), F.max(kept).alias("clean_max_price"))
    dm = dim_material.select("material", "material_desc", F.col("material_group").alias("category"))
    return (stat.join(dm, "material", "left")
                   .select("material", "material_desc", "category",
                           r6("clean_median_price").alias("clean_median_price"),
                           F.coalesce("clean_n", F.lit(0)).alias("clean_n"),
                           r6("clean_min_price").alias("clean_min_price"),
                           r6("clean_max_price").alias("clean_max_price"),
                           r6(F.col("clean_max_price") - F.col("clean_min_price")).alias("clean_price_spread"),
                           "raw_n", r6("raw_min_price").alias("raw_min_price"),
                           r6("raw_max_price").alias("raw_max_price"),
                           (F.col("raw_max_price") > F.col("raw_min_price") * 20).alias("has_price_outlier"),
                           (F.coalesce("clean_n", F.lit(0)) >= STABLE_N).alias("price_is_stable")))


def material_vendor_price_stats(grn: DataFrame, dim_material: DataFrame) -> DataFrame:
    """MRT-03 (q ``mart_material_vendor_price_stats``)."""
    keys = ["material", "vendor_name"]
    prices = _raw_prices(grn).where(F.col("vendor_name").isNotNull()).groupBy(*keys, "price").agg(
        F.count(F.lit(1)).alias("n"), F.sum("gr_qty").alias("qty"), F.sum("total_amount_wo_tax").alias("amount"))
    st = _banded(prices, keys).where("in_band").groupBy(*keys).agg(
        F.max("clean_median_price").alias("clean_median_price"), F.sum("n").alias("clean_n"),
        F.sum("qty").alias("total_qty"), F.sum("amount").alias("total_value"))
    dm = dim_material.select("material", "material_desc", F.col("material_group").alias("category"))
    return (st.join(dm, "material", "left")
              .select("material", "material_desc", "category", "vendor_name",
                      r6("clean_median_price").alias("clean_median_price"), "clean_n",
                      F.round(F.col("total_qty").cast("double"), 4).alias("total_qty"),
                      F.round(F.col("total_value").cast("double"), 4).alias("total_value"),
                      (F.col("clean_n") >= STABLE_N).alias("price_is_stable")))


def mart_procurement(grn: DataFrame, dim_material: DataFrame, price_stats: DataFrame,
                     vendor_lead: DataFrame) -> DataFrame:
    """MRT-04: receipt line + category, capex flag, clean median, outlier flag, vendor lead time."""
    dm = dim_material.select("material", F.col("material_group").alias("category"), "material_type",
                             "manufacturer_desc", "generic_name")
    ps = price_stats.select("material", F.col("clean_median_price").alias("material_median_price"),
                            F.col("clean_n").alias("material_price_sample_n"))
    lt = vendor_lead.select("vendor_name", F.col("avg_lead_time_days").alias("vendor_avg_lead_time_days"),
                            F.col("median_lead_time_days").alias("vendor_median_lead_time_days"))
    price = F.col("net_price").cast("double")
    med = F.col("material_median_price")
    # one join with all that is known of a material; lines without one (capital goods, services) get
    # spread keys that match nothing, instead of meeting in the task of the null key
    about = dm.join(ps, "material", "left").withColumnRenamed("material", "_material")
    nowhere = F.concat(F.lit("\0"), F.xxhash64("po_no", "gr_no").cast("string"))
    lines = grn.withColumn("_key", F.coalesce(F.col("material"), nowhere))
    return (lines.join(about, F.col("_key") == F.col("_material"), "left").join(lt, "vendor_name", "left")
               .select("plant", "material", "material_desc", "category", "material_type", "manufacturer_desc",
                       "generic_name", "vendor_code", "vendor_name", "po_no", "gr_no",
                       F.col("gr_qty").cast("double").alias("qty"), price.alias("unit_price"),
                       F.col("unit_mrp").cast("double").alias("unit_mrp"),
                       F.round(F.col("total_amount_wo_tax").cast("double"), 4).alias("line_value"),
                       F.col("material").isNull().alias("is_capex_or_service"),
                       "material_median_price", "material_price_sample_n",
                       (med.isNotNull() & ((price < med / BAND) | (price > med * BAND))).alias("is_price_outlier"),
                       "vendor_avg_lead_time_days", "vendor_median_lead_time_days",
                       "gr_date", "expiry_date", "year", "month_num", "month"))
