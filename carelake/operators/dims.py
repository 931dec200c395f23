"""DIM-01..07: dimension builders.

One row per key is chosen with a partial-aggregatable ``min(struct(...))`` instead of a
window: the choice is deterministic (decision D4: smallest non-null value, PO before
GRN) and the aggregation combines map-side, so a hot key never lands whole in one task.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.functions.expr import ip_op_class


def _not_nan(col: str):
    return F.col(col).isNotNull() & (F.lower(F.col(col)) != "nan")


def dim_plant(po: DataFrame, inventory: DataFrame, consumption: DataFrame) -> DataFrame:
    """DIM-01: every plant code seen anywhere, name from PO (falls back to the code)."""
    names = (po.where(_not_nan("plant") & _not_nan("plant_name"))
               .groupBy("plant").agg(F.min("plant_name").alias("plant_name")))
    codes = (po.select("plant").union(inventory.select("plant")).union(consumption.select("plant"))
               .where(_not_nan("plant")).distinct())
    return (codes.join(names, "plant", "left")
                 .select("plant", F.coalesce("plant_name", "plant").alias("plant_name")))


INV_ATTRS = ["material_desc", "material_group", "major_group_desc", "minor_group_desc",
             "generic_name", "manufacturer_desc", "formulary", "material_type"]


def dim_material(inventory: DataFrame, consumption: DataFrame) -> DataFrame:
    """DIM-02: consumption descriptions outer-joined to inventory attributes."""
    attrs = F.struct(*INV_ATTRS)
    none_attrs = F.lit(None).cast(inventory.select(attrs.alias("a")).schema["a"].dataType)
    # outer join of the two sources as union + ONE groupBy (min ignores the other side's NULLs)
    both = (consumption.where(F.col("material").isNotNull())
                       .select("material", F.col("material_desc").alias("desc_cons"), none_attrs.alias("a"))
            .unionByName(inventory.where(F.col("material").isNotNull())
                                  .select("material", F.lit(None).cast("string").alias("desc_cons"), attrs.alias("a"))))
    g = both.groupBy("material").agg(F.min("desc_cons").alias("desc_cons"), F.min("a").alias("a"))
    return g.select("material", F.coalesce("desc_cons", F.col("a.material_desc")).alias("material_desc"),
                    *[F.col(f"a.{x}").alias(x) for x in INV_ATTRS if x != "material_desc"])


def dim_sloc(inventory: DataFrame) -> DataFrame:
    """DIM-03: composite key (plant, sloc) - never join on sloc alone."""
    return (inventory.where(F.col("plant").isNotNull() & F.col("sloc").isNotNull()
                            & F.col("sloc_desc").isNotNull())
                     .groupBy("plant", "sloc").agg(F.min("sloc_desc").alias("sloc_desc"))
                     .withColumn("ip_op_class", ip_op_class("sloc_desc")))


def dim_vendor(po: DataFrame, grn: DataFrame) -> DataFrame:
    """DIM-04: vendor code -> name, PO name preferred over GRN."""
    both = (po.select("vendor_code", "vendor_name", F.lit(0).alias("src"))
              .unionByName(grn.select("vendor_code", "vendor_name", F.lit(1).alias("src")))
              .where(_not_nan("vendor_code") & F.col("vendor_name").isNotNull()))
    return (both.groupBy("vendor_code")
                .agg(F.min(F.struct("src", "vendor_name")).alias("v"))
                .select("vendor_code", F.col("v.vendor_name").alias("vendor_name")))


def dim_costcenter(consumption: DataFrame) -> DataFrame:
    """DIM-05: names are not supplied, so department_name = code."""
    return (consumption.where(_not_nan("cost_ctr")).select("cost_ctr").distinct()
                       .withColumn("department_name", F.col("cost_ctr")))


def plant_domains(dim_plant_df: DataFrame, inventory: DataFrame, consumption: DataFrame,
                  grn: DataFrame) -> DataFrame:
    """DIM-06: plant -> data domains; plants without any data are dropped.

    Each membership is a distinct plant list (tiny after the map-side distinct) joined
    back with a left join; no per-plant collect happens on the driver.
    """
    def flag(df, name):
        return df.select("plant").distinct().withColumn(name, F.lit(True))

    d = (dim_plant_df.join(flag(inventory, "has_inv"), "plant", "left")
                     .join(flag(consumption, "has_con"), "plant", "left")
                     .join(flag(grn, "has_grn"), "plant", "left"))
    domains = F.concat(
        F.when(F.col("has_inv"), F.array(F.lit("inventory"))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("has_con"), F.array(F.lit("consumption"), F.lit("forecasting")))
         .otherwise(F.array().cast("array<string>")),
        F.when(F.col("has_grn"), F.array(F.lit("procurement"))).otherwise(F.array().cast("array<string>")))
    return (d.select("plant", "plant_name", domains.alias("domains"))
             .where(F.size("domains") > 0)
             .select("plant", "plant_name", F.array_join("domains", ",").alias("domains")))


def material_options(dim_mat: DataFrame, stock_value: DataFrame | None = None,
                     plant: str | None = None) -> DataFrame:
    """DIM-07: material option list, restricted to materials stocked at a plant."""
    df = dim_mat.select("material", "material_desc", "material_group")
    if plant and plant.upper() != "ALL" and stock_value is not None:
        df = df.join(stock_value.where(F.col("plant") == plant).select("material"), "material", "left_semi")
    return df


def group_options(dim_mat: DataFrame) -> DataFrame:
    """DIM-07: distinct non-blank material groups."""
    return (dim_mat.where(F.col("material_group").isNotNull()
                          & ~F.col("material_group").isin("nan", ""))
                   .select("material_group").distinct())


def vendor_options(vendor_volume: DataFrame, plant: str | None = None) -> DataFrame:
    """DIM-07: distinct vendors of the (plant-filtered) vendor volume table."""
    df = vendor_volume
    if plant and plant.upper() != "ALL":
        df = df.where(F.col("plant") == plant)
    return (df.where(F.col("vendor_name").isNotNull() & ~F.col("vendor_name").isin("nan", ""))
              .select("vendor_name").distinct())
