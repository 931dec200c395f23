"""FC-*: demand matrix, level forecast, replenishment, radar and back-test.

The (plant, material) x month matrix is one grouped aggregation with conditional sums
(a pivot with a fixed column list), computed for quantity and value in the same pass.
All forecast arithmetic is column arithmetic on that matrix: no UDF, no collect, and
the only shuffle is the one groupBy on (plant, material).
"""
from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelake.operators.common import first_rows
from carelake.operators.order_stats import median
from carelake.functions.expr import (Z_95, aging_risk_label, clip, money, r6, radar_status,
                                     round_half_even)

MA_WINDOW = 3


def history_slots(history_end: _dt.date, months: int) -> list[_dt.date]:
    """First days of the ``months`` history months ending at ``history_end``."""
    out = []
    y, m = history_end.year, history_end.month
    for _ in range(months):
        out.append(_dt.date(y, m, 1))
        m -= 1
        if m == 0:
            y, m = y - 1, 12
    return out[::-1]


def _slot(history_start: _dt.date) -> Column:
    return (F.col("year") * 12 + F.col("month_num")) - (history_start.year * 12 + history_start.month)


def demand_matrix(cons: DataFrame, history_end: _dt.date, months: int = 6, spread: bool = False) -> DataFrame:
    """FC-01: per (plant, material) the monthly qty (q_0..) and value (v_0..), missing = 0; with
    ``spread`` also the deviation of all lines' quantities.

    Every key comes from one pass over all lines (distinct, or the deviation); only the lines of
    the history are summed, exactly per (plant, material, month), and their doubles are laid out in a second step:
    a task then holds two exact sums a group and not two for every month, which is what its memory
    grows with (few lines share a group).
    """
    start = history_slots(history_end, months)[0]
    slot = _slot(start)
    lines = cons.where(F.col("plant").isNotNull() & F.col("material").isNotNull())
    sums = (("q", "qty"), ("v", "amount_lc"))
    monthly = lines.where(slot.between(0, months - 1)).groupBy("plant", "material", slot.alias("_slot")).agg(
        *[F.sum(c).cast("double").alias(p) for p, c in sums])
    at = lambda p, k: F.max(F.when(F.col("_slot") == k, F.col(p))).alias(f"{p}_{k}")
    cells = [f"{p}_{k}" for p, _ in sums for k in range(months)]
    laid = monthly.groupBy("plant", "material").agg(*[at(p, k) for p, _ in sums for k in range(months)])
    keys = demand_spread(cons) if spread else lines.select("plant", "material").distinct()
    return keys.join(laid, ["plant", "material"], "left").select(
        "plant", "material", *[F.coalesce(x, F.lit(0.0)).alias(x) for x in cells], *keys.columns[2:])


def demand_spread(cons: DataFrame) -> DataFrame:
    """(plant, material, demand_std): the deviation of the lines' quantities, for the keys of the demand matrix."""
    return (cons.where(F.col("plant").isNotNull() & F.col("material").isNotNull())
                .groupBy("plant", "material").agg(F.stddev_pop("qty").alias("demand_std")))


def _mean(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols) / F.lit(float(len(cols)))


def level_and_spread(prefix: str, n: int, upto: int | None = None) -> tuple[Column, Column]:
    """FC-02 base level and population std over the first ``upto`` months of the matrix."""
    k = upto if upto is not None else n
    cols = [F.col(f"{prefix}_{i}") for i in range(k)]
    w = min(MA_WINDOW, k)
    level = _mean(cols[-w:])
    rate = reduce(lambda a, b: a + b, cols) / F.lit(float(k))
    base = F.when(level > 0, level).otherwise(rate)
    mu = _mean(cols)
    sigma = F.sqrt(_mean([(x - mu) * (x - mu) for x in cols]))
    return base, sigma


def demand_forecast(matrix: DataFrame, months: int = 6, horizon: int = 3, z: float = Z_95, keep: tuple = ()) -> DataFrame:
    """FC-02: flat level forecast with a multiplicative CV band, one row per horizon step; columns to
    ``keep`` go along."""
    out = matrix
    for p, name in (("q", "qty"), ("v", "cash")):
        base, sigma = level_and_spread(p, months)
        out = (out.withColumn(f"fc_{name}", base)
                  .withColumn(f"sigma_{name}", sigma)
                  .withColumn(f"cv_{name}", clip(F.when(F.col(f"fc_{name}") > 0,
                                                        F.col(f"sigma_{name}") / F.col(f"fc_{name}"))
                                                  .otherwise(F.lit(0.0)), 0.0, 1.5)))
    out = out.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    cols = ["plant", "material", "h", *keep]
    for name in ("qty", "cash"):
        r = F.lit(z) * F.col(f"cv_{name}") * (F.lit(1.0) + F.lit(0.15) * (F.col("h") - 1))
        cols += [r6(F.col(f"fc_{name}") / (F.lit(1.0) + r)).alias(f"lo_{name}"),
                 r6(F.col(f"fc_{name}")).alias(f"fc_{name}"),
                 r6(F.col(f"fc_{name}") * (F.lit(1.0) + r)).alias(f"hi_{name}")]
    return out.select(*cols)


def _group_of(dim_material: DataFrame) -> DataFrame:
    return dim_material.select("material", F.coalesce("material_group", F.lit("")).alias("material_group"))


def forecast_sales(matrix: DataFrame, dim_material: DataFrame, history_end: _dt.date,
                   months: int = 6, horizon: int = 3, z: float = Z_95) -> DataFrame:
    """FC-03: 6 actual + 3 forecast rows per series (SET-07 via explode)."""
    slots = history_slots(history_end, months)
    keys = matrix.join(_group_of(dim_material), "material", "left").withColumn(
        "material_group", F.coalesce("material_group", F.lit("")))
    hist = F.array(*[F.struct(F.lit(d).alias("posting_date"), F.col(f"q_{i}").alias("sales_quantity"),
                              F.col(f"v_{i}").alias("sales_value")) for i, d in enumerate(slots)])
    actual = (keys.select("plant", F.col("material").alias("material_id"), "material_group",
                          F.inline(hist))
                  .select("material_id", "plant", "material_group", "posting_date",
                          money("sales_quantity").alias("sales_quantity"),
                          money("sales_value").alias("sales_value")))
    nulls = ["sales_quantity_forecast", "lower_bound_sales_quantity_forecast",
             "upper_bound_sales_quantity_forecast", "cashflow_forecast",
             "lower_bound_cashflow_forecast", "upper_bound_cashflow_forecast"]
    for n in nulls:
        actual = actual.withColumn(n, F.lit(None).cast("double"))
    future = (demand_forecast(keys, months, horizon, z, ("material_group",))
                .select(F.col("material").alias("material_id"), "plant", "material_group",
                        F.add_months(F.lit(slots[-1]), F.col("h")).alias("posting_date"),
                        F.lit(None).cast("double").alias("sales_quantity"),
                        F.lit(None).cast("double").alias("sales_value"),
                        F.col("fc_qty").alias("sales_quantity_forecast"),
                        F.col("lo_qty").alias("lower_bound_sales_quantity_forecast"),
                        F.col("hi_qty").alias("upper_bound_sales_quantity_forecast"),
                        F.col("fc_cash").alias("cashflow_forecast"),
                        F.col("lo_cash").alias("lower_bound_cashflow_forecast"),
                        F.col("hi_cash").alias("upper_bound_cashflow_forecast")))
    return actual.unionByName(future)


def _demand(months: int, horizon: int) -> list[Column]:
    base, _ = level_and_spread("q", months)
    return [reduce(lambda a, b: a + b, [base] * horizon).alias("demand_forecast"), base.alias("demand_monthly")]


def demand_next(matrix: DataFrame, dim_material: DataFrame, months: int = 6,
                horizon: int = 3) -> DataFrame:
    """FC-04: horizon demand (sum of the flat forecast) and next-month demand."""
    return (matrix.join(_group_of(dim_material), "material", "left")
                  .select("plant", "material", F.coalesce("material_group", F.lit("")).alias("material_group"),
                          *_demand(months, horizon)))


def material_lead_time(grn: DataFrame) -> DataFrame:
    """FC-05: mean raw PO->GR days per material (not clipped)."""
    return (grn.where(F.col("material").isNotNull() & F.col("po_to_gr_tat").isNotNull())
               .groupBy("material").agg(F.avg("po_to_gr_tat").alias("lead_time_days")))


def replenishment(inv: DataFrame, cons: DataFrame, grn: DataFrame, dim_material: DataFrame,
                  history_end: _dt.date, months: int = 6, horizon: int = 3,
                  z: float = Z_95, default_lead_days: float = 5.0, matrix: DataFrame | None = None) -> DataFrame:
    """FC-06: stock x demand outer join, safety stock from line-level volatility and lead time;
    ``matrix`` is the demand matrix of ``cons`` if it has been written, with or without the deviation."""
    stock = (inv.where(F.col("plant").isNotNull() & F.col("material").isNotNull())
                .groupBy("plant", "material")
                .agg(F.sum("qty").cast("double").alias("closing_stock"),
                     F.sum("total_cost").cast("double").alias("closing_stock_value"),
                     F.avg("aging_days").alias("aging_days"),
                     F.avg("moving_avg_price").cast("double").alias("unit_cost")))
    matrix = matrix if matrix is not None else demand_matrix(cons, history_end, months, spread=True)
    dn = matrix.select("plant", "material", *_demand(months, horizon), *[c for c in matrix.columns if c == "demand_std"])
    if "demand_std" not in matrix.columns:
        dn = dn.join(demand_spread(cons), ["plant", "material"])
    lead = material_lead_time(grn)
    # portfolio fallback: exact median of the per-material means (a scalar subquery)
    med = median(lead, F.col("lead_time_days"))
    lead_days = F.coalesce(F.col("lead_time_days"), med, F.lit(default_lead_days))
    df = (stock.join(dn, ["plant", "material"], "full_outer")
               .join(lead, "material", "left")
               .join(dim_material.select("material", "material_desc", "material_group"), "material", "left"))
    fill0 = ["closing_stock", "closing_stock_value", "demand_forecast", "demand_monthly", "unit_cost",
             "demand_std"]
    for x in fill0:
        df = df.withColumn(x, F.coalesce(F.col(x), F.lit(0.0)))
    lead_months = F.greatest(lead_days / 30.0, F.lit(0.05))
    safe = round_half_even(F.lit(z) * F.col("demand_std") * F.sqrt(lead_months), 2)
    df = (df.withColumn("lead_months", lead_months)
            .withColumn("safe_stock", safe)
            .withColumn("replenishment_quantity",
                        F.greatest(F.col("demand_forecast") + F.col("safe_stock") - F.col("closing_stock"),
                                   F.lit(0.0))))
    return df.select(
        "plant", F.col("material").alias("material_id"), "material_desc",
        F.coalesce("material_group", F.lit("")).alias("material_group"),
        r6("closing_stock").alias("closing_stock"), r6("closing_stock_value").alias("closing_stock_value"),
        r6("aging_days").alias("aging_days"), r6("unit_cost").alias("unit_cost"),
        r6("demand_forecast").alias("demand_forecast"), r6("demand_monthly").alias("demand_monthly"),
        r6("demand_std").alias("demand_std"), r6("lead_months").alias("lead_months"),
        "safe_stock", r6("replenishment_quantity").alias("replenishment_quantity"),
        F.coalesce(F.col("aging_days") > 180, F.lit(False)).alias("inventory_aging_risk"),
        aging_risk_label("aging_days").alias("aging_risk"))


def kpi_fulfillment(rep: DataFrame) -> DataFrame:
    """FC-07."""
    s, d = F.col("closing_stock"), F.col("demand_monthly")
    return rep.select("plant", "material_id", "material_desc", "closing_stock", "demand_monthly",
                      r6(F.when(d > 0, clip(s / d, 0.0, 1.0) * 100.0).otherwise(F.lit(100.0)))
                      .alias("fulfillment_rate"),
                      r6(F.when(d > 0, s / d)).alias("coverage_months"))


def kpi_stock_radar(rep: DataFrame, horizon: int = 3) -> DataFrame:
    """FC-08."""
    cov = F.when(F.col("demand_forecast") > 0,
                 F.col("closing_stock") / (F.col("demand_forecast") / float(max(horizon, 1))))
    return (rep.select("plant", "material_id", "material_desc", "material_group", "closing_stock",
                       "demand_forecast", "aging_days", "aging_risk", "replenishment_quantity",
                       cov.alias("coverage_months"))
               .withColumn("radar_status", radar_status("replenishment_quantity", "coverage_months",
                                                        "aging_days"))
               .withColumn("coverage_months", r6("coverage_months")))


def kpi_aging_risk_forecast(rep: DataFrame) -> DataFrame:
    """FC-09."""
    stag = F.col("demand_monthly") < F.col("closing_stock") * 0.05
    return rep.select("plant", "material_id", "material_desc", "material_group", "closing_stock",
                      "demand_monthly", "aging_days",
                      (F.col("aging_days") + 90).alias("projected_aging_days"),
                      stag.alias("will_stagnate"),
                      F.when(stag & (F.col("closing_stock") > 0), "Rising").otherwise("Stable")
                      .alias("aging_risk_forecast"))


def forecast_accuracy(matrix: DataFrame, dim_material: DataFrame, months: int = 6,
                      folds: tuple | None = None) -> DataFrame:
    """FC-10: rolling-origin back-test -> (metric, value) rows.

    series -> groupBy(material_group) -> one global agg: no join of one-row frames and
    no driver round trip; the final ``stack`` turns the row into metric rows.
    """
    folds = folds or (months - 2, months - 1)      # the last two months of the history
    g = F.coalesce(F.col("material_group"), F.lit(""))
    s = matrix.join(dim_material.select("material", "material_group"), "material", "left").withColumn("g", g)
    for k in folds:
        base, _ = level_and_spread("q", months, upto=k)
        s = s.withColumn(f"a{k}", F.col(f"q_{k}")).withColumn(f"p{k}", base)
    active = reduce(lambda a, b: a + b, [F.when(F.col(f"q_{i}") > 0, 1).otherwise(0) for i in range(months)])
    s = s.withColumn("intermittent", F.when(active <= 2, 1).otherwise(0))
    per_group = s.groupBy("g").agg(
        *[F.sum(F.abs(F.col(f"a{k}") - F.col(f"p{k}"))).alias(f"err{k}") for k in folds],
        *[F.sum(f"a{k}").alias(f"A{k}") for k in folds],
        *[F.sum(f"p{k}").alias(f"P{k}") for k in folds],
        F.count(F.lit(1)).alias("n"), F.sum("intermittent").alias("n_int"))
    tot = per_group.agg(
        *[F.sum(f"err{k}").alias(f"err{k}") for k in folds],
        *[F.sum(f"A{k}").alias(f"A{k}") for k in folds],
        *[F.sum(f"P{k}").alias(f"P{k}") for k in folds],
        *[F.sum(F.abs(F.col(f"A{k}") - F.col(f"P{k}"))).alias(f"cat{k}") for k in folds],
        F.sum("n").alias("n"), F.sum("n_int").alias("n_int"))

    def mean_over_folds(expr_of):
        return reduce(lambda a, b: a + b, [expr_of(k) for k in folds]) / float(len(folds))

    def den(k):
        return F.greatest(F.col(f"A{k}"), F.lit(1.0))

    sku = mean_over_folds(lambda k: F.col(f"err{k}") / den(k) * 100.0)
    cat = mean_over_folds(lambda k: F.col(f"cat{k}") / den(k) * 100.0)
    agg = mean_over_folds(lambda k: F.abs(F.col(f"A{k}") - F.col(f"P{k}")) / den(k) * 100.0)
    mae = mean_over_folds(lambda k: F.col(f"err{k}") / F.col("n"))

    def acc(m):
        return round_half_even(F.greatest(F.lit(0.0), F.lit(100.0) - m), 1)

    row = tot.select(acc(agg).alias("m1"), acc(cat).alias("m2"), acc(sku).alias("m3"),
                     round_half_even(mae, 2).alias("m4"),
                     round_half_even(F.col("n_int") / F.col("n") * 100.0, 1).alias("m5"),
                     F.col("n").cast("double").alias("m6"))
    return row.selectExpr(
        "stack(6, 'Aggregate Forecast Accuracy %', m1, 'Weighted Forecast Accuracy %', m2, "
        "'SKU-Level Accuracy %', m3, 'MAE (units)', m4, 'Intermittent SKUs %', m5, "
        "'Series count', m6) AS (metric, value)")


def forecast_series(fs: DataFrame, kind: str = "qty", plant: str | None = None,
                    material: str | None = None, material_group: str | None = None) -> DataFrame:
    """FC-11: actual / lo / fc / hi per month for a plant, material or group (N4: sums -> 0)."""
    cols = {"qty": ("sales_quantity", "lower_bound_sales_quantity_forecast", "sales_quantity_forecast",
                    "upper_bound_sales_quantity_forecast"),
            "cash": ("sales_value", "lower_bound_cashflow_forecast", "cashflow_forecast",
                     "upper_bound_cashflow_forecast")}[kind]
    df = fs
    if plant and plant.upper() != "ALL":
        df = df.where(F.col("plant") == plant)
    if material and material != "All Items":
        df = df.where(F.col("material_id") == material)
    elif material_group:
        df = df.where(F.col("material_group") == material_group)
    names = ["actual", "lo", "fc", "hi"]
    return df.groupBy("posting_date").agg(
        *[F.round(F.coalesce(F.sum(c), F.lit(0.0)), 4).alias(n) for c, n in zip(cols, names)])


WEEK_DAYS = {"week_1": 7, "week_2": 14, "week_3": 21, "week_4": 28}


def weekly_forecast(rep: DataFrame, week: str = "week_1", plant: str | None = None,
                    limit: int | None = None) -> DataFrame:
    """FC-12: plants collapsed per material; 7/14/21/28-day demand and cash; all rows, or the first ``limit``."""
    df = rep
    if plant and plant.upper() != "ALL":
        df = df.where(F.col("plant") == plant)
    df = df.withColumn("aging_risk", F.coalesce("aging_risk", F.lit("0")))
    agg = df.groupBy("material_id").agg(
        F.min("material_desc").alias("material_desc"),
        F.round(F.sum("closing_stock"), 6).alias("closing_stock"),
        F.round(F.sum("closing_stock_value"), 6).alias("closing_stock_value"),
        F.round(F.sum("demand_forecast"), 6).alias("demand_forecast"),
        F.round(F.sum("demand_monthly"), 6).alias("demand_monthly"),
        F.round(F.sum("replenishment_quantity"), 6).alias("replenishment_quantity"),
        F.mode("aging_risk", True).alias("aging_risk"))
    frac = WEEK_DAYS.get(week, 7) / 30.0
    unit = F.when(F.col("closing_stock") != 0, F.col("closing_stock_value") / F.col("closing_stock")
                  ).otherwise(F.lit(0.0))
    base = F.when(F.col("demand_monthly") > 0, F.col("demand_monthly")).otherwise(F.col("demand_forecast"))
    wk = round_half_even(base * frac, 0)
    return (first_rows(agg.withColumn("unit_cost", unit).withColumn("wk_demand", wk), limit,
                       F.desc("replenishment_quantity"), F.desc("demand_forecast"), F.asc("material_id"))
               .select(F.col("material_id").alias("material"),
                       F.col("material_desc").alias("material_name"),
                       round_half_even("replenishment_quantity", 0).alias("order_quantity"),
                       round_half_even("demand_forecast", 0).alias("demand_forecast"),
                       round_half_even(F.col("demand_forecast") * F.col("unit_cost"), 2).alias("cash_flow_prediction"),
                       round_half_even("closing_stock", 0).alias("stock"),
                       round_half_even("closing_stock_value", 2).alias("stock_value"),
                       F.col("aging_risk").alias("aging"),
                       F.col("wk_demand").alias("demand_forecast_week"),
                       round_half_even(F.col("wk_demand") * F.col("unit_cost"), 2).alias("cash_flow_prediction_week")))


def replenishment_summary(rep: DataFrame, plant: str | None = None) -> DataFrame:
    """FC-13 summary block (one row)."""
    df = rep if not plant or plant.upper() == "ALL" else rep.where(F.col("plant") == plant)
    return df.agg(
        F.count(F.lit(1)).alias("total_materials"),
        F.round(F.sum("closing_stock"), 4).alias("total_closing_stock"),
        F.round(F.sum("replenishment_quantity"), 4).alias("total_replenishment_needed"),
        F.count_if(F.col("replenishment_quantity") > 0).alias("materials_needing_replenishment"),
        F.count_if(F.col("inventory_aging_risk")).alias("materials_with_aging_risk"),
        F.round(F.coalesce(F.avg("demand_forecast"), F.lit(0.0)), 6).alias("avg_demand_forecast"),
        *[F.count_if(F.col("aging_risk") == lab).alias(f"aging_{i}")
          for i, lab in enumerate(["<3 Months", "3-6 Months", "6-12 Months", "1+ Year"])])


def replenishment_top(rep: DataFrame, n: int = 20) -> DataFrame:
    """FC-13: top-20 by reorder quantity (TOP-02, full tie-break)."""
    return (rep.where(F.col("replenishment_quantity") > 0)
               .orderBy(F.desc("replenishment_quantity"), "material_id", "plant").limit(n)
               .select(F.coalesce("material_desc", "material_id").alias("material"), "plant",
                       "replenishment_quantity", "aging_risk", "closing_stock", "demand_forecast"))


def aging_top(rep: DataFrame, n: int = 20) -> DataFrame:
    """FC-13: top-20 oldest (label '1+ Year') by closing stock."""
    return (rep.where(F.col("aging_risk").contains("1+"))
               .orderBy(F.desc("closing_stock"), "material_id", "plant").limit(n)
               .select(F.coalesce("material_desc", "material_id").alias("material"), "plant",
                       "aging_risk", "closing_stock", "demand_forecast", "replenishment_quantity"))
