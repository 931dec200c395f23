"""INS-26..37: consumption, forecast overview, reorder board, executive summary, cards."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carelake.functions.expr import (AGING_RISK_LABELS, UNCAT_LABELS, clean_category, cover_months, money,
                                     month_index, r6, round_half_even, reorder_status)
from carelake.operators.common import band_table, first_rows, for_plant, key_month_grid, running_shares, top_n


def _uncat(c: Column) -> Column:
    return F.lower(F.trim(c)).isin(UNCAT_LABELS)


def _ym() -> Column:
    return F.format_string("%04d-%02d", F.col("year"), month_index("month") + 1)


# ------------------------------------------------------------------ INS-26 / 27
def revenue_distribution(uc: DataFrame, plant: str | None = None) -> DataFrame:
    """INS-26 internal consumption per month (sales placeholders are not built, D13)."""
    return (for_plant(uc, plant).groupBy("year", "month")
            .agg(F.round(F.sum("consumption_cost"), 4).alias("internal_consumption")))


def consumption_timeline(uc: DataFrame, plant: str | None = None) -> DataFrame:
    """INS-27 monthly cost and units."""
    return (for_plant(uc, plant).groupBy("year", "month")
            .agg(F.round(F.sum("consumption_cost"), 4).alias("cost"), F.round(F.sum("total_units"), 4).alias("units")))


def consumption_categories(uc: DataFrame, plant: str | None = None, n: int = 10) -> DataFrame:
    """INS-27 top categories by cost (missing group -> Uncategorized)."""
    g = (for_plant(uc, plant).withColumn("cat", F.coalesce("material_group", F.lit("Uncategorized")))
         .groupBy("cat").agg(F.sum("consumption_cost").alias("v"), F.sum("total_units").alias("u")))
    return (top_n(g, n, F.desc("v"), "cat")
            .select(F.col("cat").alias("name"), F.round("v", 4).alias("value"), F.round("u", 4).alias("units"),
                    _uncat(F.col("cat")).alias("uncat")))


def consumption_departments(dp: DataFrame, plant: str | None = None, n: int = 8) -> DataFrame:
    """INS-27 top cost centres with their share (WIN-03 via a scalar total)."""
    d = for_plant(dp, plant)
    g = d.groupBy("cost_ctr").agg(F.sum("consumption_cost").alias("v"), F.sum("consumption_qty").alias("q"))
    tot = g.select(F.sum("v")).scalar()
    return (top_n(g, n, F.desc("v"), "cost_ctr")
            .select(F.col("cost_ctr").alias("code"), F.round("v", 4).alias("value"), F.round("q", 4).alias("qty"),
                    r6(F.when(tot != 0, F.col("v") / tot * 100).otherwise(F.lit(0.0))).alias("share")))


# ------------------------------------------------------------------ INS-28 / 29
def units_top(uc: DataFrame, plant: str | None = None, n: int = 10) -> DataFrame:
    """INS-28 top items by units with cost per unit."""
    g = (for_plant(uc, plant).where(F.col("material").isNotNull() & F.col("material_desc").isNotNull())
         .groupBy("material", "material_desc").agg(F.sum("total_units").alias("u"), F.sum("consumption_cost").alias("c")))
    return (top_n(g, n, F.desc("u"), "material")
            .select("material", F.col("material_desc").alias("desc"), F.round("u", 4).alias("units"),
                    F.round("c", 4).alias("cost"),
                    r6(F.when(F.col("u") > 0, F.col("c") / F.col("u")).otherwise(F.lit(0.0))).alias("cpu")))


def units_month_matrix(uc: DataFrame, plant: str | None = None, k: int = 8) -> DataFrame:
    """INS-28 top-8 category x month matrix of units and cost, zero-filled."""
    df = for_plant(uc, plant).withColumn("cat", F.coalesce("material_group", F.lit("Uncategorized"))).withColumn("ym", _ym())
    top = top_n(df.groupBy("cat").agg(F.sum("total_units").alias("t")), k, F.desc("t"), "cat")
    grid = key_month_grid(top, "cat", df.select("ym").distinct())
    cells = df.groupBy("cat", "ym").agg(F.sum("total_units").alias("u"), F.sum("consumption_cost").alias("c"))
    return (grid.join(cells, ["cat", "ym"], "left")
            .select(F.col("cat").alias("name"), "ym", F.round(F.coalesce("u", F.lit(0.0)), 4).alias("units"),
                    F.round(F.coalesce("c", F.lit(0.0)), 4).alias("cost")))


def department_pareto(dp: DataFrame, plant: str | None = None, n: int = 24) -> DataFrame:
    """INS-29 cost-centre Pareto (running share on the aggregated frame)."""
    g = for_plant(dp, plant).groupBy("cost_ctr").agg(F.sum("consumption_cost").alias("v"), F.sum("consumption_qty").alias("q"))
    s = running_shares(g, "v", "cost_ctr")
    return s.where(F.col("rk") <= n).select(F.col("cost_ctr").alias("code"), F.round("v", 4).alias("value"),
                                            F.round("q", 4).alias("qty"), r6("share").alias("share"), r6("cum").alias("cum"),
                                            F.col("rk").cast("int").alias("rk"))


# ------------------------------------------------------------------ INS-30..32
def _fs_month(fs: DataFrame, kind: str) -> DataFrame:
    a, f, lo, hi = (("sales_quantity", "sales_quantity_forecast", "lower_bound_sales_quantity_forecast",
                     "upper_bound_sales_quantity_forecast") if kind == "qty" else
                    ("sales_value", "cashflow_forecast", "lower_bound_cashflow_forecast", "upper_bound_cashflow_forecast"))
    return fs.groupBy("posting_date").agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(n)
                                            for c, n in ((a, "actual"), (f, "fc"), (lo, "lo"), (hi, "hi"))])


def forecast_timeline(fs: DataFrame, plant: str | None = None, kind: str = "qty", cumulative: bool = False) -> DataFrame:
    """INS-30 / INS-32 actual -> forecast cone per month (NULL outside its phase)."""
    g = _fs_month(for_plant(fs, plant), kind)
    isf = F.col("fc") > 0
    cols = [F.col("posting_date"), F.date_format("posting_date", "MMM").alias("label"),
            F.round(F.when(F.col("actual") > 0, F.col("actual")), 4).alias("actual"),
            F.round(F.when(isf, F.col("fc")), 4).alias("forecast"), F.round(F.when(isf, F.col("lo")), 4).alias("lower"),
            F.round(F.when(isf, F.col("hi")), 4).alias("upper"), isf.alias("is_forecast")]
    if cumulative:
        w = Window.orderBy("posting_date").rowsBetween(Window.unboundedPreceding, 0)
        cols.append(F.round(F.when(isf, F.sum(F.when(isf, F.col("fc")).otherwise(F.lit(0.0))).over(w)), 4)
                    .alias("cumulative"))
    return g.select(*cols)


def _items(fs: DataFrame, dim_material: DataFrame, kind: str, plant: str | None, n: int) -> DataFrame:
    a, f, lo, hi = (("sales_quantity", "sales_quantity_forecast", "lower_bound_sales_quantity_forecast",
                     "upper_bound_sales_quantity_forecast") if kind == "qty" else
                    ("sales_value", "cashflow_forecast", "lower_bound_cashflow_forecast", "upper_bound_cashflow_forecast"))
    d = for_plant(fs, plant)
    ff = d.where(F.col(f).isNotNull() & (F.col(f) > 0))
    first_fc = ff.groupBy("material_id").agg(F.min("posting_date").alias("d0"))
    itm = (ff.join(first_fc, "material_id")
           .groupBy("material_id").agg(F.sum(f).alias("fc"), F.sum(lo).alias("lo"), F.sum(hi).alias("hi"),
                                       F.sum(F.when(F.col("posting_date") == F.col("d0"), F.col(f))).alias("next_mo")))
    # WIN-07: last known actual = total actual on the material's latest actual month
    act = d.where(F.col(a).isNotNull())
    last_d = act.groupBy("material_id").agg(F.max("posting_date").alias("dl"))
    last = (act.join(last_d, "material_id").where(F.col("posting_date") == F.col("dl"))
               .groupBy("material_id").agg(F.sum(a).alias("last_actual")))
    dm = dim_material.select(F.col("material").alias("material_id"), "material_desc", "material_group")
    return (top_n(itm, n, F.desc("fc"), "material_id").join(last, "material_id", "left").join(dm, "material_id", "left")
            .select(F.col("material_id").alias("material"), F.coalesce("material_desc", "material_id").alias("desc"),
                    clean_category("material_group").alias("group"), r6("fc").alias("forecast"),
                    r6("next_mo").alias("next_mo"), r6("lo").alias("lower"), r6("hi").alias("upper"),
                    F.round(F.coalesce("last_actual", F.lit(0.0)), 4).alias("last_actual")))


def _categories(fs: DataFrame, dim_material: DataFrame, kind: str, plant: str | None, n: int = 10) -> DataFrame:
    f = "sales_quantity_forecast" if kind == "qty" else "cashflow_forecast"
    ff = for_plant(fs, plant).where(F.col(f).isNotNull() & (F.col(f) > 0))
    g = (ff.join(dim_material.select(F.col("material").alias("material_id"), F.col("material_group").alias("grp")),
                 "material_id", "left")
         .where(F.length(F.coalesce("grp", F.lit(""))) > 0)
         .groupBy("grp").agg(F.sum(f).alias("v")))
    return top_n(g, n, F.desc("v"), "grp").select(clean_category("grp").alias("group"), "grp", r6("v").alias("forecast"))


def demand_top_items(fs, dim_material, plant=None, n=12):
    """INS-31 top-12 items by horizon demand with last actual (WIN-07) and first month (AGG-07)."""
    return _items(fs, dim_material, "qty", plant, n)


def demand_categories(fs, dim_material, plant=None):
    """INS-31 forecast demand by category."""
    return _categories(fs, dim_material, "qty", plant)


def cashflow_top_items(fs, dim_material, plant=None, n=12):
    """INS-32 top-12 items by forecast spend."""
    return _items(fs, dim_material, "cash", plant, n)


def reorder_top(rep: DataFrame, plant: str | None = None, n: int = 8) -> DataFrame:
    """INS-30 biggest reorder values."""
    need = (for_plant(rep, plant).where(F.col("replenishment_quantity") > 0)
            .withColumn("val", F.col("replenishment_quantity") * F.coalesce("unit_cost", F.lit(0.0))))
    return (top_n(need, n, F.desc("val"), "material_id", "plant")
            .select(F.col("material_id").alias("material"), "plant", F.col("material_desc").alias("desc"),
                    F.col("replenishment_quantity").alias("qty"), r6("val").alias("value"),
                    F.col("demand_monthly").alias("cover")))


# ------------------------------------------------------------------ INS-33 / 34
REORDER_STATUSES = ["Stock-out", "Reorder now", "Healthy", "Overstocked", "Dead stock"]


def replen_frame(rep: DataFrame, plant: str | None = None) -> DataFrame:
    """Reorder board frame: numeric NULLs -> 0, reorder value, cover, status (COL-25)."""
    df = for_plant(rep, plant)
    for c in ["closing_stock", "closing_stock_value", "demand_forecast", "demand_monthly", "unit_cost",
              "replenishment_quantity", "aging_days", "safe_stock"]:
        df = df.withColumn(c, F.coalesce(F.col(c), F.lit(0.0)))
    return (df.withColumn("reorder_value", F.col("replenishment_quantity") * F.col("unit_cost"))
              .withColumn("cover", cover_months("closing_stock", "demand_monthly"))
              .withColumn("status", reorder_status("closing_stock", "demand_forecast", "demand_monthly",
                                                   "replenishment_quantity", "aging_days")))


def replenishment_spectrum(rep: DataFrame, plant: str | None = None) -> DataFrame:
    """INS-33 status spectrum, understock -> overstock."""
    return band_table(replen_frame(rep, plant), F.col("status"), REORDER_STATUSES,
                      {"count": ("count", None), "value": ("sum", "closing_stock_value")})


def reorder_by_category(rep: DataFrame, plant: str | None = None, n: int = 7) -> DataFrame:
    """INS-33 reorder cash vs cash in aging stock per category."""
    df = replen_frame(rep, plant).withColumn("g", clean_category("material_group"))
    g = df.groupBy("g").agg(F.sum("reorder_value").alias("rv"), F.count_if(F.col("replenishment_quantity") > 0).alias("rc"),
                            F.sum(F.when(F.col("aging_days") > 180, F.col("closing_stock_value")).otherwise(F.lit(0.0)))
                            .alias("av"))
    return (top_n(g, n, F.desc("rv"), "g")
            .select(F.col("g").alias("group"), r6("rv").alias("reorder_value"), F.col("rc").alias("reorder_count"),
                    r6("av").alias("aging_value")))


def aging_ladder(rep: DataFrame, plant: str | None = None) -> DataFrame:
    """INS-33 cash locked per aging bucket."""
    return band_table(replen_frame(rep, plant), F.col("aging_risk"), AGING_RISK_LABELS,
                      {"value": ("sum", "closing_stock_value"), "count": ("count", None)})


def _board_cut(status: str | None, aging: str | None, kind: str | None):
    """The cut a board element stands for; the most specific argument given decides."""
    kinds = {"order_now": F.col("replenishment_quantity") > 0,
             "aging": (F.col("aging_days") > 180) & (F.col("closing_stock_value") > 0)}
    cuts = [F.col("status") == status if status else None, F.col("aging_risk") == aging if aging else None,
            kinds.get(kind)]
    return next((c for c in cuts if c is not None), F.lit(True))


def _board_columns() -> list:
    return [F.col("material_id").alias("material"), "plant", F.col("material_desc").alias("desc"),
            clean_category("material_group").alias("group"), "status", F.col("closing_stock").alias("stock"),
            F.col("closing_stock_value").alias("stock_value"), "demand_monthly", r6("cover").alias("cover"),
            F.col("replenishment_quantity").alias("reorder_qty"), r6("reorder_value").alias("reorder_value"),
            F.col("aging_days").cast("int").alias("aging_days")]


def risk_items(rep: DataFrame, plant: str | None = None, status: str | None = None, aging: str | None = None,
               kind: str | None = None, limit: int | None = None) -> DataFrame:
    """INS-34 item list behind any reorder / aging cut."""
    urgent = kind == "order_now" or status in REORDER_STATUSES[:2]
    rows = replen_frame(rep, plant).where(_board_cut(status, aging, kind))
    return (first_rows(rows, limit, F.desc("reorder_value" if urgent else "closing_stock_value"), "material_id", "plant")
            .select(*_board_columns()))


def item_risk(rep: DataFrame, material: str, plant: str | None = None) -> DataFrame:
    """INS-34 one item's reorder and aging status, a row per plant that holds or needs it."""
    return (replen_frame(rep, plant).where(F.col("material_id") == str(material))
            .select(*_board_columns(), r6("demand_forecast").alias("demand_forecast"), "safe_stock",
                    F.col("aging_risk").alias("bucket"), r6("unit_cost").alias("unit_cost")))


def reorder_totals(rep: DataFrame, plant: str | None = None) -> DataFrame:
    """INS-33 totals of the reorder board in one pass."""
    need, aged = F.col("replenishment_quantity") > 0, F.col("aging_days") > 180
    value = F.col("closing_stock_value")
    return replen_frame(rep, plant).agg(
        F.count_if(need).alias("reorder_skus"), F.round(F.sum("reorder_value"), 2).alias("reorder_value"),
        F.round(F.sum("replenishment_quantity"), 4).alias("reorder_qty"),
        F.count_if(F.col("status") == "Stock-out").alias("stockout_skus"), F.count_if(aged).alias("aging_skus"),
        F.round(F.coalesce(F.sum(F.when(aged, value)), F.lit(0.0)), 2).alias("aging_value"),
        F.count_if(F.col("status") == "Healthy").alias("healthy_skus"), F.count(F.lit(1)).alias("total_skus"),
        F.round(F.sum(value), 2).alias("stock_value"))


def department_totals(dp: DataFrame, plant: str | None = None) -> DataFrame:
    """INS-29 cost, quantity, departments, top shares, departments to reach 80 % and HHI."""
    g = for_plant(dp, plant).groupBy("cost_ctr").agg(F.sum("consumption_cost").alias("v"),
                                                     F.sum("consumption_qty").alias("q"))
    s = running_shares(g, "v", "cost_ctr")
    lead = lambda k: r6(F.coalesce(F.sum(F.when(F.col("rk") <= k, F.col("share"))), F.lit(0.0)))
    return s.agg(F.round(F.sum("v"), 4).alias("cost"), F.round(F.sum("q"), 4).alias("qty"),
                 F.count(F.lit(1)).alias("departments"), F.min_by("cost_ctr", "rk").alias("top_dept"),
                 lead(1).alias("top1"), lead(5).alias("top5"), lead(10).alias("top10"),
                 (F.count_if(F.col("cum") <= 80) + 1).alias("n80"),
                 r6(F.sum(F.col("share") * F.col("share"))).alias("hhi"))


# ------------------------------------------------------------------ INS-35..37
def stock_age_mix(agedist: DataFrame, plant: str | None = None) -> DataFrame:
    """INS-35 fresh / aging / problem / dead stock value from the aging distribution."""
    b = F.col("aging_bucket")
    mix = (F.when(b == "0-30", "fresh").when(b == "31-90", "aging").when(b.isin("91-180", "181-365"), "problem")
            .when(b == "365+", "deadStock"))
    return band_table(for_plant(agedist, plant), mix, ["fresh", "aging", "problem", "deadStock"],
                      {"value": ("sum", "stock_value")})


def dashboard_summary(spark: SparkSession, sv: DataFrame, doh: DataFrame, hs: DataFrame, uc: DataFrame,
                      nm: DataFrame, pv: DataFrame, rep: DataFrame, ne: DataFrame, fr: DataFrame,
                      plant: str | None = None) -> DataFrame:
    """INS-35 executive scalars, one scalar subquery each (no cross join)."""
    sv, doh, hs, uc, nm, pv, rep, ne, fr = (for_plant(x, plant) for x in (sv, doh, hs, uc, nm, pv, rep, ne, fr))
    # one struct-valued scalar subquery per source table (each read once), fields unpacked below
    s_sv = sv.select(F.struct(F.sum("stock_value_cost").alias("value"), F.sum("stock_value_mrp").alias("mrp"),
                              F.sum("stock_qty").alias("qty"), F.countDistinct("material").alias("skus"))).scalar()
    s_uc = uc.select(F.struct(F.sum("consumption_cost").alias("cost"), F.sum("total_units").alias("units"))).scalar()
    s_pv = pv.select(F.struct(F.sum("purchase_value").alias("value"),
                              F.countDistinct("vendor_name").alias("vendors"))).scalar()
    s_rep = rep.select(F.struct(F.count_if(F.col("replenishment_quantity") > 0).alias("n"),
                                F.sum("replenishment_quantity").alias("qty"))).scalar()
    s_ne = ne.select(F.struct(F.countDistinct("material").alias("skus"), F.sum("total_cost").alias("value"))).scalar()
    value, mrp = s_sv["value"], s_sv["mrp"]
    return spark.range(1).select(
        F.round(F.coalesce(value, F.lit(0.0)), 2).alias("stock_value"),
        F.round(F.coalesce(mrp, F.lit(0.0)), 2).alias("stock_mrp"),
        F.round(s_sv["qty"], 0).alias("current_stock"),
        F.round(s_uc["cost"], 2).alias("consumption_cost"),
        F.when(mrp != 0, round_half_even((F.lit(1.0) - value / mrp) * 100, 1)).otherwise(F.lit(0.0)).alias("margin"),
        round_half_even(F.coalesce(doh.select(F.avg("doh_days")).scalar(), F.lit(0.0)), 1).alias("days_on_hand"),
        round_half_even(F.coalesce(hs.select(F.avg("turnover_annualized")).scalar(), F.lit(0.0)), 2).alias("current_itr"),
        s_sv["skus"].alias("sku_count"),
        F.round(s_pv["value"], 2).alias("purchase_value"),
        s_pv["vendors"].alias("vendor_count"),
        F.round(s_uc["units"], 4).alias("units_consumed"),
        s_rep["n"].alias("materials_needing"),
        F.round(s_rep["qty"], 2).alias("total_qty_to_order"),
        s_ne["skus"].alias("near_expiry_skus"),
        F.round(s_ne["value"], 2).alias("near_expiry_value"),
        nm.select(F.countDistinct("material")).scalar().alias("non_moving_skus"),
        round_half_even(fr.select(F.avg("fill_rate_pct")).scalar(), 1).alias("avg_fill_rate_pct"))


def period_change(series: DataFrame, key: str = "plant", value: str = "value") -> DataFrame:
    """INS-36 period-over-period card per key: current vs previous month, % change,
    direction, 1/2/3-month look-back, minimum and mean of the prior history.

    ``series`` has (key, year, month_num, value); windows are partitioned by key.
    """
    o = F.col("year") * 12 + F.col("month_num")
    w = Window.partitionBy(key).orderBy(o)
    wd = Window.partitionBy(key).orderBy(o.desc())
    wall = Window.partitionBy(key)
    s = (series.withColumn("lb1", F.lag(value, 1).over(w)).withColumn("lb2", F.lag(value, 2).over(w))
               .withColumn("lb3", F.lag(value, 3).over(w)).withColumn("rk", F.row_number().over(wd))
               .withColumn("mn", F.min(value).over(wall)).withColumn("sm", F.sum(value).over(wall))
               .withColumn("n", F.count(F.lit(1)).over(wall)))
    cur = s.where(F.col("rk") == 1)
    chg = F.when(F.col("lb1") != 0, round_half_even((F.col(value) - F.col("lb1")) / F.col("lb1") * 100, 2))
    return cur.select(key, F.round(value, 4).alias("current"), F.round("lb1", 4).alias("previous"),
                      chg.alias("change_pct"), F.when(chg >= 0, "up").when(chg < 0, "down").alias("direction"),
                      F.round("lb1", 4).alias("lookback_1"), F.round("lb2", 4).alias("lookback_2"),
                      F.round("lb3", 4).alias("lookback_3"), round_half_even("mn", 2).alias("min_value"),
                      round_half_even(F.when(F.col("n") > 1, (F.col("sm") - F.col(value)) / (F.col("n") - 1)), 2)
                      .alias("mean_prior"))


def monthly_plant_cost(cons: DataFrame) -> DataFrame:
    """Monthly consumption cost per plant: the derived series fed to ``period_change``."""
    return (cons.groupBy("plant", "year", "month_num")
                .agg(F.sum("amount_lc").cast("double").alias("value")))


def period_card(long: DataFrame, key: str = "Location") -> DataFrame:
    """INS-37 year card per location: the latest period of a card file, the one before, % change."""
    w = Window.partitionBy(key).orderBy(F.desc("period"))
    rows = long.where(F.col("value").isNotNull()).withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= 2)
    now, before = (F.max(F.when(F.col("rk") == k, F.struct("period", "value"))) for k in (1, 2))
    g = rows.groupBy(F.col(key).alias("location")).agg(now.alias("n"), before.alias("b"))
    change = F.when(F.col("b.value") != 0, (F.col("n.value") - F.col("b.value")) / F.col("b.value") * 100)
    return g.select("location", F.col("n.period").alias("period"), F.round("n.value", 4).alias("value"),
                    F.round("b.value", 4).alias("previous_value"), round_half_even(change, 2).alias("change_pct"))


AGE_CARD = [("fresh", "<3 Months"), ("aging", "3+ Months"), ("problem", "6+ Months"), ("dead_stock", "1+ Year")]


def age_card(inv: DataFrame) -> DataFrame:
    """INS-37 stock-age counts per plant (batches), one column per card category."""
    a = F.coalesce(F.col("aging_days"), F.lit(0))
    cat = (F.when(a <= 90, "<3 Months").when(a <= 180, "3+ Months").when(a <= 365, "6+ Months").otherwise("1+ Year"))
    return inv.groupBy("plant").agg(*[F.count_if(cat == lab).alias(name) for name, lab in AGE_CARD])
