"""Oracles for INS-26..37."""
from carelake.oracle.forecast_sql import REP, SQL as FSQL
from carelake.oracle.frag import as_cte, band_sql, month_idx, r6
from carelake.oracle.frag_text import clean_category
from carelake.oracle.kpi_sql import SQL as K

UC = as_cte("uc", K["kpi_units_consumed"])
DP = as_cte("dp", K["kpi_consumption_by_department"])
FS = as_cte("fs", FSQL["forecast_sales"])
YM = f"printf('%04d-%02d', year, {month_idx('month')} + 1)"
UNCAT = "lower(trim({})) IN ('uncategorized', '', 'nan', 'none')"
COVER = "(CASE WHEN demand_monthly > 0 THEN closing_stock / demand_monthly WHEN closing_stock > 0 THEN 999.0 ELSE 0.0 END)"
RF = REP + f""",
rf0 AS (SELECT * REPLACE (COALESCE(closing_stock, 0.0) AS closing_stock, COALESCE(closing_stock_value, 0.0) AS closing_stock_value,
          COALESCE(demand_forecast, 0.0) AS demand_forecast, COALESCE(demand_monthly, 0.0) AS demand_monthly,
          COALESCE(unit_cost, 0.0) AS unit_cost, COALESCE(replenishment_quantity, 0.0) AS replenishment_quantity,
          COALESCE(aging_days, 0.0) AS aging_days, COALESCE(safe_stock, 0.0) AS safe_stock) FROM rep),
rf AS (SELECT *, replenishment_quantity * unit_cost AS reorder_value, {COVER} AS cover,
         CASE WHEN closing_stock <= 0 AND demand_forecast > 0 THEN 'Stock-out'
              WHEN aging_days > 365 AND closing_stock > 0 THEN 'Dead stock'
              WHEN replenishment_quantity > 0 AND {COVER} < 1 THEN 'Reorder now'
              WHEN {COVER} > 9 OR aging_days > 180 THEN 'Overstocked' ELSE 'Healthy' END AS status FROM rf0)"""


def _fs_month(kind):
    a, f, lo, hi = (("sales_quantity", "sales_quantity_forecast", "lower_bound_sales_quantity_forecast",
                     "upper_bound_sales_quantity_forecast") if kind == "qty" else
                    ("sales_value", "cashflow_forecast", "lower_bound_cashflow_forecast", "upper_bound_cashflow_forecast"))
    return (f"fm AS (SELECT posting_date, COALESCE(sum({a}), 0.0) AS actual, COALESCE(sum({f}), 0.0) AS fc, "
            f"COALESCE(sum({lo}), 0.0) AS lo, COALESCE(sum({hi}), 0.0) AS hi FROM fs GROUP BY posting_date)")


def _timeline(kind, cumulative=False):
    cum = (", round(CASE WHEN fc > 0 THEN sum(CASE WHEN fc > 0 THEN fc ELSE 0.0 END) OVER (ORDER BY posting_date "
           "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END, 4) AS cumulative") if cumulative else ""
    return FS + ", " + _fs_month(kind) + f""" SELECT posting_date, strftime(posting_date, '%b') AS label,
        round(CASE WHEN actual > 0 THEN actual END, 4) AS actual, round(CASE WHEN fc > 0 THEN fc END, 4) AS forecast,
        round(CASE WHEN fc > 0 THEN lo END, 4) AS lower, round(CASE WHEN fc > 0 THEN hi END, 4) AS upper,
        fc > 0 AS is_forecast{cum} FROM fm"""


def _items(kind):
    a, f, lo, hi = (("sales_quantity", "sales_quantity_forecast", "lower_bound_sales_quantity_forecast",
                     "upper_bound_sales_quantity_forecast") if kind == "qty" else
                    ("sales_value", "cashflow_forecast", "lower_bound_cashflow_forecast", "upper_bound_cashflow_forecast"))
    return FS + f""", ff AS (SELECT * FROM fs WHERE {f} IS NOT NULL AND {f} > 0),
        d0 AS (SELECT material_id, min(posting_date) AS d0 FROM ff GROUP BY 1),
        itm AS (SELECT material_id, sum({f}) AS fc, sum({lo}) AS lo, sum({hi}) AS hi,
                       sum(CASE WHEN posting_date = d0 THEN {f} END) AS next_mo
                FROM ff JOIN d0 USING (material_id) GROUP BY 1 ORDER BY fc DESC, material_id LIMIT 12),
        act AS (SELECT * FROM fs WHERE {a} IS NOT NULL),
        dl AS (SELECT material_id, max(posting_date) AS dl FROM act GROUP BY 1),
        la AS (SELECT material_id, sum({a}) AS last_actual FROM act JOIN dl USING (material_id)
               WHERE posting_date = dl GROUP BY 1)
        SELECT i.material_id AS material, COALESCE(dm.material_desc, i.material_id) AS "desc",
               {clean_category('dm.material_group')} AS "group", {r6('fc')} AS forecast, {r6('next_mo')} AS next_mo,
               {r6('lo')} AS lower, {r6('hi')} AS upper, round(COALESCE(la.last_actual, 0.0), 4) AS last_actual
        FROM itm i LEFT JOIN la USING (material_id) LEFT JOIN dim_material dm ON dm.material = i.material_id"""


def _cats(kind):
    f = "sales_quantity_forecast" if kind == "qty" else "cashflow_forecast"
    return FS + f""", ff AS (SELECT fs.*, dm.material_group AS grp FROM fs LEFT JOIN dim_material dm ON dm.material = fs.material_id
                  WHERE {f} IS NOT NULL AND {f} > 0),
        g AS (SELECT grp, sum({f}) AS v FROM ff WHERE length(COALESCE(grp, '')) > 0 GROUP BY grp ORDER BY v DESC, grp LIMIT 10)
        SELECT {clean_category('grp')} AS "group", grp, {r6('v')} AS forecast FROM g"""


SQL = {
    "revenue_distribution": UC + " SELECT year, month, round(sum(consumption_cost), 4) AS internal_consumption FROM uc GROUP BY ALL",
    "consumption_timeline": UC + """ SELECT year, month, round(sum(consumption_cost), 4) AS cost,
        round(sum(total_units), 4) AS units FROM uc GROUP BY ALL""",
    "consumption_categories": UC + f""", g AS (SELECT COALESCE(material_group, 'Uncategorized') AS cat, sum(consumption_cost) AS v,
            sum(total_units) AS u FROM uc GROUP BY 1 ORDER BY v DESC, cat LIMIT 10)
        SELECT cat AS name, round(v, 4) AS value, round(u, 4) AS units, {UNCAT.format('cat')} AS uncat FROM g""",
    "consumption_departments": DP + f""", g AS (SELECT cost_ctr, sum(consumption_cost) AS v, sum(consumption_qty) AS q FROM dp GROUP BY 1)
        SELECT cost_ctr AS code, round(v, 4) AS value, round(q, 4) AS qty,
               {r6('CASE WHEN (SELECT sum(v) FROM g) <> 0 THEN v / (SELECT sum(v) FROM g) * 100 ELSE 0.0 END')} AS share
        FROM g ORDER BY v DESC, cost_ctr LIMIT 8""",
    "units_top": UC + f""", g AS (SELECT material, material_desc, sum(total_units) AS u, sum(consumption_cost) AS c FROM uc
            WHERE material IS NOT NULL AND material_desc IS NOT NULL GROUP BY 1, 2 ORDER BY u DESC, material LIMIT 10)
        SELECT material, material_desc AS "desc", round(u, 4) AS units, round(c, 4) AS cost,
               {r6('CASE WHEN u > 0 THEN c / u ELSE 0.0 END')} AS cpu FROM g""",
    "units_month_matrix": UC + f""", d AS (SELECT *, COALESCE(material_group, 'Uncategorized') AS cat, {YM} AS ym FROM uc),
        top AS (SELECT cat, sum(total_units) AS t FROM d GROUP BY 1 ORDER BY t DESC, cat LIMIT 8),
        mons AS (SELECT DISTINCT ym FROM d),
        cells AS (SELECT cat, ym, sum(total_units) AS u, sum(consumption_cost) AS c FROM d GROUP BY 1, 2)
        SELECT top.cat AS name, mons.ym, round(COALESCE(cells.u, 0.0), 4) AS units, round(COALESCE(cells.c, 0.0), 4) AS cost
        FROM top CROSS JOIN mons LEFT JOIN cells ON cells.cat = top.cat AND cells.ym = mons.ym""",
    "department_pareto": DP + f""", g AS (SELECT cost_ctr, sum(consumption_cost) AS v, sum(consumption_qty) AS q FROM dp GROUP BY 1),
        s0 AS (SELECT *, CASE WHEN sum(v) OVER () > 0 THEN v / sum(v) OVER () * 100 ELSE 0.0 END AS share,
                      row_number() OVER (ORDER BY v DESC, cost_ctr) AS rk FROM g),
        s AS (SELECT *, sum(share) OVER (ORDER BY v DESC, cost_ctr ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM s0)
        SELECT cost_ctr AS code, round(v, 4) AS value, round(q, 4) AS qty, {r6('share')} AS share, {r6('cum')} AS cum,
               CAST(rk AS INTEGER) AS rk FROM s WHERE rk <= 24""",
    "forecast_timeline": _timeline("qty"),
    "cashflow_timeline": _timeline("cash", cumulative=True),
    "demand_top_items": _items("qty"),
    "cashflow_top_items": _items("cash"),
    "demand_categories": _cats("qty"),
    "reorder_top": REP + f""" SELECT material_id AS material, plant, material_desc AS "desc", replenishment_quantity AS qty,
        {r6('replenishment_quantity * COALESCE(unit_cost, 0.0)')} AS value, demand_monthly AS cover FROM rep
        WHERE replenishment_quantity > 0
        ORDER BY replenishment_quantity * COALESCE(unit_cost, 0.0) DESC, material_id, plant LIMIT 8""",
    "replenishment_spectrum": RF + " " + band_sql("rf", "status", ["Stock-out", "Reorder now", "Healthy", "Overstocked", "Dead stock"],
                                                  {"count": ("count", None), "value": ("sum", "closing_stock_value")}),
    "reorder_by_category": RF + f""", g AS (SELECT {clean_category('material_group')} AS g, sum(reorder_value) AS rv,
            count(*) FILTER (WHERE replenishment_quantity > 0) AS rc,
            sum(CASE WHEN aging_days > 180 THEN closing_stock_value ELSE 0.0 END) AS av FROM rf GROUP BY 1)
        SELECT g AS "group", {r6('rv')} AS reorder_value, rc AS reorder_count, {r6('av')} AS aging_value FROM g
        ORDER BY rv DESC, g LIMIT 7""",
    "aging_ladder": RF + " " + band_sql("rf", "aging_risk", ["<3 Months", "3-6 Months", "6-12 Months", "1+ Year"],
                                        {"value": ("sum", "closing_stock_value"), "count": ("count", None)}),
    "risk_items": RF + f""" SELECT material_id AS material, plant, material_desc AS "desc",
        {clean_category('material_group')} AS "group", status, closing_stock AS stock, closing_stock_value AS stock_value,
        demand_monthly, {r6('cover')} AS cover, replenishment_quantity AS reorder_qty, {r6('reorder_value')} AS reorder_value,
        CAST(trunc(aging_days) AS INTEGER) AS aging_days FROM rf ORDER BY closing_stock_value DESC, material_id, plant""",
    "stock_age_mix": as_cte("ad", K["kpi_aging_distribution"]) + " " + band_sql(
        "ad", "(CASE WHEN aging_bucket = '0-30' THEN 'fresh' WHEN aging_bucket = '31-90' THEN 'aging' "
              "WHEN aging_bucket IN ('91-180', '181-365') THEN 'problem' WHEN aging_bucket = '365+' THEN 'deadStock' END)",
        ["fresh", "aging", "problem", "deadStock"], {"value": ("sum", "stock_value")}),
    "period_change": """s0 AS (SELECT plant, year, month_num, CAST(sum(amount_lc) AS DOUBLE) AS value FROM fact_consumption GROUP BY ALL),
        s AS (SELECT *, lag(value, 1) OVER w AS lb1, lag(value, 2) OVER w AS lb2, lag(value, 3) OVER w AS lb3,
                     row_number() OVER (PARTITION BY plant ORDER BY year * 12 + month_num DESC) AS rk,
                     min(value) OVER (PARTITION BY plant) AS mn, sum(value) OVER (PARTITION BY plant) AS sm,
                     count(*) OVER (PARTITION BY plant) AS n
              FROM s0 WINDOW w AS (PARTITION BY plant ORDER BY year * 12 + month_num)),
        c AS (SELECT *, CASE WHEN lb1 <> 0 THEN round_even((value - lb1) / lb1 * 100, 2) END AS chg FROM s WHERE rk = 1)
        SELECT plant, round(value, 4) AS current, round(lb1, 4) AS previous, chg AS change_pct,
               CASE WHEN chg >= 0 THEN 'up' WHEN chg < 0 THEN 'down' END AS direction,
               round(lb1, 4) AS lookback_1, round(lb2, 4) AS lookback_2, round(lb3, 4) AS lookback_3,
               round_even(mn, 2) AS min_value, round_even(CASE WHEN n > 1 THEN (sm - value) / (n - 1) END, 2) AS mean_prior
        FROM c""",
    "age_card": """SELECT plant,
        count(*) FILTER (WHERE COALESCE(aging_days, 0) <= 90) AS fresh,
        count(*) FILTER (WHERE COALESCE(aging_days, 0) > 90 AND COALESCE(aging_days, 0) <= 180) AS aging,
        count(*) FILTER (WHERE COALESCE(aging_days, 0) > 180 AND COALESCE(aging_days, 0) <= 365) AS problem,
        count(*) FILTER (WHERE COALESCE(aging_days, 0) > 365) AS dead_stock FROM fact_inventory GROUP BY plant""",
}

_DS = ", ".join([as_cte("sv", K["kpi_stock_value"]), as_cte("dh", K["kpi_doh"]), as_cte("hs", K["kpi_health_score"]),
                 UC, as_cte("nm", K["kpi_non_moving"]), as_cte("pv", K["kpi_purchase_value"]),
                 as_cte("ne", K["kpi_near_expiry"]), as_cte("fr", K["kpi_fill_rate"])])
SQL["dashboard_summary"] = REP + ", " + _DS + """, x AS (SELECT (SELECT sum(stock_value_cost) FROM sv) AS value,
        (SELECT sum(stock_value_mrp) FROM sv) AS mrp)
    SELECT round(COALESCE(value, 0.0), 2) AS stock_value, round(COALESCE(mrp, 0.0), 2) AS stock_mrp,
           (SELECT round(sum(stock_qty), 0) FROM sv) AS current_stock,
           (SELECT round(sum(consumption_cost), 2) FROM uc) AS consumption_cost,
           CASE WHEN mrp <> 0 THEN round_even((1.0 - value / mrp) * 100, 1) ELSE 0.0 END AS margin,
           round_even(COALESCE((SELECT avg(doh_days) FROM dh), 0.0), 1) AS days_on_hand,
           round_even(COALESCE((SELECT avg(turnover_annualized) FROM hs), 0.0), 2) AS current_itr,
           (SELECT count(DISTINCT material) FROM sv) AS sku_count,
           (SELECT round(sum(purchase_value), 2) FROM pv) AS purchase_value,
           (SELECT count(DISTINCT vendor_name) FROM pv) AS vendor_count,
           (SELECT round(sum(total_units), 4) FROM uc) AS units_consumed,
           (SELECT count(*) FILTER (WHERE replenishment_quantity > 0) FROM rep) AS materials_needing,
           (SELECT round(sum(replenishment_quantity), 2) FROM rep) AS total_qty_to_order,
           (SELECT count(DISTINCT material) FROM ne) AS near_expiry_skus,
           (SELECT round(sum(total_cost), 2) FROM ne) AS near_expiry_value,
           (SELECT count(DISTINCT material) FROM nm) AS non_moving_skus,
           (SELECT round_even(avg(fill_rate_pct), 1) FROM fr) AS avg_fill_rate_pct FROM x"""
