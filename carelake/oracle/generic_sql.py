"""Oracles for GEN-* and CAT-*."""
from carelake.oracle.forecast_sql import REP, SQL as FSQL
from carelake.oracle.frag import SNAP, as_cte, band_sql, expiry_slab, month_idx, r6
from carelake.oracle.frag_text import clean_category
from carelake.oracle.insights_proc_sql import SQL as PSQL
from carelake.oracle.kpi_sql import SQL as K
from carelake.oracle.sales_sql import GR
from carelake.schemas import PORTFOLIOS, REGISTRY, columns_of, is_numeric


def summary_sql(src: str, table: str, key: str | None = None) -> str:
    """GEN-03 twin: one UNION ALL branch per (column, stat)."""
    tag = f", '{key}' AS key" if key else ""
    parts = [f"SELECT 'row_count' AS column_name, 'rows' AS stat, CAST(count(*) AS DOUBLE) AS value{tag} FROM {src}"]
    for c, t in columns_of(table):
        if is_numeric(t):
            for stat, e in (("sum", f"COALESCE(sum({c}), 0)"), ("mean", f"avg({c})"), ("median", f"median({c})")):
                parts.append(f"SELECT '{c}', '{stat}', round(CAST({e} AS DOUBLE), 4){tag} FROM {src}")
        else:
            parts.append(f"SELECT '{c}', 'distinct', CAST(count(DISTINCT {c}) AS DOUBLE){tag} FROM {src}")
    return " UNION ALL ".join(parts)


UC = as_cte("uc", K["kpi_units_consumed"])
SV = as_cte("sv", K["kpi_stock_value"])
PV = as_cte("pv", K["kpi_purchase_value"])
VV = as_cte("vv", K["kpi_vendor_volume"])
LOC = as_cte("loc", K["kpi_purchase_by_location"])
SC = as_cte("sc", K["kpi_stock_change"])
IE = (f"ie AS (SELECT *, CAST(date_diff('day', {SNAP}, expiry_date) AS INTEGER) AS dte FROM fact_inventory "
      f"WHERE expiry_date IS NOT NULL AND qty > 0), ie2 AS (SELECT *, {expiry_slab('dte')} AS slab FROM ie)")
MARGINS = (f"revenue, round(revenue - cost, 4) AS margin, "
           f"{r6('CASE WHEN revenue > 0 THEN (revenue - cost) / revenue * 100 ELSE 0.0 END')} AS margin_pct, qty")
YMP = f"printf('%04d-%02d', year, {month_idx('month')} + 1)"

_portfolio = PORTFOLIOS["procurement"]
_ctes = ", ".join(as_cte(f"t{i}", K[REGISTRY[k][0]]) for i, k in enumerate(_portfolio))

SQL = {
    "gen_query": UC + " SELECT * FROM uc",
    "gen_chart_series": UC + """ SELECT year, month, round(CAST(COALESCE(sum(total_units), 0) AS DOUBLE), 4) AS total_units,
        round(CAST(COALESCE(sum(consumption_cost), 0) AS DOUBLE), 4) AS consumption_cost FROM uc
        WHERE year IS NOT NULL AND month IS NOT NULL GROUP BY year, month""",
    "gen_summarize": SV + " " + summary_sql("sv", "kpi_stock_value"),
    "table_filter": PV + """ SELECT * FROM pv WHERE TRY_CAST(CAST(purchase_value AS VARCHAR) AS DOUBLE) >= 1000
        AND COALESCE(contains(lower(CAST(vendor_name AS VARCHAR)), 'supplier#0000000'), false)""",
    "table_global_search": SV + " SELECT * FROM sv WHERE " + " OR ".join(
        f"COALESCE(contains(lower(CAST({c} AS VARCHAR)), 'gear'), false)" for c, _ in columns_of("kpi_stock_value")),
    "table_page": SC + """ SELECT year, month AS period, material AS materialId, material_desc AS materialName,
        material_group AS materialGroup, stock_change AS stockChange, (SELECT count(*) FROM sc) AS total FROM sc
        ORDER BY stock_change DESC NULLS LAST, year NULLS LAST, month NULLS LAST, material NULLS LAST,
                 material_desc NULLS LAST, material_group NULLS LAST, stock_change NULLS LAST
        LIMIT 25 OFFSET 25""",
    "portfolio_summary": _ctes + " " + " UNION ALL ".join(
        summary_sql(f"t{i}", REGISTRY[k][0], k) for i, k in enumerate(_portfolio)),
    "adhoc_sql": VV + """ SELECT vendor_name, sum(vendor_value) AS spend, count(DISTINCT plant) AS plants FROM vv
        GROUP BY vendor_name""",
    "cat_revenue_manufacturer": GR + f" SELECT manufacturer AS name, {MARGINS} FROM smf ORDER BY revenue DESC, name LIMIT 10",
    "cat_revenue_hospital": GR + f" SELECT hospital AS name, {MARGINS} FROM sh ORDER BY revenue DESC, name LIMIT 10",
    "cat_revenue_category": GR + f""", c AS (SELECT {clean_category('material_group')} AS name, round(sum(revenue), 4) AS revenue,
            round(sum(cost), 4) AS cost, round(sum(qty), 4) AS qty FROM bym GROUP BY 1)
        SELECT name, {MARGINS} FROM c ORDER BY revenue DESC, name LIMIT 10""",
    "cat_revenue_material": GR + f" SELECT material_desc AS name, {MARGINS} FROM bym ORDER BY revenue DESC, name, material LIMIT 10",
    "cat_revenue_month": GR + f""", c AS (SELECT month, round(sum(revenue), 4) AS revenue, round(sum(cost), 4) AS cost,
            round(sum(qty), 4) AS qty FROM sm GROUP BY month)
        SELECT strftime(CAST(month || '-01' AS DATE), '%b %y') AS name, month, {MARGINS} FROM c""",
    "cat_procurement_vendors": VV + f""", v AS (SELECT vendor_name, sum(vendor_value) AS s, CAST(sum(po_lines) AS BIGINT) AS po_lines FROM vv GROUP BY 1)
        SELECT vendor_name AS name, round(s, 4) AS spend,
               {r6('CASE WHEN (SELECT sum(vendor_value) FROM vv) > 0 THEN s / (SELECT sum(vendor_value) FROM vv) * 100 ELSE 0.0 END')} AS share_pct,
               po_lines FROM v ORDER BY s DESC, vendor_name NULLS LAST LIMIT 10""",
    "cat_procurement_category": PV + f""" SELECT {clean_category('category')} AS name, round(sum(purchase_value), 4) AS spend
        FROM pv GROUP BY 1 ORDER BY sum(purchase_value) DESC, name LIMIT 10""",
    "cat_procurement_location": LOC + " SELECT plant AS name, purchase_value AS spend FROM loc ORDER BY purchase_value DESC, plant LIMIT 10",
    "cat_procurement_month": PV + f""", c AS (SELECT {YMP} AS ym, round(sum(purchase_value), 4) AS spend FROM pv GROUP BY 1)
        SELECT strftime(CAST(ym || '-01' AS DATE), '%b %y') AS name, ym, spend FROM c""",
    "cat_procurement_open_po": f"""op AS (SELECT *, open_qty * net_price AS ov, {clean_category('major_group')} AS name
            FROM fact_po WHERE open_qty > 0)
        SELECT name, round(CAST(sum(ov) AS DOUBLE), 4) AS open_value, count(DISTINCT po_no) AS open_pos FROM op GROUP BY name
        ORDER BY sum(ov) DESC, name LIMIT 10""",
    "cat_procurement_savings": as_cte("sv2", PSQL["procurement_savings"].replace("LIMIT 12)", "LIMIT 10)"))
    + ' SELECT "desc" AS name, over AS overpay, median AS median_price, max AS max_price FROM sv2',
    "cat_inventory_stock_value": SV + f""" SELECT {clean_category('material_group')} AS name, round(sum(stock_value_cost), 4) AS value,
        count(DISTINCT material) AS skus FROM sv GROUP BY 1 ORDER BY value DESC, name LIMIT 10""",
    "cat_inventory_doh": as_cte("dh", K["kpi_doh"]) + f""", g AS (SELECT {clean_category('material_group')} AS name,
            sum(stock_qty) AS q, sum(avg_daily_consumption) AS daily FROM dh GROUP BY 1),
        g2 AS (SELECT *, CASE WHEN daily > 0 THEN q / daily END AS doh FROM g WHERE daily > 0)
        SELECT name, round_even(doh, 1) AS doh_days FROM g2 ORDER BY doh DESC, name LIMIT 10""",
    "cat_inventory_aging": as_cte("ad", K["kpi_aging_distribution"]) + """ SELECT aging_bucket AS name,
        round(sum(stock_value), 4) AS value, CAST(sum(sku_count) AS BIGINT) AS skus,
        CASE aging_bucket WHEN '0-30' THEN 0 WHEN '31-90' THEN 1 WHEN '91-180' THEN 2 WHEN '181-365' THEN 3
                          WHEN '365+' THEN 4 ELSE 5 END AS ord FROM ad GROUP BY aging_bucket""",
    "cat_inventory_non_moving": as_cte("nm", K["kpi_non_moving"]) + """ SELECT material_desc AS name,
        closing_stock_value AS value, CAST(trunc(aging_days) AS INTEGER) AS aging_days FROM nm
        ORDER BY closing_stock_value DESC, material, plant LIMIT 10""",
    "cat_inventory_health": as_cte("hs", K["kpi_health_score"]) + """ SELECT health_tier AS name,
        count(DISTINCT material) AS skus, round(sum(closing_stock_value), 4) AS value FROM hs GROUP BY 1""",
    "cat_expiry": IE + ", m AS (" + band_sql("ie2", "slab", ["Expired", "0-30d", "31-90d", "91-180d", "181-365d", "365d+"],
                                             {"value": ("sum", "total_cost"), "items": ("nunique", "material")})
    + ") SELECT label AS name, ord, value, items FROM m",
    "cat_stock_risk": REP + """ SELECT aging_risk AS name, count(DISTINCT material_id) AS skus,
        round(sum(closing_stock_value), 4) AS value FROM rep GROUP BY 1""",
    "cat_stock_risk_reorder": REP + """ SELECT material_desc AS name, replenishment_quantity AS reorder_qty,
        closing_stock AS on_hand, demand_monthly AS monthly_demand FROM rep WHERE replenishment_quantity > 0
        ORDER BY replenishment_quantity DESC, material_id, plant LIMIT 15""",
    "cat_forecast": as_cte("rd", FSQL["kpi_stock_radar"]) + """ SELECT radar_status AS name,
        count(DISTINCT material_id) AS skus, round(sum(demand_forecast), 4) AS forecast_demand FROM rd GROUP BY 1""",
    "cat_forecast_fulfillment": as_cte("fl", FSQL["kpi_fulfillment"]) + """ SELECT round_even(avg(fulfillment_rate), 1)
        AS fulfillment_pct, count(*) AS skus FROM fl""",
    "cat_overview": GR + ", " + SV + ", " + PV + ", " + IE + """, x AS (SELECT (SELECT sum(revenue) FROM st) AS rev,
            (SELECT sum(cost) FROM st) AS cost,
            (SELECT CAST(COALESCE(sum(total_cost), 0) AS DOUBLE) FROM ie2
              WHERE slab IN ('Expired', '0-30d', '31-90d', '91-180d')) AS within,
            (SELECT sum(stock_value_cost) FROM sv) AS stock, (SELECT sum(purchase_value) FROM pv) AS purchase)
        SELECT 'Revenue' AS name, round(rev, 4) AS value FROM x
        UNION ALL SELECT 'Margin', round(rev - cost, 4) FROM x
        UNION ALL SELECT 'Margin Pct', round(CASE WHEN rev <> 0 THEN (rev - cost) / rev * 100 ELSE 0.0 END, 6) FROM x
        UNION ALL SELECT 'Stock Value', round(stock, 4) FROM x
        UNION ALL SELECT 'Purchase Value', round(purchase, 4) FROM x
        UNION ALL SELECT 'Expiry Within 180D', round(within, 4) FROM x""",
}
