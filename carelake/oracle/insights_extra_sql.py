"""Oracles for the remaining insight sub-blocks."""
from carelake.oracle.forecast_sql import SQL as FSQL
from carelake.oracle.frag import as_cte, month_idx, r6
from carelake.oracle.insights_inv_sql import DOH, HS
from carelake.oracle.kpi_sql import SQL as K

UC = as_cte("uc", K["kpi_units_consumed"])
DP = as_cte("dp", K["kpi_consumption_by_department"])
ORD = f"(year * 12 + {month_idx('month')})"


def _gtop(src_cte, src, value, n, qty=None, where=""):
    q = f", round(sum({qty}), 4) AS qty" if qty else ""
    w = f"WHERE {where}" if where else ""
    return (src_cte + f""" SELECT material_group AS name, round(sum({value}), 4) AS value, count(DISTINCT material) AS skus{q}
        FROM {src} {w} GROUP BY material_group ORDER BY sum({value}) DESC, material_group NULLS LAST LIMIT {n}""")


SQL = {
    "valuation_totals": f"""SELECT round(CAST(COALESCE(sum(total_cost), 0) AS DOUBLE), 4) AS cost,
        round(CAST(COALESCE(sum(total_mrp), 0) AS DOUBLE), 4) AS mrp,
        round(CAST(COALESCE(sum(total_mrp) - sum(total_cost), 0) AS DOUBLE), 4) AS markup,
        {r6('CASE WHEN sum(total_cost) <> 0 THEN CAST(sum(total_mrp) - sum(total_cost) AS DOUBLE) / CAST(sum(total_cost) AS DOUBLE) * 100 ELSE 0.0 END')} AS markup_pct,
        count(DISTINCT material) AS skus, round(CAST(COALESCE(sum(qty), 0) AS DOUBLE), 4) AS qty FROM fact_inventory""",
    "doh_totals": DOH + f""" SELECT count(*) AS total_skus, count(doh_days) AS moving_skus,
        count(*) FILTER (WHERE doh_days IS NULL) AS nonmoving_skus,
        {r6('COALESCE(median(doh_days), 0.0)')} AS median_doh, {r6('COALESCE(avg(doh_days), 0.0)')} AS mean_doh,
        round(sum(stock_value_cost), 4) AS total_value,
        round(COALESCE(sum(stock_value_cost) FILTER (WHERE doh_days >= 0 AND doh_days < 30), 0.0), 4) AS risk_value,
        count(*) FILTER (WHERE doh_days >= 0 AND doh_days < 30) AS risk_count,
        round(COALESCE(sum(stock_value_cost) FILTER (WHERE doh_days >= 30 AND doh_days < 90), 0.0), 4) AS healthy_value,
        round(COALESCE(sum(stock_value_cost) FILTER (WHERE doh_days >= 365), 0.0), 4) AS overstock_value,
        count(*) FILTER (WHERE doh_days >= 365) AS overstock_count,
        round(COALESCE(sum(stock_value_cost) FILTER (WHERE doh_days IS NULL), 0.0), 4) AS nonmoving_value FROM dj""",
    "health_totals": HS + f""" SELECT {r6('COALESCE(avg(health_score), 0.0)')} AS avg_score,
        {r6('COALESCE(median(health_score), 0.0)')} AS median_score, count(*) AS total_skus,
        round(sum(closing_stock_value), 4) AS total_value,
        {r6('COALESCE(avg(CASE WHEN consumption_cost > 0 THEN 1.0 ELSE 0.0 END), 0.0)')} AS moving_pct,
        {r6('COALESCE(avg(CASE WHEN aging_days <= 90 THEN 1.0 ELSE 0.0 END), 0.0)')} AS fresh_pct FROM hs""",
    "non_moving_categories": _gtop(as_cte("nm", K["kpi_non_moving"]), "nm", "closing_stock_value", 12,
                                   qty="closing_stock_quantity"),
    "risk_categories": _gtop(as_cte("rc", K["kpi_risk_classification"]), "rc", "closing_stock_value", 10,
                             where="risk_level = 'High'"),
    "near_expiry_categories": _gtop(as_cte("ne", K["kpi_near_expiry"]), "ne", "total_cost", 10),
    "lead_time_totals": as_cte("lt", K["kpi_vendor_lead_time"]) + f""" SELECT
        {r6('CASE WHEN sum(gr_lines) > 0 THEN sum(median_lead_time_days * gr_lines) / sum(gr_lines) ELSE 0.0 END')} AS median,
        {r6('CASE WHEN sum(gr_lines) > 0 THEN 100 * COALESCE(sum(gr_lines) FILTER (WHERE median_lead_time_days <= 7), 0) / sum(gr_lines) ELSE 0.0 END')} AS under7,
        count(DISTINCT vendor_name) AS vendors FROM lt""",
    "purchase_top_skus": as_cte("mp", K["kpi_monthly_purchase_value"]) + """ SELECT material, material_desc AS "desc",
        material_group AS "group", round(sum(monthly_purchase_value), 4) AS value FROM mp
        WHERE material IS NOT NULL AND material_desc IS NOT NULL AND material_group IS NOT NULL
        GROUP BY 1, 2, 3 ORDER BY sum(monthly_purchase_value) DESC, material LIMIT 8""",
    "consumption_totals": UC + ", " + DP + f""", m AS (SELECT year, month, sum(consumption_cost) AS c, {ORD} AS o FROM uc GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (ORDER BY o DESC) AS rk FROM m),
        dg AS (SELECT cost_ctr, sum(consumption_cost) AS v FROM dp GROUP BY 1),
        x AS (SELECT (SELECT first(c) FROM r WHERE rk = 1) AS b, (SELECT first(c) FROM r WHERE rk = 2) AS a,
                     (SELECT sum(v) FROM dg) AS dtot, (SELECT sum(v) FROM (SELECT v FROM dg ORDER BY v DESC, cost_ctr LIMIT 5)) AS top5,
                     (SELECT count(*) FROM m) AS n_months, (SELECT sum(consumption_cost) FROM uc) AS cost)
        SELECT (SELECT round(sum(consumption_cost), 4) FROM uc) AS cost, (SELECT round(sum(total_units), 4) FROM uc) AS units,
               (SELECT count(DISTINCT material) FROM uc) AS materials, (SELECT count(DISTINCT plant) FROM uc) AS plants,
               (SELECT count(DISTINCT cost_ctr) FROM dp) AS departments, {r6('cost / greatest(n_months, 1)')} AS avg_month,
               {r6('CASE WHEN a IS NOT NULL AND a <> 0 THEN (b - a) / a * 100 ELSE 0.0 END')} AS last_mom,
               {r6('CASE WHEN dtot <> 0 THEN top5 / dtot * 100 ELSE 0.0 END')} AS dept_top5 FROM x""",
    "units_scatter": UC + f""", g AS (SELECT material, material_desc, sum(total_units) AS u, sum(consumption_cost) AS c FROM uc
            WHERE material IS NOT NULL AND material_desc IS NOT NULL GROUP BY 1, 2 HAVING sum(total_units) >= 1
            ORDER BY c DESC, material LIMIT 45)
        SELECT material, material_desc AS "desc", round(u, 4) AS units, round(c, 4) AS cost,
               {r6('CASE WHEN u > 0 THEN c / u ELSE 0.0 END')} AS cpu FROM g""",
    "department_month_matrix": DP + f""", d AS (SELECT *, printf('%04d-%02d', year, {month_idx('month')} + 1) AS ym FROM dp),
        top AS (SELECT cost_ctr, sum(consumption_cost) AS t FROM d GROUP BY 1 ORDER BY t DESC, cost_ctr LIMIT 6),
        mons AS (SELECT DISTINCT ym FROM d),
        cells AS (SELECT cost_ctr, ym, sum(consumption_cost) AS v FROM d GROUP BY 1, 2)
        SELECT top.cost_ctr AS name, mons.ym, round(COALESCE(cells.v, 0.0), 4) AS value
        FROM top CROSS JOIN mons LEFT JOIN cells ON cells.cost_ctr = top.cost_ctr AND cells.ym = mons.ym""",
    "forecast_status_counts": as_cte("rd", FSQL["kpi_stock_radar"]) + ", " + as_cte("af", FSQL["kpi_aging_risk_forecast"])
    + """ SELECT radar_status AS status, count(*) AS count, 'radar' AS kind FROM rd GROUP BY 1
        UNION ALL SELECT aging_risk_forecast, count(*), 'aging' FROM af GROUP BY 1""",
}
