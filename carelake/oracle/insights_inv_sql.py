"""Oracles for INS-01..14."""
from carelake.oracle.frag import SNAP, as_cte, band_sql, expiry_slab, money, month_idx, r6
from carelake.oracle.kpi_sql import SQL as K

HS = as_cte("hs", K["kpi_health_score"])
DOH = as_cte("dh", K["kpi_doh"]) + ", " + as_cte("sv", K["kpi_stock_value"]) + """,
dj AS (SELECT dh.*, COALESCE(sv.stock_value_cost, 0.0) AS stock_value_cost FROM dh LEFT JOIN sv USING (plant, material))"""
SC = as_cte("sc", K["kpi_stock_change"])
NM = as_cte("nm", K["kpi_non_moving"])
RC = as_cte("rc", K["kpi_risk_classification"])
NE = as_cte("ne", K["kpi_near_expiry"])
AG = as_cte("ag", K["kpi_inventory_aging"])
IE = f"ie AS (SELECT *, CAST(date_diff('day', {SNAP}, expiry_date) AS INTEGER) AS dte FROM fact_inventory WHERE expiry_date IS NOT NULL AND qty > 0), ie2 AS (SELECT *, {expiry_slab('dte')} AS slab FROM ie)"

VAL_AGE = ["≤30d", "31–90d", "91–180d", "181–365d", "365d+"]
A0 = "COALESCE(aging_days, 0)"
VAL_BAND = (f"(CASE WHEN {A0} <= -1 THEN NULL WHEN {A0} <= 30 THEN '≤30d' WHEN {A0} <= 90 THEN '31–90d' "
            f"WHEN {A0} <= 180 THEN '91–180d' WHEN {A0} <= 365 THEN '181–365d' ELSE '365d+' END)")
ITR = ["Dead (0×)", "Slow (≤1×)", "Moderate (1–4×)", "Fast (>4×)"]
TV = "COALESCE(turnover_annualized, 0.0)"
DOHL = ["< 15 days", "15–30 days", "30–90 days", "90–180 days", "180–365 days", "365+ days", "No movement"]
DOH_BAND = ("(CASE WHEN doh_days IS NULL THEN 'No movement' WHEN doh_days >= 0 AND doh_days < 15 THEN '< 15 days' "
            "WHEN doh_days >= 15 AND doh_days < 30 THEN '15–30 days' WHEN doh_days >= 30 AND doh_days < 90 THEN '30–90 days' "
            "WHEN doh_days >= 90 AND doh_days < 180 THEN '90–180 days' WHEN doh_days >= 180 AND doh_days < 365 THEN '180–365 days' "
            "WHEN doh_days >= 365 THEN '365+ days' END)")
HSB = ("(CASE WHEN health_score >= 0 AND health_score < 20 THEN '0–20' WHEN health_score >= 20 AND health_score < 40 THEN '20–40' "
       "WHEN health_score >= 40 AND health_score < 60 THEN '40–60' WHEN health_score >= 60 AND health_score < 80 THEN '60–80' "
       "WHEN health_score >= 80 AND health_score < 100.01 THEN '80–100' END)")
RA = ["0–30", "31–90", "91–180", "181–365", "365+"]
RE = ["Expired", "≤90d", "91–365d", "365d+", "No date"]
RAB = ("(CASE WHEN aging_days < 30 THEN '0–30' WHEN aging_days < 90 THEN '31–90' WHEN aging_days < 180 THEN '91–180' "
       "WHEN aging_days < 365 THEN '181–365' ELSE '365+' END)")
REB = ("(CASE WHEN days_to_expiry IS NULL THEN 'No date' WHEN days_to_expiry < 0 THEN 'Expired' WHEN days_to_expiry <= 90 "
       "THEN '≤90d' WHEN days_to_expiry <= 365 THEN '91–365d' ELSE '365d+' END)")

SQL = {
    "monthly_series": SC + f""" SELECT year, month, material_group, round(sum(stock_change), 4) AS value,
        {month_idx('month')} AS month_idx FROM sc GROUP BY ALL""",
    "inventory_valuation": as_cte("sv", K["kpi_stock_value"])
    + " SELECT material_group, round(sum(stock_value_cost), 4) AS inventory_valuation FROM sv GROUP BY 1",
    "valuation_age": band_sql("fact_inventory", VAL_BAND, VAL_AGE, {"cost": ("sum", "total_cost"), "mrp": ("sum", "total_mrp"),
                                                                      "qty": ("sum", "qty"), "skus": ("nunique", "material")}),
    "valuation_categories": f"""g AS (SELECT material_group, sum(total_cost) AS c, sum(total_mrp) AS m,
            count(DISTINCT material) AS skus FROM fact_inventory GROUP BY 1 ORDER BY c DESC, material_group NULLS LAST LIMIT 12)
        SELECT material_group AS name, {money('c')} AS cost, {money('m')} AS mrp, {money('m - c')} AS markup,
               {r6('CASE WHEN c > 0 THEN CAST(m - c AS DOUBLE) / CAST(c AS DOUBLE) * 100 ELSE 0.0 END')} AS markup_pct, skus FROM g""",
    "itr_totals": HS + f""", t AS (SELECT sum(consumption_cost) AS cogs, sum(closing_stock_value) AS inv, count(*) AS total_skus,
            count(*) FILTER (WHERE consumption_cost > 0) AS movers,
            COALESCE(avg(CASE WHEN consumption_cost > 0 THEN least(turnover_annualized, 60.0) END), 0.0) AS movers_itr FROM hs),
        t2 AS (SELECT *, CASE WHEN inv <> 0 THEN cogs * 2.0 / inv ELSE 0.0 END AS itr FROM t)
        SELECT {r6('itr')} AS portfolio_itr, round(cogs, 4) AS cogs_6mo, round(cogs * 2.0, 4) AS cogs_annual,
               round(inv, 4) AS inventory, {r6('CASE WHEN itr <> 0 THEN 12.0 / itr ELSE 0.0 END')} AS months_on_hand,
               total_skus, movers, {r6('movers_itr')} AS movers_itr FROM t2""",
    "itr_categories": HS + f""", g AS (SELECT material_group, sum(consumption_cost) AS cogs, sum(closing_stock_value) AS inv,
            count(DISTINCT material) AS skus FROM hs GROUP BY 1 ORDER BY inv DESC, material_group NULLS LAST LIMIT 12)
        SELECT material_group AS name, {r6('CASE WHEN inv > 0 THEN cogs * 2.0 / inv ELSE 0.0 END')} AS itr,
               round(cogs, 4) AS cogs, round(inv, 4) AS inv, skus FROM g""",
    "itr_bands": HS + " " + band_sql("hs", f"(CASE WHEN {TV} <= 0 THEN '{ITR[0]}' WHEN {TV} <= 1 THEN '{ITR[1]}' WHEN {TV} <= 4 "
                                           f"THEN '{ITR[2]}' ELSE '{ITR[3]}' END)", ITR,
                                     {"count": ("count", None), "value": ("sum", "closing_stock_value")}),
    "itr_timeline": f"SELECT year, month_num, month, {money('sum(amount_lc)')} AS value FROM fact_consumption GROUP BY ALL",
    "itr_by_group": HS + " SELECT material_group, round_even(avg(turnover_annualized), 2) AS itr FROM hs GROUP BY 1",
    "doh_bands": DOH + " " + band_sql("dj", DOH_BAND, DOHL, {"count": ("count", None), "value": ("sum", "stock_value_cost"),
                                                            "qty": ("sum", "stock_qty")}),
    "doh_categories": DOH + f""", g AS (SELECT material_group, sum(stock_qty) AS q, sum(avg_daily_consumption) AS daily,
            sum(stock_value_cost) AS value, count(DISTINCT material) AS skus FROM dj GROUP BY 1
            ORDER BY value DESC, material_group NULLS LAST LIMIT 12)
        SELECT material_group AS name, {r6('CASE WHEN daily > 0 THEN q / daily END')} AS doh, round(value, 4) AS value,
               round(q, 4) AS qty, {r6('daily')} AS daily, skus FROM g""",
    "doh_reorder": DOH + """ SELECT material_desc AS name, material, plant, doh_days AS doh, stock_value_cost AS value,
        stock_qty AS qty, avg_daily_consumption AS daily FROM dj WHERE doh_days IS NOT NULL AND avg_daily_consumption > 0
        ORDER BY doh_days, material, plant LIMIT 12""",
    "doh_overstock": DOH + """ SELECT material_desc AS name, material, plant, doh_days AS doh, stock_value_cost AS value,
        stock_qty AS qty FROM dj WHERE doh_days > 365 ORDER BY stock_value_cost DESC, material, plant LIMIT 8""",
    "health_tiers": HS + ", hs2 AS (SELECT *, CASE WHEN consumption_cost > 0 THEN 1.0 ELSE 0.0 END AS moving FROM hs) "
    + band_sql("hs2", "health_tier", ["Healthy", "Watch", "At Risk"],
               {"count": ("count", None), "value": ("sum", "closing_stock_value"), "avg_score": ("avg", "health_score"),
                "avg_aging": ("avg", "aging_days"), "avg_turnover": ("median", "turnover_annualized"),
                "moving_pct": ("avg", "moving")}),
    "health_bands": HS + " " + band_sql("hs", HSB, ["0–20", "20–40", "40–60", "60–80", "80–100"],
                                        {"count": ("count", None), "value": ("sum", "closing_stock_value")}),
    "health_categories": HS + f""", g AS (SELECT material_group, avg(health_score) AS avg_score, sum(closing_stock_value) AS value,
            count(DISTINCT material) AS skus, avg(CASE WHEN consumption_cost > 0 THEN 1.0 ELSE 0.0 END) AS moving,
            avg(aging_days) AS avg_aging, count(*) FILTER (WHERE health_tier = 'Healthy') AS mix_healthy,
            count(*) FILTER (WHERE health_tier = 'Watch') AS mix_watch,
            count(*) FILTER (WHERE health_tier = 'At Risk') AS mix_atrisk
            FROM hs GROUP BY 1 ORDER BY value DESC, material_group NULLS LAST LIMIT 12)
        SELECT material_group AS name, {r6('avg_score')} AS avg_score, round(value, 4) AS value, skus, {r6('moving')} AS moving,
               {r6('avg_aging')} AS avg_aging, mix_healthy, mix_watch, mix_atrisk FROM g""",
    "stock_flow_monthly": SC + """ SELECT year, month, round(sum(inflow), 4) AS inflow, round(sum(outflow), 4) AS outflow,
        round(sum(stock_change), 4) AS net, substr(month, 1, 3) || ' ' || substr(CAST(year AS VARCHAR), 3, 2) AS label
        FROM sc GROUP BY year, month""",
    "stock_risers": SC + """, g AS (SELECT material, material_desc, material_group, round(sum(inflow), 4) AS inflow,
            round(sum(outflow), 4) AS outflow, round(sum(stock_change), 4) AS net FROM sc
            WHERE material IS NOT NULL AND material_desc IS NOT NULL AND material_group IS NOT NULL GROUP BY ALL),
        r AS (SELECT 'riser' AS kind, * FROM g ORDER BY net DESC, material LIMIT 8),
        f AS (SELECT 'faller' AS kind, * FROM g ORDER BY net, material LIMIT 8)
        SELECT kind, material_desc AS name, material, inflow, outflow, net FROM (SELECT * FROM r UNION ALL SELECT * FROM f)""",
    "non_moving_reasons": NM + " SELECT reason, count(*) AS count, round(sum(closing_stock_value), 4) AS value FROM nm GROUP BY 1",
    "non_moving_aging": NM + " " + band_sql(
        "nm", "(CASE WHEN aging_days < 90 THEN '≤90d' WHEN aging_days < 180 THEN '91–180d' WHEN aging_days < 365 "
              "THEN '181–365d' ELSE '365d+' END)", ["≤90d", "91–180d", "181–365d", "365d+"],
        {"value": ("sum", "closing_stock_value"), "count": ("count", None)}),
    "risk_tiers": RC + " " + band_sql("rc", "risk_level", ["High", "Medium", "Low"],
                                      {"count": ("count", None), "value": ("sum", "closing_stock_value")}),
    "risk_matrix": RC + ", " + "rb AS (SELECT *, " + RAB + " || '|' || " + REB + " AS cell FROM rc), m AS ("
    + band_sql("rb", "cell", [f"{a}|{e}" for a in RA for e in RE], {"value": ("sum", "closing_stock_value")})
    + ") SELECT split_part(label, '|', 1) AS age_band, split_part(label, '|', 2) AS expiry_band, value FROM m",
    "risk_factors": RC + """, hi AS (SELECT * FROM rc WHERE risk_level = 'High')
        SELECT 'Expiring ≤90 days' AS label, count(*) FILTER (WHERE days_to_expiry <= 90) AS count FROM hi
        UNION ALL SELECT 'Aged > 180 days', count(*) FILTER (WHERE aging_days > 180) FROM hi
        UNION ALL SELECT 'No consumption', count(*) FILTER (WHERE NOT consumed) FROM hi""",
    "expiry_ladder": IE + " " + band_sql("ie2", "slab", ["Expired", "0-30d", "31-90d", "91-180d", "181-365d", "365d+"],
                                         {"lines": ("count", None), "items": ("nunique", "material"), "qty": ("sum", "qty"),
                                          "value": ("sum", "total_cost"), "mrp": ("sum", "total_mrp")}),
    "near_expiry_buckets": NE + """ SELECT expiry_bucket AS bucket, count(*) AS count, round(sum(total_cost), 4) AS value,
        round(sum(total_mrp), 4) AS mrp, round(sum(qty), 4) AS qty FROM ne
        WHERE expiry_bucket IN ('Expired', '0-30d', '31-90d', '91-180d') GROUP BY 1""",
    "expiry_calendar": NE + """, g AS (SELECT date_trunc('month', expiry_date) AS period, round(sum(total_cost), 4) AS value,
            count(material) AS count FROM ne WHERE days_to_expiry >= 0 AND expiry_date IS NOT NULL GROUP BY 1
            ORDER BY period LIMIT 10)
        SELECT CAST(period AS DATE) AS period, strftime(period, '%b %y') AS label, value, count FROM g""",
    "expiry_items": IE + f""" SELECT material, material_desc, batch, plant, {money('qty')} AS qty, {money('total_cost')} AS value,
        {money('total_mrp')} AS mrp, dte AS days, expiry_date AS expiry, slab FROM ie2
        ORDER BY total_cost DESC, material, batch, plant""",
    "expiry_items_search": IE + f""" SELECT material, material_desc, batch, plant, {money('qty')} AS qty, {money('total_cost')} AS value,
        {money('total_mrp')} AS mrp, dte AS days, expiry_date AS expiry, slab FROM ie2
        WHERE plant = 'P03' AND slab = 'Expired' AND (contains(lower(material_desc), '1') OR contains(material, '1'))""",
    "inventory_aging_top": AG + """, t AS (SELECT * FROM ag ORDER BY closing_stock_value DESC, material, plant LIMIT 50)
        SELECT CAST(row_number() OVER (ORDER BY closing_stock_value DESC, material, plant) AS INTEGER) AS rank, material,
               material_desc, plant, age_since_last_sale_days, age_since_last_purchase_days, aging_days, aging_category,
               closing_stock_value, closing_stock_quantity FROM t""",
}
