"""Oracles for INS-15..25."""
from carelake.oracle.frag import as_cte, band_sql, money, month_idx, r6
from carelake.oracle.frag_text import clean_category
from carelake.oracle.kpi_sql import SQL as K

PV = as_cte("pv", K["kpi_purchase_value"])
VV = as_cte("vv", K["kpi_vendor_volume"])
CT = as_cte("ct", K["kpi_cycle_time"])
FR = as_cte("fr", K["kpi_fill_rate"])
LOC = as_cte("loc", K["kpi_purchase_by_location"])
LT = as_cte("lt", K["kpi_vendor_lead_time"])
MP = as_cte("mp", K["kpi_monthly_purchase_value"])
ORD = f"(year * 12 + {month_idx('month')})"
MS = f"ms AS (SELECT year, month, sum(purchase_value) AS value, {ORD} AS ord FROM pv GROUP BY year, month)"
VT = MS + """, vt0 AS (SELECT *, lag(value) OVER (ORDER BY ord) AS prev FROM ms),
vt AS (SELECT year, month, ord, round(value, 4) AS value,
              round(CASE WHEN prev IS NULL THEN 0.0 ELSE value - prev END, 4) AS delta,
              round(CASE WHEN prev IS NULL OR prev = 0 THEN 0.0 ELSE (value - prev) / prev * 100 END, 6) AS pct,
              prev IS NULL AS first FROM vt0)"""
VS = """vg AS (SELECT vendor_name, sum(vendor_value) AS value, CAST(sum(po_lines) AS BIGINT) AS lines, sum(vendor_qty) AS qty FROM vv
           WHERE vendor_name IS NOT NULL GROUP BY 1),
vs0 AS (SELECT *, CASE WHEN sum(value) OVER () > 0 THEN value / sum(value) OVER () * 100 ELSE 0.0 END AS share,
               row_number() OVER (ORDER BY value DESC, vendor_name) AS rk FROM vg),
vs AS (SELECT *, sum(share) OVER (ORDER BY value DESC, vendor_name ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM vs0)"""
WIN = f"{ORD} BETWEEN {2000 * 12 + 11} AND {2001 * 12 + 4}"
FRC = "frc AS (SELECT *, CASE WHEN ordered_qty <> 0 THEN least(greatest(1.0 - open_qty / ordered_qty, 0.0), 1.0) * 100 END AS comp FROM fr)"
YM = f"printf('%04d-%02d', year, {month_idx('month')} + 1)"
MM = MP + f""", mpy AS (SELECT *, {YM} AS ym FROM mp),
tg AS (SELECT material_group, sum(monthly_purchase_value) AS t FROM mpy GROUP BY 1 ORDER BY t DESC, material_group NULLS LAST LIMIT 8),
mons AS (SELECT DISTINCT ym FROM mpy),
cells AS (SELECT material_group, ym, sum(monthly_purchase_value) AS v FROM mpy GROUP BY ALL),
grid AS (SELECT tg.material_group AS name, mons.ym FROM tg, mons)"""

SQL = {
    "procurement_totals": ", ".join([PV, VV, CT, FR, LOC, LT]) + ", " + MS + f""",
        r AS (SELECT *, row_number() OVER (ORDER BY ord DESC) AS rk FROM ms),
        vg AS (SELECT vendor_name, sum(vendor_value) AS v FROM vv WHERE vendor_name IS NOT NULL GROUP BY 1),
        g2 AS (SELECT * FROM fact_grn WHERE unit_mrp > 0 AND net_price > 0 AND gr_qty > 0),
        s AS (SELECT (SELECT sum(purchase_value) FROM pv) AS spend,
                     (SELECT sum(v) FROM (SELECT v FROM vg ORDER BY v DESC, vendor_name LIMIT 5)) AS top5,
                     (SELECT sum(gr_lines) FROM ct) AS gl, (SELECT sum(avg_po_to_gr_tat * gr_lines) FROM ct) AS po_w,
                     (SELECT sum(avg_pr_to_gr_tat * gr_lines) FROM ct) AS pr_w, (SELECT sum(gr_lines) FROM lt) AS llg,
                     (SELECT sum(median_lead_time_days * gr_lines) FROM lt) AS med_w,
                     (SELECT sum(ordered_qty) FROM fr) AS ordered, (SELECT sum(open_qty) FROM fr) AS openq,
                     COALESCE((SELECT CAST(sum(gr_qty * unit_mrp) AS DOUBLE) FROM g2), 0.0) AS mrp,
                     COALESCE((SELECT CAST(sum(gr_qty * net_price) AS DOUBLE) FROM g2), 0.0) AS cost,
                     (SELECT first(value) FROM r WHERE rk = 1) AS b, (SELECT first(value) FROM r WHERE rk = 2) AS a)
        SELECT round(COALESCE(spend, 0.0), 4) AS spend,
               (SELECT count(DISTINCT vendor_name) FROM vv WHERE vendor_name IS NOT NULL) AS vendors,
               (SELECT CAST(COALESCE(sum(po_lines), 0) AS BIGINT) FROM pv) AS po_lines,
               {r6('CASE WHEN gl > 0 THEN po_w / gl ELSE 0.0 END')} AS avg_po_gr,
               {r6('CASE WHEN gl > 0 THEN pr_w / gl ELSE 0.0 END')} AS avg_pr_gr,
               {r6('CASE WHEN llg > 0 THEN med_w / llg ELSE 0.0 END')} AS median_lead,
               {r6('CASE WHEN ordered > 0 THEN least(greatest(1.0 - openq / ordered, 0.0), 1.0) * 100 ELSE 0.0 END')} AS completion,
               {r6('CASE WHEN spend > 0 THEN top5 / spend * 100 ELSE 0.0 END')} AS top5_share,
               (SELECT count(DISTINCT plant) FROM loc) AS n_plants,
               {r6('CASE WHEN mrp > 0 THEN (mrp - cost) / mrp * 100 ELSE 0.0 END')} AS margin_pct,
               round(mrp - cost, 4) AS margin_value, round(mrp, 4) AS mrp_value,
               {r6('CASE WHEN a IS NOT NULL AND a <> 0 THEN (b - a) / a * 100 ELSE 0.0 END')} AS last_mom FROM s""",
    "open_po_by_category": f"""op AS (SELECT *, open_qty * net_price AS open_value, {clean_category('major_group')} AS g
            FROM fact_po WHERE open_qty > 0)
        SELECT g AS category, count(DISTINCT po_no) AS pos, {money('sum(open_value)')} AS value FROM op GROUP BY g
        ORDER BY sum(open_value) DESC, g LIMIT 7""",
    "procurement_savings": f"""d AS (SELECT *, CAST(net_price AS DOUBLE) AS price FROM fact_grn
            WHERE net_price > 0 AND gr_qty > 0 AND material IS NOT NULL),
        st AS (SELECT material, median(price) AS med FROM d GROUP BY material
               HAVING count(*) >= 4 AND max(price) / min(price) <= 2.5),
        d2 AS (SELECT d.*, st.med FROM d JOIN st USING (material)),
        opp AS (SELECT material, material_desc, sum(greatest(price - med, 0.0) * CAST(gr_qty AS DOUBLE)) AS over,
                       count(*) AS lines, first(med) AS median, max(price) AS pmax, sum(gr_qty) AS qty, min(major_group) AS grp
                FROM d2 WHERE material_desc IS NOT NULL GROUP BY 1, 2 HAVING sum(greatest(price - med, 0.0) * CAST(gr_qty AS DOUBLE)) > 0
                ORDER BY over DESC, material LIMIT 12)
        SELECT material, material_desc AS "desc", {clean_category('grp')} AS "group", {r6('median')} AS median, {r6('pmax')} AS max,
               lines, {money('qty')} AS qty, {r6('over')} AS over,
               {r6('CASE WHEN median <> 0 THEN (pmax - median) / median * 100 ELSE 0.0 END')} AS spread_pct FROM opp""",
    "purchase_categories": PV + """ SELECT category AS name, round(sum(purchase_value), 4) AS value, CAST(sum(po_lines) AS BIGINT) AS lines,
        lower(trim(category)) IN ('uncategorized', '', 'nan', 'none') AS uncat FROM pv GROUP BY category
        ORDER BY sum(purchase_value) DESC, category NULLS LAST LIMIT 12""",
    "purchase_vendors": PV + ", " + VV + f""", vg AS (SELECT vendor_name, sum(vendor_value) AS v, CAST(sum(po_lines) AS BIGINT) AS lines FROM vv
            WHERE vendor_name IS NOT NULL GROUP BY 1 ORDER BY v DESC, vendor_name LIMIT 8)
        SELECT vendor_name AS name, round(v, 4) AS value,
               {r6('CASE WHEN (SELECT sum(purchase_value) FROM pv) > 0 THEN v / (SELECT sum(purchase_value) FROM pv) * 100 ELSE 0.0 END')} AS share,
               lines FROM vg""",
    "variance_timeline": PV + ", " + VT + " SELECT * FROM vt",
    "variance_totals": PV + ", " + VT + """, nf AS (SELECT * FROM vt WHERE NOT first)
        SELECT COALESCE((SELECT pct FROM vt ORDER BY ord DESC LIMIT 1), 0.0) AS latest_pct,
               COALESCE((SELECT delta FROM vt ORDER BY ord DESC LIMIT 1), 0.0) AS latest_delta,
               round(COALESCE((SELECT avg(value) FROM vt), 0.0), 4) AS avg_spend,
               COALESCE((SELECT month FROM nf ORDER BY pct DESC, ord LIMIT 1), '-') AS up_month,
               COALESCE((SELECT max(pct) FROM nf), 0.0) AS up_pct,
               COALESCE((SELECT month FROM nf ORDER BY pct, ord LIMIT 1), '-') AS down_month,
               COALESCE((SELECT min(pct) FROM nf), 0.0) AS down_pct,
               round(COALESCE((SELECT stddev_pop(pct) FROM nf), 0.0), 6) AS volatility""",
    "vendor_concentration": VV + ", " + VS + f""" SELECT count(*) AS vendors, round(sum(value), 4) AS total,
        {r6('COALESCE(sum(share) FILTER (WHERE rk = 1), 0.0)')} AS top1, {r6('COALESCE(sum(share) FILTER (WHERE rk <= 5), 0.0)')} AS top5,
        {r6('COALESCE(sum(share) FILTER (WHERE rk <= 10), 0.0)')} AS top10, count(*) FILTER (WHERE cum <= 80) + 1 AS n80,
        {r6('COALESCE(sum(share * share), 0.0)')} AS hhi FROM vs""",
    "vendor_pareto": VV + ", " + VS + f""" SELECT vendor_name AS name, round(value, 4) AS value, {r6('share')} AS share,
        {r6('cum')} AS cum, lines, CAST(rk AS INTEGER) AS rk FROM vs WHERE rk <= 15""",
    "location_share": LOC + f""" SELECT plant, purchase_value AS value,
        {r6('CASE WHEN (SELECT sum(purchase_value) FROM loc) > 0 THEN purchase_value / (SELECT sum(purchase_value) FROM loc) * 100 ELSE 0.0 END')} AS share,
        vendor_count AS vendors, po_lines AS lines FROM loc ORDER BY purchase_value DESC, plant LIMIT 12""",
    "cycle_timeline": CT + f""", c AS (SELECT * FROM ct WHERE {WIN}),
        g AS (SELECT year, month, sum(avg_po_to_gr_tat * gr_lines) AS po_w, sum(avg_pr_to_gr_tat * gr_lines) AS pr_w,
                     sum(gr_lines) AS gl FROM c GROUP BY year, month)
        SELECT year, month, {r6('CASE WHEN gl > 0 THEN COALESCE(po_w, 0.0) / gl ELSE 0.0 END')} AS po,
               {r6('CASE WHEN gl > 0 THEN COALESCE(pr_w, 0.0) / gl ELSE 0.0 END')} AS pr FROM g""",
    "cycle_plants": CT + f""", c AS (SELECT * FROM ct WHERE {WIN}),
        pp AS (SELECT plant, sum(avg_po_to_gr_tat * gr_lines) AS po_w, sum(gr_lines) AS gl FROM c GROUP BY plant),
        pp2 AS (SELECT *, CASE WHEN gl > 0 THEN COALESCE(po_w, 0.0) / gl ELSE 0.0 END AS po FROM pp)
        SELECT plant, {r6('po')} AS po, CAST(gl AS BIGINT) AS lines FROM pp2
        WHERE gl >= 20 OR (SELECT count(*) FROM pp2 WHERE gl >= 20) = 0 ORDER BY po DESC, plant LIMIT 8""",
    "lead_time_dist": LT + " " + band_sql(
        "lt", "(CASE WHEN median_lead_time_days IS NULL OR median_lead_time_days <= -1 THEN NULL "
              "WHEN median_lead_time_days <= 2 THEN '≤2d' WHEN median_lead_time_days <= 5 THEN '3–5d' "
              "WHEN median_lead_time_days <= 10 THEN '6–10d' WHEN median_lead_time_days <= 20 THEN '11–20d' ELSE '20d+' END)",
        ["≤2d", "3–5d", "6–10d", "11–20d", "20d+"], {"lines": ("sum", "gr_lines"), "vendors": ("nunique", "vendor_name")}),
    "lead_time_slow": LT + """, sig AS (SELECT * FROM lt WHERE gr_lines >= 20)
        SELECT * FROM (SELECT 'slow' AS kind, vendor_name AS name, median_lead_time_days AS days, gr_lines AS lines FROM sig
                       ORDER BY median_lead_time_days DESC, vendor_name LIMIT 8)
        UNION ALL
        SELECT * FROM (SELECT 'fast' AS kind, vendor_name AS name, median_lead_time_days AS days, gr_lines AS lines FROM sig
                       ORDER BY median_lead_time_days, vendor_name LIMIT 8)""",
    "fill_rate_plants": FR + ", " + FRC + f"""
        SELECT * FROM (SELECT 'worst' AS kind, plant, {r6('comp')} AS comp, ordered_qty, greatest(open_qty, 0.0) AS open_qty
                       FROM frc ORDER BY comp NULLS LAST, plant LIMIT 12)
        UNION ALL
        SELECT * FROM (SELECT 'best' AS kind, plant, {r6('comp')} AS comp, ordered_qty, greatest(open_qty, 0.0) AS open_qty
                       FROM frc ORDER BY comp DESC NULLS LAST, plant LIMIT 8)""",
    "fill_rate_dist": FR + ", " + FRC + " " + band_sql(
        "frc", "(CASE WHEN comp >= 99.5 THEN '100%' WHEN comp >= 95.0 AND comp < 99.5 THEN '95–99%' "
               "WHEN comp >= 85.0 AND comp < 95.0 THEN '85–95%' WHEN comp >= 70.0 AND comp < 85.0 THEN '70–85%' "
               "WHEN comp < 70.0 THEN '<70%' END)",
        ["100%", "95–99%", "85–95%", "70–85%", "<70%"], {"plants": ("count", None)}, where="ordered_qty > 0"),
    "purchase_month_matrix": MM + """ SELECT grid.name, grid.ym, round(CAST(COALESCE(c.v, 0.0) AS DOUBLE), 4) AS value
        FROM grid LEFT JOIN cells c ON c.material_group IS NOT DISTINCT FROM grid.name AND c.ym = grid.ym""",
    "margin_month_matrix": MM + f""", g AS (SELECT dm.material_group AS grp, {YM} AS ym,
            CAST(sum(g.gr_qty * g.unit_mrp) AS DOUBLE) AS mv, CAST(sum(g.gr_qty * g.net_price) AS DOUBLE) AS cv
            FROM fact_grn g JOIN dim_material dm USING (material)
            WHERE g.unit_mrp > 0 AND g.net_price > 0 AND g.gr_qty > 0 GROUP BY 1, 2)
        SELECT grid.name, grid.ym, CASE WHEN g.mv > 0 THEN round_even((g.mv - g.cv) / g.mv * 100, 1) END AS margin_pct
        FROM grid LEFT JOIN g ON grid.name = g.grp AND grid.ym = g.ym""",
    "vendor_margin": f"""g AS (SELECT vendor_name, year, month, sum(gr_qty) AS vol, CAST(sum(net_price) AS DOUBLE) / count(net_price) AS uc,
            CAST(sum(unit_mrp) AS DOUBLE) / count(unit_mrp) AS um FROM fact_grn GROUP BY ALL)
        SELECT vendor_name, year, month, {money('vol')} AS grn_volume, round_even(uc, 2) AS unit_cost,
               round_even(um, 2) AS unit_mrp,
               round_even(CASE WHEN um > 0 THEN (um - uc) / um * 100 ELSE 0.0 END, 1) AS margin FROM g""",
}
