"""Oracles for SAL-*, MRT-* and SQL-* queries."""
from carelake.oracle.frag import SNAP, as_cte, money, r6
from carelake.oracle.frag_text import clean_category
from carelake.oracle.kpi_sql import SQL as KPI_SQL

M4 = f"{money('sum(revenue)')} AS revenue, {money('sum(cost)')} AS cost, {money('sum(qty)')} AS qty, count(*) AS lines"


def _mat_grain(keys: str, where: str = "") -> str:
    return f"""g AS (SELECT {keys}, material, min(material_desc) AS md, {M4} FROM sales_line {where} GROUP BY ALL)
        SELECT g.* EXCLUDE (md), COALESCE(md, material) AS material_desc, COALESCE(dm.material_group, '') AS material_group
        FROM g LEFT JOIN dim_material dm USING (material)"""


BY_MAT = f"""g AS (SELECT material, min(material_desc) AS md, {M4} FROM sales_line GROUP BY ALL),
    bym AS (SELECT g.* EXCLUDE (md), COALESCE(md, material) AS material_desc, COALESCE(dm.material_group, '') AS material_group
            FROM g LEFT JOIN dim_material dm USING (material))"""

SQL = {
    "sales_totals": f"SELECT patient_type, {M4} FROM sales_line GROUP BY patient_type",
    "sales_monthly": f"SELECT patient_type, strftime(sale_date, '%Y-%m') AS month, {M4} FROM sales_line GROUP BY ALL",
    "sales_by_hospital": f"SELECT hospital, {M4} FROM sales_line GROUP BY hospital",
    "sales_by_manufacturer": f"SELECT manufacturer, {M4} FROM sales_line WHERE manufacturer IS NOT NULL GROUP BY ALL",
    "sales_by_material": BY_MAT + " SELECT * FROM bym",
    "sales_by_material_mfr": _mat_grain("manufacturer", "WHERE manufacturer IS NOT NULL"),
    "sales_by_material_hospital": _mat_grain("hospital"),
    "sales_by_material_dedup": BY_MAT + """
        SELECT regexp_replace(material, '\\.0$', '') AS material,
               arg_max(material_desc, {'l': length(material_desc), 'd': material_desc}) AS material_desc,
               COALESCE(max(NULLIF(material_group, '')), '') AS material_group,
               round(sum(revenue), 4) AS revenue, round(sum(cost), 4) AS cost, round(sum(qty), 4) AS qty,
               CAST(sum(lines) AS BIGINT) AS lines
        FROM bym GROUP BY 1""",
}

RAW = """raw AS (SELECT *, CAST(net_price AS DOUBLE) AS price FROM fact_grn
         WHERE material IS NOT NULL AND net_price >= 10 AND gr_qty > 0)"""
PS = RAW + f""",
p1 AS (SELECT material, median(price) AS m1 FROM raw GROUP BY 1),
clean AS (SELECT r.* FROM raw r JOIN p1 USING (material) WHERE r.price BETWEEN p1.m1 / 8.0 AND p1.m1 * 8.0),
rawstat AS (SELECT material, count(*) AS raw_n, min(price) AS raw_min_price, max(price) AS raw_max_price FROM raw GROUP BY 1),
cleanstat AS (SELECT material, median(price) AS clean_median_price, count(*) AS clean_n, min(price) AS clean_min_price,
                     max(price) AS clean_max_price FROM clean GROUP BY 1),
ps AS (SELECT a.material, dm.material_desc, dm.material_group AS category, {r6('cs.clean_median_price')} AS clean_median_price,
              COALESCE(cs.clean_n, 0) AS clean_n, {r6('cs.clean_min_price')} AS clean_min_price,
              {r6('cs.clean_max_price')} AS clean_max_price,
              {r6('cs.clean_max_price - cs.clean_min_price')} AS clean_price_spread, a.raw_n,
              {r6('a.raw_min_price')} AS raw_min_price, {r6('a.raw_max_price')} AS raw_max_price,
              a.raw_max_price > a.raw_min_price * 20 AS has_price_outlier, COALESCE(cs.clean_n, 0) >= 5 AS price_is_stable
       FROM rawstat a LEFT JOIN cleanstat cs USING (material) LEFT JOIN dim_material dm USING (material))"""

VS = RAW + f""",
vp1 AS (SELECT material, vendor_name, median(price) AS m1 FROM raw GROUP BY 1, 2),
vclean AS (SELECT r.* FROM raw r JOIN vp1 p ON r.material = p.material AND r.vendor_name = p.vendor_name
           WHERE r.price BETWEEN p.m1 / 8.0 AND p.m1 * 8.0),
vst AS (SELECT material, vendor_name, median(price) AS clean_median_price, count(*) AS clean_n,
               sum(gr_qty) AS total_qty, sum(total_amount_wo_tax) AS total_value FROM vclean GROUP BY 1, 2),
vs AS (SELECT st.material, dm.material_desc, dm.material_group AS category, st.vendor_name,
              {r6('st.clean_median_price')} AS clean_median_price, st.clean_n,
              round(CAST(st.total_qty AS DOUBLE), 4) AS total_qty, round(CAST(st.total_value AS DOUBLE), 4) AS total_value,
              st.clean_n >= 5 AS price_is_stable
       FROM vst st LEFT JOIN dim_material dm USING (material))"""

_LT_BODY = KPI_SQL["kpi_vendor_lead_time"]
MP = PS + f""",
lt AS ({_LT_BODY}),
mp AS (SELECT g.plant, g.material, g.material_desc, dm.material_group AS category, dm.material_type, dm.manufacturer_desc,
              dm.generic_name, g.vendor_code, g.vendor_name, g.po_no, g.gr_no, CAST(g.gr_qty AS DOUBLE) AS qty,
              CAST(g.net_price AS DOUBLE) AS unit_price, CAST(g.unit_mrp AS DOUBLE) AS unit_mrp,
              round(CAST(g.total_amount_wo_tax AS DOUBLE), 4) AS line_value, g.material IS NULL AS is_capex_or_service,
              ps.clean_median_price AS material_median_price, ps.clean_n AS material_price_sample_n,
              (ps.clean_median_price IS NOT NULL AND (CAST(g.net_price AS DOUBLE) < ps.clean_median_price / 8.0
                OR CAST(g.net_price AS DOUBLE) > ps.clean_median_price * 8.0)) AS is_price_outlier,
              lt.avg_lead_time_days AS vendor_avg_lead_time_days, lt.median_lead_time_days AS vendor_median_lead_time_days,
              g.gr_date, g.expiry_date, g.year, g.month_num, g.month
       FROM fact_grn g LEFT JOIN dim_material dm ON g.material = dm.material
       LEFT JOIN ps ON g.material = ps.material LEFT JOIN lt ON g.vendor_name = lt.vendor_name)"""

CLEAN_MED = PS + """,
med AS (SELECT material, median(price) AS med_price, count(*) AS n FROM clean GROUP BY 1 HAVING count(*) >= 5),
cm AS (SELECT c.*, med.med_price FROM clean c JOIN med USING (material))"""

SQL.update({
    "mart_material_price_stats": PS + " SELECT * FROM ps",
    "mart_material_vendor_price_stats": VS + " SELECT * FROM vs",
    "mart_procurement": MP + " SELECT * FROM mp",
    "sql_revenue_margin": f"""t AS (SELECT patient_type, {M4} FROM sales_line GROUP BY patient_type)
        SELECT round(sum(revenue), 4) AS revenue, round(sum(revenue - cost), 4) AS margin,
               {r6('CASE WHEN sum(revenue) > 0 THEN (sum(revenue) - sum(cost)) / sum(revenue) * 100 END')} AS margin_pct FROM t""",
    "sql_expiring_by_manufacturer": f"""SELECT m.manufacturer_desc AS manufacturer, {money('sum(i.total_cost)')} AS expiring_value,
        count(DISTINCT i.material) AS items
        FROM fact_inventory i JOIN dim_material m ON i.material = m.material
        WHERE i.qty > 0 AND i.expiry_date IS NOT NULL AND date_diff('day', {SNAP}, i.expiry_date) BETWEEN 0 AND 90
        GROUP BY 1 ORDER BY sum(i.total_cost) DESC, manufacturer NULLS LAST LIMIT 10""",
    "sql_price_deviation": CLEAN_MED + f""" SELECT material, min(material_desc) AS item,
        {r6('sum(abs(price - med_price) * CAST(gr_qty AS DOUBLE))')} AS price_deviation_impact
        FROM cm GROUP BY 1 ORDER BY sum(abs(price - med_price) * CAST(gr_qty AS DOUBLE)) DESC, material LIMIT 10""",
    "sql_overpay": CLEAN_MED + f""" SELECT material, min(material_desc) AS item,
        {r6('sum(greatest(price - med_price, 0.0) * CAST(gr_qty AS DOUBLE))')} AS overpay_impact
        FROM cm GROUP BY 1 ORDER BY sum(greatest(price - med_price, 0.0) * CAST(gr_qty AS DOUBLE)) DESC, material LIMIT 10""",
    "sql_price_by_plant": MP + f""" SELECT material, plant, {r6('median(unit_price)')} AS unit_price,
        round(sum(qty), 4) AS qty, bool_or(is_price_outlier) AS looks_anomalous
        FROM mp WHERE material IS NOT NULL GROUP BY 1, 2""",
    "sql_cheapest_vendor": VS + """, cv AS (SELECT material, min({'p': clean_median_price, 'v': vendor_name, 'n': clean_n, 'q': total_qty}) AS b,
               count(*) AS stable_vendors FROM vs WHERE price_is_stable GROUP BY material)
        SELECT material, b.v AS vendor_name, b.p AS clean_median_price, b.n AS clean_n, b.q AS total_qty, stable_vendors FROM cv""",
    "sql_consolidation_saving": VS + f""", cv AS (SELECT material, min({{'p': clean_median_price, 'v': vendor_name}}) AS b
               FROM vs WHERE price_is_stable GROUP BY material),
        cur AS (SELECT material, sum(total_value) AS tv, sum(total_qty) AS tq FROM vs GROUP BY material),
        j AS (SELECT cur.*, cv.b.p AS best_price, cv.b.v AS best_vendor, tv - cv.b.p * tq AS saving
              FROM cur JOIN cv USING (material) WHERE tq > 0)
        SELECT material, best_vendor, {r6('best_price')} AS best_price, {r6('tv / tq')} AS current_price,
               round(tq, 4) AS qty, {r6('saving')} AS saving FROM j WHERE saving > 0""",
    "sql_price_dispersion": PS + f""" SELECT material_desc, category, clean_median_price, clean_min_price, clean_max_price,
        clean_n, clean_price_spread, {r6('clean_max_price / NULLIF(clean_min_price, 0)')} AS price_ratio
        FROM ps WHERE clean_n >= 5 AND clean_median_price >= 100 ORDER BY clean_price_spread DESC, material LIMIT 10""",
    "sql_vendor_inconsistency": MP + """ SELECT vendor_name, count(*) AS lines, count(DISTINCT material) AS items,
        count(*) FILTER (WHERE is_price_outlier) AS flagged FROM mp GROUP BY vendor_name
        HAVING count(*) >= 20 AND count(*) FILTER (WHERE is_price_outlier) > 0
        ORDER BY flagged DESC, vendor_name LIMIT 10""",
    "sql_capex_split": f"""SELECT CASE WHEN doc_type IN ('1-URGENT') OR material IS NULL THEN 'Capex/Service' ELSE 'Supply' END AS spend_type,
        count(*) AS lines, {money('sum(total_value_wo_tax)')} AS value FROM fact_po GROUP BY 1""",
    "sql_median_doh": as_cte("kd", KPI_SQL["kpi_doh"])
    + f" SELECT {r6('median(doh_days)')} AS median_doh FROM kd WHERE doh_days > 0",
    "sql_vendor_spend": as_cte("vv", KPI_SQL["kpi_vendor_volume"])
    + " SELECT vendor_name, round(sum(vendor_value), 4) AS spend FROM vv GROUP BY 1 ORDER BY spend DESC, vendor_name NULLS LAST LIMIT 10",
    "sql_category_spend": f"""SELECT m.material_type, m.material_group, {money('sum(p.total_value_wo_tax)')} AS spend
        FROM fact_po p JOIN dim_material m ON p.material = m.material GROUP BY 1, 2""",
    "sql_true_variance": as_cte("pvv", KPI_SQL["kpi_procurement_variance"])
    + f" SELECT year, month, round(sum(purchase_value), 4) AS spend, round(sum(prev_value), 4) AS prev_spend, "
      f"{r6('(sum(purchase_value) - sum(prev_value)) / NULLIF(sum(prev_value), 0) * 100')} AS true_variance_pct FROM pvv GROUP BY 1, 2",
    "sql_dead_stock": f"""SELECT plant, material, batch, {money('qty')} AS qty, {money('total_cost')} AS total_cost, aging_days,
        expiry_date, formulary, COALESCE(expiry_date < {SNAP}, false) AS expired FROM fact_inventory
        WHERE qty > 0 AND material NOT IN (SELECT material FROM sales_line WHERE material IS NOT NULL)
          AND material NOT IN (SELECT material FROM fact_po WHERE material IS NOT NULL)
          AND material NOT IN (SELECT material FROM fact_grn WHERE material IS NOT NULL)""",
    "sql_received_vs_ordered": f"""t AS (SELECT (SELECT CAST(sum(total_value_wo_tax) AS DOUBLE) FROM fact_po) AS o,
                 (SELECT CAST(sum(total_amount_wo_tax) AS DOUBLE) FROM fact_grn) AS r)
        SELECT round(o, 4) AS ordered_value, round(r, 4) AS received_value,
               {r6('CASE WHEN o > 0 THEN r / o * 100 END')} AS received_pct FROM t""",
    "sql_unit_cost": f"""raw AS (SELECT *, CAST(amount_lc AS DOUBLE) / CAST(qty AS DOUBLE) AS rate FROM fact_consumption
                   WHERE material IS NOT NULL AND qty > 0 AND CAST(amount_lc AS DOUBLE) / CAST(qty AS DOUBLE) >= 10),
        p1 AS (SELECT material, median(rate) AS m1 FROM raw GROUP BY 1),
        clean AS (SELECT r.* FROM raw r JOIN p1 USING (material) WHERE r.rate BETWEEN p1.m1 / 8.0 AND p1.m1 * 8.0)
        SELECT material, {r6('median(rate)')} AS median_unit_cost, count(*) AS clean_n, {money('sum(qty)')} AS qty,
               {money('sum(amount_lc)')} AS cost FROM clean GROUP BY 1 HAVING count(*) >= 5""",
    "sql_proxy_margin": CLEAN_MED + f""" SELECT {money('sum(gr_qty * unit_mrp)')} AS mrp_value,
        {money('sum(gr_qty * net_price)')} AS cost_value,
        {r6('CASE WHEN sum(gr_qty * unit_mrp) > 0 THEN CAST(sum(gr_qty * unit_mrp) - sum(gr_qty * net_price) AS DOUBLE) / CAST(sum(gr_qty * unit_mrp) AS DOUBLE) * 100 END')} AS margin_pct
        FROM cm WHERE unit_mrp >= 10""",
    "sql_manufacturer_coverage": f"""j AS (SELECT p.*, m.manufacturer_desc FROM fact_po p LEFT JOIN dim_material m ON p.material = m.material),
        tot AS (SELECT CAST(sum(total_value_wo_tax) AS DOUBLE) AS t,
                       CAST(sum(total_value_wo_tax) FILTER (WHERE manufacturer_desc IS NOT NULL) AS DOUBLE) AS mapped FROM j),
        g AS (SELECT COALESCE(manufacturer_desc, 'Unmapped') AS manufacturer, CAST(sum(total_value_wo_tax) AS DOUBLE) AS v FROM j GROUP BY 1)
        SELECT manufacturer, round(v, 4) AS value, {r6('CASE WHEN t > 0 THEN v / t * 100 END')} AS share_pct,
               {r6('CASE WHEN t > 0 THEN COALESCE(mapped, 0.0) / t * 100 END')} AS coverage_pct FROM g, tot""",
    "sql_out_of_formulary": f"""SELECT plant, {money('sum(total_cost)')} AS stock_value, {money('sum(qty)')} AS stock_qty,
        count(DISTINCT material) AS items FROM fact_inventory WHERE formulary = 'OUT OF FORMULARY' GROUP BY plant""",
    "sql_redistribution": f"""ex AS (SELECT plant, material, sum(qty) AS eq, sum(total_cost) AS ev FROM fact_inventory
              WHERE qty > 0 AND date_diff('day', {SNAP}, expiry_date) BETWEEN 0 AND 90 GROUP BY 1, 2),
        own AS (SELECT plant, material, sum(qty) AS own_qty FROM fact_consumption GROUP BY 1, 2),
        tot AS (SELECT material, sum(qty) AS all_qty, count(DISTINCT plant) AS all_plants FROM fact_consumption GROUP BY 1),
        j AS (SELECT ex.*, tot.all_qty - COALESCE(own.own_qty, 0) AS other_qty,
                     tot.all_plants - CASE WHEN own.own_qty IS NOT NULL THEN 1 ELSE 0 END AS other_plants
              FROM ex JOIN tot USING (material) LEFT JOIN own USING (plant, material))
        SELECT plant, material, {money('eq')} AS expiring_qty, {money('ev')} AS expiring_value, other_plants,
               {money('other_qty')} AS other_plants_consumption FROM j WHERE other_plants > 0""",
    "sql_inactive_items": """act AS (SELECT material FROM sales_line UNION SELECT material FROM fact_po UNION
                SELECT material FROM fact_grn UNION SELECT material FROM fact_consumption),
        actd AS (SELECT * FROM dim_material WHERE material IN (SELECT material FROM act WHERE material IS NOT NULL)),
        gen AS (SELECT generic_name, count(*) AS n FROM actd GROUP BY 1),
        grp AS (SELECT material_group, count(*) AS n FROM actd GROUP BY 1)
        SELECT d.material, d.material_desc, d.generic_name, d.material_group, COALESCE(gen.n, 0) AS active_same_generic,
               COALESCE(grp.n, 0) AS active_same_group
        FROM dim_material d LEFT JOIN gen ON d.generic_name = gen.generic_name
        LEFT JOIN grp ON d.material_group = grp.material_group
        WHERE d.material NOT IN (SELECT material FROM act WHERE material IS NOT NULL)""",
    "inventory_by_ward_class": f"""ds AS (SELECT plant, sloc,
            CASE WHEN sloc_desc IS NULL THEN 'OTHER'
             WHEN (regexp_matches(upper(sloc_desc), '\\bIP\\b|IP[-/ ]') OR starts_with(upper(sloc_desc), 'IP'))
              AND (regexp_matches(upper(sloc_desc), '\\bOP\\b|OP[-/ ]') OR starts_with(upper(sloc_desc), 'OP')) THEN 'IP/OP'
             WHEN regexp_matches(upper(sloc_desc), '\\bIP\\b|IP[-/ ]') OR starts_with(upper(sloc_desc), 'IP') THEN 'IP'
             WHEN regexp_matches(upper(sloc_desc), '\\bOP\\b|OP[-/ ]') OR starts_with(upper(sloc_desc), 'OP') THEN 'OP'
             WHEN contains(upper(sloc_desc), 'OT') THEN 'OT' ELSE 'OTHER' END AS ip_op_class FROM dim_sloc)
        SELECT COALESCE(ds.ip_op_class, 'OTHER') AS ip_op_class, {money('sum(i.total_cost)')} AS stock_value,
               {money('sum(i.qty)')} AS stock_qty, count(DISTINCT i.material) AS sku_count
        FROM fact_inventory i LEFT JOIN ds ON i.plant = ds.plant AND i.sloc = ds.sloc GROUP BY 1""",
})


GR = BY_MAT + f""",
st AS (SELECT patient_type, {M4} FROM sales_line GROUP BY patient_type),
sm AS (SELECT patient_type, strftime(sale_date, '%Y-%m') AS month, {M4} FROM sales_line GROUP BY ALL),
sh AS (SELECT hospital, {M4} FROM sales_line GROUP BY hospital),
smf AS (SELECT manufacturer, {M4} FROM sales_line WHERE manufacturer IS NOT NULL GROUP BY ALL)"""


def _pt(col, pt):
    return f"COALESCE(sum({col}) FILTER (WHERE patient_type = '{pt}'), 0)"


IPR, OPR, IPC, OPC = _pt("revenue", "IP"), _pt("revenue", "OP"), _pt("cost", "IP"), _pt("cost", "OP")


def _top(src, key, n, extra=""):
    return f"""SELECT {key}, {extra} revenue, round(revenue - cost, 4) AS margin, qty,
        {r6('CASE WHEN revenue <> 0 THEN (revenue - cost) / revenue * 100 ELSE 0.0 END')} AS margin_pct
        FROM {src} ORDER BY revenue DESC, {key} LIMIT {n}"""


SQL.update({
    "revenue_totals": GR + f""" SELECT round({IPR} + {OPR}, 4) AS revenue, round({IPC} + {OPC}, 4) AS cost,
        round(({IPR} + {OPR}) - ({IPC} + {OPC}), 4) AS margin,
        {r6(f"CASE WHEN ({IPR} + {OPR}) <> 0 THEN (({IPR} + {OPR}) - ({IPC} + {OPC})) / ({IPR} + {OPR}) * 100 ELSE 0.0 END")} AS margin_pct,
        round({IPR}, 4) AS ip_revenue, round({OPR}, 4) AS op_revenue, round({IPR} - {IPC}, 4) AS ip_margin,
        round({OPR} - {OPC}, 4) AS op_margin,
        {r6(f"CASE WHEN ({IPR} + {OPR}) <> 0 THEN {IPR} / ({IPR} + {OPR}) * 100 ELSE 0.0 END")} AS ip_share,
        {r6(f"CASE WHEN ({IPR} + {OPR}) <> 0 THEN {OPR} / ({IPR} + {OPR}) * 100 ELSE 0.0 END")} AS op_share,
        round(sum(qty), 4) AS qty, CAST(sum(lines) AS BIGINT) AS lines,
        (SELECT count(DISTINCT material) FROM bym) AS materials, (SELECT count(*) FROM smf) AS manufacturers,
        (SELECT count(*) FROM sh) AS hospitals,
        (SELECT {money('sum(amount_lc)')} FROM fact_consumption) AS internal_cost,
        (SELECT count(DISTINCT month) FROM sm) AS months FROM st""",
    "revenue_timeline": GR + f""" SELECT month, round({IPR}, 4) AS ip_revenue, round({OPR}, 4) AS op_revenue,
        round({IPR} + {OPR}, 4) AS revenue, round({IPR} - {IPC}, 4) AS ip_margin, round({OPR} - {OPC}, 4) AS op_margin,
        round(({IPR} + {OPR}) - ({IPC} + {OPC}), 4) AS margin FROM sm GROUP BY month""",
    "revenue_top_hospitals": GR + " " + _top("sh", "hospital", 8),
    "revenue_top_manufacturers": GR + " " + _top("smf", "manufacturer", 10),
    "revenue_top_items": GR + ", ti AS (" + _top("bym", "material", 12, "material_desc, material_group,") + ") SELECT * REPLACE ("
    + clean_category("material_group") + " AS material_group) FROM ti",
    "revenue_by_category": GR + f""", gc AS (SELECT {clean_category('material_group')} AS g, sum(revenue) AS r, sum(cost) AS c
            FROM bym GROUP BY 1)
        SELECT g AS "group", round(r, 4) AS revenue, round(r - c, 4) AS margin,
               {r6('CASE WHEN r <> 0 THEN (r - c) / r * 100 ELSE 0.0 END')} AS margin_pct FROM gc ORDER BY r DESC, g LIMIT 8""",
    "revenue_items": GR + f""" SELECT material, material_desc, {clean_category('material_group')} AS "group", revenue,
        round(revenue - cost, 4) AS margin,
        {r6('CASE WHEN revenue > 0 THEN (revenue - cost) / revenue * 100 ELSE 0.0 END')} AS margin_pct, qty
        FROM bym ORDER BY revenue DESC, material""",
})
