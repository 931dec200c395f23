"""Oracles for filter variants, drills, lookups and totals (FLT-01/02, SAL-05, INS-20/21/23/29/33/34, GEN-05, RE-05, MRT-01)."""
from carelake.oracle.forecast_sql import SQL as FSQL
from carelake.oracle.frag import as_cte, r6
from carelake.oracle.frag_text import clean_category
from carelake.oracle.generic_sql import SC, SV, UC, summary_sql
from carelake.oracle.insights_cons_sql import DP, RF
from carelake.oracle.insights_proc_sql import CT, FR, FRC, LOC, WIN, ORD
from carelake.oracle.kpi_sql import SQL as K
from carelake.oracle.sales_sql import GR, M4
from carelake.schemas import PORTFOLIOS, REGISTRY

SHARE = r6("CASE WHEN revenue > 0 THEN (revenue - cost) / revenue * 100 ELSE 0.0 END")
ITEM = (f"material, material_desc, {clean_category('material_group')} AS \"group\", revenue, "
        f"round(revenue - cost, 4) AS margin, {SHARE} AS margin_pct, qty")
BOARD = (f"material_id AS material, plant, material_desc AS \"desc\", {clean_category('material_group')} AS \"group\", status, "
         f"closing_stock AS stock, closing_stock_value AS stock_value, demand_monthly, {r6('cover')} AS cover, "
         f"replenishment_quantity AS reorder_qty, {r6('reorder_value')} AS reorder_value, "
         "CAST(trunc(aging_days) AS INTEGER) AS aging_days")


def _grain(key: str, lines: str = "sales_line") -> str:
    """The sales grain (key, material) with description and group."""
    k = f"{key}, " if key else ""
    keep = f"WHERE {key} IS NOT NULL" if key == "manufacturer" else ""
    return f"""g AS (SELECT {k}material, min(material_desc) AS md, {M4} FROM {lines} {keep} GROUP BY ALL),
        gm AS (SELECT g.* EXCLUDE (md), COALESCE(md, g.material) AS material_desc, COALESCE(dm.material_group, '') AS material_group
               FROM g LEFT JOIN dim_material dm ON g.material = dm.material)"""


def _dedup(key: str) -> str:
    k = f"{key}, " if key else ""
    return ("mixed AS (SELECT * REPLACE (CASE WHEN month_num % 2 = 1 THEN material || '.0' ELSE material END AS material) "
            "FROM sales_line), " + _grain(key, "mixed") + f"""
        SELECT {k}regexp_replace(material, '\\.0$', '') AS material,
               arg_max(material_desc, {{'l': length(material_desc), 'd': material_desc}}) AS material_desc,
               COALESCE(max(NULLIF(material_group, '')), '') AS material_group, round(sum(revenue), 4) AS revenue,
               round(sum(cost), 4) AS cost, round(sum(qty), 4) AS qty, CAST(sum(lines) AS BIGINT) AS lines
        FROM gm GROUP BY ALL""")


def _table(name: str) -> str:
    return FSQL[name] if name in FSQL else K[name]


def _portfolio(name: str) -> str:
    keys = PORTFOLIOS[name]
    ctes = ", ".join(as_cte(f"t{i}", _table(REGISTRY[k][0])) for i, k in enumerate(keys))
    return ctes + " " + " UNION ALL ".join(summary_sql(f"t{i}", REGISTRY[k][0], k) for i, k in enumerate(keys))


CYC = CT + f""", c AS (SELECT *, {ORD} AS o FROM ct WHERE {WIN}),
    t AS (SELECT month, o, round(sum(avg_po_to_gr_tat * gr_lines) / sum(gr_lines), 6) AS po FROM c GROUP BY month, o)"""
DEPT = DP + """, g AS (SELECT cost_ctr, sum(consumption_cost) AS v, sum(consumption_qty) AS q FROM dp GROUP BY 1),
    s0 AS (SELECT *, v / (SELECT sum(v) FROM g) * 100 AS share, row_number() OVER (ORDER BY v DESC, cost_ctr) AS rk FROM g),
    s AS (SELECT *, sum(share) OVER (ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM s0)"""

SQL = {
    "gen_query_region": UC + """ SELECT * FROM uc WHERE material_group = 'MEDIUM'
        AND plant = (SELECT min(plant) FROM dim_plant WHERE plant_name = 'NATION_3')""",
    "gen_query_materials": SC + " SELECT * FROM sc WHERE plant = 'P03' AND material IN ('1', '2', '30')",
    "gen_chart_top": UC + """ SELECT material_group, round(COALESCE(sum(consumption_cost), 0), 4) AS consumption_cost FROM uc
        WHERE material_group IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3""",
    "kpi_stock_value_region": SV + " SELECT * FROM sv WHERE plant = 'P05'",
    "revenue_items_manufacturer": _grain("manufacturer") + f" SELECT {ITEM} FROM gm WHERE manufacturer = 'Brand#17'",
    "revenue_items_hospital": _grain("hospital") + f" SELECT {ITEM} FROM gm WHERE hospital = 'P03'",
    "revenue_items_category": _grain("") + f", i AS (SELECT {ITEM} FROM gm) SELECT * FROM i WHERE \"group\" = 'Medium'",
    "risk_items_order_now": RF + f" SELECT {BOARD} FROM rf WHERE replenishment_quantity > 0",
    "risk_items_aging": RF + f" SELECT {BOARD} FROM rf WHERE rf.aging_days > 180 AND closing_stock_value > 0",
    "risk_items_dead_stock": RF + f" SELECT {BOARD} FROM rf WHERE status = 'Dead stock'",
    "risk_items_bucket": RF + f" SELECT {BOARD} FROM rf WHERE aging_risk = '6-12 Months' AND plant = 'P03'",
    "item_risk": RF + f""" SELECT {BOARD}, {r6('demand_forecast')} AS demand_forecast, safe_stock, aging_risk AS bucket,
        {r6('unit_cost')} AS unit_cost FROM rf WHERE material_id = '30'""",
    "reorder_totals": RF + """ SELECT count(*) FILTER (WHERE replenishment_quantity > 0) AS reorder_skus,
        round(sum(reorder_value), 2) AS reorder_value, round(sum(replenishment_quantity), 4) AS reorder_qty,
        count(*) FILTER (WHERE status = 'Stock-out') AS stockout_skus, count(*) FILTER (WHERE aging_days > 180) AS aging_skus,
        round(COALESCE(sum(closing_stock_value) FILTER (WHERE aging_days > 180), 0.0), 2) AS aging_value,
        count(*) FILTER (WHERE status = 'Healthy') AS healthy_skus, count(*) AS total_skus,
        round(sum(closing_stock_value), 2) AS stock_value FROM rf""",
    "reorder_order_now": RF + f""", t AS (SELECT * FROM rf WHERE replenishment_quantity > 0
        ORDER BY rf.reorder_value DESC, material_id, plant LIMIT 8) SELECT {BOARD} FROM t""",
    "reorder_aged": RF + f""", t AS (SELECT * FROM rf WHERE rf.aging_days > 180 AND closing_stock_value > 0
        ORDER BY closing_stock_value DESC, material_id, plant LIMIT 8) SELECT {BOARD} FROM t""",
    "department_totals": DEPT + f""" SELECT round(sum(v), 4) AS cost, round(sum(q), 4) AS qty, count(*) AS departments,
        arg_min(cost_ctr, rk) AS top_dept, {r6('sum(share) FILTER (WHERE rk <= 1)')} AS top1,
        {r6('sum(share) FILTER (WHERE rk <= 5)')} AS top5, {r6('sum(share) FILTER (WHERE rk <= 10)')} AS top10,
        count(*) FILTER (WHERE cum <= 80) + 1 AS n80, {r6('sum(share * share)')} AS hhi FROM s""",
    "completion_totals": FR + ", " + FRC + f""" SELECT
        {r6('least(greatest(1.0 - sum(open_qty) / sum(ordered_qty), 0.0), 1.0) * 100')} AS completion,
        count(*) AS plants, count(*) FILTER (WHERE comp >= 99.5) AS perfect FROM frc""",
    "completion_plants": FR + ", " + FRC + f""" SELECT plant, {r6('comp')} AS comp, ordered_qty,
        greatest(open_qty, 0.0) AS open_qty FROM frc WHERE ordered_qty > 0""",
    "cycle_totals": CYC + f""" SELECT (SELECT {r6('sum(avg_po_to_gr_tat * gr_lines) / sum(gr_lines)')} FROM c) AS avg_po,
        (SELECT {r6('sum(avg_pr_to_gr_tat * gr_lines) / sum(gr_lines)')} FROM c) AS avg_pr,
        (SELECT month FROM t ORDER BY po, o LIMIT 1) AS fast_month, (SELECT min(po) FROM t) AS fast_po,
        (SELECT month FROM t ORDER BY po DESC, o LIMIT 1) AS slow_month, (SELECT max(po) FROM t) AS slow_po""",
    "location_diversity": LOC + """ SELECT plant, vendor_count AS vendors, purchase_value AS value FROM loc
        ORDER BY vendor_count DESC, plant LIMIT 7""",
    "location_totals": LOC + f""" SELECT count(*) AS plants, round(sum(purchase_value), 4) AS total,
        {r6('avg(purchase_value)')} AS avg, (SELECT plant FROM loc ORDER BY purchase_value DESC, plant LIMIT 1) AS top_plant,
        max(purchase_value) AS top_value FROM loc""",
    "entity_browse": GR + ", " + as_cte("vv", K["kpi_vendor_volume"]) + f""", src AS (
          SELECT 'item' AS type, 0 AS ti, false AS cat, material_desc AS l, CAST(revenue AS DOUBLE) AS w FROM bym
          UNION ALL SELECT 'category', 1, true, material_group, count(*) FROM dim_material GROUP BY material_group
          UNION ALL SELECT 'manufacturer', 2, false, manufacturer, revenue FROM smf
          UNION ALL SELECT 'vendor', 3, false, vendor_name, sum(vendor_value) FROM vv GROUP BY vendor_name
          UNION ALL SELECT 'hospital', 4, false, hospital, revenue FROM sh),
        tp AS (SELECT type, ti, w, CASE WHEN cat THEN {clean_category('l')} ELSE l END AS l FROM src WHERE l <> ''
               QUALIFY row_number() OVER (PARTITION BY type ORDER BY w DESC NULLS LAST, l) <= 6),
        one AS (SELECT type, ti, arg_max(l, w) AS label, max(w) AS w FROM tp GROUP BY type, ti, lower(l)),
        fin AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY w DESC NULLS LAST, label) AS rd FROM one)
        SELECT type, label, CAST(rd AS INTEGER) AS round FROM fin ORDER BY rd, ti LIMIT 18""",
    "sales_dedup_plain": _dedup(""),
    "sales_dedup_mfr": _dedup("manufacturer"),
    "sales_dedup_hospital": _dedup("hospital"),
    **{f"portfolio_{p}": _portfolio(p) for p in ("inventory", "consumption", "forecasting")},
}
