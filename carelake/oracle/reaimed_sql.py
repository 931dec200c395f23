"""Oracles for RE-*, STR-*, SRC-* and DIM-07 (DuckDB). Regex oracles pass the patterns
to RE2 with the 'i' option; RE2's \\b is ASCII-only where Java's is Unicode-aware, so the
two regex queries are also tested against Python ``re`` directly (tests/test_handbuilt.py)."""
from carelake.oracle.forecast_sql import REP
from carelake.oracle.frag import as_cte
from carelake.oracle.frag_text import clean_category
from carelake.oracle.kpi_sql import SQL as K
from carelake.oracle.sales_sql import GR
from carelake.operators.reaimed import DEICTIC, INTENT_LOCKS, REFINE_START
from carelake.schemas import columns_of

SV = as_cte("sv", K["kpi_stock_value"])
VV = as_cte("vv", K["kpi_vendor_volume"])
UC = as_cte("uc", K["kpi_units_consumed"])
MP = as_cte("mp", K["kpi_monthly_purchase_value"])


def _sq(s: str) -> str:
    return s.replace("'", "''")


def _re2(p: str) -> str:
    """Pattern without the inline (?i) flag (passed as the 'i' option instead)."""
    return _sq(p.replace("(?i)", "").replace("(?is)", ""))


SQL = {
    "top_n_other": VV + """, v AS (SELECT vendor_name, sum(vendor_value) AS spend FROM vv GROUP BY 1),
        r AS (SELECT *, row_number() OVER (ORDER BY spend DESC NULLS LAST, vendor_name) AS rn, count(*) OVER () AS n FROM v)
        SELECT CASE WHEN n <= 8 OR rn < 8 THEN vendor_name ELSE 'Other (' || CAST(n - 7 AS VARCHAR) || ' more)' END AS vendor_name,
               CAST(CASE WHEN n <= 8 OR rn < 8 THEN rn ELSE 8 END AS INTEGER) AS rn, round(sum(spend), 4) AS spend
        FROM r GROUP BY 1, 2""",
    "heat_matrix": SV + """ SELECT material_group, plant, round(sum(stock_value_cost), 4) AS stock_value_cost
        FROM sv GROUP BY material_group, plant""",
    "hierarchy_rollup": SV + """ SELECT material_group, material, round(sum(stock_value_cost), 4) AS stock_value_cost,
        CAST(grouping(material_group, material) AS INTEGER) AS level FROM sv GROUP BY ROLLUP (material_group, material)""",
    "box_stats": """b AS (SELECT plant, min(CAST(net_price AS DOUBLE)) AS mn,
            quantile_cont(CAST(net_price AS DOUBLE), [0.25, 0.5, 0.75]) AS q, max(CAST(net_price AS DOUBLE)) AS mx,
            avg(CAST(net_price AS DOUBLE)) AS mean, count(net_price) AS n FROM fact_grn WHERE plant IS NOT NULL GROUP BY plant)
        SELECT plant, round(mn, 6) AS min, round(q[1], 6) AS q1, round(q[2], 6) AS median, round(q[3], 6) AS q3,
               round(mx, 6) AS max, round(mean, 6) AS mean, n FROM b""",
    "histogram_bins": """d AS (SELECT CAST(net_price AS DOUBLE) AS v FROM fact_grn WHERE net_price IS NOT NULL),
        s AS (SELECT min(v) AS mn, max(v) AS mx, (max(v) - min(v)) / 24 AS w FROM d),
        b AS (SELECT CAST(CASE WHEN s.mx = s.mn THEN 1 ELSE least(floor((d.v - s.mn) / s.w) + 1, 24) END AS INTEGER) AS bin
              FROM d, s)
        SELECT bin, round(s.mn + (bin - 1) * s.w, 6) AS lo, round(s.mn + bin * s.w, 6) AS hi, count(*) AS count
        FROM b, s GROUP BY bin, s.mn, s.w""",
    "entity_search": GR + f""", src AS (
          SELECT 'item' AS type, 0 AS ti, material_desc AS raw, false AS is_cat FROM bym
          UNION ALL SELECT 'category', 1, material_group, true FROM dim_material
          UNION ALL SELECT 'manufacturer', 2, manufacturer_desc, false FROM dim_material
          UNION ALL SELECT 'vendor', 3, vendor_name, false FROM dim_vendor
          UNION ALL SELECT 'hospital', 4, hospital, false FROM sh),
        cand AS (SELECT DISTINCT type, ti, is_cat, raw FROM src WHERE raw IS NOT NULL AND raw <> '' AND contains(lower(raw), 'e')),
        rk AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY CASE WHEN starts_with(lower(raw), 'e') THEN 0 ELSE 1 END,
                                            length(raw), raw) AS o FROM cand),
        tp AS (SELECT *, CASE WHEN is_cat THEN {clean_category('raw')} ELSE raw END AS label FROM rk WHERE o <= 6),
        dd AS (SELECT type, ti, arg_min(label, o) AS label, min(o) AS o FROM tp GROUP BY type, ti, lower(label)),
        fin AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY o) AS i FROM dd)
        SELECT type, label, CAST(i AS INTEGER) AS round FROM fin ORDER BY i, ti LIMIT 18""",
    "nonzero_fraction": SV + " " + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, round(COALESCE(avg(CASE WHEN {c} IS NOT NULL THEN CASE WHEN {c} <> 0 THEN 1.0 "
        f"ELSE 0.0 END END), 0.0), 6) AS nonzero_fraction FROM sv"
        for c, t in columns_of("kpi_stock_value") if t in ("double", "int", "bigint")),
    "cosine_topk": """pos AS (SELECT label, unnest(generate_series(1, len(embedding))) AS p, unnest(embedding) AS x FROM embeddings),
        cen AS (SELECT label, p, avg(CAST(x AS DOUBLE)) AS x FROM pos GROUP BY label, p),
        ev AS (SELECT vec_id, unnest(generate_series(1, len(embedding))) AS p, unnest(embedding) AS x FROM embeddings),
        dots AS (SELECT ev.vec_id, cen.label, sum(CAST(ev.x AS DOUBLE) * cen.x) AS dot FROM ev JOIN cen USING (p) GROUP BY 1, 2),
        nv AS (SELECT vec_id, sqrt(sum(CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS nv FROM ev GROUP BY 1),
        nc AS (SELECT label, sqrt(sum(x * x)) AS nc FROM cen GROUP BY 1),
        sims AS (SELECT d.vec_id, d.label AS exemplar, CASE WHEN nv = 0 OR nc = 0 THEN 0.0 ELSE dot / (nv * nc) END AS sim
                 FROM dots d JOIN nv USING (vec_id) JOIN nc ON nc.label = d.label),
        rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, exemplar) AS rank FROM sims)
        SELECT vec_id, CAST(rank AS INTEGER) AS rank, exemplar, round(sim, 6) AS similarity FROM rk
        WHERE rank <= 4 AND sim >= 0.32""",
    "scope_carry": """c AS (SELECT *, CASE WHEN role = 'assistant' AND regexp_extract(text, '(?is)\\[active scope:\\s*(.+?)\\s*\\]', 1) <> ''
                 THEN trim(regexp_extract(text, '(?is)\\[active scope:\\s*(.+?)\\s*\\]', 1)) END AS m FROM conversations)
        SELECT conv_id, turn, last_value(m IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS scope FROM c QUALIFY role = 'user'""",
}


TRIMMED = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
WC = f"(CASE WHEN text IS NULL OR {TRIMMED} = '' THEN 0 ELSE len(string_split_regex({TRIMMED}, '\\s+')) END)"
_tags = ", ".join(f"CASE WHEN regexp_matches(text, '{_re2(p)}', 'i') THEN '{n}' END" for n, p in INTENT_LOCKS.items())
SQL["intent_tags"] = f"""t AS (SELECT conv_id, turn, list_filter([{_tags}], lambda x: x IS NOT NULL) AS tags FROM conversations)
    SELECT conv_id, turn, array_to_string(tags, ',') AS tags, CAST(len(tags) AS INTEGER) AS n_tags FROM t"""
SQL["followup_turns"] = f"""t AS (SELECT conv_id, turn, text, {WC} AS words FROM conversations WHERE role = 'user')
    SELECT conv_id, turn, CAST(words AS INTEGER) AS words,
           CASE WHEN words = 0 THEN false WHEN words <= 6 THEN true
                WHEN regexp_matches(text, '{_re2(REFINE_START)}', 'i') THEN true
                WHEN words <= 14 AND regexp_matches(text, '{_re2(DEICTIC)}', 'i') THEN true ELSE false END AS is_followup
    FROM t"""

# ------------------------------------------------------------------ RE-06 / RE-07
_FP = {"fact_consumption": "fact_consumption", "fact_inventory": "fact_inventory", "fact_grn": "fact_grn",
       "fact_po": "fact_po", "sales_line": "sales_line", "sales_by_material": "bym", "kpi_stock_value": "sv",
       "kpi_units_consumed": "uc", "kpi_monthly_purchase_value": "mp", "stock_replenishment_and_aging_risk": "rep"}
SQL["item_footprint"] = REP + ", " + GR + ", " + SV + ", " + UC + ", " + MP + """,
    matched AS (SELECT material FROM dim_material WHERE material = 'gear' OR contains(lower(material_desc), 'gear')),
    codes AS (SELECT DISTINCT code FROM (SELECT material AS code FROM matched UNION ALL
              SELECT CASE WHEN material LIKE '%.0' THEN left(material, length(material) - 2)
                          WHEN regexp_matches(material, '^[0-9]+$') THEN material || '.0' END FROM matched)
              WHERE code IS NOT NULL)
    """ + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS rows FROM {src} "
    f"WHERE CAST({'material_id' if t == 'stock_replenishment_and_aging_risk' else 'material'} AS VARCHAR) IN (SELECT code FROM codes)"
    for t, src in sorted(_FP.items()))


def _profile_sql() -> str:
    import re as _re

    from carelake.operators.reaimed import _ID, _TIME, short_type
    tables = ["fact_consumption", "fact_inventory", "dim_plant", "dim_sloc", "kpi_stock_value", "kpi_vendor_volume",
              "sales_by_hospital"]
    srcs = {"fact_consumption": "fact_consumption", "fact_inventory": "fact_inventory", "dim_plant": "dim_plant",
            "dim_sloc": "ds", "kpi_stock_value": "sv", "kpi_vendor_volume": "vv", "sales_by_hospital": "sh"}
    cols = {t: columns_of(t) for t in tables if t != "dim_sloc"}
    cols["dim_sloc"] = [("plant", "string"), ("sloc", "string"), ("sloc_desc", "string"), ("ip_op_class", "string")]
    vals = []
    for t in tables:
        for c, ty in cols[t]:
            st = short_type(ty)
            role = "time" if (_re.search(_TIME, c) or st == "date") else ("dim" if (st == "text" or _re.search(_ID, c))
                                                                       else "measure")
            vals.append(f"('{t}', '{c}', '{st}', '{role}')")
    counts = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM {srcs[t]}" for t in tables)
    return (GR + ", " + SV + ", " + VV + ", ds AS (SELECT * FROM dim_sloc), "
            f"md AS (SELECT * FROM (VALUES {', '.join(vals)}) v(table_name, column_name, short_type, role)), "
            f"cn AS ({counts}) SELECT md.*, cn.rows FROM md LEFT JOIN cn USING (table_name)")


SQL["catalog_profile"] = _profile_sql()

# ------------------------------------------------------------------ streaming oracles
from carelake.oracle.sales_sql import SQL as _S  # noqa: E402

SQL["stream_sales_monthly"] = _S["sales_monthly"]
SQL["stream_daily_totals"] = """SELECT CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS events,
    round(sum(value), 4) AS value_sum, count(*) FILTER (WHERE event_type = 'error') AS errors
    FROM events GROUP BY 1"""

# ------------------------------------------------------------------ sources (SRC-*)
Q4, M6 = "DECIMAL(18,4)", "DECIMAL(24,6)"
SQL["fact_grn"] = "SELECT * FROM fact_grn"
SQL["fact_po"] = "SELECT * FROM fact_po"
SQL["src_consumption"] = f"""SELECT * REPLACE (CAST(qty AS {Q4}) AS qty, CAST(amount_lc AS {M6}) AS amount_lc)
    FROM fact_consumption WHERE mvt = '201' AND posting_date IS NOT NULL AND qty > 0"""
SQL["src_inventory"] = f"""SELECT * REPLACE (CAST(NULL AS VARCHAR) AS hsn, CAST(qty AS {Q4}) AS qty,
    CAST(total_cost AS {M6}) AS total_cost, CAST(total_mrp AS {M6}) AS total_mrp,
    CAST(moving_avg_price AS {M6}) AS moving_avg_price) FROM fact_inventory"""
SQL["src_grn"] = f"""SELECT * REPLACE (CAST(gr_qty AS {Q4}) AS gr_qty, CAST(base_price AS {M6}) AS base_price,
    CAST(net_price AS {M6}) AS net_price, CAST(unit_mrp AS {M6}) AS unit_mrp,
    CAST(total_amount_wo_tax AS {M6}) AS total_amount_wo_tax) FROM fact_grn"""
SQL["src_po"] = f"""SELECT * REPLACE (CAST(po_qty AS {Q4}) AS po_qty, CAST(open_qty AS {Q4}) AS open_qty,
    CAST(net_price AS {M6}) AS net_price, CAST(total_value_wo_tax AS {M6}) AS total_value_wo_tax,
    CAST(total_value_tax AS {M6}) AS total_value_tax) FROM fact_po"""
SQL["sales_line_loaded"] = f"""SELECT * REPLACE (CAST(qty AS {Q4}) AS qty, CAST(revenue AS {M6}) AS revenue,
    CAST(cost AS {M6}) AS cost) FROM sales_line"""
SQL["sales_file_audit"] = """SELECT patient_type, 'ym=' || strftime(sale_date, '%Y-%m') AS source, count(*) AS seen,
    count(*) AS kept FROM sales_line GROUP BY ALL"""
SQL["dq_report"] = """SELECT 'fact_consumption_rows' AS metric, count(*) AS value FROM fact_consumption
    UNION ALL SELECT 'fact_inventory_rows', count(*) FROM fact_inventory
    UNION ALL SELECT 'fact_grn_rows', count(*) FROM fact_grn
    UNION ALL SELECT 'fact_po_rows', count(*) FROM fact_po
    UNION ALL SELECT 'dim_plant_count', count(*) FROM dim_plant
    UNION ALL SELECT 'dim_material_count', count(*) FROM dim_material
    UNION ALL SELECT 'dim_vendor_count', count(*) FROM dim_vendor
    UNION ALL SELECT 'dim_costcenter_count', count(*) FROM dim_costcenter
    UNION ALL SELECT 'consumption_rows_' || strftime(posting_date, '%Y-%m'), count(*) FROM fact_consumption GROUP BY 1
    UNION ALL SELECT 'months_with_consumption', count(DISTINCT strftime(posting_date, '%Y-%m')) FROM fact_consumption"""

# ------------------------------------------------------------------ DIM-07 / SQL-02
SQL["material_options"] = "SELECT material, material_desc, material_group FROM dim_material"
SQL["group_options"] = """SELECT DISTINCT material_group FROM dim_material
    WHERE material_group IS NOT NULL AND material_group NOT IN ('nan', '')"""
SQL["vendor_options"] = VV + """ SELECT DISTINCT vendor_name FROM vv
    WHERE vendor_name IS NOT NULL AND vendor_name NOT IN ('nan', '')"""
SQL["sql_top_manufacturers"] = GR + """ SELECT manufacturer, revenue, round(revenue - cost, 4) AS margin,
    round(CASE WHEN revenue > 0 THEN (revenue - cost) / revenue * 100 END, 6) AS margin_pct
    FROM smf ORDER BY revenue DESC, manufacturer LIMIT 10"""
# one event in 50 arrives in a second wave; it is late if its day ended before the watermark of the first
SQL["stream_daily_late"] = """e AS (SELECT *, event_id % 50 = 0 AS second, CAST(date_trunc('day', ts) AS DATE) AS day FROM events),
wm AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 7 DAY AS w FROM e WHERE NOT second),
m AS (SELECT *, second AND day + INTERVAL 1 DAY <= (SELECT w FROM wm) AS late FROM e)
SELECT day, count(*) FILTER (NOT late) AS events, round(sum(value) FILTER (NOT late), 4) AS value_sum,
       count(*) FILTER (NOT late AND event_type = 'error') AS errors, count(*) FILTER (late) AS late
FROM m GROUP BY day"""
SQL["sales_line_listed"] = SQL["sales_line_loaded"]
SQL["sales_landed_audit"] = """SELECT patient_type, 'ym=' || strftime(sale_date, '%Y-%m') AS source, 'read' AS status,
    CAST(NULL AS VARCHAR) AS reason, count(*) AS seen, count(*) AS kept FROM sales_line GROUP BY ALL
    UNION ALL SELECT 'OP', 'no-revenue', 'skipped', 'lacks qty, rev', 0, 0
    UNION ALL SELECT 'OP', 'header-only', 'empty', 'no rows', 0, 0"""
SQL["src_consumption_mixed"], SQL["src_grn_mixed"] = SQL["src_consumption"], SQL["src_grn"]
SQL["src_inventory_mixed"] = SQL["src_inventory"].replace("CAST(NULL AS VARCHAR) AS hsn, ", "")
SQL["src_date_rejects"] = """SELECT 'po_date' AS column_name, count(po_date) AS present, 0 AS rejected FROM fact_grn
    UNION ALL SELECT 'gr_date', count(*) FILTER (gr_date IS NOT NULL OR month_num = 3), count(*) FILTER (month_num = 3) FROM fact_grn
    UNION ALL SELECT 'expiry_date', count(expiry_date), 0 FROM fact_grn"""
SQL["period_card"] = """f AS (SELECT plant AS location, CASE WHEN month_num >= 4 THEN year ELSE year - 1 END AS y, sum(amount_lc) AS v
    FROM fact_consumption GROUP BY 1, 2),
r AS (SELECT *, CAST(v AS DOUBLE) AS d, row_number() OVER (PARTITION BY location ORDER BY y DESC) AS rk FROM f),
p AS (SELECT a.location, a.y, a.d, b.d AS b FROM r a LEFT JOIN r b ON a.location = b.location AND b.rk = 2 WHERE a.rk = 1)
SELECT location, y || '-' || (y + 1) AS period, round(d, 4) AS value, round(b, 4) AS previous_value,
       round_even(CASE WHEN b <> 0 THEN (d - b) / b * 100 END, 2) AS change_pct FROM p"""
