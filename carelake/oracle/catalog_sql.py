"""Collects every oracle and wraps it with the fixture CTEs."""
from carelake.oracle.fixtures_sql import with_fixtures

FACT_SQL = {
    "fact_consumption": "SELECT * FROM fact_consumption",
    "fact_inventory": "SELECT * FROM fact_inventory",
    "sales_line": "SELECT * FROM sales_line",
}


def all_sql() -> dict:
    from carelake.oracle import (branches_sql, forecast_sql, generic_sql, insights_cons_sql, insights_inv_sql, insights_proc_sql,
                                 insights_extra_sql, kpi_sql, reaimed_sql, sales_sql)
    out = {}
    for mod_sql in [FACT_SQL, kpi_sql.SQL, forecast_sql.SQL, sales_sql.SQL, insights_inv_sql.SQL, insights_proc_sql.SQL,
                    insights_cons_sql.SQL, generic_sql.SQL, reaimed_sql.SQL,
                    insights_extra_sql.SQL, branches_sql.SQL]:
        for k, v in mod_sql.items():
            out[k] = with_fixtures(v)
    out["cat_inventory_expiry"] = out["cat_expiry"]      # the inventory catalogue's expiry view is the ladder
    out.update(_whole_catalogue(out))
    out.update(_totals(out))
    out.update(_more(out))
    for name in ("dashboard_summary", "procurement_totals", "mart_procurement"):      # the same rows, read from stored tables
        out[f"{name}_stored"] = out[name]
    return out


def _whole_catalogue(sql: dict) -> dict:
    """Queries over every table of the catalogue, each table as the oracle that it has itself."""
    from carelake.operators.reaimed import _ID, _TIME
    from carelake.plans.pipeline import DIMS, FACT_PARTITIONS, FORECAST_TABLES, KPI_TABLES, MART_TABLES, SALES_TABLES
    tables = [*FACT_PARTITIONS, *DIMS, *KPI_TABLES, *SALES_TABLES, *MART_TABLES, *FORECAST_TABLES]
    by_id = {"forecast_sales", "stock_replenishment_and_aging_risk", "kpi_fulfillment", "kpi_stock_radar", "kpi_aging_risk_forecast"}
    keyed = sorted(by_id | {"fact_consumption", "fact_inventory", "fact_grn", "fact_po", "sales_line", "dim_material", "kpi_stock_value",
                            "kpi_inventory_aging", "kpi_doh", "kpi_health_score", "kpi_non_moving", "kpi_risk_classification",
                            "kpi_near_expiry", "kpi_stock_change", "kpi_monthly_purchase_value", "kpi_units_consumed",
                            "sales_by_material", "sales_by_material_mfr", "sales_by_material_hospital"})
    counts = "\n UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM ({sql[t]}) WHERE "
                                  f"CAST({'material_id' if t in by_id else 'material'} AS VARCHAR) IN (SELECT code FROM codes)" for t in keyed)
    footprint = f"""WITH matched AS (SELECT material FROM ({sql['dim_material']}) WHERE material = 'gear' OR contains(lower(material_desc), 'gear')),
codes AS (SELECT DISTINCT code FROM (SELECT material AS code FROM matched UNION ALL
          SELECT CASE WHEN material LIKE '%.0' THEN left(material, length(material) - 2)
                      WHEN regexp_matches(material, '^[0-9]+$') THEN material || '.0' END FROM matched) WHERE code IS NOT NULL)
{counts}"""
    columns = "\n UNION ALL ".join(f"SELECT '{t}' AS table_name, column_name, column_type FROM (DESCRIBE {sql[t]})" for t in tables)
    sizes = "\n UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM ({sql[t]})" for t in tables)
    profile = f"""WITH cols AS ({columns}), sizes AS ({sizes}),
short AS (SELECT *, CASE WHEN column_type = 'VARCHAR' THEN 'text' WHEN column_type = 'BOOLEAN' THEN 'bool'
                         WHEN column_type LIKE 'DECIMAL%' OR column_type IN ('DOUBLE', 'FLOAT') THEN 'num'
                         WHEN column_type = 'DATE' OR column_type LIKE 'TIMESTAMP%' THEN 'date' ELSE 'int' END AS short_type FROM cols)
SELECT table_name, column_name, short_type, CASE WHEN regexp_matches(column_name, '{_TIME}') OR short_type = 'date' THEN 'time'
       WHEN short_type = 'text' OR regexp_matches(column_name, '{_ID}') THEN 'dim' ELSE 'measure' END AS role, rows
FROM short JOIN sizes USING (table_name)"""
    join = f"""WITH pv AS ({sql['kpi_purchase_value']}), sv AS ({sql['kpi_stock_value']}), fr AS ({sql['kpi_fill_rate']}), dp AS ({sql['dim_plant']}),
spend AS (SELECT plant, sum(purchase_value) AS spend, count(DISTINCT vendor_name) AS vendors FROM pv GROUP BY plant),
stock AS (SELECT plant, sum(stock_value_cost) AS stock FROM sv GROUP BY plant)
SELECT plant, plant_name, round(spend, 4) AS spend, vendors, round(stock, 4) AS stock FROM dp LEFT JOIN spend USING (plant) LEFT JOIN stock USING (plant)
WHERE plant IN (SELECT plant FROM fr WHERE ordered_qty > 0)"""
    capped = f"""WITH s AS (SELECT material, round(sum(stock_value_cost), 4) AS stock FROM ({sql['kpi_stock_value']}) GROUP BY material)
SELECT *, (SELECT count(*) > 40 FROM s) AS truncated FROM s ORDER BY stock DESC, material LIMIT 40"""
    return {"item_footprint_all": footprint, "catalog_profile_all": profile, "adhoc_sql_join": join, "adhoc_sql_capped": capped}


def _totals(sql: dict) -> dict:
    """Headline totals, each over the oracle of the table that it reads."""
    from carelake.oracle.frag_text import clean_category
    t = {k: f"({sql[k]})" for k in sql}

    def s(c, name, where=None):
        return f"round(CAST(coalesce(sum({c}){f' FILTER ({where})' if where else ''}, 0) AS DOUBLE), 4) AS {name}"
    ex = f"""(SELECT *, dte, CASE WHEN dte <= -1 THEN 'Expired' WHEN dte <= 30 THEN '0-30d' WHEN dte <= 90 THEN '31-90d'
        WHEN dte <= 180 THEN '91-180d' WHEN dte <= 365 THEN '181-365d' ELSE '365d+' END AS slab
        FROM (SELECT *, date_diff('day', (SELECT max(snapshot_date) FROM {t['fact_inventory']}), expiry_date) AS dte
              FROM {t['fact_inventory']} WHERE expiry_date IS NOT NULL AND qty > 0))"""
    items = f"""(SELECT material, material_desc, sum(total_units) AS u, sum(consumption_cost) AS c FROM {t['kpi_units_consumed']}
        WHERE material IS NOT NULL AND material_desc IS NOT NULL GROUP BY 1, 2)"""
    grp = "(SELECT material_group AS g, sum(monthly_purchase_value) AS v FROM mp GROUP BY 1)"
    mp = f"mp AS (SELECT *, year || '-' || lpad(CAST(month(strptime(month, '%B')) AS VARCHAR), 2, '0') AS ym FROM {t['kpi_monthly_purchase_value']})"

    def headline(f, lo, hi):
        return f"""WITH fs AS {t['forecast_sales']}, acc AS {t['forecast_accuracy']},
m AS (SELECT posting_date, sum({f}) AS f, sum({lo}) AS lo, sum({hi}) AS hi FROM fs GROUP BY 1 HAVING sum({f}) > 0),
n AS (SELECT * FROM m ORDER BY posting_date LIMIT 1), e AS (SELECT sum({f}) AS t, count(DISTINCT material_id) AS k FROM fs WHERE {f} > 0),
h AS (SELECT count(*) AS h FROM m)
SELECT coalesce((SELECT round(f, 4) FROM n), 0.0) AS next, coalesce((SELECT round(lo, 4) FROM n), 0.0) AS next_lower,
       coalesce((SELECT round(hi, 4) FROM n), 0.0) AS next_upper, h AS horizon, round(coalesce(t, 0.0), 4) AS total_horizon,
       round(CASE WHEN h > 0 THEN t / h ELSE 0.0 END, 4) AS avg_month, k AS materials,
       (SELECT round(value, 4) FROM acc WHERE metric = 'Aggregate Forecast Accuracy %') AS accuracy,
       (SELECT round(value, 4) FROM acc WHERE metric = 'Weighted Forecast Accuracy %') AS weighted_acc,
       (SELECT CAST(value AS INTEGER) FROM acc WHERE metric = 'Series count') AS series FROM e, h"""
    qty = headline("sales_quantity_forecast", "lower_bound_sales_quantity_forecast", "upper_bound_sales_quantity_forecast")
    cash = headline("cashflow_forecast", "lower_bound_cashflow_forecast", "upper_bound_cashflow_forecast")
    rep = t["stock_replenishment_and_aging_risk"]
    return {
        "stock_flow_totals": f"""SELECT {s('inflow', 'inflow')}, {s('outflow', 'outflow')}, {s('stock_change', 'net')},
            count(DISTINCT material) AS skus, count(DISTINCT year || month) AS months FROM {t['kpi_stock_change']}""",
        "non_moving_totals": f"""SELECT {s('closing_stock_value', 'blocked_value')}, count(*) AS blocked_skus,
            {s('closing_stock_quantity', 'qty')} FROM {t['kpi_non_moving']}""",
        "risk_totals": f"SELECT {s('closing_stock_value', 'total_value')}, count(*) AS total_skus FROM {t['kpi_risk_classification']}",
        "near_expiry_totals": f"""SELECT {s('total_cost', 'exposure')}, count(*) AS skus, {s('total_cost', 'expired_value', "expiry_bucket = 'Expired'")},
            {s('total_cost', 'urgent_value', "expiry_bucket = '0-30d'")}, {s('total_mrp', 'mrp_exposure')} FROM {t['kpi_near_expiry']}""",
        "cat_expiry_items": f"""WITH x AS (SELECT * FROM {ex} WHERE slab = '91-180d')
            SELECT material_desc AS name, round(CAST(total_cost AS DOUBLE), 4) AS value, CAST(dte AS INTEGER) AS days_left, expiry_date AS expiry,
                   (SELECT {s('total_cost', 'v')} FROM x) AS band_value FROM x ORDER BY total_cost DESC, material, plant, batch, dte, sloc LIMIT 15""",
        "cat_expiry_within": f"SELECT {s('total_cost', 'actionable')}, count(DISTINCT material) AS items FROM {ex} WHERE dte <= 180",
        "open_po_totals": f"""SELECT {s('open_qty * net_price', 'total_value')}, count(DISTINCT po_no) AS total_pos, count(*) AS total_lines
            FROM {t['fact_po']} WHERE open_qty > 0""",
        "savings_totals": f"""WITH d AS (SELECT *, CAST(net_price AS DOUBLE) AS price, CAST(gr_qty AS DOUBLE) AS q FROM {t['fact_grn']}
            WHERE net_price > 0 AND gr_qty > 0 AND material IS NOT NULL),
            st AS (SELECT material, median(price) AS med FROM d GROUP BY 1 HAVING count(*) >= 4 AND max(price) / min(price) <= 2.5),
            l AS (SELECT material, material_desc, sum(greatest(price - med, 0) * q) AS over, sum(price * q) AS spend
                  FROM d JOIN st USING (material) GROUP BY 1, 2)
            SELECT {s('over', 'opportunity', 'material_desc IS NOT NULL AND over > 0')},
                   count(*) FILTER (material_desc IS NOT NULL AND over > 0) AS items_flagged, {s('spend', 'spend_base')} FROM l""",
        "purchase_totals": f"""WITH {mp} SELECT {s('monthly_purchase_value', 'total')},
            round(sum(monthly_purchase_value) / greatest(count(DISTINCT ym), 1), 4) AS avg, count(DISTINCT material) AS skus,
            (SELECT g FROM {grp} WHERE g IS NOT NULL ORDER BY v DESC, g LIMIT 1) AS top_group FROM mp""",
        "purchase_series": f"""WITH {mp}, top AS (SELECT g FROM {grp} ORDER BY v DESC, g NULLS LAST LIMIT 4), months AS (SELECT DISTINCT ym FROM mp)
            SELECT g AS name, months.ym, round(coalesce(sum(monthly_purchase_value), 0), 4) AS value FROM top CROSS JOIN months
            LEFT JOIN mp ON mp.material_group IS NOT DISTINCT FROM g AND mp.ym = months.ym GROUP BY 1, 2""",
        "purchase_margins": f"""WITH {mp} (SELECT 'row' AS kind, g AS name, round(v, 4) AS total FROM {grp} ORDER BY v DESC, g NULLS LAST LIMIT 8)
            UNION ALL SELECT 'month', ym, round(sum(monthly_purchase_value), 4) FROM mp GROUP BY ym""",
        "consumption_items": f"""SELECT material, material_desc AS "desc", round(u, 4) AS units, round(c, 4) AS cost
            FROM {items} ORDER BY c DESC, material LIMIT 8""",
        "units_categories": f"""WITH g AS (SELECT coalesce(material_group, 'Uncategorized') AS name, sum(total_units) AS u, sum(consumption_cost) AS c
            FROM {t['kpi_units_consumed']} GROUP BY 1)
            SELECT name, round(u, 4) AS units, round(c, 4) AS cost, round(u / (SELECT sum(u) FROM g) * 100, 6) AS share,
                   lower(trim(name)) IN ('uncategorized', '', 'nan', 'none') AS uncat FROM g ORDER BY u DESC, name LIMIT 9""",
        "units_totals": f"""SELECT {s('total_units', 'units')}, {s('consumption_cost', 'cost')}, count(DISTINCT material) AS materials,
            round(sum(consumption_cost) / sum(total_units), 6) AS cpu, (SELECT material_desc FROM {items} ORDER BY u DESC, material LIMIT 1) AS top_material
            FROM {t['kpi_units_consumed']}""",
        "forecast_totals": f"""WITH q AS ({qty}), c AS ({cash}), r AS (SELECT count(*) AS n, {s('replenishment_quantity', 'q')},
            {s('replenishment_quantity * coalesce(unit_cost, 0)', 'v')} FROM {rep} WHERE replenishment_quantity > 0)
            SELECT q.next AS next_demand, q.next_lower, q.next_upper, q.accuracy, q.weighted_acc, q.series, q.horizon, r.n AS replen_skus,
                   r.q AS replen_qty, r.v AS replen_value, c.next AS cashflow_next FROM q, c, r""",
        "demand_totals": qty, "cashflow_totals": cash,
        "cashflow_categories": f"""SELECT {clean_category('grp')} AS "group", grp, round(v, 6) AS forecast FROM
            (SELECT d.mg AS grp, sum(cashflow_forecast) AS v FROM {t['forecast_sales']} f JOIN
             (SELECT material, material_group AS mg FROM {t['dim_material']}) d ON f.material_id = d.material
             WHERE cashflow_forecast > 0 AND length(d.mg) > 0 GROUP BY 1) ORDER BY v DESC, grp LIMIT 10""",
    }


def _more(sql: dict) -> dict:
    """Table contracts, filtered forms, look-ups and coercions."""
    from carelake.plans.pipeline import DIMS, FACT_PARTITIONS, FORECAST_TABLES, KPI_TABLES, MART_TABLES, SALES_TABLES
    from carelake.plans.queries import CONTRACTS
    t = {k: f"({sql[k]})" for k in sql}
    snap = f"(SELECT max(snapshot_date) FROM {t['fact_inventory']})"
    given = {"year": f"CAST(year({snap}) AS INTEGER)", "period": f"monthname({snap})", "returned": "0", "rate": "CAST(0 AS DOUBLE)",
             "op": "CAST(0 AS DOUBLE)", "ip": "CAST(0 AS DOUBLE)"}
    lead = {"inventory_valuation": "stock_value_cost", "turnover": "turnover_annualized", "inventory_aging": "age_since_last_sale_days",
            "monthly_purchase": "monthly_purchase_value", "vendor_margin": "grn_volume", "units_sold": "total_units",
            "return_rate": "total_units", "revenue_distribution": "internal_consumption"}
    derived = {"inventory_valuation": ("year", "period"), "turnover": ("year", "period"), "return_rate": ("returned", "rate"),
               "revenue_distribution": ("op", "ip")}
    out = {}
    for name, (table, names) in CONTRACTS.items():
        own = derived.get(name, ())
        cols = ", ".join(f'{given[c] if c in own else c} AS "{shown}"' for c, shown in names.items())
        ties = ", ".join(f'"{v}" NULLS LAST' for v in names.values())
        out[f"contract_{name}"] = (f"SELECT {cols}, (SELECT count(*) FROM {t[table]}) AS total FROM {t[table]} "
                                   f"ORDER BY {lead[name]} DESC NULLS LAST, {ties} LIMIT 40")
    month_idx = "CAST(month(strptime(month, '%B')) - 1 AS INTEGER) AS month_idx"
    out["monthly_series_purchase"] = (f"SELECT year, month, material_group, round(sum(monthly_purchase_value), 4) AS value, {month_idx} "
                                      f"FROM {t['kpi_monthly_purchase_value']} GROUP BY 1, 2, 3")
    out["monthly_series_units"] = f"SELECT year, month, round(sum(total_units), 4) AS value, {month_idx} FROM {t['kpi_units_consumed']} GROUP BY 1, 2"
    sums = ", ".join(f"round(coalesce(sum({c}), 0.0), 4) AS {n}" for c, n in (
        ("sales_quantity", "actual"), ("lower_bound_sales_quantity_forecast", "lo"), ("sales_quantity_forecast", "fc"),
        ("upper_bound_sales_quantity_forecast", "hi")))
    for name, cut in (("plant", "plant = 'P03'"), ("material", "material_id = '30'"), ("group", "material_group = 'MEDIUM'")):
        out[f"sales_forecast_series_{name}"] = f"SELECT posting_date, {sums} FROM {t['forecast_sales']} WHERE {cut} GROUP BY posting_date"
    out["material_options_plant"] = f"""SELECT material, material_desc, material_group FROM {t['dim_material']}
        WHERE material IN (SELECT material FROM {t['kpi_stock_value']} WHERE plant = 'P03')"""
    out["vendor_options_plant"] = f"""SELECT DISTINCT vendor_name FROM {t['kpi_vendor_volume']}
        WHERE plant = 'P03' AND vendor_name IS NOT NULL AND vendor_name NOT IN ('nan', '')"""
    out["sql_price_lookup"] = f"""SELECT material_desc, clean_median_price, raw_n FROM {t['mart_material_price_stats']}
        WHERE material_desc ILIKE '%gear%'"""
    out["sql_category_spend_cut"] = f"""SELECT material_type, material_group, round(CAST(sum(total_value_wo_tax) AS DOUBLE), 4) AS spend
        FROM {t['fact_po']} JOIN (SELECT material, material_type, material_group FROM {t['dim_material']}) d USING (material)
        WHERE material_type = 'ZMED' AND material_group ILIKE '%m%' AND po_date >= DATE '2000-05-01' AND po_date < DATE '2001-05-01' GROUP BY 1, 2"""
    moved = " UNION ".join(f"SELECT material FROM {t[f]} WHERE {d} >= DATE '2001-09-01' AND material IS NOT NULL" for f, d in (
        ("sales_line", "sale_date"), ("fact_po", "po_date"), ("fact_grn", "gr_date")))
    out["sql_dead_stock_since"] = f"""SELECT plant, material, batch, round(CAST(qty AS DOUBLE), 4) AS qty,
        round(CAST(total_cost AS DOUBLE), 4) AS total_cost, aging_days, expiry_date, formulary, coalesce(expiry_date < {snap}, false) AS expired
        FROM {t['fact_inventory']} WHERE qty > 0 AND material NOT IN ({moved})"""
    active = f"{moved} UNION SELECT material FROM {t['fact_consumption']} WHERE posting_date >= DATE '2001-09-01' AND material IS NOT NULL"
    first = lambda k: (f"(SELECT {k}, string_agg(material, ',' ORDER BY material) AS xs FROM (SELECT {k}, material FROM live "  # noqa: E731
                       f"WHERE {k} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY material) <= 5) GROUP BY 1)")
    out["sql_active_alternatives"] = f"""WITH d AS {t['dim_material']}, act AS ({active}), live AS (SELECT * FROM d WHERE material IN (FROM act))
        SELECT material, material_desc, d.generic_name, d.material_group, coalesce(g.xs, m.xs, '') AS alternatives, g.xs IS NOT NULL AS same_generic
        FROM d LEFT JOIN {first('generic_name')} g ON d.generic_name = g.generic_name
        LEFT JOIN {first('material_group')} m ON d.material_group = m.material_group WHERE material NOT IN (FROM act)"""
    out["safe_columns"] = f'SELECT * EXCLUDE ("desc"), "desc" AS material_desc FROM {t["units_top"]}'
    out["clean_output"] = f"""SELECT plant, material, material_desc, material_group, round(closing_stock_quantity, 4) AS closing_stock_quantity,
        round(closing_stock_value, 4) AS closing_stock_value, round(aging_days, 4) AS aging_days, strftime(last_sale_date, '%Y-%m-%d') AS last_sale_date,
        strftime(last_purchase_date, '%Y-%m-%d') AS last_purchase_date, age_since_last_sale_days, age_since_last_purchase_days, aging_category
        FROM {t['kpi_inventory_aging']}"""
    out["src_numbers"] = f"""SELECT 'GR Qty' AS column_name, count(gr_qty) AS numbers, round(CAST(coalesce(sum(gr_qty), 0) AS DOUBLE), 2) AS total FROM {t['fact_grn']}
        UNION ALL SELECT 'Net Price', count(net_price), round(CAST(coalesce(sum(net_price), 0) AS DOUBLE), 2) FROM {t['fact_grn']}
        UNION ALL SELECT 'Material Description', 0, 0.0"""
    tables = [*FACT_PARTITIONS, *DIMS, *KPI_TABLES, *SALES_TABLES, *MART_TABLES, *FORECAST_TABLES]
    out["staged_build"] = "\n UNION ALL ".join(f"SELECT '{x}' AS table_name, count(*) AS rows FROM {t[x]}" for x in tables)
    return out
