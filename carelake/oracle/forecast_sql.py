"""Oracles for FC-* (history Dec 2000 .. May 2001, horizon 3, z 1.645)."""
from carelake.oracle.frag import aging_risk_label, r6

N, H = 6, 3
START = 2000 * 12 + 12


def _sum(cols):
    return "(" + " + ".join(cols) + ")"


def _level(p, k=N):
    cols = [f"{p}_{i}" for i in range(k)]
    w = min(3, k)
    level = f"({_sum(cols[-w:])} / {float(w)})"
    rate = f"({_sum(cols)} / {float(k)})"
    return f"(CASE WHEN {level} > 0 THEN {level} ELSE {rate} END)"


def _sigma(p, k=N):
    cols = [f"{p}_{i}" for i in range(k)]
    mu = f"({_sum(cols)} / {float(k)})"
    return "sqrt(" + _sum([f"({c} - {mu}) * ({c} - {mu})" for c in cols]) + f" / {float(k)})"


MAT = "mat AS (SELECT plant, material, " + ", ".join(
    [f"CAST(COALESCE(sum(CASE WHEN slot = {k} THEN qty END), 0) AS DOUBLE) AS q_{k}" for k in range(N)]
    + [f"CAST(COALESCE(sum(CASE WHEN slot = {k} THEN amount_lc END), 0) AS DOUBLE) AS v_{k}" for k in range(N)]
) + f" FROM (SELECT *, (year * 12 + month_num) - {START} AS slot FROM fact_consumption) " \
    "WHERE plant IS NOT NULL AND material IS NOT NULL GROUP BY plant, material)"

FCB = ("fcb AS (SELECT *, " + f"{_level('q')} AS fc_qty, {_sigma('q')} AS sigma_qty, "
       f"{_level('v')} AS fc_cash, {_sigma('v')} AS sigma_cash FROM mat), "
       "fcc AS (SELECT *, least(greatest(CASE WHEN fc_qty > 0 THEN sigma_qty / fc_qty ELSE 0.0 END, 0.0), 1.5) AS cv_qty, "
       "least(greatest(CASE WHEN fc_cash > 0 THEN sigma_cash / fc_cash ELSE 0.0 END, 0.0), 1.5) AS cv_cash FROM fcb), "
       "fch AS (SELECT fcc.*, h FROM fcc, range(1, 4) t(h))")


def _band(name):
    r = f"(1.645 * cv_{name} * (1.0 + 0.15 * (h - 1)))"
    return (f"{r6(f'fc_{name} / (1.0 + {r})')} AS lo_{name}, {r6(f'fc_{name}')} AS fc_{name}, "
            f"{r6(f'fc_{name} * (1.0 + {r})')} AS hi_{name}")


DFC = f"{MAT}, {FCB}, dfc AS (SELECT plant, material, CAST(h AS INTEGER) AS h, {_band('qty')}, {_band('cash')} FROM fch)"

GROUP_OF = "grp AS (SELECT material, COALESCE(material_group, '') AS material_group FROM dim_material)"

DN = (f"{MAT}, {GROUP_OF}, dn AS (SELECT m.plant, m.material, COALESCE(g.material_group, '') AS material_group, "
      f"({_level('q')} + {_level('q')} + {_level('q')}) AS demand_forecast, {_level('q')} AS demand_monthly "
      "FROM mat m LEFT JOIN grp g USING (material))")

REP = DN + """,
stock AS (SELECT plant, material, CAST(sum(qty) AS DOUBLE) AS closing_stock,
                 CAST(sum(total_cost) AS DOUBLE) AS closing_stock_value, avg(aging_days) AS aging_days,
                 CAST(avg(moving_avg_price) AS DOUBLE) AS unit_cost
          FROM fact_inventory WHERE plant IS NOT NULL AND material IS NOT NULL GROUP BY ALL),
vol AS (SELECT plant, material, stddev_pop(qty) AS demand_std FROM fact_consumption
        WHERE plant IS NOT NULL AND material IS NOT NULL GROUP BY ALL),
lead AS (SELECT material, avg(po_to_gr_tat) AS lead_time_days FROM fact_grn
         WHERE material IS NOT NULL AND po_to_gr_tat IS NOT NULL GROUP BY material),
j AS (SELECT COALESCE(s.plant, d.plant) AS plant, COALESCE(s.material, d.material) AS material,
             COALESCE(s.closing_stock, 0.0) AS closing_stock, COALESCE(s.closing_stock_value, 0.0) AS closing_stock_value,
             s.aging_days, COALESCE(s.unit_cost, 0.0) AS unit_cost,
             COALESCE(d.demand_forecast, 0.0) AS demand_forecast, COALESCE(d.demand_monthly, 0.0) AS demand_monthly
      FROM stock s FULL OUTER JOIN dn d ON s.plant = d.plant AND s.material = d.material),
j2 AS (SELECT j.*, COALESCE(v.demand_std, 0.0) AS demand_std, dm.material_desc, dm.material_group,
              greatest(COALESCE(l.lead_time_days, (SELECT median(lead_time_days) FROM lead), 5.0) / 30.0, 0.05) AS lead_months
       FROM j LEFT JOIN vol v USING (plant, material) LEFT JOIN lead l USING (material)
       LEFT JOIN dim_material dm USING (material)),
j3 AS (SELECT *, round_even(1.645 * demand_std * sqrt(lead_months), 2) AS safe_stock FROM j2),
rep AS (SELECT plant, material AS material_id, material_desc, COALESCE(material_group, '') AS material_group,
""" + ", ".join(f"{r6(c)} AS {c}" for c in ["closing_stock", "closing_stock_value", "aging_days", "unit_cost",
                                             "demand_forecast", "demand_monthly", "demand_std", "lead_months"]) + """,
               safe_stock, """ + r6("greatest(demand_forecast + safe_stock - closing_stock, 0.0)") + """ AS replenishment_quantity,
               COALESCE(aging_days > 180, false) AS inventory_aging_risk, """ + aging_risk_label("aging_days") + """ AS aging_risk
        FROM j3)"""

SQL = {
    "demand_matrix": MAT + " SELECT * FROM mat",
    "demand_forecast": DFC + " SELECT * FROM dfc",
    "forecast_sales": DFC + f""", {GROUP_OF},
        keys AS (SELECT m.*, COALESCE(g.material_group, '') AS mg FROM mat m LEFT JOIN grp g USING (material)),
        act AS (SELECT material AS material_id, plant, mg AS material_group,
                       CAST(DATE '2000-12-01' + to_months(CAST(s AS INTEGER)) AS DATE) AS posting_date,
                       round([q_0, q_1, q_2, q_3, q_4, q_5][s + 1], 4) AS sales_quantity,
                       round([v_0, v_1, v_2, v_3, v_4, v_5][s + 1], 4) AS sales_value,
                       CAST(NULL AS DOUBLE) AS sales_quantity_forecast, CAST(NULL AS DOUBLE) AS lower_bound_sales_quantity_forecast,
                       CAST(NULL AS DOUBLE) AS upper_bound_sales_quantity_forecast, CAST(NULL AS DOUBLE) AS cashflow_forecast,
                       CAST(NULL AS DOUBLE) AS lower_bound_cashflow_forecast, CAST(NULL AS DOUBLE) AS upper_bound_cashflow_forecast
                FROM keys, range(0, 6) t(s)),
        fut AS (SELECT d.material AS material_id, d.plant, k.mg AS material_group,
                       CAST(DATE '2001-05-01' + to_months(CAST(d.h AS INTEGER)) AS DATE) AS posting_date,
                       CAST(NULL AS DOUBLE) AS sales_quantity, CAST(NULL AS DOUBLE) AS sales_value,
                       d.fc_qty AS sales_quantity_forecast, d.lo_qty AS lower_bound_sales_quantity_forecast,
                       d.hi_qty AS upper_bound_sales_quantity_forecast, d.fc_cash AS cashflow_forecast,
                       d.lo_cash AS lower_bound_cashflow_forecast, d.hi_cash AS upper_bound_cashflow_forecast
                FROM dfc d JOIN keys k USING (plant, material))
        SELECT * FROM act UNION ALL SELECT * FROM fut""",
    "demand_next": DN + f" SELECT plant, material, material_group, {r6('demand_forecast')} AS demand_forecast, "
                        f"{r6('demand_monthly')} AS demand_monthly FROM dn",
    "material_lead_time": f"""SELECT material, {r6('avg(po_to_gr_tat)')} AS lead_time_days FROM fact_grn
        WHERE material IS NOT NULL AND po_to_gr_tat IS NOT NULL GROUP BY material""",
    "stock_replenishment_and_aging_risk": REP + " SELECT * FROM rep",
    "kpi_fulfillment": REP + f""" SELECT plant, material_id, material_desc, closing_stock, demand_monthly,
        {r6('CASE WHEN demand_monthly > 0 THEN least(greatest(closing_stock / demand_monthly, 0.0), 1.0) * 100.0 ELSE 100.0 END')} AS fulfillment_rate,
        {r6('CASE WHEN demand_monthly > 0 THEN closing_stock / demand_monthly END')} AS coverage_months FROM rep""",
    "kpi_stock_radar": REP + f""", rd AS (SELECT plant, material_id, material_desc, material_group, closing_stock,
        demand_forecast, aging_days, aging_risk, replenishment_quantity,
        CASE WHEN demand_forecast > 0 THEN closing_stock / (demand_forecast / 3.0) END AS cov FROM rep)
        SELECT plant, material_id, material_desc, material_group, closing_stock, demand_forecast, aging_days,
               aging_risk, replenishment_quantity, {r6('cov')} AS coverage_months,
               CASE WHEN replenishment_quantity > 0 AND (cov IS NULL OR cov < 1) THEN 'Stock-Out Risk'
                    WHEN aging_days > 180 THEN 'Overstock/Aging' ELSE 'Healthy' END AS radar_status FROM rd""",
    "kpi_aging_risk_forecast": REP + """ SELECT plant, material_id, material_desc, material_group, closing_stock,
        demand_monthly, aging_days, aging_days + 90 AS projected_aging_days,
        demand_monthly < closing_stock * 0.05 AS will_stagnate,
        CASE WHEN demand_monthly < closing_stock * 0.05 AND closing_stock > 0 THEN 'Rising' ELSE 'Stable' END AS aging_risk_forecast
        FROM rep""",
    "forecast_accuracy": MAT + f""",
        s AS (SELECT m.*, COALESCE(dm.material_group, '') AS g, q_4 AS a4, {_level('q', 4)} AS p4,
                     q_5 AS a5, {_level('q', 5)} AS p5,
                     CASE WHEN ({' + '.join(f'(CASE WHEN q_{i} > 0 THEN 1 ELSE 0 END)' for i in range(N))}) <= 2
                          THEN 1 ELSE 0 END AS intermittent
              FROM mat m LEFT JOIN dim_material dm USING (material)),
        pg AS (SELECT g, sum(abs(a4 - p4)) AS err4, sum(abs(a5 - p5)) AS err5, sum(a4) AS A4, sum(a5) AS A5,
                      sum(p4) AS P4, sum(p5) AS P5, count(*) AS n, sum(intermittent) AS n_int FROM s GROUP BY g),
        t AS (SELECT sum(err4) AS err4, sum(err5) AS err5, sum(A4) AS A4, sum(A5) AS A5, sum(P4) AS P4,
                     sum(P5) AS P5, sum(abs(A4 - P4)) AS cat4, sum(abs(A5 - P5)) AS cat5, sum(n) AS n,
                     sum(n_int) AS n_int FROM pg),
        m AS (SELECT
          round_even(greatest(0.0, 100.0 - (abs(A4 - P4) / greatest(A4, 1.0) * 100.0 + abs(A5 - P5) / greatest(A5, 1.0) * 100.0) / 2.0), 1) AS m1,
          round_even(greatest(0.0, 100.0 - (cat4 / greatest(A4, 1.0) * 100.0 + cat5 / greatest(A5, 1.0) * 100.0) / 2.0), 1) AS m2,
          round_even(greatest(0.0, 100.0 - (err4 / greatest(A4, 1.0) * 100.0 + err5 / greatest(A5, 1.0) * 100.0) / 2.0), 1) AS m3,
          round_even((err4 / n + err5 / n) / 2.0, 2) AS m4,
          round_even(CAST(n_int AS DOUBLE) / n * 100.0, 1) AS m5,
          CAST(n AS DOUBLE) AS m6 FROM t)
        SELECT 'Aggregate Forecast Accuracy %' AS metric, m1 AS value FROM m
        UNION ALL SELECT 'Weighted Forecast Accuracy %', m2 FROM m
        UNION ALL SELECT 'SKU-Level Accuracy %', m3 FROM m
        UNION ALL SELECT 'MAE (units)', m4 FROM m
        UNION ALL SELECT 'Intermittent SKUs %', m5 FROM m
        UNION ALL SELECT 'Series count', m6 FROM m""",
}

_FS = SQL["forecast_sales"]
for _key, _cols in (("sales_forecast_series", ("sales_quantity", "lower_bound_sales_quantity_forecast",
                                               "sales_quantity_forecast", "upper_bound_sales_quantity_forecast")),
                    ("cashflow_forecast_series", ("sales_value", "lower_bound_cashflow_forecast",
                                                  "cashflow_forecast", "upper_bound_cashflow_forecast"))):
    _body = _FS.replace("SELECT * FROM act UNION ALL SELECT * FROM fut",
                        ", fs AS (SELECT * FROM act UNION ALL SELECT * FROM fut) SELECT posting_date, "
                        + ", ".join(f"round(COALESCE(sum({c}), 0.0), 4) AS {n}"
                                    for c, n in zip(_cols, ["actual", "lo", "fc", "hi"]))
                        + " FROM fs GROUP BY posting_date")
    SQL[_key] = _body

SQL["weekly_forecast"] = REP + """,
    a AS (SELECT material_id, min(material_desc) AS material_desc, round(sum(closing_stock), 6) AS closing_stock,
                 round(sum(closing_stock_value), 6) AS closing_stock_value, round(sum(demand_forecast), 6) AS demand_forecast,
                 round(sum(demand_monthly), 6) AS demand_monthly, round(sum(replenishment_quantity), 6) AS replenishment_quantity
          FROM rep GROUP BY material_id),
    md AS (SELECT material_id, aging_risk FROM (
             SELECT material_id, aging_risk, row_number() OVER (PARTITION BY material_id ORDER BY count(*) DESC, aging_risk) AS rn
             FROM rep GROUP BY material_id, aging_risk) WHERE rn = 1),
    b AS (SELECT a.*, md.aging_risk,
                 CASE WHEN closing_stock <> 0 THEN closing_stock_value / closing_stock ELSE 0.0 END AS unit_cost,
                 round_even(CASE WHEN demand_monthly > 0 THEN demand_monthly ELSE demand_forecast END * (7 / 30.0), 0) AS wk
          FROM a JOIN md USING (material_id)
          ORDER BY replenishment_quantity DESC, demand_forecast DESC, material_id)
    SELECT material_id AS material, material_desc AS material_name, round_even(replenishment_quantity, 0) AS order_quantity,
           round_even(demand_forecast, 0) AS demand_forecast, round_even(demand_forecast * unit_cost, 2) AS cash_flow_prediction,
           round_even(closing_stock, 0) AS stock, round_even(closing_stock_value, 2) AS stock_value, aging_risk AS aging,
           wk AS demand_forecast_week, round_even(wk * unit_cost, 2) AS cash_flow_prediction_week FROM b"""

for _w, _days in (("week_2", 14), ("week_3", 21), ("week_4", 28)):
    SQL[f"weekly_forecast_{_w}"] = SQL["weekly_forecast"].replace("* (7 / 30.0)", f"* ({_days} / 30.0)")

SQL["replenishment_summary"] = REP + """ SELECT count(*) AS total_materials,
    round(sum(closing_stock), 4) AS total_closing_stock, round(sum(replenishment_quantity), 4) AS total_replenishment_needed,
    count(*) FILTER (WHERE replenishment_quantity > 0) AS materials_needing_replenishment,
    count(*) FILTER (WHERE inventory_aging_risk) AS materials_with_aging_risk,
    round(COALESCE(avg(demand_forecast), 0.0), 6) AS avg_demand_forecast,
    count(*) FILTER (WHERE aging_risk = '<3 Months') AS aging_0, count(*) FILTER (WHERE aging_risk = '3-6 Months') AS aging_1,
    count(*) FILTER (WHERE aging_risk = '6-12 Months') AS aging_2, count(*) FILTER (WHERE aging_risk = '1+ Year') AS aging_3
    FROM rep"""
SQL["replenishment_top"] = REP + """ SELECT COALESCE(material_desc, material_id) AS material, plant, replenishment_quantity,
    aging_risk, closing_stock, demand_forecast FROM rep WHERE replenishment_quantity > 0
    ORDER BY replenishment_quantity DESC, material_id, plant LIMIT 20"""
SQL["aging_top"] = REP + """ SELECT COALESCE(material_desc, material_id) AS material, plant, aging_risk, closing_stock,
    demand_forecast, replenishment_quantity FROM rep WHERE contains(aging_risk, '1+')
    ORDER BY closing_stock DESC, material_id, plant LIMIT 20"""
