"""Schema registry: the output contract of every curated and KPI table.

``check(df, name)`` verifies a frame against its contract (column names and types);
the generic surface (GEN-03/05) and the oracles read column roles from here.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType, _parse_datatype_string  # noqa: F401

SCHEMAS = {
    "fact_consumption": "struct<material:string,material_desc:string,plant:string,sloc:string,mvt:string,cost_ctr:string,qty:decimal(12,2),amount_lc:decimal(24,6),uom:string,posting_date:date,year:int,month_num:int,month:string>",
    "fact_inventory": "struct<plant:string,sloc:string,sloc_desc:string,material:string,material_desc:string,hsn:string,batch:string,qty:decimal(12,2),uom:string,total_cost:decimal(24,6),total_mrp:decimal(24,6),moving_avg_price:decimal(18,4),aging_days:int,manufacturer_desc:string,generic_name:string,formulary:string,material_type:string,material_group:string,major_group_desc:string,minor_group_desc:string,expiry_date:date,grn_date:date,snapshot_date:date>",
    "sales_line": "struct<sale_date:date,material:string,material_desc:string,qty:decimal(12,2),revenue:decimal(24,6),cost:decimal(24,6),manufacturer:string,hospital:string,patient_type:string,year:int,month_num:int,month:string>",
    "dim_plant": "struct<plant:string,plant_name:string>",
    "dim_material": "struct<material:string,material_desc:string,material_group:string,major_group_desc:string,minor_group_desc:string,generic_name:string,manufacturer_desc:string,formulary:string,material_type:string>",
    "dim_sloc": "struct<plant:string,sloc:string,sloc_desc:string,ip_op_class:string>",
    "dim_vendor": "struct<vendor_code:string,vendor_name:string>",
    "dim_costcenter": "struct<cost_ctr:string,department_name:string>",
    "kpi_stock_value": "struct<plant:string,material:string,material_desc:string,material_group:string,stock_qty:double,stock_value_cost:double,stock_value_mrp:double>",
    "kpi_aging_distribution": "struct<plant:string,material_group:string,aging_bucket:string,stock_value:double,stock_qty:double,sku_count:bigint>",
    "kpi_inventory_aging": "struct<plant:string,material:string,material_desc:string,material_group:string,closing_stock_quantity:double,closing_stock_value:double,aging_days:double,last_sale_date:date,last_purchase_date:date,age_since_last_sale_days:int,age_since_last_purchase_days:int,aging_category:string>",
    "kpi_doh": "struct<plant:string,material:string,material_desc:string,material_group:string,stock_qty:double,consumption_qty:double,avg_daily_consumption:double,doh_days:double>",
    "kpi_health_score": "struct<plant:string,material:string,material_desc:string,material_group:string,closing_stock_value:double,aging_days:double,consumption_cost:double,turnover_annualized:double,health_score:double,health_tier:string>",
    "kpi_non_moving": "struct<plant:string,material:string,material_desc:string,material_group:string,closing_stock_quantity:double,closing_stock_value:double,aging_days:double,last_sale_date:date,reason:string>",
    "kpi_risk_classification": "struct<material:string,plant:string,material_desc:string,material_group:string,closing_stock_quantity:double,closing_stock_value:double,aging_days:double,nearest_expiry:date,days_to_expiry:int,consumed:boolean,risk_level:string>",
    "kpi_near_expiry": "struct<plant:string,material:string,material_desc:string,material_group:string,batch:string,expiry_date:date,days_to_expiry:int,expiry_bucket:string,qty:double,total_cost:double,total_mrp:double>",
    "kpi_stock_change": "struct<year:int,month:string,plant:string,material:string,material_desc:string,material_group:string,inflow:double,outflow:double,stock_change:double>",
    "kpi_stock_change_by_group": "struct<year:int,month:string,plant:string,material_group:string,stock_change:double>",
    "kpi_purchase_value": "struct<plant:string,vendor_name:string,category:string,year:int,month:string,purchase_value:double,purchase_qty:double,po_lines:bigint>",
    "kpi_monthly_purchase_value": "struct<year:int,month:string,plant:string,material:string,material_desc:string,material_group:string,monthly_purchase_value:double,purchase_qty:double>",
    "kpi_procurement_variance": "struct<plant:string,year:int,month:string,purchase_value:double,prev_value:double,variance_abs:double,variance_pct:double>",
    "kpi_vendor_volume": "struct<plant:string,vendor_name:string,vendor_value:double,vendor_qty:double,po_lines:bigint,value_share_pct:double>",
    "kpi_purchase_by_location": "struct<plant:string,purchase_value:double,purchase_qty:double,vendor_count:bigint,po_lines:bigint>",
    "kpi_units_consumed": "struct<year:int,month:string,plant:string,material:string,material_desc:string,material_group:string,total_units:double,consumption_cost:double>",
    "kpi_consumption_by_department": "struct<cost_ctr:string,plant:string,year:int,month:string,consumption_qty:double,consumption_cost:double,department_name:string>",
    "kpi_cycle_time": "struct<plant:string,year:int,month:string,avg_po_to_gr_tat:double,avg_pr_to_gr_tat:double,gr_lines:bigint>",
    "kpi_vendor_lead_time": "struct<vendor_name:string,avg_lead_time_days:double,median_lead_time_days:double,gr_lines:bigint>",
    "kpi_fill_rate": "struct<plant:string,ordered_qty:double,open_qty:double,fill_rate_pct:double>",
    "forecast_sales": "struct<material_id:string,plant:string,material_group:string,posting_date:date,sales_quantity:double,sales_value:double,sales_quantity_forecast:double,lower_bound_sales_quantity_forecast:double,upper_bound_sales_quantity_forecast:double,cashflow_forecast:double,lower_bound_cashflow_forecast:double,upper_bound_cashflow_forecast:double>",
    "stock_replenishment_and_aging_risk": "struct<plant:string,material_id:string,material_desc:string,material_group:string,closing_stock:double,closing_stock_value:double,aging_days:double,unit_cost:double,demand_forecast:double,demand_monthly:double,demand_std:double,lead_months:double,safe_stock:double,replenishment_quantity:double,inventory_aging_risk:boolean,aging_risk:string>",
    "kpi_fulfillment": "struct<plant:string,material_id:string,material_desc:string,closing_stock:double,demand_monthly:double,fulfillment_rate:double,coverage_months:double>",
    "kpi_stock_radar": "struct<plant:string,material_id:string,material_desc:string,material_group:string,closing_stock:double,demand_forecast:double,aging_days:double,aging_risk:string,replenishment_quantity:double,coverage_months:double,radar_status:string>",
    "kpi_aging_risk_forecast": "struct<plant:string,material_id:string,material_desc:string,material_group:string,closing_stock:double,demand_monthly:double,aging_days:double,projected_aging_days:double,will_stagnate:boolean,aging_risk_forecast:string>",
    "forecast_accuracy": "struct<metric:string,value:double>",
    "fact_grn": "struct<plant:string,sloc:string,material:string,material_desc:string,vendor_code:string,vendor_name:string,po_no:string,gr_no:string,gr_qty:decimal(12,2),base_price:decimal(18,4),net_price:decimal(18,4),unit_mrp:decimal(18,4),total_amount_wo_tax:decimal(24,6),po_to_gr_tat:int,pr_to_gr_tat:int,major_group:string,minor_group:string,po_date:date,gr_date:date,expiry_date:date,posting_date:date,year:int,month_num:int,month:string>",
    "fact_po": "struct<plant:string,plant_name:string,sloc:string,material:string,material_desc:string,vendor_code:string,vendor_name:string,po_no:string,doc_type:string,po_qty:decimal(12,2),open_qty:decimal(12,2),net_price:decimal(18,4),total_value_wo_tax:decimal(24,6),total_value_tax:decimal(26,8),major_group:string,minor_group:string,po_date:date,delivery_date:date,posting_date:date,year:int,month_num:int,month:string>",
    "sales_totals": "struct<patient_type:string,revenue:double,cost:double,qty:double,lines:bigint>",
    "sales_monthly": "struct<patient_type:string,month:string,revenue:double,cost:double,qty:double,lines:bigint>",
    "sales_by_hospital": "struct<hospital:string,revenue:double,cost:double,qty:double,lines:bigint>",
    "sales_by_manufacturer": "struct<manufacturer:string,revenue:double,cost:double,qty:double,lines:bigint>",
}

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")

# Registry key -> (table, status); portfolio -> registry keys (KPI registry, 2.1/1.5)
REGISTRY = {
    "current-stock-value": ("kpi_stock_value", "available"),
    "inventory-aging": ("kpi_inventory_aging", "available"),
    "inventory-turnover-ratio": ("kpi_health_score", "proxy"),
    "aging-distribution": ("kpi_aging_distribution", "available"),
    "days-on-hand": ("kpi_doh", "available"),
    "inventory-health-score": ("kpi_health_score", "available"),
    "non-moving-inventory": ("kpi_non_moving", "available"),
    "inventory-risk": ("kpi_risk_classification", "available"),
    "stock-change": ("kpi_stock_change", "available"),
    "purchase-value": ("kpi_purchase_value", "available"),
    "monthly-purchase-value": ("kpi_monthly_purchase_value", "available"),
    "procurement-variance": ("kpi_procurement_variance", "available"),
    "vendor-volume-contribution": ("kpi_vendor_volume", "available"),
    "purchase-by-location": ("kpi_purchase_by_location", "available"),
    "unit-sold-per-sku": ("kpi_units_consumed", "available"),
    "consumption-by-department": ("kpi_consumption_by_department", "available"),
    "fulfillment-rate": ("kpi_fulfillment", "available"),
    "stock-radar": ("kpi_stock_radar", "available"),
    "aging-risk-forecast": ("kpi_aging_risk_forecast", "available"),
    "near-expiry": ("kpi_near_expiry", "available"),
    "procurement-cycle-time": ("kpi_cycle_time", "available"),
    "vendor-lead-time": ("kpi_vendor_lead_time", "available"),
    "fill-rate": ("kpi_fill_rate", "available"),
    "forecast-accuracy": ("forecast_accuracy", "proxy"),
}
PORTFOLIOS = {
    "inventory": ["current-stock-value", "inventory-aging", "days-on-hand", "stock-change", "aging-distribution",
                  "inventory-health-score", "non-moving-inventory", "inventory-risk", "near-expiry"],
    "procurement": ["purchase-value", "monthly-purchase-value", "procurement-variance", "vendor-volume-contribution",
                    "purchase-by-location", "procurement-cycle-time", "vendor-lead-time", "fill-rate"],
    "consumption": ["unit-sold-per-sku", "consumption-by-department"],
    "forecasting": ["fulfillment-rate", "stock-radar", "aging-risk-forecast"],
}


def struct_of(name: str) -> StructType:
    return _parse_datatype_string(SCHEMAS[name])


def columns_of(name: str) -> list[tuple[str, str]]:
    """[(column, simple type)] of a registered table (parsed without a Spark session)."""
    body = SCHEMAS[name][len("struct<"):-1]
    out, depth, cur = [], 0, ""
    for ch in body + ",":
        if ch == "," and depth == 0:
            n, t = cur.split(":", 1)
            out.append((n, t))
            cur = ""
            continue
        depth += ch == "("
        depth -= ch == ")"
        cur += ch
    return out


def is_numeric(simple_type: str) -> bool:
    return simple_type.split("(")[0] in NUMERIC


def check(df: DataFrame, name: str) -> DataFrame:
    """Fail fast when a frame drifts from its contract (names and types)."""
    got = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    exp = columns_of(name)
    if got != exp:
        raise ValueError(f"schema drift in {name}: expected {exp}, got {got}")
    return df
