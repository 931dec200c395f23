"""SRC-10 / SRC-15: the staged batch build (curated -> KPI / forecast / sales / marts).

* The joined line is written once and the five facts are derived from it, so the largest
  table is shuffled once.
* Curated facts are written partitioned by (year, month_num) so month filters prune
  files; dimensions and the DQ report are written next to them.
* The KPI stage re-reads the curated tables from the shared output folder: the
  written table cuts the lineage (an executor lost during the KPI stage never forces
  the fact derivation to rerun) - no localCheckpoint, no machine-local folder.
* The six-month demand matrix (with the deviation of the lines), the stock items and the sales
  aggregate (by grain) are written once; the forecast tables, the stock KPIs and the seven grains
  read them. The written dimensions are read, and so are KPI tables that others are made from.
* Tables that do not read one another are written a few at a time, so that the last tasks of one
  leave no cores idle.
"""
from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession

from carelake.operators import forecast as fc
from carelake.operators import kpi, sales
from carelake.plans.store import LATER_TABLES, Store, StoredWarehouse, write_table, write_together
from carelake.plans.warehouse import Warehouse
from carelake.sources.fixtures import Lake, facts_of
from carelake.sources.quality import dq_report

FACT_PARTITIONS = {"fact_consumption": ["year", "month_num"], "fact_grn": ["year", "month_num"],
                   "fact_po": ["year", "month_num"], "sales_line": ["year", "month_num"], "fact_inventory": []}
DIMS = ["dim_plant", "dim_material", "dim_sloc", "dim_vendor", "dim_costcenter"]
KPI_TABLES = ["kpi_stock_value", "kpi_aging_distribution", "kpi_inventory_aging", "kpi_doh", "kpi_health_score",
              "kpi_non_moving", "kpi_risk_classification", "kpi_near_expiry", "kpi_stock_change",
              "kpi_stock_change_by_group", "kpi_purchase_value", "kpi_monthly_purchase_value",
              "kpi_procurement_variance", "kpi_vendor_volume", "kpi_purchase_by_location", "kpi_units_consumed",
              "kpi_consumption_by_department", "kpi_cycle_time", "kpi_vendor_lead_time", "kpi_fill_rate"]
FORECAST_TABLES = ["forecast_sales", "stock_replenishment_and_aging_risk", "kpi_fulfillment", "kpi_stock_radar",
                   "kpi_aging_risk_forecast", "forecast_accuracy"]
SALES_TABLES = ["sales_totals", "sales_monthly", "sales_by_hospital", "sales_by_manufacturer", "sales_by_material",
                "sales_by_material_mfr", "sales_by_material_hospital"]
MART_TABLES = ["mart_material_price_stats", "mart_material_vendor_price_stats", "mart_procurement"]


def build_curated(lake: Lake, out: str) -> dict:
    """Stage 1: facts (partitioned), dimensions and the DQ report."""
    out = out.rstrip("/")
    facts = lake.tables
    if lake.line is not None:       # joined once; the five facts read the written line
        write_table(lake.line, f"{out}/work/line")
        facts = facts_of(lake.spark.read.parquet(f"{out}/work/line"))
    at = {name: f"{out}/curated/{name}" for name in [*FACT_PARTITIONS, *DIMS]}
    write_together({at[n]: facts[n] for n in FACT_PARTITIONS}, {at[n]: p for n, p in FACT_PARTITIONS.items()})
    cur = Lake.from_curated(lake.spark, f"{out}/curated", snapshot_date=lake.snapshot_date,
                            history_end=lake.history_end, history_months=lake.history_months, horizon=lake.horizon)
    write_together({at[d]: getattr(cur, d) for d in DIMS})
    for d in DIMS:
        cur.__dict__[d] = lake.spark.read.parquet(at[d])
    report = dq_report({n: getattr(cur, n) for n in ["fact_consumption", "fact_inventory", "fact_grn", "fact_po"]},
                       {d: getattr(cur, d) for d in ["dim_plant", "dim_material", "dim_vendor", "dim_costcenter"]},
                       cur.fact_consumption)
    report.coalesce(1).write.mode("overwrite").json(f"{out}/curated/_dq_report")
    return {"curated": f"{out}/curated"}


def build_kpis(spark: SparkSession, out: str, params: dict) -> dict:
    """Stage 2: KPI, forecast, sales and mart tables from the written curated layer."""
    out = out.rstrip("/")
    cur = Lake.from_curated(spark, f"{out}/curated", **params)
    for d in DIMS:
        cur.__dict__[d] = spark.read.parquet(f"{out}/curated/{d}")
    wh = Warehouse(cur)
    items = kpi.stock_items(cur.fact_inventory, cur.fact_consumption)
    matrix = fc.demand_matrix(cur.fact_consumption, cur.history_end, cur.history_months, spread=True)
    shared = {f"{out}/kpi/sales_aggregates": sales.sales_aggregates(cur.sales_line), f"{out}/work/stock_items": items,
              f"{out}/work/demand_matrix": matrix}
    write_together(shared, {f"{out}/kpi/sales_aggregates": ["grain"]})
    wh.sales = spark.read.parquet(f"{out}/kpi/sales_aggregates")
    wh.items = spark.read.schema(items.schema).parquet(f"{out}/work/stock_items")
    wh.matrix = spark.read.schema(matrix.schema).parquet(f"{out}/work/demand_matrix")
    names = KPI_TABLES + SALES_TABLES + MART_TABLES + FORECAST_TABLES
    first = [t for t in names if t not in LATER_TABLES]
    write_together({**{f"{out}/kpi/{t}": wh[t] for t in first}, f"{out}/kpi/demand_matrix": wh.matrix.drop("demand_std")})
    for t in first:
        wh._cache[t] = spark.read.parquet(f"{out}/kpi/{t}")
    write_together({f"{out}/kpi/{t}": wh[t] for t in LATER_TABLES})
    return {"kpi": f"{out}/kpi"}


def output_paths(out: str) -> dict[str, str]:
    """Folder of every table that a full build leaves behind."""
    out = out.rstrip("/")
    return {"line": f"{out}/work/line", **{t: f"{out}/curated/{t}" for t in [*FACT_PARTITIONS, *DIMS]},
            **{t: f"{out}/kpi/{t}" for t in KPI_TABLES + SALES_TABLES + MART_TABLES + FORECAST_TABLES}}


def build(spark: SparkSession, lake: Lake, out: str, stage: str = "all") -> dict:
    """SRC-15: ``stage`` = curated | kpi | all. Failures propagate (no swallowed stage).

    A full build of source tables is recorded in the manifest of ``out`` (plans.store), so that
    queries whose session names that folder read its tables.
    """
    timings, result = {}, {}
    catalogue = StoredWarehouse(lake, Store(spark, out)) if stage == "all" and lake.inputs and lake.line is not None else None
    if catalogue is not None:
        catalogue.take_back(list(output_paths(out).values()))
    params = dict(snapshot_date=lake.snapshot_date, history_end=lake.history_end,
                  history_months=lake.history_months, horizon=lake.horizon)
    if stage in ("curated", "all"):
        t0 = time.time()
        result.update(build_curated(lake, out))
        timings["curated_s"] = round(time.time() - t0, 2)
    if stage in ("kpi", "all"):
        t0 = time.time()
        result.update(build_kpis(spark, out, params))
        timings["kpi_s"] = round(time.time() - t0, 2)
    if catalogue is not None:
        catalogue.adopt(output_paths(out))
    result["timings"] = timings
    return result


def main(argv=None):
    import argparse

    from carelake.session import get_spark
    ap = argparse.ArgumentParser(description="carelake batch build")
    ap.add_argument("--testdata", required=True, help="driver table folder (sf dir)")
    ap.add_argument("--out", required=True, help="output folder (shared storage on a cluster)")
    ap.add_argument("--stage", default="all", choices=["curated", "kpi", "all"])
    a = ap.parse_args(argv)
    spark = get_spark()
    print(json.dumps(build(spark, Lake.from_testdata(spark, a.testdata), a.out, a.stage)))


if __name__ == "__main__":
    main()
