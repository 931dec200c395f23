"""SRC-09: table lookup over the curated, KPI, forecast, sales and mart layers.

``Warehouse(lake)[name]`` builds the named table lazily (a DataFrame, not data); the
pipeline writes the same names to parquet, and ``register_views`` exposes them to SQL.
"""
from __future__ import annotations

from collections.abc import Mapping

from carelake.operators import forecast as fc
from carelake.operators import kpi, marts, sales


class Warehouse(Mapping):
    def __init__(self, lake):
        self.lake = lake
        self._cache = {}
        l = lake
        self.matrix = None         # the demand matrix, when a build has written it
        self.items = None          # the stock items and their consumption, when a build has written them
        rep = lambda: fc.replenishment(l.fact_inventory, l.fact_consumption, l.fact_grn, l.dim_material,
                                       l.history_end, l.history_months, l.horizon, matrix=self.matrix)
        matrix = lambda: (self.matrix if self.matrix is not None
                          else fc.demand_matrix(l.fact_consumption, l.history_end, l.history_months))
        self.sales = None          # all grains, when a build has written them
        agg = lambda g: self.sales if self.sales is not None else sales.grain_aggregate(l.sales_line, g)
        self._builders = {
            "fact_consumption": lambda: l.fact_consumption, "fact_inventory": lambda: l.fact_inventory,
            "fact_grn": lambda: l.fact_grn, "fact_po": lambda: l.fact_po, "sales_line": lambda: l.sales_line,
            "dim_plant": lambda: l.dim_plant, "dim_material": lambda: l.dim_material, "dim_sloc": lambda: l.dim_sloc,
            "dim_vendor": lambda: l.dim_vendor, "dim_costcenter": lambda: l.dim_costcenter,
            "kpi_stock_value": lambda: kpi.kpi_stock_value(l.fact_inventory, self.items),
            "kpi_aging_distribution": lambda: kpi.kpi_aging_distribution(l.fact_inventory),
            "kpi_inventory_aging": lambda: kpi.kpi_inventory_aging(l.fact_inventory, l.fact_consumption, l.snapshot_col,
                                                                   self.items),
            "kpi_doh": lambda: kpi.kpi_doh(l.fact_inventory, l.fact_consumption, self.items),
            "kpi_health_score": lambda: kpi.kpi_health_score(l.fact_inventory, l.fact_consumption, self.items),
            "kpi_non_moving": lambda: kpi.kpi_non_moving(l.fact_inventory, l.fact_consumption, l.snapshot_col,
                                                         self["kpi_inventory_aging"]),
            "kpi_risk_classification": lambda: kpi.kpi_risk_classification(l.fact_inventory, l.fact_consumption, l.snapshot_col,
                                                                           self["kpi_inventory_aging"]),
            "kpi_near_expiry": lambda: kpi.kpi_near_expiry(l.fact_inventory, l.snapshot_col),
            "kpi_stock_change": lambda: kpi.kpi_stock_change(l.fact_grn, l.fact_consumption, l.dim_material),
            "kpi_stock_change_by_group": lambda: kpi.kpi_stock_change_by_group(self["kpi_stock_change"]),
            "kpi_purchase_value": lambda: kpi.kpi_purchase_value(l.fact_po),
            "kpi_monthly_purchase_value": lambda: kpi.kpi_monthly_purchase_value(l.fact_po, l.dim_material),
            "kpi_procurement_variance": lambda: kpi.kpi_procurement_variance(l.fact_po),
            "kpi_vendor_volume": lambda: kpi.kpi_vendor_volume(l.fact_po),
            "kpi_purchase_by_location": lambda: kpi.kpi_purchase_by_location(l.fact_po),
            "kpi_units_consumed": lambda: kpi.kpi_units_consumed(l.fact_consumption, l.dim_material),
            "kpi_consumption_by_department": lambda: kpi.kpi_consumption_by_department(l.fact_consumption,
                                                                                     l.dim_costcenter),
            "kpi_cycle_time": lambda: kpi.kpi_cycle_time(l.fact_grn),
            "kpi_vendor_lead_time": lambda: kpi.kpi_vendor_lead_time(l.fact_grn),
            "kpi_fill_rate": lambda: kpi.kpi_fill_rate(l.fact_po),
            "forecast_sales": lambda: fc.forecast_sales(matrix(), l.dim_material, l.history_end, l.history_months,
                                                        l.horizon),
            "stock_replenishment_and_aging_risk": rep,
            "kpi_fulfillment": lambda: fc.kpi_fulfillment(self["stock_replenishment_and_aging_risk"]),
            "kpi_stock_radar": lambda: fc.kpi_stock_radar(self["stock_replenishment_and_aging_risk"], l.horizon),
            "kpi_aging_risk_forecast": lambda: fc.kpi_aging_risk_forecast(self["stock_replenishment_and_aging_risk"]),
            "forecast_accuracy": lambda: fc.forecast_accuracy(matrix(), l.dim_material, l.history_months),
            "mart_material_price_stats": lambda: marts.material_price_stats(l.fact_grn, l.dim_material),
            "mart_material_vendor_price_stats": lambda: marts.material_vendor_price_stats(l.fact_grn, l.dim_material),
            "mart_procurement": lambda: marts.mart_procurement(l.fact_grn, l.dim_material,
                                                               self["mart_material_price_stats"],
                                                               self["kpi_vendor_lead_time"]),
        }
        for g in sales.GRAINS:
            self._builders[g] = (lambda _g=g: sales.sales_grain(agg(_g), _g, l.dim_material))

    def __getitem__(self, name):
        if name not in self._cache:
            self._cache[name] = self._builders[name]()
        return self._cache[name]

    def __iter__(self):
        return iter(self._builders)

    def __len__(self):
        return len(self._builders)
