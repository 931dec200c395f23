"""Plan guards for every registered query: no cartesian products or nested-loop joins
(the scale rule: no cross joins, no all-pairs), and pushed filters reach the scans."""
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

# queries that execute jobs while being constructed (landing writes, streams) are planned too,
# they simply take longer; the guard applies to the returned frame
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# the full sweep over every query is scripts/plan_guard.py; the suite checks the operators
# most at risk (grids, scalar-subquery summaries, pair-like recipes, top-N folds, cosine)
GUARDED = ["purchase_month_matrix", "margin_month_matrix", "units_month_matrix", "department_month_matrix",
           "dashboard_summary", "procurement_totals", "sql_redistribution", "sql_received_vs_ordered",
           "top_n_other", "cosine_topk", "vendor_pareto", "cat_overview", "risk_matrix", "expiry_ladder"]


def test_no_cross_join_in_guarded_queries(spark):
    bad = []
    for name in GUARDED:
        fn = E.queries()[name]
        plan = _plan(fn(spark, SF_SMALL))
        if any(f in plan for f in FORBIDDEN):
            bad.append(name)
    assert bad == []


@pytest.mark.parametrize("name,pushed", [("kpi_inventory_aging", "EqualTo(l_linestatus,O)"),
                                         ("fact_consumption", "Not(EqualTo(l_returnflag,R))"),
                                         ("sales_monthly", "GreaterThanOrEqual(l_shipdate")])
def test_filters_reach_parquet_scan(spark, name, pushed):
    import contextlib
    import io
    df = E.queries()[name](spark, SF_SMALL)
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")          # formatted explain lists each scan's PushedFilters in full
    assert pushed in buf.getvalue()
