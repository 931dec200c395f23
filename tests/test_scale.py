"""What a task holds and what a plan costs, where a finding asked for it."""
import datetime
import re
from decimal import Decimal

from carelake.operators import forecast as fc

END = datetime.date(2001, 5, 1)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_demand_matrix_holds_two_exact_sums_a_group(spark):
    rows = [("P1", "1", 2001, 5, Decimal("2.50"), Decimal("10.000001")), ("P1", "1", 2001, 5, Decimal("1.00"), Decimal("0.000002")),
            ("P1", "1", 2000, 12, Decimal("4.00"), None), ("P1", "1", 1995, 1, Decimal("9.00"), Decimal("9.0")),
            ("P1", "2", 1995, 1, Decimal("9.00"), Decimal("9.0")), ("P1", "3", None, 5, Decimal("9.00"), Decimal("9.0")),
            (None, "1", 2001, 5, Decimal("9.00"), Decimal("9.0")), ("P1", None, 2001, 5, Decimal("9.00"), Decimal("9.0"))]
    cons = spark.createDataFrame(rows, "plant string, material string, year int, month_num int, qty decimal(12,2), amount_lc decimal(24,6)")
    m = fc.demand_matrix(cons, END)
    got = {r["material"]: r for r in m.collect()}
    assert set(got) == {"1", "2", "3"}
    assert [got["1"][f"q_{k}"] for k in range(6)] == [4.0, 0, 0, 0, 0, 3.5]
    assert [got["1"][f"v_{k}"] for k in range(6)] == [0, 0, 0, 0, 0, 10.000003]
    assert not any(got[x][f"{p}_{k}"] for x in ("2", "3") for p in "qv" for k in range(6))
    spread = fc.demand_matrix(cons, END, spread=True)
    assert sorted(map(tuple, spread.drop("demand_std").collect())) == sorted(map(tuple, m.collect()))
    sums = [len(re.findall(r"\bsum\(", line)) for line in _plan(m).splitlines() if "Aggregate" in line]
    assert sums and max(sums) <= 2
    # only the lines of the history are summed; every key comes from one pass that sums nothing
    assert any("Filter" in line and "year" in line and ">= 0" in line for line in _plan(m).splitlines())


def test_replenishment_takes_the_deviation_that_a_written_matrix_holds(spark):
    cons = spark.createDataFrame([("P1", "1", 2001, 5, Decimal("2.50"), Decimal("10.0")), ("P1", "1", 1995, 1, Decimal("9.50"), Decimal("9.0")),
                                  ("P2", "2", 1995, 1, Decimal("9.00"), Decimal("9.0"))],
                                 "plant string, material string, year int, month_num int, qty decimal(12,2), amount_lc decimal(24,6)")
    inv = spark.createDataFrame([("P1", "1", Decimal("1.00"), Decimal("2.0"), 3, Decimal("4.0"))],
                                "plant string, material string, qty decimal(12,2), total_cost decimal(24,6), aging_days int, moving_avg_price decimal(18,4)")
    grn = spark.createDataFrame([("1", 9)], "material string, po_to_gr_tat int")
    dim = spark.createDataFrame([("1", "one", "g")], "material string, material_desc string, material_group string")
    make = lambda matrix: fc.replenishment(inv, cons, grn, dim, END, matrix=matrix)
    want = sorted(map(str, make(None).collect()))
    for spread in (False, True):
        assert sorted(map(str, make(fc.demand_matrix(cons, END, spread=spread)).collect())) == want
    assert {r["plant"]: r["demand_std"] for r in make(None).collect()} == {"P1": 3.5, "P2": 0.0}
    held = fc.demand_matrix(cons, END, spread=True)
    assert _plan(make(held)).count("stddev_pop") == _plan(held).count("stddev_pop")      # not made a second time
