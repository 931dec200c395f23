"""Distributed selection against ``percentile``: ties across bucket edges, signs, infinities, empty keys."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from carelake.operators import cookbook, generic, insights_extra, insights_inventory
from carelake.operators.order_stats import magnitude, median, quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
RNG = np.random.default_rng(11)
EDGE = [2.0 ** (k / 64) for k in range(-3, 4)]      # values on the edges of magnitude buckets
SETS = {
    "one": [4.5], "two": [1.0, 2.0], "ties": [3.0] * 500 + [3.0000001] * 500, "edges": sorted(EDGE * 40),
    "across": [np.nextafter(2.0, 0)] * 7 + [2.0] * 7 + [np.nextafter(2.0, 3)] * 6, "signs": list(RNG.normal(size=999)),
    "zeros": [0.0] * 10 + [-0.0] * 5 + [-1e-300, 1e-300], "narrow": list(RNG.uniform(100, 100.5, 4001)),
    "wide": list(10.0 ** RNG.uniform(-200, 200, 1000)), "inf": [float("-inf")] * 3 + [1.0] * 3 + [float("inf")] * 4, "none": [None, None]}


def test_quantiles_equal_percentile(spark):
    df = spark.createDataFrame([(k, None if v is None else float(v)) for k, vs in SETS.items() for v in vs], "k string, v double").repartition(5)
    want = {}
    for r in df.groupBy("k").agg(*[F.percentile("v", p).alias(f"p{i}") for i, p in enumerate(PROBS)]).collect():
        want.update({(r["k"], p): r[f"p{i}"] for i, p in enumerate(PROBS) if r[f"p{i}"] is not None})
    got = {(r["k"], r["p"]): r["value"] for r in quantiles(df, ["k"], F.col("v"), PROBS).collect()}
    assert got == want
    assert {k for k, _ in got} == set(SETS) - {"none"}


def test_median_of_a_whole_table_is_a_scalar(spark):
    df = spark.createDataFrame([(float(x),) for x in (5, 1, 4, 2)] + [(None,)], "v double")
    row = spark.range(1).select(median(df, F.col("v")).alias("m"), median(df.where("v > 9"), F.col("v")).alias("none")).first()
    assert (row["m"], row["none"]) == (3.0, None)


def test_magnitude_never_falls(spark):
    vs = sorted({*EDGE, *[-x for x in EDGE], 0.0, 1e-308, 1e308, *RNG.normal(size=200).tolist(), float("inf"), float("-inf")})
    out = [r[0] for r in spark.createDataFrame([(v,) for v in vs], "v double").coalesce(1).select(magnitude(F.col("v"))).collect()]
    assert out == sorted(out)


@pytest.mark.parametrize("name", ["doh", "health", "tiers", "summarize", "median_doh"])
def test_no_whole_table_percentile_in_the_plan(lake, name):
    from carelake.plans.warehouse import Warehouse
    w = Warehouse(lake)
    df = {"doh": lambda: insights_extra.doh_totals(insights_inventory._doh_frame(w["kpi_doh"], w["kpi_stock_value"], None)), "health": lambda: insights_extra.health_totals(w["kpi_health_score"]),
          "tiers": lambda: insights_inventory.health_tiers(w["kpi_health_score"]), "summarize": lambda: generic.summarize(w["kpi_stock_value"]),
          "median_doh": lambda: cookbook.median_doh(w["kpi_doh"])}[name]()
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "median(" not in plan and "percentile(" not in plan


def test_levels_read_one_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 97).cast("double").alias("v"), (F.col("id") % 3).alias("k"))
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")      # else reuse shows only at run time
    try:
        plan = quantiles(df, ["k"], F.col("v"), [0.5])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert plan.count("ReusedExchange") >= 2


def test_with_median_is_percentile_of_the_counted_rows(spark):
    from carelake.operators.order_stats import with_median
    rows = [("a", 1.0, 2), ("a", 3.0, 1), ("a", 9.0, 1), ("b", 7.0, 1), ("b", 8.0, 0), ("c", 0.1, 1), ("c", 0.2, 1), ("d", 5.0, 0)]
    df = spark.createDataFrame(rows, "k string, v double, n bigint")
    got = {(r["k"], r["v"]): r["m"] for r in with_median(df, ["k"], "v", F.col("n"), "m").collect()}
    want = {r["k"]: r["m"] for r in df.groupBy("k").agg(F.percentile("v", F.lit(0.5), F.col("n")).alias("m")).collect()}
    assert got == {(k, v): want[k] for k, v, _ in rows}


def test_price_marts_clean_twice_and_move_the_prices_once(spark):
    from decimal import Decimal

    from carelake.operators import marts
    prices = {("1", "V"): [10, 11, 11, 12, 90, 2000], ("1", "W"): [20, 30], ("2", "V"): [15], ("3", None): [40, 50], (None, "V"): [60]}
    rows = [(m, v, Decimal(p), Decimal(2), Decimal(2 * p)) for (m, v), ps in prices.items() for p in ps] + [("4", "V", Decimal(5), Decimal(1), Decimal(5))]
    grn = spark.createDataFrame(rows, "material string, vendor_name string, net_price decimal(18,4), gr_qty decimal(12,2), total_amount_wo_tax decimal(24,6)")
    dm = spark.createDataFrame([("1", "one", "g")], "material string, material_desc string, material_group string")
    pairs = marts.material_vendor_price_stats(grn, dm)
    got = {(r["material"], r["vendor_name"]): (r["clean_median_price"], r["clean_n"], r["total_qty"]) for r in pairs.collect()}
    assert got == {("1", "V"): (11.0, 5, 10.0), ("1", "W"): (25.0, 2, 4.0), ("2", "V"): (15.0, 1, 2.0)}
    items = marts.material_price_stats(grn, dm)
    got = {r["material"]: (r["clean_median_price"], r["clean_n"], r["raw_n"], r["raw_max_price"], r["clean_max_price"]) for r in items.collect()}
    assert got == {"1": (12.0, 7, 8, 2000.0, 90.0), "2": (15.0, 1, 1, 15.0, 15.0), "3": (45.0, 2, 2, 50.0, 50.0)}
    for df in (pairs, items):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile" not in plan and plan.count("Join") == 1      # the join of the material's name
