"""Unit tests for COL-* boundaries and the N1-N10 missing-value rules."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from carelake.functions import expr as X


def one(spark, col, value, dtype):
    if dtype == "double" and isinstance(value, int):
        value = float(value)
    return spark.createDataFrame([(value,)], f"x {dtype}").select(col.alias("r")).first()["r"]


@pytest.mark.parametrize("days,label", [(-2, None), (-1, None), (0, "0-30"), (30, "0-30"), (30.5, "31-90"),
                                        (31, "31-90"), (90, "31-90"), (180, "91-180"), (365, "181-365"),
                                        (365.1, "365+"), (None, None)])
def test_aging_bucket_right_closed(spark, days, label):
    assert one(spark, X.aging_bucket("x"), days, "double") == label


@pytest.mark.parametrize("days,label", [(-5, "Expired"), (0, "Expired"), (1, "0-30d"), (30, "0-30d"), (31, "31-90d"),
                                        (180, "91-180d"), (181, "nan")])
def test_near_expiry_day_zero_is_expired(spark, days, label):
    assert one(spark, X.near_expiry_bucket("x"), days, "int") == label


@pytest.mark.parametrize("days,label", [(-1, "Expired"), (0, "0-30d"), (30, "0-30d"), (366, "365d+"), (None, None)])
def test_expiry_slab_day_zero_not_expired(spark, days, label):
    assert one(spark, X.expiry_slab("x"), days, "int") == label


@pytest.mark.parametrize("s,t", [("J&j", "J&J"), ("o'neil", "O'Neil"), ("brand#12", "Brand#12"), ("3rd kind", "3Rd Kind"),
                                 (None, None)])
def test_title_case_restarts_after_non_letters(spark, s, t):
    assert one(spark, X.title_case("x"), s, "string") == t


@pytest.mark.parametrize("s,d", [("2026-05-31 00:00:00", dt.date(2026, 5, 31)), ("2026-05-31T08:00:00", dt.date(2026, 5, 31)),
                                 ("2026-05-31", dt.date(2026, 5, 31)), ("31/05/2026", None)])
def test_loader_dates_may_carry_a_time(spark, s, d):
    assert one(spark, X.parse_fixed_date("x", "yyyy-MM-dd"), s, "string") == d


def test_title_case_keeps_accented_words_whole(spark):
    assert one(spark, X.title_case("x"), "éCLAIR d'ÉTÉ", "string") == "Éclair D'Été"


def test_capex_types_are_a_parameter(spark):
    df = spark.createDataFrame([("Service PO", "m"), ("1-URGENT", "m"), ("x", None)], "t string, m string")
    assert [r[0] for r in df.select(X.is_capex("t", "m")).collect()] == [True, False, True]
    assert [r[0] for r in df.select(X.is_capex("t", "m", ["1-URGENT"])).collect()] == [False, True, True]


@pytest.mark.parametrize("s,t", [("100301.0", "100301"), (" 100301 ", "100301"), ("218766", "218766"), (None, None)])
def test_normalize_id(spark, s, t):
    assert one(spark, X.normalize_id("x"), s, "string") == t


@pytest.mark.parametrize("s,d", [("31.05.2026", dt.date(2026, 5, 31)), ("2026-05-31 10:00:00", dt.date(2026, 5, 31)),
                                 ("46173", dt.date(2026, 5, 31)), ("46173.5", dt.date(2026, 5, 31)), ("05/06/2026", dt.date(2026, 5, 6)),
                                 ("05/31/2026", dt.date(2026, 5, 31)), ("31.05.2026 10:00:00", dt.date(2026, 5, 31)),
                                 ("not a date", None), (None, None)])
def test_parse_any_date_and_serial(spark, s, d):
    assert one(spark, X.parse_any_date("x"), s, "string") == d


@pytest.mark.parametrize("s,t", [("M065-INJECTIONS", "Injections"), ("nan", "Uncategorised"), (None, "Uncategorised"),
                                 ("", "Uncategorised"), ("tablets", "Tablets")])
def test_clean_category(spark, s, t):
    assert one(spark, X.clean_category("x"), s, "string") == t


def test_hospital_code(spark):
    df = spark.createDataFrame([("hm04-123", "x"), ("NOPREFIX", "Loc A"), (None, None)], "inv string, loc string")
    got = [r[0] for r in df.select(X.hospital_code("inv", "loc")).collect()]
    assert got == ["HM04", "LOC A", "UNKNOWN"]


def test_round_half_even(spark):
    assert one(spark, X.round_half_even("x", 1), 2.25, "double") == 2.2
    assert one(spark, F.round(F.col("x"), 1), 2.25, "double") == 2.3


def test_safe_div_never_raises_under_ansi(spark):
    assert one(spark, X.safe_div(F.lit(5), F.col("x")), 0, "int") is None
    assert one(spark, X.safe_div(F.lit(5), F.col("x"), 0.0), 0, "int") == 0.0


@pytest.mark.parametrize("score,tier", [(40.0, "At Risk"), (40.1, "Watch"), (70.0, "Watch"), (70.1, "Healthy"),
                                        (-1.0, "nan")])
def test_health_tiers(spark, score, tier):
    assert one(spark, X.health_tier("x"), score, "double") == tier


def test_risk_level_null_expiry_falls_through(spark):
    df = spark.createDataFrame([(None, 10.0, True), (None, 10.0, False), (50, 10.0, True), (None, 200.0, True)],
                               "dte int, age double, consumed boolean")
    got = [r[0] for r in df.select(X.risk_level("dte", "age", "consumed")).collect()]
    assert got == ["Low", "High", "High", "Medium"]


def test_reorder_status_order(spark):
    rows = [(0.0, 5.0, 5.0, 5.0, 0.0), (10.0, 0.0, 0.0, 0.0, 400.0), (1.0, 5.0, 5.0, 4.0, 0.0),
            (100.0, 1.0, 1.0, 0.0, 0.0), (5.0, 3.0, 3.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "s double, df double, dm double, r double, a double")
    got = [r[0] for r in df.select(X.reorder_status("s", "df", "dm", "r", "a")).collect()]
    assert got == ["Stock-out", "Dead stock", "Reorder now", "Overstocked", "Healthy"]


def test_ip_op_class(spark):
    df = spark.createDataFrame([("IP PHARMACY",), ("IP/OP STORE",), ("OT STORE",), ("MAIN STORE",), (None,)], "d string")
    assert [r[0] for r in df.select(X.ip_op_class("d")).collect()] == ["IP", "IP/OP", "OT", "OTHER", "OTHER"]


def test_month_index_unknown_last(spark):
    assert one(spark, X.month_index("x"), "March", "string") == 2
    assert one(spark, X.month_index("x"), "Smarch", "string") == 13
