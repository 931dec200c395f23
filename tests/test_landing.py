"""Listing, headers, audit, mixed dates and card files of a landing zone."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from carelake.operators import insights_consumption as ic
from carelake.operators import sales
from carelake.sources import headers, loaders

IP = "SALESDATE,MATERIALCODE,MATERIALLINEITEM,QTY,TOTALMRP,TOTALCOSTPRICE,MANUFACTURERNAME,SALESINVOICENO,LOCATIONNAME\n"
OP = "BILLDATE,ITEMCODE,ITEMNAME,QTY,TOTALMRP,TOTALCOSTPRICE,BILLNO,STORENAME\n"
WINDOW = (dt.date(2026, 5, 1), dt.date(2026, 5, 31))


@pytest.fixture
def zone(tmp_path):
    files = {"IP Sales/a+b c.csv": IP + "2026-05-31,1,A,1,10,5,m,h-1,X\n2025-01-01,1,A,1,10,5,m,h-1,X\n",
             "IP Sales/2026/%20.csv": "﻿" + IP + "05/30/2026,2,B,1,20,5,m,h-1,X\n",
             "OP Sales/c.csv": OP + "31.05.2026,3,C,1,30,5,h-2,Y\n", "OP Sales/d.csv": '"BILLDATE", ITEMCODE ,QTY,"TOTAL,MRP"\n31.05.2026,3,1,1\n',
             "OP Sales/none.csv": OP, "OP Sales/zero.csv": "", "OP Sales/_hidden.csv": OP, "OP Sales/note.txt": "x"}
    for name, text in files.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text, encoding="utf-8")
    return str(tmp_path)


def test_every_landed_file_has_an_audit_row(spark, zone):
    folders = loaders.sales_folders(zone)
    raw, skipped = sales.read_sales_files(spark, folders)
    assert [s.rsplit("/", 1)[-1] for s in skipped] == ["d.csv"]
    got = {r["source"]: tuple(r)[2:] for r in sales.landed_file_audit(spark, folders, raw, WINDOW).collect()}
    assert got == {"a+b c.csv": ("read", None, 2, 1), "%20.csv": ("read", None, 1, 1), "c.csv": ("read", None, 1, 1),
                   "d.csv": ("skipped", "lacks rev, cost", 0, 0), "none.csv": ("empty", "no rows", 0, 0),
                   "zero.csv": ("empty", "no header", 0, 0)}
    lines = sorted((r["material"], r["patient_type"], float(r["revenue"])) for r in sales.canonical_sales_lines(raw, WINDOW).collect())
    assert lines == [("1", "IP", 10.0), ("2", "IP", 20.0), ("3", "OP", 30.0)]


def test_headers_are_split_and_cleaned(spark, zone):
    got = {r["path"].rsplit("/", 1)[-1]: r["header"] for r in headers.headers(spark, loaders.sales_folders(zone)).collect()}
    assert got["d.csv"] == ["BILLDATE", "ITEMCODE", "QTY", "TOTAL,MRP"] and got["%20.csv"][0] == "SALESDATE" and "zero.csv" not in got
    assert headers._names(["a", "", "A", "b"]) == ["a", "_1", "A_2", "b"]
    assert headers.list_landed(spark, {"IP": [zone + "/nowhere"]}).count() == 0


def jobs(spark, name, work):
    sc = spark.sparkContext
    sc.setJobGroup(name, name)
    try:
        work()
        return len(sc.statusTracker().getJobIdsForGroup(name))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_jobs_do_not_follow_the_number_of_files(spark, tmp_path):
    counts = []
    for n in (40, 120):
        d = tmp_path / f"n{n}"
        (d / "IP Sales").mkdir(parents=True)
        for i in range(n):
            (d / "IP Sales" / f"{i}.csv").write_text((IP if i % 2 else IP.replace("QTY", " QTY ")) + "2026-05-31,1,A,1,10,5,m,h-1,X\n")
        read = []
        counts.append(jobs(spark, f"read-{n}", lambda d=d, read=read: read.append(
            sales.read_sales_files(spark, {"IP": [f"{d}/IP Sales"]})[0])))
        assert read[0].count() == n
    assert counts[0] == counts[1] <= 5      # a folder of over 32 files is listed by a job of its own


def test_dates_in_any_form_and_rejects(spark, tmp_path):
    head = "Material,Plnt,SLoc,MvT,Cost Ctr,Quantity,Amount in LC,EUn,Pstng Date\n"
    dates = ["2026-05-31", "05/31/2026", "31.05.2026", "46173", "2026-05-31 10:30:00", "46173.5", "", "soon", "31/31/2026"]
    p = tmp_path / "c.csv"
    p.write_text(head + "".join(f"1,P,S,201,C,1,2,EA,{d}\n" for d in dates))
    raw = loaders.read_raw(spark, str(p))
    assert [r["posting_date"] for r in loaders.load_consumption(raw).collect()] == [dt.date(2026, 5, 31)] * 6
    assert loaders.date_rejects(raw, loaders.CONSUMPTION_COLUMNS).collect() == [("posting_date", 8, 2)]


def test_card_files_with_other_years(spark, tmp_path):
    p = tmp_path / "card.csv"
    p.write_text("Location,2023-2024,Note,2024-2025,March 2025 Revenue\nA,10,x,15,7\nB,,y,4,\nC,0,z,5,1\n")
    long = loaders.read_card(spark, str(p), ["Location"])
    assert long.count() == 9 and long.where("value is null").count() == 2
    years = long.where(F.col("period").rlike(r"^\d{4}-"))
    got = {r["location"]: tuple(r)[1:] for r in ic.period_card(years).collect()}
    assert got == {"A": ("2024-2025", 15.0, 10.0, 50.0), "B": ("2024-2025", 4.0, None, None), "C": ("2024-2025", 5.0, 0.0, None)}
    with pytest.raises(ValueError):
        headers.unpivot_periods(long.select("Location"), ["Location"], r"^\d{4}$")


def test_receipts_are_landed_packed_and_load_as_from_plain_files(spark, tmp_path):
    from glob import glob

    from carelake.sources import landing
    months = ["2026-01-31", "2026-02-28", "2026-02-01", None]
    rows = [(f" P{i} ", "S1.0", "100.0" if i % 3 else None, "a, \"b\"", f"V{i}", "Vendor", f"PO{i}", f"{i}-1.0", "2.5000", "1.5", "-1", "", "x",
             "12.7", "soon", None, "t", d, d, "05/30/2026") for i, d in enumerate(months)]
    names = list(loaders.GRN_COLUMNS)
    raw = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)).select(
        *[F.col(n).alias(loaders.GRN_COLUMNS[n][0]) for n in names], F.substring("gr_date", 1, 7).alias("ym"))
    got = {}
    for packed in (False, True):
        path = landing.write_csv(raw, str(tmp_path / str(packed)), "ym", packed)
        assert len(glob(f"{path}/ym=2026-0*/*.csv{'.gz' if packed else ''}")) >= 2
        got[packed] = sorted(map(str, loaders.load_grn(loaders.read_raw(spark, path)).collect()))
    assert got[True] == got[False] and len(got[True]) == 4
    first = next(r for r in loaders.load_grn(loaders.read_raw(spark, str(tmp_path / "True"))).collect() if r["po_no"] == "PO1")
    assert (first["plant"], first["sloc"], first["material"], first["gr_no"], first["material_desc"]) == ("P1", "S1", "100", "1-1", 'a, "b"')
    assert (str(first["gr_qty"]), str(first["base_price"]), str(first["net_price"])) == ("2.5000", "1.500000", "-1.000000")
    assert (first["unit_mrp"], first["total_amount_wo_tax"], first["po_to_gr_tat"], first["pr_to_gr_tat"], first["major_group"]) == (None, None, 12, None, None)
    undated = next(r for r in loaders.load_grn(loaders.read_raw(spark, str(tmp_path / "True"))).collect() if r["po_no"] == "PO3")
    assert (undated["gr_date"], undated["year"], undated["month_num"], undated["month"]) == (None, None, None, None)
    assert (first["gr_date"], first["month"], first["expiry_date"]) == (dt.date(2026, 2, 28), "February", dt.date(2026, 5, 30))


def test_files_by_value_are_written_without_a_sort_and_the_setting_is_put_back(spark, tmp_path):
    from carelake.session import open_writers
    from carelake.sources import landing
    key = "spark.sql.maxConcurrentOutputFileWriters"
    was = spark.conf.get(key, None)
    with open_writers(spark, 7):
        assert spark.conf.get(key) == "7"
    landing.write_csv(spark.range(20).selectExpr("id", "string(id % 5) AS ym"), str(tmp_path / "zone"), "ym")
    assert spark.conf.get(key, None) == was
    read = spark.read.option("header", True).csv(str(tmp_path / "zone"))
    assert sorted((int(r["id"]), r["ym"]) for r in read.collect()) == [(i, i % 5) for i in range(20)]


def test_the_receipts_loader_is_short_enough_to_be_compiled(spark, tmp_path, capsys):
    import re
    raw = spark.createDataFrame([tuple("x" for _ in loaders.GRN_COLUMNS)], ", ".join(f"c{i} string" for i in range(len(loaders.GRN_COLUMNS))))
    raw.toDF(*[v[0] for v in loaders.GRN_COLUMNS.values()]).write.option("header", True).csv(str(tmp_path / "raw"))
    loaders.load_grn(loaders.read_raw(spark, str(tmp_path / "raw"))).explain("codegen")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000      # a longer method is interpreted
