"""Landing-zone writers: curated frames -> raw extract files (headers as the ERP names them).

Used to exercise the raw loaders end to end on files that Spark derives from the given
tables: every column is written as text in the source system's format.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.functions.expr import SPREADSHEET_EPOCH
from carelake.session import open_writers
from carelake.sources.loaders import CONSUMPTION_COLUMNS, GRN_COLUMNS, INVENTORY_COLUMNS, PO_COLUMNS


def _as_raw(df: DataFrame, mapping: dict, date_fmt: dict | None = None, drop: tuple = ()) -> DataFrame:
    date_fmt = date_fmt or {}
    cols = []
    for k, cands in mapping.items():
        if k not in df.columns or cands[0] in drop:
            continue
        c = F.col(k)
        if k in date_fmt:
            c = F.date_format(c, date_fmt[k])
        cols.append(c.cast("string").alias(cands[0]))
    return df.select(*cols)


def write_csv(df: DataFrame, path: str, partition_by: str | None = None, packed: bool = False) -> str:
    """``packed``: gzip at its fastest level, which takes no longer than plain text and under half its space; a
    task's files are small, so it does not matter that they cannot be split."""
    w = df.write.mode("overwrite").option("header", True)
    if packed:
        w = w.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
    if partition_by:
        w = w.partitionBy(partition_by)
    with open_writers(df.sparkSession):
        w.csv(path)
    return path


def consumption_extract(fact: DataFrame) -> DataFrame:
    return _as_raw(fact, CONSUMPTION_COLUMNS)


def inventory_extract(fact: DataFrame) -> DataFrame:
    # the HSN column is absent from this extract: the loader must fall back to NULL
    return _as_raw(fact, INVENTORY_COLUMNS, drop=("HSN Code",))


def grn_extract(fact: DataFrame) -> DataFrame:
    """Monthly GRN files (partition column ``ym``)."""
    return _as_raw(fact.withColumn("ym", F.date_format("gr_date", "yyyy-MM")), {**GRN_COLUMNS, "ym": ["ym"]})


def po_extract(fact: DataFrame) -> DataFrame:
    """Monthly PO files with dd.MM.yyyy dates (partition column ``ym``)."""
    return _as_raw(fact.withColumn("ym", F.date_format("po_date", "yyyy-MM")), {**PO_COLUMNS, "ym": ["ym"]},
                   {"po_date": "dd.MM.yyyy", "delivery_date": "dd.MM.yyyy"})


# Sales files: IP files use the SALESDATE / MATERIALCODE... header family, OP files the
# BILLDATE / ITEMCODE... family; one extra file lacks the revenue column (must be skipped).
IP_HEADERS = {"date": "SALESDATE", "mat": "MATERIALCODE", "desc": "MATERIALLINEITEM", "qty": "QTY", "rev": "TOTALMRP",
              "cost": "TOTALCOSTPRICE", "mfr": "MANUFACTURERNAME", "inv": "SALESINVOICENO", "loc": "LOCATIONNAME"}
OP_HEADERS = {"date": "BILLDATE", "mat": "ITEMCODE", "desc": "ITEMNAME", "qty": "QTY", "rev": "TOTALMRP",
              "cost": "TOTALCOSTPRICE", "mfr": "MANUFACTURERNAME", "inv": "BILLNO", "loc": "STORENAME"}


def sales_extract(sales_line: DataFrame, headers: dict, date_fmt: str) -> DataFrame:
    """Sales lines as a raw file: invoice = '<hospital>-<n>', location = hospital name in lower case."""
    return sales_line.select(
        F.date_format("sale_date", date_fmt).alias(headers["date"]),
        F.concat(F.col("material"), F.lit(".0")).alias(headers["mat"]),       # drifting key format ('x.0')
        F.col("material_desc").alias(headers["desc"]), F.col("qty").cast("string").alias(headers["qty"]),
        F.col("revenue").cast("string").alias(headers["rev"]), F.col("cost").cast("string").alias(headers["cost"]),
        F.lower("manufacturer").alias(headers["mfr"]),
        F.concat(F.lower("hospital"), F.lit("-"), F.monotonically_increasing_id().cast("string")).alias(headers["inv"]),
        F.lower("hospital").alias(headers["loc"]),
        F.date_format("sale_date", "yyyy-MM").alias("ym"))


def mixed_dates(df: DataFrame, mapping: dict, spoilt: dict | None = None) -> DataFrame:
    """An extract whose dates come in four forms, row by row: ISO, month-first with slashes, dotted,
    spreadsheet serial. ``spoilt``: date column -> rows whose text is no date."""
    turn = F.pmod(F.xxhash64(*df.columns), F.lit(4))
    dates = {k for k in mapping if k.endswith("_date") and k in df.columns}
    forms = {k: (F.when(turn == 0, F.date_format(k, "yyyy-MM-dd")).when(turn == 1, F.date_format(k, "MM/dd/yyyy"))
                  .when(turn == 2, F.date_format(k, "dd.MM.yyyy")).otherwise(F.date_diff(F.col(k), F.lit(SPREADSHEET_EPOCH).cast("date")).cast("string")))
             for k in dates}
    for k, bad in (spoilt or {}).items():
        forms[k] = F.when(bad, F.lit("n/a")).otherwise(forms[k])
    return _as_raw(df.select(*[forms[c].alias(c) if c in dates else F.col(c) for c in df.columns]), mapping)


def card_extract(monthly: DataFrame, key: str) -> DataFrame:
    """A card file: one row per key, one column per financial year (April to March)."""
    start = F.when(F.col("month_num") >= 4, F.col("year")).otherwise(F.col("year") - 1)
    period = F.concat(start.cast("string"), F.lit("-"), (start + 1).cast("string"))
    return monthly.withColumn("_period", period).groupBy(F.col(key).alias("Location")).pivot("_period").agg(F.sum("value"))
