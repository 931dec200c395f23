"""SRC-01..07: loaders for raw ERP extracts (CSV or parquet landing zone).

Each loader is ``select`` of typed, trimmed columns over a multi-file read: headers
are normalised (SRC-06), alternates fall back to NULL when absent (SRC-02), monthly
files are unioned by name (SRC-03/04), and values never raise (N1: ``try_cast`` /
``try_to_timestamp``). Dates may come in any form, also mixed in one column (text, with
slashes, dotted, spreadsheet serials); ``date_rejects`` counts what fits none.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carelake.functions.expr import calendar_columns, date_part, normalize_id, parse_any_date, parse_fixed_date
from carelake.sources.headers import list_landed, read_by_header, unpivot_periods

QTY = "decimal(18,4)"
MONEY = "decimal(24,6)"

# Raw extract headers (logical name -> candidate headers, first present wins).
CONSUMPTION_COLUMNS = {
    "material": ["Material"], "material_desc": ["Material Description"], "plant": ["Plnt"], "sloc": ["SLoc"],
    "mvt": ["MvT"], "cost_ctr": ["Cost Ctr"], "qty": ["Quantity"], "amount_lc": ["Amount in LC"], "uom": ["EUn"],
    "posting_date": ["Pstng Date"],
}
INVENTORY_COLUMNS = {
    "plant": ["Plant"], "sloc": ["Storage Location"], "sloc_desc": ["Storage Location Description", "Storage Location Desc"],
    "material": ["Material"], "material_desc": ["Material Desc", "Material Description"], "hsn": ["HSN Code"],
    "batch": ["Batch"], "qty": ["Quantity"], "uom": ["Basic UOM"], "total_cost": ["Total Cost"], "total_mrp": ["Total MRP"],
    "moving_avg_price": ["Moving Average Price(Unit)"], "aging_days": ["Aging"],
    "manufacturer_desc": ["Manufacturer Description"], "generic_name": ["Generic Name"], "formulary": ["Formulary"],
    "material_type": ["Material Type"], "material_group": ["Material Group"],
    "major_group_desc": ["Major Group Description"], "minor_group_desc": ["Minor Group Description"],
    "expiry_date": ["Expiry Date"], "grn_date": ["GRN Date"], "snapshot_date": ["Date"],
}
GRN_COLUMNS = {
    "plant": ["Plant"], "sloc": ["S.Loc"], "material": ["Material"], "material_desc": ["Material Description"],
    "vendor_code": ["Goods supplier"], "vendor_name": ["Goods supplier name", "Goods Supplier Name"],
    "po_no": ["PO No"], "gr_no": ["GR No"], "gr_qty": ["GR Qty"], "base_price": ["Base Price"],
    "net_price": ["Net Price"], "unit_mrp": ["Unit MRP"], "total_amount_wo_tax": ["Total Amount without tax"],
    "po_to_gr_tat": ["PO to GR TAT"], "pr_to_gr_tat": ["PR to GR TAT"], "major_group": ["Major Group"],
    "minor_group": ["Minor Group"], "po_date": ["PO Date"], "gr_date": ["GR Date"], "expiry_date": ["Expiry Date"],
}
PO_COLUMNS = {
    "plant": ["Plant"], "plant_name": ["Plant Name"], "sloc": ["Storage Location"], "material": ["Material"],
    "material_desc": ["Material Description"], "vendor_code": ["PO Vendor"], "vendor_name": ["Vendor Name"],
    "po_no": ["PO No"], "doc_type": ["Doc.Type description"], "po_qty": ["PO Quantity"], "open_qty": ["Open Qty"],
    "net_price": ["Net Price"], "total_value_wo_tax": ["Total value without Tax"],
    "total_value_tax": ["Total value with Tax"], "major_group": ["Major Group"], "minor_group": ["Minor Group"],
    "po_date": ["PO Date"], "delivery_date": ["Delivery Date"],
}


def read_raw(spark: SparkSession, paths: list[str] | str, fmt: str = "csv") -> DataFrame:
    """SRC-06/07: read one or many extract files, headers stripped; files with one header are
    one read, different headers are unioned by name."""
    paths = [paths] if isinstance(paths, str) else sorted(paths)
    if fmt != "csv":
        df = spark.read.option("mergeSchema", "true").format(fmt).load(paths)
        return df.toDF(*[c.strip() for c in df.columns])
    frames = [df.drop("file_path") for *_, df in read_by_header(spark, {"": paths})]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _trimmed(df: DataFrame, candidates: list[str]) -> Column:
    for c in candidates:
        if c in df.columns:
            return F.trim(F.col(f"`{c}`").cast("string"))
    return F.lit(None).cast("string")


def pick(df: DataFrame, candidates: list[str]) -> Column:
    """SRC-02: first present candidate column, as trimmed text; NULL when none exists."""
    v = _trimmed(df, candidates)
    return F.when(v != "", v)


def _num(df, cands, t=QTY):
    return pick(df, cands).try_cast(t)


def _with_days(raw: DataFrame, columns: dict) -> DataFrame:
    """``raw`` with the text of every date column and its date part, each made once and not for every format."""
    dates = {k: pick(raw, cands) for k, cands in columns.items() if k.endswith("_date")}
    return raw.select("*", *[x for k, v in dates.items() for x in (v.alias(f"_{k}_text"), date_part(v).alias(f"_{k}_day"))])


def _date(k: str) -> Column:
    """A date in any form, value by value (COL-06), of a frame ``_with_days``."""
    return parse_any_date(f"_{k}_text", F.col(f"_{k}_day"))


def date_rejects(raw: DataFrame, columns: dict) -> DataFrame:
    """(column_name, present, rejected): date texts of an extract, and those that no form fits."""
    names = [k for k in columns if k.endswith("_date")]
    text = {k: pick(raw, columns[k]) for k in names}
    aggs = [x for k in names for x in (F.count(text[k]).alias(f"p_{k}"),
                                       F.count_if(text[k].isNotNull() & parse_any_date(text[k]).isNull()).alias(f"r_{k}"))]
    stacked = ", ".join(f"'{k}', p_{k}, r_{k}" for k in names)
    return raw.agg(*aggs).selectExpr(f"stack({len(names)}, {stacked}) AS (column_name, present, rejected)")


def load_consumption(raw: DataFrame) -> DataFrame:
    """SRC-01: goods-issue lines - movement 201, valid posting date, positive quantity."""
    c = CONSUMPTION_COLUMNS
    raw = _with_days(raw, c)
    df = raw.select(
        normalize_id(pick(raw, c["material"])).alias("material"), pick(raw, c["material_desc"]).alias("material_desc"),
        normalize_id(pick(raw, c["plant"])).alias("plant"), normalize_id(pick(raw, c["sloc"])).alias("sloc"),
        normalize_id(pick(raw, c["mvt"])).alias("mvt"), normalize_id(pick(raw, c["cost_ctr"])).alias("cost_ctr"),
        _num(raw, c["qty"]).alias("qty"), _num(raw, c["amount_lc"], MONEY).alias("amount_lc"),
        pick(raw, c["uom"]).alias("uom"), _date("posting_date").alias("posting_date"))
    return (df.where((F.col("mvt") == "201") & F.col("posting_date").isNotNull() & (F.col("qty") > 0))   # FLT-06
              .select("*", *calendar_columns("posting_date")))


def load_inventory(raw: DataFrame) -> DataFrame:
    """SRC-02: snapshot rows; absent alternates become NULL columns."""
    c = INVENTORY_COLUMNS
    raw = _with_days(raw, c)
    ids = ["plant", "sloc", "material", "batch"]
    money_cols = ["total_cost", "total_mrp", "moving_avg_price"]
    cols = []
    for k, cands in c.items():
        if k in ids:
            cols.append(normalize_id(pick(raw, cands)).alias(k))
        elif k == "qty":
            cols.append(_num(raw, cands).alias(k))
        elif k in money_cols:
            cols.append(_num(raw, cands, MONEY).alias(k))
        elif k == "aging_days":
            cols.append(pick(raw, cands).try_cast("double").cast("int").alias(k))
        elif k.endswith("_date"):
            cols.append(_date(k).alias(k))
        else:
            cols.append(pick(raw, cands).alias(k))
    return raw.select(*cols)


def load_grn(raw: DataFrame) -> DataFrame:
    """SRC-03: receipt lines from the union of monthly files (NULL material kept, D1).

    Texts are trimmed in a step of their own: with that in one step, the generated method is too long to be compiled.
    """
    c = GRN_COLUMNS
    text = {k: _trimmed(raw, cands) for k, cands in c.items()}
    raw = _with_days(raw, c).select("*", *[(v.try_cast("double") if k.endswith("_tat") else v).alias(f"_{k}_bare") for k, v in text.items()])
    bare = {k: F.col(f"_{k}_bare") for k in c}
    some = lambda k, made=lambda x: x: F.when(bare[k] != "", made(bare[k])).alias(k)
    code = lambda x: normalize_id(x, trimmed=True)
    days = lambda k: F.when(bare[k].isNotNull(), bare[k].cast("int")).alias(k)
    number = lambda k, t=MONEY: F.when(bare[k] != "", bare[k]).try_cast(t).alias(k)
    df = raw.select(
        some("plant", code), some("sloc", code), some("material", code), some("material_desc"),
        some("vendor_code", code), some("vendor_name"), some("po_no", code), some("gr_no", code),
        number("gr_qty", QTY), number("base_price"), number("net_price"), number("unit_mrp"), number("total_amount_wo_tax"),
        days("po_to_gr_tat"), days("pr_to_gr_tat"), some("major_group"), some("minor_group"),
        _date("po_date").alias("po_date"), _date("gr_date").alias("gr_date"),
        _date("expiry_date").alias("expiry_date"))
    return df.withColumn("posting_date", F.col("gr_date")).select("*", *calendar_columns("gr_date"))


def load_po(raw: DataFrame) -> DataFrame:
    """SRC-04: order lines; dates arrive as dd.MM.yyyy text (COL-05)."""
    c = PO_COLUMNS
    df = raw.select(
        normalize_id(pick(raw, c["plant"])).alias("plant"), pick(raw, c["plant_name"]).alias("plant_name"),
        normalize_id(pick(raw, c["sloc"])).alias("sloc"), normalize_id(pick(raw, c["material"])).alias("material"),
        pick(raw, c["material_desc"]).alias("material_desc"),
        normalize_id(pick(raw, c["vendor_code"])).alias("vendor_code"), pick(raw, c["vendor_name"]).alias("vendor_name"),
        normalize_id(pick(raw, c["po_no"])).alias("po_no"), pick(raw, c["doc_type"]).alias("doc_type"),
        _num(raw, c["po_qty"]).alias("po_qty"), _num(raw, c["open_qty"]).alias("open_qty"),
        _num(raw, c["net_price"], MONEY).alias("net_price"),
        _num(raw, c["total_value_wo_tax"], MONEY).alias("total_value_wo_tax"),
        _num(raw, c["total_value_tax"], MONEY).alias("total_value_tax"),
        pick(raw, c["major_group"]).alias("major_group"), pick(raw, c["minor_group"]).alias("minor_group"),
        parse_fixed_date(pick(raw, c["po_date"])).alias("po_date"),
        parse_fixed_date(pick(raw, c["delivery_date"])).alias("delivery_date"))
    return df.withColumn("posting_date", F.col("po_date")).select("*", *calendar_columns("po_date"))


# Headers of card files that name a period.
CARD_PERIODS = r"^\d{4}-\d{4}$|^[A-Z][a-z]+ \d{4}( Revenue)?$"


def read_card(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """SRC-12: a card file with one column per year or month, as (keys, period, value) rows; the
    period columns are found in the header of each file."""
    frames = [unpivot_periods(df.drop("file_path"), keys, CARD_PERIODS) for *_, df in read_by_header(spark, {"": [path]})]
    return reduce(lambda a, b: a.unionByName(b), frames)


def sales_folders(root: str, ip_dir: str = "IP Sales", op_dir: str = "OP Sales") -> dict[str, list[str]]:
    """SRC-07: patient type -> landing folder."""
    return {"IP": [f"{root.rstrip('/')}/{ip_dir}"], "OP": [f"{root.rstrip('/')}/{op_dir}"]}


def sales_sources(spark: SparkSession, root: str, ext: str = "csv") -> list[tuple[str, str]]:
    """SRC-07: sorted (patient type, file) pairs of a landing zone."""
    listed = list_landed(spark, sales_folders(root), ext).select("tag", "path").orderBy("tag", "path")
    return [(r["tag"], r["path"]) for r in listed.collect()]
