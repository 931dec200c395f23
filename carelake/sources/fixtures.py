"""Test-data adapters: driver tables (TPC-H-like) -> the curated facts.

The driver ships a star schema (lineitem, orders, part, supplier, customer, nation).
This module derives the six curated inputs of the engine from it, following the
derivation table of FIXTURES.md section 3. The same derivation is written as a SQL
prefix in ``carelake.oracle.fixtures_sql`` so the oracle starts from identical rows.

Scale notes: every line keeps its real part, supplier and nation, and no date is cut but
the sales window. lineitem x orders is the only large-large join (on the order key, after
orders x customer); part and supplier grow with the data and carry no broadcast hint, so
AQE broadcasts them only when their measured size allows it.
"""
from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carelake.functions.expr import calendar_columns
from carelake.schemas import SCHEMAS, columns_of

# Fixed values of the fixture derivation (FIXTURES.md section 3).
SNAPSHOT_DATE = _dt.date(2001, 5, 31)
WINDOW_START = _dt.date(2000, 12, 1)
CAPEX_DOC_TYPES = ["1-URGENT"]      # order priorities that stand for capital / service orders
SLOC_DESCS = ["IP PHARMACY", "OP PHARMACY", "IP/OP STORE", "OT STORE", "MAIN STORE"]
SOURCE_TABLES = ["lineitem", "orders", "part", "supplier", "customer", "nation"]
# what each fact reads of the joined line
FACT_COLUMNS = {
    "fact_consumption": ["l_returnflag", "material_code", "p_name", "plant", "sloc", "o_custkey", "q", "net_price", "sdate"],
    "fact_inventory": ["l_linestatus", "sdate", "plant", "sloc", "l_linenumber", "material_code", "p_name", "p_partkey", "l_orderkey", "q",
                       "net_price", "mrp_base", "p_brand", "p_size", "p_type", "l_partkey"],
    "fact_grn": ["plant", "sloc", "l_linenumber", "l_partkey", "material_code", "p_name", "s_suppkey", "s_name", "l_orderkey", "q", "mrp_base",
                 "net_price", "l_tax", "sdate", "odate", "p_size", "p_brand", "p_type"],
    "fact_po": ["plant", "plant_name", "sloc", "l_linenumber", "l_partkey", "material_code", "p_name", "s_suppkey", "s_name", "l_orderkey",
                "o_orderpriority", "o_orderstatus", "q", "net_price", "p_size", "p_brand", "p_type", "odate"],
    "sales_line": ["l_returnflag", "sdate", "material_code", "p_name", "q", "mrp_base", "net_price", "p_brand", "plant"]}
# what the facts read of the joined line
LINE_COLUMNS = ["l_orderkey", "l_partkey", "p_partkey", "l_linenumber", "l_tax", "l_returnflag", "l_linestatus", "o_custkey", "o_orderstatus",
                "o_orderpriority", "p_name", "p_brand", "p_type", "p_size", "s_suppkey", "s_name", "plant", "plant_name",
                "material_code", "q", "mrp_base", "net_price", "odate", "sdate", "sloc"]
MONEY = "decimal(24,6)"   # line values: quantity x price, exact


def _d(x: _dt.date) -> Column:
    return F.lit(x)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def base_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem x orders x part x supplier x customer x nation, with derived keys."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount",
        "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    p = read_table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    s = read_table(spark, sf_dir, "supplier").select(
        "s_suppkey", "s_name")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = read_table(spark, sf_dir, "nation").select(
        "n_nationkey", "n_name")

    # orders x customer first (shuffled by customer key), then ONE shuffle of lineitem by
    # order key: the largest table crosses the network once.
    oc = o.join(c, o.o_custkey == c.c_custkey)
    line = (li.join(oc, li.l_orderkey == oc.o_orderkey)
              .join(p, p.p_partkey == li.l_partkey)
              .join(s, s.s_suppkey == li.l_suppkey)
              .join(n, n.n_nationkey == c.c_nationkey))

    mrp_base = F.col("p_retailprice").cast("decimal(12,2)")
    factor = (F.when(F.col("l_orderkey") % 97 == 0, F.lit(12))
               .when(F.col("l_orderkey") % 89 == 0, F.lit(0.05).cast("decimal(3,2)"))
               .otherwise(F.lit(1)))
    net_price = (mrp_base * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)")) * factor
                 ).cast("decimal(18,4)")
    return line.select(
        "*",
        F.concat(F.lit("P"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("plant"),
        F.col("n_name").alias("plant_name"),
        F.col("p_partkey").cast("string").alias("material_code"),
        F.col("l_quantity").cast("decimal(12,2)").alias("q"),
        mrp_base.alias("mrp_base"),
        net_price.alias("net_price"),
        F.col("o_orderdate").cast("date").alias("odate"),
        F.col("l_shipdate").cast("date").alias("sdate"),
        F.concat(F.lit("S"), F.col("l_linenumber").cast("string")).alias("sloc"),
    )


def _null_material(line_material: Column) -> Column:
    """Capex / service lines carry no material (FIXTURES.md: linenumber 7, partkey % 3 = 0)."""
    return F.when((F.col("l_linenumber") == 7) & (F.col("l_partkey") % 3 == 0),
                  F.lit(None).cast("string")).otherwise(line_material)


def _expiry(col_sdate: str = "sdate") -> Column:
    return F.when(F.col("l_partkey") % 11 == 0, F.lit(None).cast("date")).otherwise(
        F.date_add(F.col(col_sdate), (F.lit(60) + (F.col("l_partkey") % 12) * 60).cast("int")))


def fact_consumption(line: DataFrame) -> DataFrame:
    """SRC-01 shape: goods-issue lines (movement 201), positive qty, valid date."""
    return line.where(F.col("l_returnflag") != "R").select(
        F.col("material_code").alias("material"),
        F.col("p_name").alias("material_desc"),
        "plant", "sloc",
        F.lit("201").alias("mvt"),
        F.concat(F.lit("CC"), (F.col("o_custkey") % 40).cast("string")).alias("cost_ctr"),
        F.col("q").alias("qty"),
        (F.col("q") * F.col("net_price")).cast(MONEY).alias("amount_lc"),
        F.lit("EA").alias("uom"),
        F.col("sdate").alias("posting_date"),
        *calendar_columns("sdate"),
    )


def fact_grn(line: DataFrame) -> DataFrame:
    tat = F.datediff(F.col("sdate"), F.col("odate"))
    return line.select(
        "plant", "sloc",
        _null_material(F.col("material_code")).alias("material"),
        F.col("p_name").alias("material_desc"),
        F.col("s_suppkey").cast("string").alias("vendor_code"),
        F.col("s_name").alias("vendor_name"),
        F.col("l_orderkey").cast("string").alias("po_no"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"),
                    F.col("l_linenumber").cast("string")).alias("gr_no"),
        F.col("q").alias("gr_qty"),
        F.col("mrp_base").cast("decimal(18,4)").alias("base_price"),
        "net_price",
        F.when(F.col("l_tax") > 0.02, F.col("mrp_base") * F.lit(1.25).cast("decimal(3,2)"))
         .otherwise(F.lit(0).cast("decimal(3,2)")).cast("decimal(18,4)").alias("unit_mrp"),
        (F.col("q") * F.col("net_price")).cast(MONEY).alias("total_amount_wo_tax"),
        tat.alias("po_to_gr_tat"),
        (tat + F.col("l_linenumber")).alias("pr_to_gr_tat"),
        F.when(F.col("p_size") % 10 == 0, F.lit(None).cast("string"))
         .otherwise(F.col("p_brand")).alias("major_group"),
        F.col("p_type").alias("minor_group"),
        F.col("odate").alias("po_date"),
        F.col("sdate").alias("gr_date"),
        _expiry().alias("expiry_date"),
        F.col("sdate").alias("posting_date"),
        *calendar_columns("sdate"),
    )


def fact_po(line: DataFrame) -> DataFrame:
    open_qty = (F.when(F.col("o_orderstatus") == "O", F.col("q"))
                 .when(F.col("o_orderstatus") == "P", F.floor(F.col("q") / 4).cast("decimal(12,2)"))
                 .otherwise(F.lit(0).cast("decimal(12,2)")))
    value = (F.col("q") * F.col("net_price")).cast(MONEY)
    return line.select(
        "plant", "plant_name", "sloc",
        _null_material(F.col("material_code")).alias("material"),
        F.col("p_name").alias("material_desc"),
        F.col("s_suppkey").cast("string").alias("vendor_code"),
        F.col("s_name").alias("vendor_name"),
        F.col("l_orderkey").cast("string").alias("po_no"),
        F.col("o_orderpriority").alias("doc_type"),
        F.col("q").alias("po_qty"),
        open_qty.cast("decimal(12,2)").alias("open_qty"),
        "net_price",
        value.alias("total_value_wo_tax"),
        (value * F.lit(1.12).cast("decimal(3,2)")).cast("decimal(26,8)").alias("total_value_tax"),
        F.when(F.col("p_size") % 10 == 0, F.lit(None).cast("string"))
         .otherwise(F.col("p_brand")).alias("major_group"),
        F.col("p_type").alias("minor_group"),
        F.col("odate").alias("po_date"),
        F.date_add(F.col("odate"), 14).alias("delivery_date"),
        F.col("odate").alias("posting_date"),
        *calendar_columns("odate"),
    )


def fact_inventory(line: DataFrame) -> DataFrame:
    sloc_desc = F.element_at(F.array(*[F.lit(s) for s in SLOC_DESCS]),
                             (F.col("l_linenumber") % len(SLOC_DESCS) + 1).cast("int"))
    return line.where(
        (F.col("l_linestatus") == "O")
        & (F.col("sdate") <= _d(SNAPSHOT_DATE))
    ).select(
        "plant", "sloc", sloc_desc.alias("sloc_desc"),
        F.col("material_code").alias("material"),
        F.col("p_name").alias("material_desc"),
        F.concat(F.lit("HSN"), (F.col("p_partkey") % 50).cast("string")).alias("hsn"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"),
                    F.col("l_linenumber").cast("string")).alias("batch"),
        F.col("q").alias("qty"),
        F.lit("EA").alias("uom"),
        (F.col("q") * F.col("net_price")).cast(MONEY).alias("total_cost"),
        (F.col("q") * F.col("mrp_base") * F.lit(1.25).cast("decimal(3,2)")).cast(MONEY).alias("total_mrp"),
        F.col("net_price").alias("moving_avg_price"),
        F.datediff(_d(SNAPSHOT_DATE), F.col("sdate")).alias("aging_days"),
        F.col("p_brand").alias("manufacturer_desc"),
        F.element_at(F.split(F.col("p_name"), " "), -1).alias("generic_name"),
        F.when(F.col("p_size") % 5 == 0, F.lit("OUT OF FORMULARY"))
         .otherwise(F.lit("IN FORMULARY")).alias("formulary"),
        F.when(F.col("p_size") % 7 == 0, F.lit("ZCON")).otherwise(F.lit("ZMED")).alias("material_type"),
        F.col("p_type").alias("material_group"),
        F.col("p_brand").alias("major_group_desc"),
        F.col("p_type").alias("minor_group_desc"),
        _expiry().alias("expiry_date"),
        F.col("sdate").alias("grn_date"),
        _d(SNAPSHOT_DATE).alias("snapshot_date"),
    )


def sales_line(line: DataFrame) -> DataFrame:
    """SAL-01 canonical sales lines (already normalised keys, decision D10)."""
    return line.where(
        (F.col("l_returnflag") != "R")
        & F.col("sdate").between(_d(WINDOW_START), _d(SNAPSHOT_DATE))
    ).select(
        F.col("sdate").alias("sale_date"),
        F.col("material_code").alias("material"),
        F.col("p_name").alias("material_desc"),
        F.col("q").alias("qty"),
        (F.col("q") * F.col("mrp_base") * F.lit(1.25).cast("decimal(3,2)")).cast(MONEY).alias("revenue"),
        (F.col("q") * F.col("net_price")).cast(MONEY).alias("cost"),
        F.col("p_brand").alias("manufacturer"),
        F.col("plant").alias("hospital"),
        F.when(F.col("l_returnflag") == "A", F.lit("IP")).otherwise(F.lit("OP")).alias("patient_type"),
        *calendar_columns("sdate"),
    )


def facts_of(line: DataFrame, names: list[str] = tuple(FACT_COLUMNS)) -> dict[str, DataFrame]:
    """The curated facts, or some of them, derived from one joined line."""
    make = {"fact_consumption": fact_consumption, "fact_inventory": fact_inventory, "fact_grn": fact_grn, "fact_po": fact_po,
            "sales_line": sales_line}
    return {n: make[n](line) for n in names}


@dataclass
class Lake:
    """The curated layer as lazy DataFrames plus the run parameters.

    Built either from the driver's test tables (``Lake.from_testdata``) or from a
    curated parquet directory written by the pipeline (``Lake.from_curated``).
    """
    spark: SparkSession
    tables: dict = field(default_factory=dict)
    snapshot_date: _dt.date | None = SNAPSHOT_DATE      # None: max(snapshot_date) of the data
    history_end: _dt.date = _dt.date(SNAPSHOT_DATE.year, SNAPSHOT_DATE.month, 1)
    history_months: int = 6
    horizon: int = 3
    line: DataFrame | None = None       # the joined line that the facts are derived from
    inputs: dict = field(default_factory=dict)      # table -> path of what the facts are made of

    @classmethod
    def from_testdata(cls, spark: SparkSession, sf_dir: str) -> "Lake":
        line = base_line(spark, sf_dir)
        lake = cls(spark)
        lake.line, lake.tables = line, facts_of(line)
        lake.sf_dir = sf_dir
        lake.inputs = {t: f"{sf_dir.rstrip('/')}/{t}.parquet" for t in SOURCE_TABLES}
        return lake

    @classmethod
    def from_curated(cls, spark: SparkSession, curated_dir: str, **params) -> "Lake":
        names = ["fact_consumption", "fact_inventory", "fact_grn", "fact_po", "sales_line"]
        # run parameters default to the data: snapshot -> max(snapshot_date) (lazy scalar),
        # history end -> month of the last posting (one-row aggregate, needed for the fixed
        # month slots of the demand matrix)
        params.setdefault("snapshot_date", None)
        lake = cls(spark, **params)
        base = curated_dir.rstrip("/")
        # partition columns come back last and as INT; restore the contract column order
        order = {n: [c for c, _ in columns_of(n)] for n in names if n in SCHEMAS}
        lake.tables = {}
        for n in names:
            df = spark.read.parquet(f"{base}/{n}")
            lake.tables[n] = df.select(*order[n]) if n in order else df
        if "history_end" not in params:
            last = lake.tables["fact_consumption"].agg(F.max("posting_date")).first()[0]
            if last is not None:
                lake.history_end = _dt.date(last.year, last.month, 1)
        return lake

    @property
    def snapshot_col(self) -> Column:
        """Snapshot date of the run: the parameter when set, else max(snapshot_date) of the data."""
        if self.snapshot_date is not None:
            return F.lit(self.snapshot_date)
        return self.fact_inventory.select(F.max("snapshot_date")).scalar()

    def __getattr__(self, name):
        tables = self.__dict__.get("tables", {})
        if name in tables:
            return tables[name]
        raise AttributeError(name)

    # the dimensions are derived lazily from the facts (DIM-01..05)
    @cached_property
    def dim_material(self) -> DataFrame:
        from carelake.operators.dims import dim_material
        return dim_material(self.fact_inventory, self.fact_consumption)

    @cached_property
    def dim_plant(self) -> DataFrame:
        from carelake.operators.dims import dim_plant
        return dim_plant(self.fact_po, self.fact_inventory, self.fact_consumption)

    @cached_property
    def dim_sloc(self) -> DataFrame:
        from carelake.operators.dims import dim_sloc
        return dim_sloc(self.fact_inventory)

    @cached_property
    def dim_vendor(self) -> DataFrame:
        from carelake.operators.dims import dim_vendor
        return dim_vendor(self.fact_po, self.fact_grn)

    @cached_property
    def dim_costcenter(self) -> DataFrame:
        from carelake.operators.dims import dim_costcenter
        return dim_costcenter(self.fact_consumption)
