"""Stored-table catalogue: queries read a built table if it is current, and derive it if not.

A manifest row says what a stored table was made of: its name, its input files (number, bytes
and a digest of path, length and time of change), the run parameters and the library's
code. Their hash is the table's signature. A query that asks for a table computes the
signature it needs from the inputs as they are now; a manifest row with that
signature names a table with the very rows that deriving would give. A changed file,
parameter or line of code gives another signature, so a stale table is never read. A table
built for a query goes to a folder of its own and its row is appended after the write (and those
beside it) has committed, so a lost executor or a second builder leaves nothing half done. A staged
build overwrites its folders: it takes them back (a row without a signature) before it
starts, and the last row of a folder is the one that counts.
"""
from __future__ import annotations

import dataclasses
import datetime as _dt
import hashlib
import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache, reduce
from importlib.resources import files

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from carelake.operators import forecast as fc
from carelake.operators import kpi, sales
from carelake.plans.warehouse import Warehouse
from carelake.schemas import SCHEMAS, columns_of
from carelake.session import ensure_checkpoint_dir
from carelake.streaming.incremental import work_dir

ROOT_SETTING = "spark.carelake.store.dir"
MANIFEST = ("name string, signature string, path string, schema string, built_at timestamp, code string, params map<string,string>, "
            "inputs array<struct<table:string,files:bigint,bytes:bigint,digest:string>>")
MATRIX_TABLES = ["forecast_sales", "stock_replenishment_and_aging_risk", "forecast_accuracy"]      # made from the demand matrix
ITEM_TABLES = ["kpi_stock_value", "kpi_inventory_aging", "kpi_doh", "kpi_health_score"]      # made from the stock items
# tables that are made without the material dimension
NO_MATERIALS = {"fact_consumption", "fact_inventory", "fact_grn", "fact_po", "sales_line", "kpi_purchase_value", "kpi_vendor_volume",
                "kpi_cycle_time", "kpi_fill_rate", "kpi_purchase_by_location", "kpi_vendor_lead_time"}
DIMS = ["dim_material", "dim_plant", "dim_sloc", "dim_vendor", "dim_costcenter"]
# tables that read other tables, and so are written after them
LATER_TABLES = ["kpi_non_moving", "kpi_risk_classification", "kpi_stock_change_by_group", "mart_procurement", "kpi_fulfillment",
                "kpi_stock_radar", "kpi_aging_risk_forecast"]
AT_ONCE = 3      # tables that are written at a time


@lru_cache(maxsize=1)
def code_version() -> str:
    """A hash of the modules that decide what is in a table."""
    h = hashlib.sha256()

    def add(folder):
        for f in sorted(folder.iterdir(), key=lambda f: f.name):
            if f.name.endswith(".py"):
                h.update(f.name.encode() + f.read_bytes())
    for part in ("operators", "functions", "sources", "plans"):
        add(files("carelake").joinpath(part))
    return h.hexdigest()[:16]


def fingerprints(spark: SparkSession, inputs: dict[str, str]) -> list[dict]:
    """Files, bytes and digest of every input folder, in one job that lists and reads no content."""
    parts = [spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
             .select(F.lit(name).alias("table"), "path", "length", "modificationTime") for name, path in sorted(inputs.items())]
    listed = reduce(lambda a, b: a.unionByName(b), parts)
    rows = listed.groupBy("table").agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"),
        F.hex(F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).alias("digest")).orderBy("table").collect()
    return [r.asDict() for r in rows]      # one row per input table


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_together(frames: dict[str, DataFrame], partitions: dict | None = None) -> None:
    """Write {path: frame}, a few at a time, so that the last tasks of one leave no cores idle; a failure of one is raised."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        list(pool.map(lambda path: write_table(frames[path], path, (partitions or {}).get(path)), frames))


class Store:
    """The manifest and the tables under one shared folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @property
    def manifest(self) -> DataFrame:
        """One row per stored table and signature (an empty frame before the first build)."""
        try:
            return self.spark.read.schema(MANIFEST).json(f"{self.root}/_manifest")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], MANIFEST)

    def current(self) -> DataFrame:
        """(name, signature, path, schema): the last row of every folder, unless it was taken back."""
        last = F.max_by(F.struct("name", "signature", "schema"), "built_at").alias("r")
        return self.manifest.groupBy("path").agg(last).select("r.name", "r.signature", "path", "r.schema").where("signature <> ''")

    def add(self, tables: list[tuple], params: dict, inputs: list[dict]) -> None:
        """Record (name, signature, path, schema) of tables that have been written."""
        now = _dt.datetime.now()
        rows = [(name, signature, path, schema.json(), now, code_version(), params,
                 [(i["table"], i["files"], i["bytes"], i["digest"]) for i in inputs]) for name, signature, path, schema in tables]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").json(f"{self.root}/_manifest")


class StoredWarehouse(Warehouse):
    """A ``Warehouse`` whose tables are read from the store where they are current."""

    def __init__(self, lake, store: Store):
        super().__init__(lake)
        self.store, spark = store, lake.spark
        self.inputs = fingerprints(spark, lake.inputs)
        self.params = {k: str(getattr(lake, k)) for k in ("snapshot_date", "history_end", "history_months", "horizon")}
        wanted = {self.signature(n): n for n in [*self, "line"]}
        self.known = {r["name"]: (r["path"], r["schema"]) for r in store.current().where(
            F.col("signature").isin(list(wanted))).select("name", "path", "schema").collect()}      # builds of these very tables
        self._settle()

    def signature(self, name: str) -> str:
        what = json.dumps([name, code_version(), self.params, self.inputs], sort_keys=True)
        return hashlib.sha256(what.encode()).hexdigest()[:32]

    def stored(self, name: str) -> DataFrame | None:
        if name not in self.known:
            return None
        path, schema = self.known[name]
        schema = StructType.fromJson(json.loads(schema))
        return self.lake.spark.read.schema(schema).parquet(path).select(*schema.names)

    def _settle(self) -> None:
        """Facts and dimensions that are stored replace the derived ones, also as inputs of others."""
        from carelake.sources.fixtures import facts_of
        if (line := self.stored("line")) is not None:
            self.lake.line, self.lake.tables = line, facts_of(line)
        for name in list(self.lake.tables):
            if name in self.known:
                self.lake.tables[name] = self.stored(name)
        for name in DIMS:
            if name in self.known:
                self.lake.__dict__[name] = self.stored(name)

    def __getitem__(self, name):
        if name not in self._cache and name in self.known:
            self._cache[name] = self.stored(name)
        return super().__getitem__(name)

    def build(self, names: list[str]) -> list[str]:
        """Write those of ``names`` that are not current; returns what was written.

        The joined line comes first (what the facts read of it), so that the facts are derived from it once, then the
        material dimension, if a table reads it, then facts and dimensions, then what reads no other table, then the rest. Each of these
        groups is written a few tables at a time and recorded when all of it has been written.
        """
        from carelake.sources.fixtures import LINE_COLUMNS
        made = []
        names, facts = list(dict.fromkeys(names)), self.lake.tables
        early = [n for n in names if n in facts or n in DIMS]
        groups = [["line"][:self.lake.line is not None], ["dim_material"][:not NO_MATERIALS.issuperset(names)], early,
                  [n for n in names if n not in early + LATER_TABLES], [n for n in names if n in LATER_TABLES]]
        for group in groups:
            group = [n for n in group if n not in self.known]
            if not group:
                continue
            for name in group:
                _share(self, {n for n in names if n not in self.known}, name)
            frames = {n: self.lake.line.select(*LINE_COLUMNS) if n == "line" else self[n] for n in group}
            paths = {n: f"{self.store.root}/{n}/{self.signature(n)[:12]}-{uuid.uuid4().hex[:8]}" for n in group}
            write_together({paths[n]: frames[n] for n in group})
            self.store.add([(n, self.signature(n), paths[n], frames[n].schema) for n in group], self.params, self.inputs)
            for name in group:
                self.known[name] = (paths[name], frames[name].schema.json())
                self._cache.pop(name, None)
            self._settle()
            made += group
        return made

    def take_back(self, paths: list[str]) -> None:
        """Say that these folders are about to change."""
        self.store.add([("", "", p, StructType()) for p in paths], {}, [])
        self.known = {n: (p, s) for n, (p, s) in self.known.items() if p not in paths}

    def adopt(self, tables: dict[str, str]) -> None:
        """Record tables that a staged build has written: {name: path}."""
        rows = []
        for name, path in tables.items():
            df = self.lake.spark.read.parquet(path)
            # partition columns are read back last; the contract has their place
            order = [c for c, _ in columns_of(name) if c in df.columns] if name in SCHEMAS else df.columns
            rows.append((name, self.signature(name), path, df.select(*order).schema))
            self.known[name] = (path, rows[-1][3].json())
        self.store.add(rows, self.params, self.inputs)
        self._cache.clear()
        self._settle()


def _once(df: DataFrame, spark: SparkSession, name: str, *partition_by: str) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back."""
    path = work_dir(spark, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _share(w: Warehouse, missing: set[str], name: str) -> None:
    """Before the first of several ``missing`` tables is made from the demand matrix, the stock items or the sales aggregate,
    write that once."""
    l = w.lake
    if w.matrix is None and name in MATRIX_TABLES and len(missing.intersection(MATRIX_TABLES)) > 1:
        w.matrix = _once(fc.demand_matrix(l.fact_consumption, l.history_end, l.history_months, spread=True), l.spark, "demand-matrix")
    if w.items is None and name in ITEM_TABLES and len(missing.intersection(ITEM_TABLES)) > 1:
        w.items = _once(kpi.stock_items(l.fact_inventory, l.fact_consumption), l.spark, "stock-items")
    if w.sales is None and name in sales.GRAINS and len(missing.intersection(sales.GRAINS)) > 1:
        w.sales = _once(sales.sales_aggregates(l.sales_line), l.spark, "sales-aggregates", "grain")


def open_warehouse(lake) -> Warehouse:
    """The lake's tables: from the store that the session names, else derived."""
    root = lake.spark.conf.get(ROOT_SETTING, None)
    if not root or not getattr(lake, "inputs", None):
        return Warehouse(lake)
    return StoredWarehouse(lake, Store(lake.spark, root))


def line_warehouse(lake, names: list[str] = (), facts: list[str] | None = None) -> Warehouse:
    """``open_warehouse`` for plans of several tables: the joined line, the material dimension and what several of
    ``names`` are made from are written once to the shared checkpoint folder, unless they are stored or the facts are cached.
    Of the line, what the facts read, or those in ``facts``, which are then all that the warehouse has.

    Every fact of a lazy lake holds the whole join of the line, so a plan of many tables repeats
    it for each of their inputs: its shuffles, its broadcasts and its stages, all at once in one driver.
    """
    wh = open_warehouse(lake)
    if lake.line is None or "line" in getattr(wh, "known", {}) or any(df.is_cached for df in lake.tables.values()):
        return wh
    from carelake.sources.fixtures import FACT_COLUMNS, LINE_COLUMNS, facts_of
    facts = list(FACT_COLUMNS) if facts is None else facts
    read = set().union(*[FACT_COLUMNS[f] for f in facts])
    line = _once(lake.line.select(*[c for c in LINE_COLUMNS if c in read]), lake.spark, "line")
    held = dataclasses.replace(lake, line=line, tables=facts_of(line, facts))
    held.__dict__["dim_material"] = _once(held.dim_material, lake.spark, "dim_material")
    w = Warehouse(held)
    for name in names:
        _share(w, set(names), name)
    return w


def written(w: Warehouse, name: str) -> DataFrame:
    """A small table that others are joined to, written once (unless the warehouse has it stored): the plan then knows its
    size and can hand it out whole instead of shuffling what it is joined to."""
    return w[name] if name in getattr(w, "known", {}) else _once(w[name], w.lake.spark, name)


def built_warehouse(lake, names: list[str]) -> StoredWarehouse:
    """A warehouse that holds ``names`` stored, building what is missing, under the session's store
    or else its shared checkpoint folder."""
    root = lake.spark.conf.get(ROOT_SETTING, None) or f"{ensure_checkpoint_dir(lake.spark).rstrip('/')}/carelake-store"
    wh = StoredWarehouse(lake, Store(lake.spark, root))
    wh.build(names)
    return wh
