"""RE-01..11: per-result helpers of the reference rebuilt as Spark jobs.

None of these collects a group or emits all pairs: top-N + Other is a ranked
re-aggregation of an already aggregated frame; cosine scoring compares every row with
a bounded exemplar set delivered as one scalar-subquery array (size-checked).
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from carelake.functions.expr import clean_category, r6
from carelake.operators.common import first_rows, ranked, top_n

# Cosine routing parameters and the deterministic intent-lock patterns.
TOP_K = 4
MIN_SIM = 0.32
EXEMPLAR_BLOCK = 4096      # vectors that are held together
INTENT_LOCKS = {
    "price_dispersion": r"(?i)\b(overpay|over-?pay|overpaying|paying too much|price (inconsisten|leakage|dispersion|swing|variation)|inconsistent price)",
    "genuine_supply": r"(?i)\b(genuine|actual|real)\b.{0,25}\bsupply\b|\bsupply\b.{0,25}\bexcluding\b.{0,15}\b(capital|capex|service)|exclud\w*\b.{0,15}\b(capital|capex|service)",
}
# Follow-up cues and the scope marker.
REFINE_START = r"(?i)^\s*(and|also|now|just|only|then|but|what about|how about|excluding|exclude|without|remove|drop|instead|same|of (these|those)|for (these|those|that|it|them))\b"
DEICTIC = r"(?i)\b(that|those|these|this|them|they|it|its|their|there|the (top|cheapest|worst|best|same|first|last|one)|the ones)\b"
SCOPE_MARK = r"(?is)\[active scope:\s*(.+?)\s*\]"
CAT_CAPS = {"bar": 14, "grouped_bar": 12, "stacked_bar": 12, "pie": 8, "donut": 8, "treemap": 18}


# ------------------------------------------------------------------ RE-01..04
def top_n_other(df: DataFrame, label: str, value: str, cap: int = 8, additive: bool = True) -> DataFrame:
    """RE-01: keep the top cap-1 rows and fold the tail into 'Other (k more)' for additive
    measures; plain top-cap for ratios; untouched at <= cap rows. ``df`` is aggregated."""
    order = [F.desc_nulls_last(value), F.asc(label)]
    head = ranked(df.select(label, value), cap, *order, rank_col="rn")
    if not additive:
        return head
    n = df.select(F.count(F.lit(1))).scalar()
    kept = head.where((F.col("rn") < cap) | (n <= cap)).select(F.collect_list(F.struct(label, "rn"))).scalar()
    at = F.try_element_at(F.filter("kept", lambda k: k[label].eqNullSafe(F.col(label))), F.lit(1))["rn"]
    rows = df.select(label, value, kept.alias("kept")).select(label, value, at.alias("rn"))   # ``cap`` entries at most
    lab = F.when(F.col("rn").isNull(), F.format_string("Other (%d more)", n - (cap - 1))).otherwise(F.col(label))
    return (rows.groupBy(lab.alias(label), F.coalesce("rn", F.lit(cap)).alias("rn"))
                .agg(F.round(F.sum(value), 4).alias(value)))


def heat_matrix(df: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """RE-02: the cells (row, column, value) of a matrix; cells without rows are absent."""
    return df.groupBy(row, col).agg(F.round(F.sum(value), 4).alias(value))


def hierarchy_rollup(df: DataFrame, parent: str, leaf: str, value: str) -> DataFrame:
    """RE-03: parent and leaf totals in one pass (ROLLUP + grouping_id)."""
    return (df.rollup(parent, leaf)
              .agg(F.round(F.sum(value), 4).alias(value), F.grouping_id(parent, leaf).cast("int").alias("level")))


def box_stats(df: DataFrame, group: str, value: str, exact: bool = True) -> DataFrame:
    """RE-04: five-number summary per group (exact percentiles by default; approximate
    percentiles are the opt-in for very large groups)."""
    v, quarts = F.col("v"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    rows = df.where(F.col(group).isNotNull()).select(group, F.col(value).cast("double").alias("v"))
    if exact:    # counted per (group, value) first, which spreads a large group over tasks
        rows = rows.groupBy(group, "v").agg(F.count(F.lit(1)).alias("k"))
        q = F.percentile(v, quarts, F.col("k"))
    else:
        rows, q = rows.withColumn("k", F.lit(1)), F.percentile_approx(v, quarts, 10000)
    n = F.coalesce(F.sum(F.when(v.isNotNull(), F.col("k"))), F.lit(0))
    return (rows.groupBy(group)
              .agg(F.min(v).alias("min"), q.alias("q"), F.max(v).alias("max"),
                   F.when(n > 0, F.sum(v * F.col("k")) / n).alias("mean"), n.alias("n"))
              .select(group, r6("min").alias("min"), r6(F.col("q")[0]).alias("q1"), r6(F.col("q")[1]).alias("median"),
                      r6(F.col("q")[2]).alias("q3"), r6("max").alias("max"), r6("mean").alias("mean"), "n"))


def histogram_bins(df: DataFrame, value: str, bins: int = 24) -> DataFrame:
    """RE-04: fixed-width bins over [min, max]; max falls in the last bin."""
    v = F.col(value).cast("double")
    d = df.where(v.isNotNull())
    mn = d.select(F.min(v)).scalar()
    mx = d.select(F.max(v)).scalar()
    width = (mx - mn) / bins
    b = F.when(mx == mn, F.lit(1)).otherwise(F.least(F.floor((v - mn) / width) + 1, F.lit(bins))).cast("int")
    return (d.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
             .select("bin", r6(mn + (F.col("bin") - 1) * width).alias("lo"), r6(mn + F.col("bin") * width).alias("hi"),
                     "count"))


# ------------------------------------------------------------------ RE-05..07
def entity_search(sources: dict, q: str, mtype: str | None = None, limit: int = 18) -> DataFrame:
    """RE-05: prefix-ranked contains search per entity type, interleaved round-robin.

    ``sources`` maps type -> (DataFrame, label column, is_category). Each type is a
    distributed top-k (TakeOrdered); only the <= cap winners reach the interleave.
    """
    types = [mtype] if mtype in sources else list(sources)
    cap = limit if mtype in sources else 6
    ql = q.strip().lower()
    parts = []
    for ti, t in enumerate(types):
        df, col, is_cat = sources[t]
        lab = F.col(col)
        cand = (df.where(lab.isNotNull() & (lab != "") & F.lower(lab).contains(ql)).select(lab.alias("raw")).distinct())
        top = cand.orderBy(F.when(F.lower("raw").startswith(ql), 0).otherwise(1), F.length("raw"), "raw").limit(cap)
        ranked = top.withColumn("o", F.row_number().over(
            Window.orderBy(F.when(F.lower("raw").startswith(ql), 0).otherwise(1), F.length("raw"), "raw")))
        disp = clean_category("raw") if is_cat else F.col("raw")
        dedup = (ranked.withColumn("label", disp).groupBy(F.lower("label").alias("k"))
                       .agg(F.min_by("label", "o").alias("label"), F.min("o").alias("o")))
        parts.append(dedup.select(F.lit(t).alias("type"), F.lit(ti).alias("ti"), "label", "o"))
    allp = reduce(lambda a, b: a.unionByName(b), parts)
    allp = allp.withColumn("i", F.row_number().over(Window.partitionBy("type").orderBy("o")))
    return allp.orderBy("i", "ti").limit(limit).select("type", "label", F.col("i").alias("round"))


def entity_browse(sources: dict, limit: int = 18, cap: int = 6) -> DataFrame:
    """RE-05 without a query: the most important labels of each type, interleaved round-robin.

    ``sources`` maps type -> (DataFrame of label and weight, is_category). Each type is an
    ordered limit; labels that clean to the same text keep the heavier one.
    """
    parts = []
    for ti, (t, (df, is_cat)) in enumerate(sources.items()):
        top = top_n(df.where(F.col("label") != ""), cap, F.desc_nulls_last("weight"), "label")
        shown = top.withColumn("label", clean_category("label") if is_cat else F.col("label"))
        once = shown.groupBy(F.lower("label").alias("k")).agg(F.max_by("label", "weight").alias("label"),
                                                              F.max("weight").alias("weight"))
        parts.append(once.select(F.lit(t).alias("type"), F.lit(ti).alias("ti"), "label", "weight"))
    w = Window.partitionBy("type").orderBy(F.desc_nulls_last("weight"), "label")
    mixed = reduce(lambda a, b: a.unionByName(b), parts).withColumn("round", F.row_number().over(w))
    return mixed.orderBy("round", "ti").limit(limit).select("type", "label", "round")


def code_variants(codes: DataFrame, col: str = "material") -> DataFrame:
    """COL-30: 'x' and 'x.0' forms of each code."""
    c = F.col(col).cast("string")
    return (codes.select(c.alias("code"))
                 .union(codes.select(F.when(c.endswith(".0"), F.expr(f"substring({col}, 1, length({col}) - 2)"))
                                     .when(c.rlike(r"^\d+$"), F.concat(c, F.lit(".0"))).alias("code")))
                 .where(F.col("code").isNotNull()).distinct())


def item_footprint(dim_material: DataFrame, tables: dict, q: str, limit: int | None = None) -> DataFrame:
    """RE-06: match items by code or name, then count their rows in every material-keyed table."""
    qq = q.strip()
    ql = qq.lower()
    m = dim_material.where((F.col("material") == qq) | F.lower("material_desc").contains(ql))
    order = [F.when(F.col("material") == qq, 0).when(F.lower("material_desc").startswith(ql), 1).otherwise(2),
             F.length("material_desc"), "material"]
    matched = first_rows(m, limit, *order).select("material")
    codes = code_variants(matched)
    # every table is reduced to (code, rows) in its own pass; the tagged union meets the codes once
    keyed = {n: key for n in sorted(tables) if (key := material_key(tables[n].columns)) and not n.startswith("mart_")}
    parts = [tables[n].groupBy(F.col(key).cast("string").alias("code")).agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(n).alias("table_name"), "code", "rows") for n, key in keyed.items()]
    # the codes are distinct; a semi-join would be pushed back into every arm
    counts = reduce(lambda a, b: a.unionByName(b), parts).join(codes, "code")
    names = dim_material.sparkSession.createDataFrame([(n,) for n in keyed], "table_name string")      # tables without a hit count 0
    return names.join(counts.groupBy("table_name").agg(F.sum("rows").alias("rows")), "table_name", "left").select(
        "table_name", F.coalesce("rows", F.lit(0)).alias("rows"))


def material_key(columns: list[str]) -> str | None:
    """The column that names the item of a table."""
    return next((c for c in ("material", "material_id") if c in columns), None)


# Column-name patterns of the time and key roles.
_TIME = r"(?i)(^month$|^month_num$|^year$|^week$|^quarter$|_date$|^date$|snapshot|posting|^period$)"
_ID = (r"(?i)(^material$|^material_id$|^plant$|^sloc$|^hsn$|^batch$|vendor_code|vendor_name|cost_ctr|^hospital$|"
       r"^manufacturer$|manufacturer_desc|^patient$|po_no|gr_no|^generic_name$|_code$|_id$|_no$)")


def short_type(simple: str) -> str:
    """RE-07 five-way type reduction."""
    b = simple.split("(")[0].lower()
    if b in ("string", "varchar", "char"):
        return "text"
    if b in ("double", "float", "decimal"):
        return "num"
    if b in ("bigint", "int", "smallint", "tinyint"):
        return "int"
    if b in ("date", "timestamp", "timestamp_ntz"):
        return "date"
    if b == "boolean":
        return "bool"
    return b


def catalog_profile(spark: SparkSession, tables: dict) -> DataFrame:
    """RE-07: per table and column: row count, short type and role (time / dim / measure).

    Column metadata comes from the schemas; the only data work is one count per table.
    """
    import re
    meta = []
    for name, df in tables.items():
        for f in df.schema.fields:
            st = short_type(f.dataType.simpleString())
            if re.search(_TIME, f.name) or st == "date":
                role = "time"
            elif st == "text" or re.search(_ID, f.name):
                role = "dim"
            else:
                role = "measure"
            meta.append((name, f.name, st, role))
    md = spark.createDataFrame(meta, "table_name string, column_name string, short_type string, role string")
    counts = reduce(lambda a, b: a.unionByName(b),
                    [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n, df in tables.items()])
    return md.join(counts, "table_name", "left")


# ------------------------------------------------------------------ RE-08
def label_exemplars(emb: DataFrame, vec: str = "embedding", label: str = "label") -> DataFrame:
    """Exemplar vector per label = centroid (per-position mean; partial aggregation, no collect_list of a group)."""
    pos = emb.select(label, F.posexplode(vec).alias("p", "x"))
    c = pos.groupBy(label, "p").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return (c.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("p", "x"))).alias("s"))
             .select(label, F.transform("s", lambda e: e["x"]).alias("centroid")))


def cosine_topk(emb: DataFrame, exemplars: DataFrame, vec: str = "embedding", key: str = "vec_id",
                label: str = "label", k: int = TOP_K, min_sim: float = MIN_SIM, block: int = EXEMPLAR_BLOCK) -> DataFrame:
    """RE-08: top-k exemplars per row by cosine similarity (>= min_sim; zero norm -> 0).

    Exemplars are gathered into blocks of about ``block`` vectors, and every row meets every block
    once: its k best of a block are a state of at most k entries, and the states of all
    blocks merge into the k best of all, so any number of exemplars gives the same plan.
    The vectors of the rows go to a block's tasks by (block, salt); a single block needs no merge.
    """
    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)

    n_blocks = max(1, -(-exemplars.count() // block))
    entry = F.struct(F.col(label).alias("l"), F.col("centroid").alias("c"), F.sqrt(dot(F.col("centroid"), F.col("centroid"))).alias("nc"))
    held = exemplars.groupBy(F.pmod(F.xxhash64(label, "centroid"), F.lit(n_blocks)).alias("b")).agg(F.collect_list(entry).alias("ex"))
    v = F.transform(F.col(vec), lambda x: x.cast("double"))
    rows = emb.select(key, v.alias("v"), F.monotonically_increasing_id().alias("_row")).withColumn("nv", F.sqrt(dot(F.col("v"), F.col("v"))))
    if n_blocks == 1:
        met = rows.withColumn("ex", held.select(F.first("ex")).scalar())      # at most ``block`` vectors, no join
    else:
        salts = F.lit(int(emb.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        met = (rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("b"), F.pmod(F.xxhash64("_row"), salts).alias("s"))
                   .join(held.select("*", F.explode(F.sequence(F.lit(0), salts - 1)).alias("s")), ["b", "s"]))
    # ascending (-similarity, exemplar) is the order of the ranks
    sims = F.transform("ex", lambda e: F.struct(
        F.when((F.col("nv") == 0) | (e["nc"] == 0), F.lit(0.0)).otherwise(-dot(F.col("v"), e["c"]) / (F.col("nv") * e["nc"])).alias("d"),
        e["l"].alias("exemplar")))
    best = met.select(key, "_row", F.slice(F.array_sort(F.filter(sims, lambda m: -m["d"] >= min_sim)), 1, k).alias("best"))
    if n_blocks > 1:
        best = best.where(F.size("best") > 0).groupBy("_row").agg(
            F.first(key).alias(key), F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    return best.select(key, F.posexplode("best").alias("pos", "m")).select(
        key, (F.col("pos") + 1).alias("rank"), F.col("m.exemplar").alias("exemplar"), r6(-F.col("m.d")).alias("similarity"))


# ------------------------------------------------------------------ RE-09..11
def intent_tags(df: DataFrame, text: str = "text", keys=("conv_id", "turn")) -> DataFrame:
    """RE-09: regex intent tags over whole texts."""
    tags = F.array_compact(F.array(*[F.when(F.col(text).rlike(p), F.lit(n)) for n, p in INTENT_LOCKS.items()]))
    return df.select(*keys, F.array_join(tags, ",").alias("tags"), F.size(tags).alias("n_tags"))


def _word_count(text: Column) -> Column:
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(t.isNull() | (t == ""), F.lit(0)).otherwise(F.size(F.split(t, r"\s+")))


def followup_turns(conv: DataFrame) -> DataFrame:
    """RE-10: is a user turn a follow-up (<= 6 words, refinement opener, or a short back-reference)?"""
    t = F.col("text")
    wc = _word_count(t)
    is_f = (F.when(wc == 0, F.lit(False))
             .when(wc <= 6, F.lit(True))
             .when(t.rlike(REFINE_START), F.lit(True))
             .when((wc <= 14) & t.rlike(DEICTIC), F.lit(True))
             .otherwise(F.lit(False)))
    return conv.where(F.col("role") == "user").select("conv_id", "turn", wc.alias("words"), is_f.alias("is_followup"))


def scope_carry(conv: DataFrame) -> DataFrame:
    """RE-10: latest '[active scope: ...]' marker carried by an earlier assistant turn."""
    mark = F.regexp_extract(F.col("text"), SCOPE_MARK, 1)
    m = F.when((F.col("role") == "assistant") & (mark != ""), F.trim(mark))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return (conv.withColumn("_m", m).withColumn("scope", F.last("_m", ignorenulls=True).over(w))
                .where(F.col("role") == "user").select("conv_id", "turn", "scope"))


def nonzero_fraction(df: DataFrame) -> DataFrame:
    """RE-11: share of non-zero values per numeric column (over non-null values)."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    aggs = [F.coalesce(F.avg(F.when(F.col(c).isNotNull(), F.when(F.col(c) != 0, 1.0).otherwise(0.0))), F.lit(0.0))
            .alias(f"f{i}") for i, c in enumerate(cols)]
    entries = ", ".join(f"'{c}', round(f{i}, 6)" for i, c in enumerate(cols))
    return df.agg(*aggs).selectExpr(f"stack({len(cols)}, {entries}) AS (column_name, nonzero_fraction)")
