"""Small building blocks shared by the insight operators."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carelake.operators.order_stats import medians


def for_plant(df: DataFrame, plant: str | None) -> DataFrame:
    """FLT-01 on a resolved plant code: None / 'ALL' means every plant."""
    if not plant or plant.upper() == "ALL":
        return df
    return df.where(F.col("plant") == plant)


def band_table(df: DataFrame, band: Column, labels: list[str], measures: dict) -> DataFrame:
    """SET-05: one row per fixed label (zeros for empty bands) without a skeleton frame.

    ``measures`` maps output name -> (kind, column) with kind in sum / count / nunique.
    Conditional aggregation runs as ONE partial-aggregated pass; ``stack`` then turns
    the single row into len(labels) rows in label order (column ``ord``). Distinct counts of
    one column are first grouped by (band, column), so that no row is copied per label.
    """
    shown, distinct = measures, {col for kind, col in measures.values() if kind == "nunique"}
    if len(distinct) == 1 and all(kind in ("sum", "count", "nunique") for kind, _ in measures.values()):
        key = distinct.pop()
        parts = [(F.count(F.lit(1)) if kind == "count" else F.sum(col)).alias(f"__{name}")
                 for name, (kind, col) in measures.items() if kind != "nunique"]
        df = df.groupBy(band.alias("__band"), F.col(key).alias("__key")).agg(*parts)
        band = F.col("__band")
        measures = {name: ("seen", "__key") if kind == "nunique" else ("total" if kind == "count" else kind, f"__{name}")
                    for name, (kind, _) in measures.items()}
    aggs = []
    for i, lab in enumerate(labels):
        hit = band == F.lit(lab)
        for name, (kind, col) in measures.items():
            if kind == "sum":
                e = F.coalesce(F.sum(F.when(hit, F.col(col))), F.lit(0)).cast("double")
            elif kind == "count":
                e = F.count_if(F.coalesce(hit, F.lit(False)))
            elif kind == "total":
                e = F.coalesce(F.sum(F.when(hit, F.col(col))), F.lit(0))
            elif kind == "seen":
                e = F.count_if(F.coalesce(hit & F.col(col).isNotNull(), F.lit(False)))
            elif kind == "nunique":
                e = F.count_distinct(F.when(hit, F.col(col)))
            elif kind == "avg":
                e = F.coalesce(F.avg(F.when(hit, F.col(col))), F.lit(0.0)).cast("double")
            elif kind == "median":      # filled in below
                e = F.lit(0.0)
            else:
                raise ValueError(kind)
            aggs.append(e.alias(f"{name}__{i}"))
    row = df.agg(*aggs)
    names = list(measures)
    parts = []
    for i, lab in enumerate(labels):
        esc = lab.replace("'", "\\'")
        parts.append(f"'{esc}', {i}, " + ", ".join(f"`{n}__{i}`" for n in names))
    expr = f"stack({len(labels)}, {', '.join(parts)}) AS (label, ord, {', '.join(names)})"
    out = row.selectExpr(expr)
    for name, (kind, col) in shown.items():
        if kind == "median":
            half = medians(df.select(band.alias("label"), F.col(col).alias("__of")).where(F.col("label").isin(labels)),
                           ["label"], F.col("__of"), "__median")
            out = out.join(half, "label", "left").withColumn(name, F.coalesce("__median", F.lit(0.0))).drop("__median")
    def fmt(n):
        kind = shown[n][0]
        if kind == "sum":
            return F.round(F.col(n), 4).alias(n)
        if kind in ("avg", "median"):
            return F.round(F.col(n), 6).alias(n)
        return F.col(n)
    return out.select("label", "ord", *[fmt(n) for n in names])


def first_rows(df: DataFrame, limit: int | None, *order) -> DataFrame:
    """All rows, or the first ``limit`` in the given order."""
    return df if limit is None else top_n(df, limit, *order)


def top_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """TOP-02: ordered limit (TakeOrderedAndProject: per-partition top-n, then merge)."""
    return df.orderBy(*order).limit(n)


def leaders_and_count(df: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """One row: ``n`` rows of ``df`` (one per key), and ``top``, the sum of the ``k`` largest values.

    Both come from one pass: the leaders of every hash bucket, ``k`` at most, meet in the last step.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(64))
    rank = F.row_number().over(Window.partitionBy("__b").orderBy(F.desc_nulls_last(value), key))
    rows = df.select(bucket.alias("__b"), key, value).withColumn("__r", rank)
    part = rows.groupBy("__b").agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.when(F.col("__r") <= k, F.col(value))).alias("vs"))
    best = F.slice(F.sort_array(F.flatten(F.collect_list("vs")), asc=False), 1, k)
    total = F.aggregate(best, F.lit(0.0), lambda a, v: a + v)
    return part.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.when(F.size(best) > 0, total).alias("top"))


def ranked(df: DataFrame, n: int, *order: Column, rank_col: str = "rank") -> DataFrame:
    """WIN-09: top-n with a 1-based rank column (the window runs on the n kept rows only)."""
    top = df.orderBy(*order).limit(n)
    return top.withColumn(rank_col, F.row_number().over(Window.orderBy(*order)))


def key_medians(df: DataFrame, keys: list[str], value: str, name: str, count: str = "n") -> DataFrame:
    """Exact median of ``value`` and row count per key. Rows are first counted per (key, value),
    which spreads a hot key over tasks; what meets in one task is a key's distinct values."""
    seen = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    return seen.groupBy(*keys).agg(F.percentile(F.col(value).cast("double"), F.lit(0.5), F.col("__n")).alias(name),
                                   F.sum("__n").alias(count))


def running_shares(df: DataFrame, value: str, label: str) -> DataFrame:
    """WIN-04: ``share`` of the total in percent, rank ``rk`` and running share ``cum`` by (value
    descending, label ascending, null values last), for any number of rows. Rows fall into
    buckets by magnitude (64 an octave); a window over the bucket totals gives each bucket
    what lies before it, and every bucket is ranked on its own."""
    total = df.select(F.sum(value)).scalar()
    v = F.col(value).cast("double")
    step = F.floor(F.log2(F.abs(v)) * 64) + F.lit(100_000)
    bucket = F.when(v > 0, step).when(v < 0, -step).when(v == 0, F.lit(0)).otherwise(F.lit(-1_000_000))
    rows = (df.withColumn("share", F.when(total > 0, F.col(value) / total * 100).otherwise(F.lit(0.0)))
              .withColumn("__b", bucket))
    before = Window.orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    starts = (rows.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"), F.sum("share").alias("__s"))
                  .select("__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n"),
                          F.coalesce(F.sum("__s").over(before), F.lit(0.0)).alias("__s")))
    inside = Window.partitionBy("__b").orderBy(F.desc(value), F.asc(label))
    so_far = F.sum("share").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return (rows.join(starts, "__b")
                .withColumn("rk", F.col("__n") + F.row_number().over(inside))
                .withColumn("cum", F.col("__s") + F.coalesce(so_far, F.lit(0.0)))
                .drop("__b", "__n", "__s"))


def key_month_grid(rows: DataFrame, key: str, months: DataFrame, ym: str = "ym") -> DataFrame:
    """SET-06 skeleton: every (key, month) pair for the keys in ``rows`` and the months in ``months``.

    The month list is one bounded scalar subquery (distinct months, partial aggregation)
    exploded against the top-k keys: no join of any kind builds the grid.
    """
    arr = months.select(F.array_sort(F.collect_set(F.col(ym)))).scalar()
    return rows.select(key, arr.alias("_months")).select(key, F.explode("_months").alias(ym))
