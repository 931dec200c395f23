"""Exact order statistics of whole tables by distributed selection.

``percentile`` gathers every distinct value of a group in one task. Here rows are first counted per
(key, value), which a hash shuffle spreads over all tasks and which makes ties one row.
The rank's bucket is then narrowed down twice, by order of magnitude and linearly inside
that bucket, from histograms of a few thousand rows; only the values of the last bucket
are put in order. All three levels read the same shuffled counts.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PER_OCTAVE, LINEAR = 64, 4096
_V, _N = "__v", "__n"


def magnitude(v: Column) -> Column:
    """An integer that never falls as ``v`` (DOUBLE) rises: ``PER_OCTAVE`` steps per power of two, the
    infinities and NaN (the largest value, as Spark orders) apart."""
    step = F.floor(F.log2(F.abs(v)) * PER_OCTAVE) + F.lit(100_000)
    # never null, so that no filter on it keeps the three levels from reading one shuffle
    return F.coalesce(F.when(F.isnan(v), F.lit(300_000)).when(v == float("inf"), F.lit(250_000)).when(
        v == float("-inf"), F.lit(-250_000)).when(v > 0, step).when(v < 0, -step), F.lit(0))


def _holding(hist: DataFrame, by: list[str], order: str, before: Column) -> DataFrame:
    """Rows of ``hist`` that hold ``__rank``, with ``__before``: how many values come before them."""
    up = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (hist.withColumn("__before", before + F.coalesce(F.sum(_N).over(up), F.lit(0)))
                .where((F.col("__before") <= F.col("__rank")) & (F.col("__rank") < F.col("__before") + F.col(_N))))


def quantiles(df: DataFrame, keys: list[str], value: Column, probs: list[float]) -> DataFrame:
    """(keys, p, value DOUBLE): for each key and probability the exact quantile of the non-null
    values, interpolated linearly between ranks as ``percentile`` does. Keys without values
    have no row, nor have null keys. The keys must be few (column names, labels): each has a histogram."""
    counted = (df.select(*keys, value.cast("double").alias(_V)).where(F.col(_V).isNotNull())
                 .groupBy(*keys, _V).agg(F.count(F.lit(1)).alias(_N)))
    rows = counted.withColumn("__b", magnitude(F.col(_V)))
    by, inner = [*keys, "__rank"], [*keys, "__b"]

    # level 1: the magnitude bucket of every rank; a rank is a row of its own from here on
    hist = rows.groupBy(*inner).agg(F.sum(_N).alias(_N), F.min(_V).alias("__lo"), F.max(_V).alias("__hi"))
    total = F.sum(_N).over(Window.partitionBy(*keys)) if keys else F.sum(_N).over(Window.partitionBy(F.lit(0)))
    hist = hist.withColumn("__total", total)
    pos = [(F.col("__total") - 1) * F.lit(float(p)) for p in probs]
    ranks = F.array_distinct(F.array(*[f(x).cast("bigint") for x in pos for f in (F.floor, F.ceil)]))
    hist = hist.select("*", F.explode(ranks).alias("__rank"))
    level = _holding(hist, by, "__b", F.lit(0)).select(*inner, "__rank", "__total", "__lo", "__hi", "__before")

    # level 2: equal steps between the least and the greatest value of that bucket
    width = F.col("__hi") - F.col("__lo")
    sub = F.when((width > 0) & (width < float("inf")), F.floor((F.col(_V) - F.col("__lo")) / width * LINEAR)).otherwise(F.lit(0))
    # one row per key and rank, so the broadcast is bounded by the number of keys
    near = rows.join(F.broadcast(level), inner).withColumn("__s", sub)
    per = [*by, "__total", "__b", "__s"]
    hist2 = near.groupBy(*per).agg(F.sum(_N).alias(_N), F.first("__before").alias("__start"))
    level2 = _holding(hist2, by, "__s", F.col("__start")).select(*per, "__before")

    # level 3: the values of one step, in order
    last = near.select(*per, _V, _N).join(F.broadcast(level2), per)
    found = _holding(last.withColumnRenamed("__before", "__start"), by, _V, F.col("__start"))
    at = found.groupBy(*keys, "__total").agg(F.map_from_entries(F.collect_list(F.struct("__rank", _V))).alias("__at"))
    picks = []
    for p in probs:
        x = (F.col("__total") - 1) * F.lit(float(p))
        lo, hi = F.floor(x).cast("bigint"), F.ceil(x).cast("bigint")
        a, b = F.element_at("__at", lo), F.element_at("__at", hi)
        picks.append(F.struct(F.lit(float(p)).alias("p"), F.when(a == b, a).otherwise((hi - x) * a + (x - lo) * b).alias("value")))
    return at.select(*keys, F.explode(F.array(*picks)).alias("__p")).select(*keys, "__p.p", "__p.value")


def medians(df: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """(keys, name): the exact median of each key."""
    return quantiles(df, keys, value, [0.5]).select(*keys, F.col("value").alias(name))


def with_median(df: DataFrame, keys: list[str], value: str, n: Column, name: str) -> DataFrame:
    """``df`` with the exact median of its key in ``name``, as ``percentile`` gives it: a row stands for ``n``
    equal values (0: not counted), and ``value`` occurs once in a key. The rows of a key are sorted, not
    held as an aggregate's state, so many small keys cost no buffer each and a large one spills."""
    every = Window.partitionBy(*keys)
    up = every.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = df.withColumn(_N, n).withColumn("__upto", F.sum(_N).over(up)).withColumn("__total", F.max("__upto").over(every))

    def at(rank: Column) -> Column:
        holds = (F.col("__upto") > rank) & (F.col("__upto") - F.col(_N) <= rank)
        return F.max(F.when(holds, F.col(value))).over(every)
    a, b = at(F.expr("(__total - 1) div 2")), at(F.expr("__total div 2"))
    rows = rows.withColumns({"__a": a, "__b": b})
    middle = F.when(F.col("__a") == F.col("__b"), F.col("__a")).otherwise(F.col("__a") * 0.5 + F.col("__b") * 0.5)
    return rows.withColumn(name, middle).drop(_N, "__upto", "__total", "__a", "__b")


def median(df: DataFrame, value: Column) -> Column:
    """The exact median of a whole table as a scalar subquery; NULL without values."""
    return medians(df, [], value, "m").scalar()


def stacked(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, value): the non-null values of several numeric columns as rows, for their quantiles by name."""
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns])
    return df.select(F.explode(cells).alias("c")).select("c.name", "c.value").where("value is not null")
