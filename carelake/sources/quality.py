"""SRC-11: data-quality report - row counts, distinct dimension members, months with data."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dq_report(facts: dict, dims: dict, consumption: DataFrame) -> DataFrame:
    """(metric, value) rows: one single-row aggregate per table, unioned (no driver loop over data)."""
    parts = [df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(f"{n}_rows").alias("metric"), "value")
             for n, df in facts.items()]
    parts += [df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(f"{n}_count").alias("metric"), "value")
              for n, df in dims.items()]
    months = (consumption.groupBy(F.date_format("posting_date", "yyyy-MM").alias("ym"))
                         .agg(F.count(F.lit(1)).alias("value"))
                         .select(F.concat(F.lit("consumption_rows_"), F.col("ym")).alias("metric"), "value"))
    n_months = consumption.agg(F.countDistinct(F.date_format("posting_date", "yyyy-MM")).alias("value")).select(
        F.lit("months_with_consumption").alias("metric"), "value")
    return reduce(lambda a, b: a.unionByName(b), parts + [months, n_months])
