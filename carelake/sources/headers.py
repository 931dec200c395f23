"""SRC-05..08: landed files as tables - their listing, their headers, one read per header.

The listing comes from the file index and its sizes. The headers of all files come from one job that takes the first line of every file, so neither grows into
a driver read per path. Files with the same header are one read with a given schema, which
needs no look at the files.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def path_key(path: Column) -> Column:
    """One spelling of a file's path, from ``binaryFile`` (plain) or ``_metadata`` (escaped)."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def _glob(ext: str) -> str:
    """Names of landed files, as they are or packed by gzip."""
    return f"*.{ext}{{,.gz}}"


def _unescaped(path: Column) -> Column:
    return path_key(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))))


def _found(make, spark: SparkSession, schema: str) -> DataFrame:
    try:
        return make()
    except Exception as e:      # a folder or pattern without files
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def list_landed(spark: SparkSession, tagged: dict[str, list[str]], ext: str = "csv") -> DataFrame:
    """(tag, path, bytes) of every file under the folders and patterns of each tag.

    Names come from the file index that any read builds, as scans leave out files of no bytes.
    """
    names, sizes = [], []
    for t, paths in sorted(tagged.items()):
        for p in paths:
            found = _found(lambda p=p: spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
                "pathGlobFilter", _glob(ext)).load(p).select("path", "length"), spark, "path string, length bigint")
            names += [(t, f) for f in found.inputFiles()]
            sizes.append(found.select(F.lit(t).alias("tag"), path_key(F.col("path")).alias("path"), F.col("length").alias("bytes")))
    listed = spark.createDataFrame(names, "tag string, path string").select("tag", _unescaped(F.col("path")).alias("path"))
    return listed.join(reduce(lambda a, b: a.unionByName(b), sizes), ["tag", "path"], "left").select(
        "tag", "path", F.coalesce("bytes", F.lit(0)).alias("bytes"))


def header_fields(line: Column) -> Column:
    """The trimmed fields of a CSV header line, quotes and a byte-order mark removed."""
    bare = F.regexp_replace(line, "^\ufeff", "")
    return F.transform(F.split(bare, r',(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda f: F.trim(F.regexp_replace(F.trim(f), '^"|"$', "")))


def headers(spark: SparkSession, tagged: dict[str, list[str]], ext: str = "csv") -> DataFrame:
    """(tag, path, header ARRAY<STRING>) of every file that has a first line, in one job.

    The rows of a file's first split are numbered in order, so its header is the value with the
    least number; that is combined map-side to one row a file.
    """
    def lines(tag, p):
        rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", _glob(ext)).text(p)
        return rows.where(F.col("_metadata.file_block_start") == 0).select(
            F.lit(tag).alias("tag"), _unescaped(F.col("_metadata.file_path")).alias("path"), "value")
    parts = [_found(lambda p=p, t=t: lines(t, p), spark, "tag string, path string, value string") for t, paths in sorted(tagged.items()) for p in paths]
    rows = reduce(lambda a, b: a.unionByName(b), parts).withColumn("n", F.monotonically_increasing_id())
    first = rows.groupBy("tag", "path").agg(F.min_by("value", "n").alias("line"))
    return first.select("tag", "path", header_fields(F.col("line")).alias("header"))


def _names(header: list[str]) -> list[str]:
    """Column names of a header: blanks and repeats get their position."""
    low = [h.lower() for h in header]
    return [h if h and low.index(h.lower()) == i else f"{h}_{i}" for i, h in enumerate(header)]


def read_by_header(spark: SparkSession, tagged: dict[str, list[str]], ext: str = "csv") -> list[tuple[str, list[str], list[str], DataFrame]]:
    """(tag, column names, files, rows as text with ``file_path``) per header; one job whatever the number of files."""
    alike = headers(spark, tagged, ext).groupBy("tag", "header").agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy("tag", "header")
    out = []
    for r in alike.collect():      # one row per header
        names = _names(r["header"])
        df = spark.read.option("header", True).schema(StructType([StructField(n, StringType()) for n in names])).csv(r["paths"])
        out.append((r["tag"], names, r["paths"], df.select("*", _unescaped(F.col("_metadata.file_path")).alias("file_path"))))
    return out


def unpivot_periods(df: DataFrame, keys: list[str], pattern: str) -> DataFrame:
    """Wide card files: the columns whose header matches ``pattern`` become (period, value) rows."""
    import re
    periods = [c for c in df.columns if c not in keys and re.search(pattern, c)]
    if not periods:
        raise ValueError(f"no column matches {pattern}")
    return df.select(*keys, *[F.col(f"`{c}`").try_cast("double").alias(c) for c in periods]).unpivot(keys, periods, "period", "value")
