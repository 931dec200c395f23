"""URL filters by a temporal list join (operator 2, DataFrame functions only).

A list entry is dated: from ``effective_at`` it adds its key to a list or removes it, until
the next entry of the same list and key. A key is a domain (``d:example.org``, which covers
its subdomains) or a path prefix (``p:host/a/b``, which covers what lies below). Every
capture is evaluated against the entries that were active when it was fetched.

As-of join: captures and entries meet in one ordering by (list, key, time) and each capture
takes the last entry before it. Both steps, the validity intervals and the as-of
state, run in time buckets: a window inside (list, key, bucket), and one over the
buckets of a key that only sees one pre-aggregated row per bucket. A host with a third
of all captures is thus many small windows, and no interval is spread over the days it
covers.

Defined results: a null or unparsable url, or a null fetch time, matches nothing and is
kept; an entry with a null key, list or time is ignored; of entries for one key at one
instant the largest id holds, and an entry holds from its very instant; repeated
captures each get their row; empty lists keep everything; other columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from carelake.llm.common import KEY


def host(url: Column) -> Column:
    """Lower-case host without user, port and trailing dot; null when there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    h = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"(\.?:[0-9]*|\.)$", ""))
    return F.when(h != "", h)


def segments(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda s: s != "")


def domain_keys(h: Column) -> Column:
    labels = F.split(h, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(
        F.lit("d:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))


def prefix_key(h: Column, segs: Column, n) -> Column:
    return F.concat(F.lit("p:"), F.array_join(F.concat(F.array(h), F.slice(segs, F.lit(1), n)), "/"))


def keys(url: Column) -> Column:
    """All keys that cover a url; none for a url without host."""
    h, segs = host(url), segments(url)
    prefixes = F.transform(F.sequence(F.lit(0), F.size(segs)), lambda n: prefix_key(h, segs, n))
    return F.when(h.isNull(), F.array().cast("array<string>")).otherwise(F.concat(domain_keys(h), prefixes))


def validity(entries: DataFrame, bucket_hours: int = 6) -> DataFrame:
    """(entry_id, list, key, adds, valid_from, valid_to, bucket); valid_to is null while open."""
    e = entries.select("entry_id", F.col("list_name").alias("list"), "key", F.coalesce("adds", F.lit(False)).alias("adds"),
                       F.col("effective_at").alias("valid_from"), _bucket("effective_at", bucket_hours)).where(
        F.col("list").isNotNull() & F.col("key").isNotNull() & F.col("valid_from").isNotNull())
    by = ["list", "key", "bucket"]
    inside = Window.partitionBy(*by).orderBy("valid_from", "entry_id")
    firsts = e.groupBy(*by).agg(F.min("valid_from").alias("first"))
    after = firsts.select(*by, F.lead("first").over(Window.partitionBy("list", "key").orderBy("bucket")).alias("_after"))
    return e.withColumn("_next", F.lead("valid_from").over(inside)).join(after, by).select(
        "entry_id", "list", "key", "adds", "valid_from", F.coalesce("_next", "_after").alias("valid_to"), "bucket")


def _bucket(t: str, hours: int) -> Column:
    return F.floor(F.unix_timestamp(F.col(t).cast("timestamp")) / (3600 * hours)).alias("bucket")


def evaluate(captures: DataFrame, entries: DataFrame, block_list: str = "block", allow_list: str = "allow",
             bucket_hours: int = 6, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """(id, url, fetched_at, host, verdict, entry_id, list, key, valid_from, valid_to) per capture.

    The verdict is ``allow`` if an allow entry is active for the capture, else ``block`` if a
    block entry is, else ``keep``; the entry named is the most specific one of that list.
    """
    # numbered so that repeated captures stay apart; an id is only compared inside one job
    c = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(time_col).alias("at"))
    c = c.groupBy("id", "url", "at").agg(F.count("*").alias("copies")).select(
        "*", F.xxhash64("id", "url", "at").alias(KEY[0]), F.xxhash64(F.lit(7), "url", "at", "id").alias(KEY[1]))
    asks = c.where("at is not null").select(*KEY, "at", F.explode(keys(F.col("url"))).alias("key")).select(
        "*", F.explode(F.array(F.lit(block_list), F.lit(allow_list))).alias("list"))
    held = F.struct("valid_from", "entry_id", "adds", "valid_to")
    v = validity(entries, bucket_hours).where(F.col("list").isin(block_list, allow_list))
    both = v.select("list", "key", "bucket", F.col("valid_from").alias("at"), F.lit(0).alias("ask"), "entry_id",
                    held.alias("held"), *[F.lit(None).cast("bigint").alias(k) for k in KEY]).unionByName(
        asks.select("list", "key", _bucket("at", bucket_hours), "at", F.lit(1).alias("ask"), F.lit(None).alias("entry_id"),
                    F.lit(None).alias("held"), *KEY))
    by = ["list", "key", "bucket"]
    last = F.last("held", ignorenulls=True)
    inside = Window.partitionBy(*by).orderBy("at", "ask", "entry_id").rowsBetween(Window.unboundedPreceding, 0)
    per_bucket = both.groupBy(*by).agg(F.max("held").alias("held"))
    before = Window.partitionBy("list", "key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_bucket.select(*by, last.over(before).alias("_carried")).where("_carried is not null")
    state = both.withColumn("_in", last.over(inside)).where("ask = 1").join(carried, by, "left").select(
        *KEY, "list", "key", F.coalesce("_in", "_carried").alias("held")).where("held.adds")
    best = state.groupBy(*KEY).agg(F.max(F.struct(
        (F.col("list") == allow_list).alias("allowed"), F.length("key").alias("n"), "key", "list",
        F.col("held.entry_id").alias("entry_id"), F.col("held.valid_from").alias("valid_from"),
        F.col("held.valid_to").alias("valid_to"))).alias("m"))
    return c.join(best, KEY, "left").select(
        "id", "url", F.col("at").alias("fetched_at"), host(F.col("url")).alias("host"),
        F.when(F.col("m").isNull(), "keep").when(F.col("m.allowed"), "allow").otherwise("block").alias("verdict"),
        "m.entry_id", "m.list", "m.key", "m.valid_from", "m.valid_to",
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("_copy")).drop("_copy")
