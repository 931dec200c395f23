"""SimHash near-duplicates by covering locality-sensitive hashing (operator 7).

Words are runs without ASCII white space of the ASCII-lowered text, shingles are
``shingle`` consecutive words, and bit i of the 64-bit fingerprint is set when more than
half of the shingle hashes (XXH64, seed 42) set it. Fingerprints within ``max_bits``
differing bits are linked.

Candidates: bit i gets the label m(i) in {1 .. 2^(r+1)-1}; table v keeps the bits with odd
<m(i), v>. Any r differing bits span fewer than r+1 dimensions, so some v is orthogonal
to all their labels and that table drops exactly such bits: every pair within the radius
r meets in a bucket. Links inside buckets: two fingerprints at distance 2 share the
midpoint that flips one bit of each, so the members of shared buckets emit themselves
and their one-bit flips over the dropped bits; the at most 65 fingerprints around one
midpoint are pairwise within 2 bits and form a star. No bucket is expanded into
pairs, and a bucket of any size is only counted, never gathered.

Defined results: null, empty and blank texts have fingerprint 0 and link like any
other; repeated rows get the same component; a null id does not lower a component
id; an empty table gives an empty result; extra input columns are ignored.
"""
from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.llm.common import KEY, arrow_map, keyed, text_bytes, with_key, written
from carelake.llm.components import connected_components

SEED = 42


def fingerprint(text: bytes, shingle: int) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in
                  zip(starts[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist())]
    h = np.array(hashes, np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i:i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, __llm_ka, __llm_kb, fp BIGINT) per row."""
    def run(batch):
        yield {"id": batch.column("id"), "__llm_ka": batch.column("__llm_ka"), "__llm_kb": batch.column("__llm_kb"),
               "fp": np.array([fingerprint(t, shingle) for t in text_bytes(batch)], np.int64)}
    rows = keyed(docs, id_col, text_col).withColumn("id", F.col("id").cast("bigint"))
    return arrow_map(rows, run, "id bigint, __llm_ka bigint, __llm_kb bigint, fp bigint")


def keep_masks(radius: int) -> list[int]:
    """Kept bits of the 2^(r+1)-1 covering tables, as signed 64-bit masks."""
    n = 2 ** (radius + 1) - 1
    labels = [1 + i % n for i in range(64)]
    masks = [sum(1 << i for i, m in enumerate(labels) if bin(m & v).count("1") % 2) for v in range(1, n + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links (a, b) of the distinct fingerprints ``fps`` (fp) whose components are those of
    all pairs within ``max_bits`` (0, 1 or 2)."""
    if max_bits not in (0, 1, 2):
        raise ValueError("max_bits must be 0, 1 or 2")
    if max_bits == 0:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    masks = F.array(*[F.lit(m).cast("bigint") for m in keep_masks(max_bits)])
    rows = fps.select("fp", F.posexplode(masks).alias("t", "mask")).select(
        "fp", "t", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    shared = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    near = rows.join(shared, ["t", "key"]).groupBy("fp").agg(
        F.bit_or(F.bitwise_not("mask")).alias("dropped"))
    flips = F.filter(F.sequence(F.lit(0), F.lit(63)),
                     lambda i: F.getbit(F.col("dropped"), i) == 1)
    around = near.select("fp", F.explode(F.concat(
        F.array(F.lit(0).cast("bigint")),
        F.transform(flips, lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), i)))).alias("flip"))
    # all fingerprints around one midpoint: at most 1 + 64 by construction
    star = around.select(F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"), "fp").groupBy("mid").agg(
        F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    if max_bits == 1:   # only the midpoint itself is within one bit of the others
        centre = star.where(F.array_contains("fps", F.col("mid"))).withColumn("b", F.col("mid"))
    else:
        centre = star.withColumn("b", F.array_min("fps"))
    out = centre.select(F.explode("fps").alias("a"), "b").where("a <> b")
    return out.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)


def simhash_groups(docs: DataFrame, shingle: int = 3, max_bits: int = 2,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, __llm_ka, __llm_kb, fp, component_id) per row; component_id is the least id reachable."""
    rows = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    classes = rows.groupBy("fp").agg(F.min("id").alias("least"))
    comp = connected_components(links(classes.select("fp"), max_bits))
    rooted = classes.join(comp, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.join(named, "root").select("fp", "component_id")
    return rows.join(of, "fp")


def one_per_group(docs: DataFrame, shingle: int = 3, max_bits: int = 2,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` per near-duplicate group, all columns: the row with the least id
    (ids that are null last; between rows of one id the least row key). ``docs`` is read twice."""
    g = simhash_groups(docs, shingle, max_bits, id_col, text_col)
    # groups without any id have no component id: their fingerprint stands for it
    unit = [F.col("component_id"), F.when(F.col("component_id").isNull(), F.col("fp")).alias("_fp")]
    least = g.select(*unit, F.struct(F.col("id").isNull(), "id", *KEY).alias("r")).groupBy(
        "component_id", "_fp").agg(F.min("r").alias("r")).select("r.__llm_ka", "r.__llm_kb")
    return with_key(docs, id_col, text_col).join(least, KEY).dropDuplicates(KEY).drop(*KEY)
