"""Embedding near-duplicates by random-hyperplane sign hashing (operator 9).

``TABLES`` tables of ``BITS`` hyperplane signs give every vector a bucket per table. At
cosine 0.98 two vectors agree on a sign with probability 0.936, so a pair misses all
tables with probability below 1e-4 (and further below as the cosine grows). Only buckets
with at least two vectors receive the vectors themselves; there the cosine is computed
in double precision. Buckets larger than ``BLOCK`` are dealt as pairs of blocks over
many tasks, each pair once, so no bucket is gathered whole and none is capped. A task
returns for every vector how many links it has found first in this table and one linked
vector of a spanning star, never the pairs, and equal vectors are one class from the start.

Defined results: vectors that are null, zero, or hold null or non-finite components, and
those with a null group, link with nothing; vectors of unequal length never link; a null
id has no links and is its own (null) component; repeated ids are separate vectors, each
with the links and the component of its own vector; an empty table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.llm.common import written
from carelake.llm.components import connected_components

TABLES, BITS, BLOCK = 26, 16, 512


def planes(dim: int, seed: int = 17) -> np.ndarray:
    return np.random.default_rng([seed, dim]).normal(size=(dim, TABLES * BITS))


def signatures(v: np.ndarray) -> np.ndarray:
    """(rows, TABLES) bucket numbers below 2^BITS."""
    bits = (v @ planes(v.shape[1])) > 0
    return np.packbits(bits.reshape(len(v), TABLES, BITS), axis=2).view(">u2")[:, :, 0].astype(np.int32)


def _classes(vectors: DataFrame, id_col: str, vec_col: str, group_col: str) -> DataFrame:
    """(g, v, members, least): usable vectors, equal ones once."""
    v = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(group_col).alias("g"),
                       F.col(vec_col).cast("array<double>").alias("v"))
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    return v.where(F.col("id").isNotNull() & F.col("g").isNotNull() & F.col("v").isNotNull() & fine)


def _sign(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("c", pa.int64()), ("members", pa.int64()), ("g", pa.string()), ("v", pa.binary()), ("sig", pa.list_(pa.int32()))])
        for b in batches:
            ids, members, groups = (b.column(i).to_pylist() for i in range(3))
            lists = b.column(3)
            flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            rows = []
            for dim in np.unique(np.diff(ends)):      # vectors of unequal length have their own planes
                at = np.flatnonzero(np.diff(ends) == dim)
                m = flat[ends[at][:, None] + np.arange(dim)[None, :]]
                m = m / np.abs(m).max(1, keepdims=True)
                rows += [(ids[i], members[i], f"{dim}:{groups[i]}", m[k].astype("<f8").tobytes(), s)
                         for k, (i, s) in enumerate(zip(at, signatures(m)))]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), out)]
                                             if rows else [pa.array([], f.type) for f in out], schema=out)
    return classes.select("c", "members", F.col("g").cast("string"), "v").mapInArrow(
        run, "c bigint, members bigint, g string, v binary, sig array<int>")


def _link_task(threshold: float):
    def star(x, y):
        """Spanning links of the graph given by index pairs."""
        root: dict = {}

        def find(i):
            while root.setdefault(i, i) != i:
                root[i] = root[root[i]]
                i = root[i]
            return i
        kept = []
        for i, j in zip(x.tolist(), y.tolist()):
            a, b = find(i), find(j)
            if a != b:
                root[b] = a
                kept.append((i, j))
        return kept

    def run(key, t):
        table, two = key[1].as_py(), key[3].as_py() != key[4].as_py()
        c, n, block = t.column("c").to_numpy(), t.column("members").to_numpy(), t.column("b").to_numpy()
        sig = t.column("sig").combine_chunks().values.to_numpy().reshape(len(c), TABLES)
        v = np.frombuffer(b"".join(t.column("v").to_pylist()), "<f8").reshape(len(c), -1)
        v = v / np.sqrt((v * v).sum(1, keepdims=True))
        left = np.flatnonzero(block == key[3].as_py()) if two else np.arange(len(c))
        right = np.flatnonzero(block == key[4].as_py()) if two else left
        x, y = np.nonzero(v[left] @ v[right].T >= threshold)
        x, y = left[x], right[y]
        if not two:
            x, y = x[x < y], y[x < y]
        new = ~(sig[x, :table] == sig[y, :table]).any(1)      # pairs that met in an earlier table count there
        found = np.zeros(len(c), np.int64)
        np.add.at(found, x[new], n[y[new]])
        np.add.at(found, y[new], n[x[new]])
        links = star(x, y)
        has = np.flatnonzero(found)
        return pa.table({"c": pa.array(np.concatenate((c[has], c[[i for i, _ in links]] if links else c[:0]))),
                         "found": pa.array(np.concatenate((found[has], np.zeros(len(links), np.int64)))),
                         "other": pa.array([None] * len(has) + [int(c[j]) for _, j in links], pa.int64())})
    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding",
                    group_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) per row of ``vectors``."""
    usable = _classes(vectors, id_col, vec_col, group_col)
    # a class has a number of its own, which is fixed once it is written: ids may repeat on other vectors
    classes = written(usable.groupBy("g", "v").agg(F.min("id").alias("least"), F.count("*").alias("members"))
                      .withColumn("c", F.monotonically_increasing_id()), "vector-classes")
    signed = written(_sign(classes), "signed")
    keys = signed.select("c", "g", F.posexplode("sig").alias("t", "key"))
    shared = keys.groupBy("g", "t", "key").agg(F.count("*").alias("n")).where("n > 1").select(
        "g", "t", "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    meet = keys.join(shared, ["g", "t", "key"]).select("c", F.struct("t", "key", "blocks").alias("m"))
    meet = meet.groupBy("c").agg(F.collect_list("m").alias("ms"))      # at most TABLES entries
    dealt = signed.join(meet, "c").select("*", F.explode("ms").alias("m")).select(
        "g", "m.t", "m.key", "m.blocks", "c", "members", "v", "sig",
        F.pmod(F.xxhash64("c"), F.col("m.blocks")).cast("int").alias("b"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")).select(
        "g", "t", "key", F.least("b", "o").alias("b1"), F.greatest("b", "o").alias("b2"), "b", "c", "members", "v", "sig")
    found = written(dealt.groupBy("g", "t", "key", "b1", "b2").applyInArrow(
        _link_task(threshold), "c bigint, found bigint, other bigint"), "vector-links")
    comp = connected_components(found.where("other is not null").select(F.col("c").alias("a"), F.col("other").alias("b")))
    n = found.groupBy("c").agg(F.sum("found").alias("found"))
    linked = classes.join(n, "c", "left").join(comp, F.col("c") == F.col("node"), "left").withColumn(
        "component", F.coalesce("component", "c"))
    # components are named by their least id
    names = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    of = linked.join(names, "component").select(
        "g", "v", (F.coalesce("found", F.lit(0)) + F.col("members") - 1).cast("bigint").alias("n_links"), "component_id")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(group_col).alias("g"),
                          F.col(vec_col).cast("array<double>").alias("v"))
    out = rows.join(of, (rows.id.isNotNull()) & (rows.g == of.g) & (rows.v == of.v), "left").select(
        "id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
