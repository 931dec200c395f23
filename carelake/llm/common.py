"""Helpers shared by the training-data operators: scratch tables, row keys, Arrow batches."""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelake.session import ensure_checkpoint_dir

KEY = ["__llm_ka", "__llm_kb"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: lineage ends at the table."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` plus (__llm_ka, __llm_kb): two independent 64-bit hashes of (id, text) name a row.

    Column names that begin with ``__llm_`` are reserved. The keys are never null, so joins on them are plain equi-joins; rows with the same id
    and the same text (repeated rows) share a key and get the same result.
    """
    i, t = F.col(id_col), F.col(text_col)
    return docs.select("*", F.xxhash64(i, t, i.isNull(), t.isNull()).alias("__llm_ka"),
                       F.xxhash64(F.lit(7), t, i, t.isNull(), i.isNull()).alias("__llm_kb"))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, __llm_ka, __llm_kb) of ``docs``, whatever other columns it has."""
    pair = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return with_key(pair, "id", "text")


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` for a function that turns one record batch into column dicts."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    struct = StructType.fromDDL(schema)

    def run(batches):
        out = to_arrow_schema(struct)
        for batch in batches:
            for cols in fn(batch):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[f.name], type=f.type) for f in out], schema=out)
    return df.mapInArrow(run, struct)


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list:
    """UTF-8 bytes of a text column; null becomes empty."""
    return [b or b"" for b in batch.column(name).cast(pa.binary()).to_pylist()]


def bounded_sample(docs: DataFrame, labels: DataFrame, label: str, held_out, rows: int,
                   id_col: str = "doc_id", text_col: str = "text", extra: tuple = ()) -> list:
    """At most ``rows`` labelled training rows per class, chosen by a hash of the id.

    Labels of held-out ids and null labels are dropped before the join. The bound is the
    only sampling in a classifier: every other step covers all rows.
    """
    lab = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y")).where(
        F.col("_y").isNotNull() & F.col("_id").isNotNull() & ~held_out(F.col("_id"))).dropDuplicates(["_id"])
    counts = lab.agg(F.count_if(F.col("_y") == 1).alias("_n1"), F.count_if(F.col("_y") == 0).alias("_n0"))
    order = F.xxhash64(F.col("_id"), F.lit(11))
    picks = [lab.where(F.col("_y") == y).orderBy(order, "_id").limit(rows) for y in (0, 1)]
    chosen = picks[0].unionByName(picks[1]).join(F.broadcast(counts))      # one row of counts
    got = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"),
                      *[F.col(c).alias(f"_{c}") for c in extra]).join(F.broadcast(chosen), "_id")
    # at most 2 x rows labels were chosen, so both the broadcast and this collect are bounded
    return sorted(got.dropDuplicates(["_id"]).collect(), key=lambda r: (hash_of(r["_id"]), r["_id"]))


def prior_shift(got: list) -> float:
    """What the log-odds of a sample must be moved by to match the rates of all training labels."""
    y = [r["_y"] for r in got]
    return float(np.log((got[0]["_n1"] + 0.5) / (got[0]["_n0"] + 0.5)) -
                 np.log((sum(y) + 0.5) / (len(y) - sum(y) + 0.5)))


def hash_of(i: int) -> int:
    return (int(i) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF


def crc_bucket(id_column, n: int):
    return F.crc32(id_column.cast("string").cast("binary")) % n


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Adam:
    """Adam steps over a dict of numpy arrays."""

    def __init__(self, params: dict, rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.99 * self.v[k] + 0.01 * g * g
            mh, vh = self.m[k] / (1 - 0.9 ** self.t), self.v[k] / (1 - 0.99 ** self.t)
            self.params[k] -= (self.rate * mh / (np.sqrt(vh) + 1e-7)).astype(self.params[k].dtype)
