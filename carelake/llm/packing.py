"""Best-fit packing by minimum bin slack (operator 10).

Texts become token ids (a public byte-level BPE file) and an end id; longer documents are cut
into pieces of ``capacity`` tokens, the first of which may be shorter. Pieces are then
packed into sequences of at most ``capacity`` tokens. Minimum bin slack: for one bin at
a time, a bitset subset-sum dynamic program over the available lengths (largest first)
finds the fullest feasible combination, which is removed. A combination stays the
fullest while its lengths last, so it is removed as often as they allow at once.

Only the histogram of lengths (at most ``capacity`` rows) reaches the driver, and the plan
that comes back names for each length which ranks go to which bins; its size is bounded
by the capacity too, not by the number of pieces. Ranks within a length are dealt by
salted windows and a prefix sum over the salts, so no length needs one task.

Defined results: a null or empty text is one piece of just the end id; every row is its own
document, repeated rows and null ids included; an empty table gives an empty result.
"""
from __future__ import annotations

import base64
import os
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from carelake.llm.common import written

CAPACITY = 2048


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Token ids of whole texts, as little-endian 32-bit bytes, as the ``tokenizers`` file gives them.

    ``x.json`` may have the same vocabulary beside it as ranks (``x.tiktoken``), which
    encode to the same ids in a fifth of the time; texts with a special token's string, and
    files without ranks, go through ``tokenizers``.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        ranks = path.removesuffix(".json") + ".tiktoken"
        self.fast = None
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken
            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table,
                                          special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.fast is None or any(s in text for s in self.special):
            ids = self.tok.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id",
           text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids ARRAY<INT>]) of every document."""
    fields = [("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
              ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids
    schema = pa.schema(fields)
    ddl = "id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(tokenizer)
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for s in range(0, len(texts), 512):
                rows: list[list] = [[] for _ in fields]
                for name, text in zip(names[s:s + 512], texts[s:s + 512]):
                    ids = enc.encode(text) + end
                    n = len(ids) // 4
                    cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        part = ids[4 * a:4 * b]
                        row = [name, k, a, b - a, zlib.crc32(part)]
                        if with_ids:
                            row.append(np.frombuffer(part, "<u4").astype(np.int32))
                        for col, v in zip(rows, row):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(rows, fields)], schema=schema)
    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(run, ddl)


def fullest(counts: np.ndarray, capacity: int) -> dict[int, int]:
    """The fullest feasible combination {length: copies} over the available ``counts[length]``.

    Bit s of ``reach`` says that some combination of the lengths seen so far has sum s. The
    largest available length is always in the bin, as the one that is hardest to place.
    """
    top = int(np.flatnonzero(counts)[-1])
    room, limit = capacity - top, (1 << (capacity - top + 1)) - 1
    reach, steps = 1, []
    for length in np.flatnonzero(counts[:room + 1])[::-1].tolist():
        have = int(counts[length]) - (length == top)
        left = min(have, room // length)
        power = 1
        while left > 0 and not reach >> room & 1:      # copies in powers of two: log(copies) shifts
            take = min(power, left)
            steps.append((length, take, reach))
            reach |= reach << (length * take) & limit
            left, power = left - take, power * 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, {top: 1}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            out[length] = out.get(length, 0) + take
            at -= length * take
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple]:
    """Rows (length, first rank, end rank, copies, first bin, offset): pieces of ``length`` with
    rank r in [first, end) go to bin first_bin + (r - first) // copies, at
    offset + (r - first) % copies * length."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    used, rows, bins = np.zeros(capacity + 1, np.int64), [], 0
    while counts.any():
        combo = fullest(counts, capacity)
        times = min(int(counts[length]) // k for length, k in combo.items())
        offset = 0
        for length, k in combo.items():
            a = int(used[length])
            rows.append((length, a, a + times * k, k, bins, offset))
            used[length] += times * k
            counts[length] -= times * k
            offset += k * length
        bins += times
    return rows


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 0,
         id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; ``with_ids`` adds the token ids themselves."""
    spark = docs.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = pieces(docs, tokenizer or default_tokenizer(), capacity, end_id, id_col, text_col, with_ids)
    rows = written(made.withColumn("_salt", F.pmod(F.xxhash64("id", "piece", "start", "ids_crc32"), F.lit(salts))),
                   "pieces")
    cells = written(rows.groupBy("length", "_salt").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.createDataFrame(
        plan(histogram, capacity), "length bigint, first bigint, end bigint, copies bigint, bin bigint, at bigint")
    # at most `salts` rows per length are ordered here, the pieces themselves per (length, salt)
    before = cells.select("length", "_salt", (F.sum("n").over(
        Window.partitionBy("length").orderBy("_salt")) - F.col("n")).alias("_before"))
    in_cell = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("id", "piece", "start")) - 1
    ranked = rows.withColumn("_in", in_cell).join(before, ["length", "_salt"]).withColumn(
        "_rank", F.col("_before") + F.col("_in"))
    slot = F.broadcast(slots)      # bounded by the capacity: see plan()
    within = F.col("_rank") - F.col("first")
    cols = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    return ranked.join(slot, "length").where("_rank >= first and _rank < end").select(
        *cols, (F.col("bin") + F.expr("(_rank - first) div copies")).alias("sequence_id"),
        (F.col("at") + within % F.col("copies") * F.col("length")).alias("offset"))
