"""Language-model scoring with stupid backoff, computed relationally (operator 5).

Every document's n-grams up to ``order`` words are counted over the whole corpus and each word
is scored by the longest n-gram ending in it that occurs at least ``min_count`` times,
as count over count of its history, with a factor ``alpha`` per order backed off; the
last resort is the word's share of all words.

The relations are columnar. The corpus becomes a written table of blocks (texts as word
numbers, with the hashes of the words). A block's request names its distinct n-grams once:
their sorted hashes with local counts, cut into hash ranges. A range adds up the
counts of all blocks, which is the count table partitioned by hash, and answers every
block with the counts of its n-grams in order; the join of answers and blocks is by
block number, and the scores are summed per document inside it. A frequent n-gram is one
entry per block, so no range is hot. What is shuffled is about five bytes per distinct
n-gram and block, and one or two per word.

N-grams are known by ``HASH_BITS``-bit hashes. Defined results: null, empty and wordless
texts have 0 words and a null mean; repeated rows are documents of their own and count;
null ids are allowed; an empty table gives an empty result.
"""
from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.llm.common import written
from carelake.llm.suffixes import Hasher

HASH_BITS = 52
BLOCK_WORDS = 1_500_000
CHUNK = 1 << 18          # bytes hashed at a time, up to the last word that ends there
IS_WORD = np.array([chr(i).isalnum() if i < 128 else True for i in range(256)])


def pack(x) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(x))


def unpack(b: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(b))


def word_hashes(text: bytes, hasher: Hasher) -> np.ndarray:
    a = np.frombuffer(text.lower(), np.uint8)
    parts, at = [np.empty(0, np.uint64)], 0
    while at < len(a):
        to = min(at + CHUNK, len(a))
        if to < len(a):
            gaps = np.flatnonzero(~IS_WORD[a[at:to]])
            while not len(gaps) and to < len(a):      # a word longer than a chunk stays one word
                gaps = np.flatnonzero(~IS_WORD[a[to:to + CHUNK]])[:1] + (to - at)
                to = min(to + CHUNK, len(a))
            to = at + int(gaps[-1]) + 1 if len(gaps) else to
        part = a[at:to]
        if len(part) > CHUNK:
            hasher = Hasher(len(part))
        step = np.diff(np.concatenate(([0], IS_WORD[part].view(np.int8), [0])))
        start = np.flatnonzero(step == 1)
        parts.append(hasher(part, np.flatnonzero(step == -1) - start, start))
        at = to
    return np.concatenate(parts)


def ngrams(words: np.ndarray, first: np.ndarray, order: int) -> list[np.ndarray]:
    """Per order 1..n the hash of the n-gram ending at each word; 0 where a text has no such."""
    place = np.arange(len(words)) - first      # of a word in its text
    out, h = [], np.zeros(len(words), np.uint64)
    for n in range(1, order + 1):
        if n == 1:
            h = words.copy()
        else:      # extend the (n-1)-gram that ended one word before
            h = np.concatenate((np.zeros(1, np.uint64), h[:-1])) * np.uint64(0x9E3779B97F4A7C15) + words
        g = h + np.uint64(n)
        g ^= g >> np.uint64(32)
        g *= np.uint64(0xC4CEB9FE1A85EC53)
        g ^= g >> np.uint64(29)
        g = (g >> np.uint64(64 - HASH_BITS)) | np.uint64(1)
        out.append(np.where(place >= n - 1, g, np.uint64(0)))
    return out


def request(block: list, order: int) -> tuple:
    """(n-gram hashes per order, sorted distinct hashes, their counts) of a block."""
    _, lengths, distinct, numbers = block
    words = distinct[np.frombuffer(numbers, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()]
    grams = ngrams(words, np.repeat(np.cumsum(lengths) - lengths, lengths), order)
    keys, counts = np.unique(np.concatenate(grams), return_counts=True)
    return (grams, keys[1:], counts[1:]) if len(keys) and keys[0] == 0 else (grams, keys, counts)


def planes(sorted_keys: np.ndarray) -> tuple:
    """Byte planes of the differences; the high ones compress to nothing."""
    d = np.diff(sorted_keys, prepend=np.uint64(0)).astype("<u8")
    return len(d), d.view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(n: int, data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.uint8).reshape(8, n).T.copy().view("<u8").ravel().astype(np.uint64), dtype=np.uint64)


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(block BIGINT, words BIGINT, data BINARY): texts as word numbers, up to BLOCK_WORDS words and one text more."""
    out = pa.schema([("block", pa.int64()), ("words", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        hasher, serial = Hasher(CHUNK), TaskContext.get().partitionId() << 24
        ids, texts, n = [], [], 0

        def emit():
            words = np.concatenate(texts)
            distinct, numbers, n = np.unique(words, return_inverse=True, return_counts=True)
            rank = np.argsort(-n, kind="stable")      # frequent words get small numbers, whose high bytes are zero
            number = np.empty(len(rank), np.uint32)
            number[rank] = np.arange(len(rank), dtype=np.uint32)
            data = pack([ids, np.array([len(t) for t in texts]), distinct[rank],
                         number[numbers].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()])
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((serial, len(words), data), out)], schema=out)
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                ids.append(i)
                texts.append(word_hashes(t.as_buffer().to_pybytes() if t.is_valid else b"", hasher))
                n += len(texts[-1])
                if n >= BLOCK_WORDS:
                    yield emit()
                    ids, texts, n, serial = [], [], 0, serial + 1
        if ids:
            yield emit()
    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("binary")).mapInArrow(
        run, "block bigint, words bigint, data binary")


def _requests(order: int, ranges: int):
    out = pa.schema([("range", pa.int32()), ("block", pa.int64()), ("data", pa.binary())])

    def run(batches):
        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(1)):
                _, keys, counts = request(unpack(data.as_py()), order)
                step = -(-(1 << HASH_BITS) // ranges)
                edges = np.searchsorted(keys, np.array([r * step for r in range(ranges + 1)], np.uint64))
                for r in range(ranges):
                    s = slice(edges[r], edges[r + 1])
                    if edges[r + 1] > edges[r]:
                        row = (r, block, pack((*planes(keys[s]), counts[s].astype(np.uint32))))
                        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, out)], schema=out)
    return run


def _answers(batches):
    """Rows arrive by range: add up the counts of all its blocks, then answer each of them."""
    out = pa.schema([("block", pa.int64()), ("range", pa.int32()), ("data", pa.binary())])

    def answer(at, held):
        total, index = np.unique(np.concatenate([k for _, k, _ in held]), return_inverse=True)
        count = np.bincount(index, np.concatenate([c for _, _, c in held]), len(total)).astype(np.int64)
        s = 0
        for block, keys, _ in held:
            row = (block, at, pack(count[index[s:s + len(keys)]]))
            s += len(keys)
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, out)], schema=out)
    held, at = [], None
    for b in batches:
        for r, block, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            if r != at and held:
                yield from answer(at, held)
                held = []
            at = r
            n, data, counts = unpack(data.as_py())
            held.append((block, from_planes(n, data), counts))
    if held:
        yield from answer(at, held)


def score_block(block: list, counts: np.ndarray, order: int, total: int, alpha: float, min_count: int) -> tuple:
    """(ids, words per text, log scores per text); ``counts`` follow the block's sorted n-grams."""
    grams, keys, _ = request(block, order)
    c = [np.where(g > 0, counts[np.minimum(np.searchsorted(keys, g), len(keys) - 1)], 0) if len(keys) else
         np.zeros(len(g), np.int64) for g in grams]
    place = np.arange(len(grams[0])) - np.repeat(np.cumsum(block[1]) - block[1], block[1])
    logs, open_ = np.zeros(len(place)), np.ones(len(place), bool)
    for n in range(order, 0, -1):
        if n == 1:
            seen, base = open_, np.float64(total)
        else:
            seen = open_ & (c[n - 1] >= min_count)
            base = np.concatenate((np.ones(1), c[n - 2][:-1]))      # history: the (n-1)-gram ending before
        backed = np.minimum(order - 1, place) - (n - 1)             # orders tried and left
        value = np.log(np.maximum(c[n - 1], 1) / np.maximum(base, 1)) + backed * np.log(alpha)
        logs[seen] = value[seen]
        open_ = open_ & ~seen
    ends = np.cumsum(block[1])
    return block[0], block[1], [float(logs[e - k:e].sum()) for e, k in zip(ends.tolist(), block[1].tolist())]


def score(docs: DataFrame, order: int = 3, alpha: float = 0.4, min_count: int = 2, id_col: str = "doc_id",
          text_col: str = "text", ranges_per_partition: int = 4) -> DataFrame:
    """(id, n_words, log_score, mean_log_score) per row of ``docs``, natural logarithms."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = written(blocks(docs, id_col, text_col), "lm-blocks")
    total = table.agg(F.sum("words")).first()[0] or 0
    asked = table.select("block", "data").mapInArrow(
        _requests(order, n * ranges_per_partition), "range int, block bigint, data binary")
    answers = asked.repartition(n, "range").sortWithinPartitions("range").mapInArrow(
        _answers, "block bigint, range int, data binary")
    both = answers.union(table.select("block", F.lit(-1).alias("range"), "data"))

    def run(batches):
        out = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("log_score", pa.float64())])

        def emit(held):
            counts = np.concatenate([np.empty(0, np.int64), *held[1:]])
            cols = score_block(held[0], counts, order, total, alpha, min_count)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out)], schema=out)
        held, at = [], None
        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(2)):
                if block != at and held:
                    yield emit(held)
                    held = []
                at = block
                held.append(unpack(data.as_py()))
        if held:
            yield emit(held)
    scored = both.repartition(n, "block").sortWithinPartitions("block", "range").mapInArrow(
        run, "id bigint, n_words bigint, log_score double")
    return scored.withColumn("mean_log_score", F.col("log_score") / F.nullif("n_words", F.lit(0)))
