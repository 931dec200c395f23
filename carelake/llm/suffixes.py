"""Suffix-array deduplication of repeated byte strings (operator 4).

Every byte that a ``length``-byte string covers which also starts anywhere else, in the
same text or another one, is removed; strings are judged on the input and never span texts.

Sparse suffixes. The anchor of a ``length``-byte window is its leftmost least ``GRAM``-byte
gram by hash. Equal windows have equal anchors at equal offsets, so it is enough to sort
the suffixes that begin at anchors, about one in 185 bytes. One record stands for all
windows of one anchor: its suffix up to the end of the last window, preceded by the hash
of its gram (the sort string, so equal ranges of hashes are even ranges of suffixes), and
the bytes before the anchor down to the first window.

Merge sort. A task sorts its records into runs of bounded size, in which equal records
become one (their bytes are known to repeat, so their spans leave at once and a group of
copies sends one record a run). Runs are front-coded (a record keeps the bytes after the
common prefix with its predecessor), cut at the range borders and exchanged. The receiver
of a range combines the runs with a loser tree whose nodes hold the common prefix with
the last output: a longer one wins without looking at the bytes, equal ones are compared
behind it, and the front code of the next record is its prefix with the last output.

Groups. Records whose merged common prefix covers the gram share an anchor. Inside a
group the windows at one offset are equal or not as their hashes are; windows found twice
leave as spans. Spans are gathered per text and cut out in one join with the texts.

Hot grams. A short line that many texts share is the anchor of many different records, and a
group meets in one task. So the records of every gram are counted first, equal ones of a run
once; a gram with more than ``HOT`` of them sends no records. Its windows travel as rows
(gram, hash at offset) instead, each at most once a run, and what occurs in two rows repeats.
A group is thus at most ``HOT`` records and one a run, as runs count a gram from two on.

Defined results: null, empty and short texts lose nothing; repeated rows are copies of each
other, so they lose what copies lose; null ids are allowed; an empty table gives an
empty result. Where a cut leaves part of a character, ``cut_texts`` drops that part too,
while ``removed`` reports exact bytes.
"""
from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carelake.llm.common import KEY, keyed, with_key

GRAM = 32
BLOCK = 1 << 18          # bytes of a text hashed at a time
RUN_BYTES = 40 << 20     # record bytes sorted as one run
HOT = 1 << 13            # records of one gram that may meet in one task
_RADIX, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xFF51AFD7ED558CCD)


def _powers(x: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, x, np.uint64))))


class Hasher:
    """Hashes of all ``size``-byte strings of a buffer of at most ``most`` bytes, from one prefix sum."""

    def __init__(self, most: int):
        self.up, self.down = _powers(_RADIX, most), _powers(pow(_RADIX, -1, 1 << 64), most)

    def __call__(self, a: np.ndarray, size, at: np.ndarray | None = None) -> np.ndarray:
        """Hashes of a[at:at + size], of every start if ``at`` is None; ``size`` may be an array."""
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((a.astype(np.uint64) + 1) * self.up[:len(a)])))
        if at is None:
            n = len(a) - size + 1
            h = (total[size:] - total[:n]) * self.down[:n]
        else:
            h = (total[at + size] - total[at]) * self.down[at]
        h ^= h >> np.uint64(32)
        h *= _MIX
        h ^= h >> np.uint64(29)
        return h


def anchors(a: np.ndarray, length: int, hasher: Hasher) -> Iterator[tuple]:
    """(anchor, first window, last window, gram hash) of a text, windows in order, arrays."""
    span = length - GRAM + 1           # grams in a window
    for base in range(0, len(a) - length + 1, BLOCK):
        part = a[base:base + BLOCK + length - 1]
        h = hasher(part, GRAM)
        n = len(part) - length + 1     # windows that begin in this block
        order = (h & ~np.uint64((1 << 20) - 1)) | np.arange(len(h), dtype=np.uint64)
        rows = -(-len(h) // span)
        grid = np.full(rows * span, np.iinfo(np.uint64).max, np.uint64)
        grid[:len(h)] = order
        grid = grid.reshape(rows, span)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        at = (np.minimum(behind[:n], ahead[span - 1:span - 1 + n]) & np.uint64((1 << 20) - 1)).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(np.diff(at)) + 1))
        last = np.concatenate((first[1:] - 1, [n - 1]))
        yield at[first] + base, first + base, last + base, h[at[first]]


def common_prefix(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of a and b, of which ``at`` bytes are known."""
    for n in (at + 16, min(len(a), len(b))):
        n = min(n, len(a), len(b))
        x = int.from_bytes(a[at:n]) ^ int.from_bytes(b[at:n])
        if x:
            return n - (x.bit_length() + 7) // 8
    return n


def joined_spans(ka, kb, lo, hi) -> list[np.ndarray]:
    """Overlapping and touching spans of a text as one."""
    order = np.lexsort((hi, lo, kb, ka))
    ka, kb, lo, hi = (np.asarray(x, np.int64)[order] for x in (ka, kb, lo, hi))
    new = np.ones(len(ka), bool)
    new[1:] = (ka[1:] != ka[:-1]) | (kb[1:] != kb[:-1])
    step = np.cumsum(new) * (hi.max(initial=0) + 1)
    hi = np.maximum.accumulate(hi + step) - step         # the furthest end so far in a text
    new[1:] |= lo[1:] > hi[:-1]
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:] - 1, [len(ka) - 1]))[:len(first)]
    return [ka[first], kb[first], lo[first], hi[last]]


class Run:
    """Records of a task: equal ones once, then sorted, front-coded and cut into ranges."""

    def __init__(self, ranges: int):
        self.ranges, self.records, self.spans, self.bytes = ranges, {}, ([], [], [], []), 0

    def add(self, ka: int, kb: int, text: bytes, length: int, at, first, last, grams) -> None:
        records, spans = self.records, self.spans
        for a, p, q, h in zip(at.tolist(), first.tolist(), last.tolist(), grams.astype(">u8")):
            z = (a - p, text[p:q + length])
            old = records.get(z)
            if old is None:
                records[z] = [h.tobytes(), ka, kb, p, 1]
                self.bytes += len(z[1])
                continue
            for row in ([(old[1], old[2], old[3])] if old[4] == 1 else []) + [(ka, kb, p)]:
                for col, v in zip(spans, (*row, row[2] + len(z[1]))):
                    col.append(v)
            old[4] = 2

    def blobs(self) -> Iterator[tuple[int, int, bytes]]:
        """(range, kind, blob): kind 0 holds spans, 1 front-coded records."""
        pack = zstandard.ZstdCompressor(level=1).compress
        if self.spans[0]:
            yield abs(self.spans[0][0]) % self.ranges, 0, pack(pickle.dumps(joined_spans(*self.spans)))
        rows = sorted(((r[0] + z[off:], z[:off], *r[1:]) for (off, z), r in self.records.items()), key=lambda r: r[0])
        self.records.clear()
        at = 0
        while at < len(rows):
            where = (int.from_bytes(rows[at][0][:8]) * self.ranges) >> 64
            limit, cols, tails, before = -(-((where + 1) << 64) // self.ranges), ([], [], [], [], [], [], []), [], b""
            while at < len(rows) and int.from_bytes(rows[at][0][:8]) < limit:
                k, head, ka, kb, p, n = rows[at]
                same = common_prefix(before, k, 0)
                tails += [k[same:], head]
                for col, v in zip(cols, (same, len(k) - same, len(head), ka, kb, p, n)):
                    col.append(v)
                before, at = k, at + 1
            yield where, 1, pack(pickle.dumps([[np.array(c, np.int64) for c in cols], b"".join(tails)]))


def read_run(blob: list) -> Iterator[tuple]:
    """(prefix shared with the last, sort string, (head, ka, kb, first window, copies))."""
    cols, data = blob
    at, k = 0, b""
    for same, tail, head, ka, kb, p, n in zip(*[c.tolist() for c in cols]):
        k = k[:same] + data[at:at + tail]
        at += tail
        yield same, k, (data[at:at + head], ka, kb, p, n)
        at += head


def merge(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """(prefix shared with the output before, sort string, payload) of all runs in order, by a
    loser tree over common prefixes."""
    size = 1
    while size < len(runs):
        size *= 2
    heads = [next(r, None) for r in runs] + [None] * (size - len(runs))
    known = [0] * size       # of each run's head: prefix shared with the last winner it met

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser then knows its prefix with the winner."""
        if heads[b] is None:
            return a, b
        if heads[a] is None:
            return b, a
        x, y = known[a], known[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        k, m = heads[a][1], heads[b][1]
        c = common_prefix(k, m, x)
        if k[c:c + 1] <= m[c:c + 1]:
            known[b] = c
            return a, b
        known[a] = c
        return b, a

    losers, level = [0] * size, list(range(size))
    width = size
    while width > 1:
        width //= 2
        level = [play(level[2 * i], level[2 * i + 1]) for i in range(width)]
        for i, (_, lost) in enumerate(level):
            losers[width + i] = lost
        level = [w for w, _ in level]
    top = level[0]
    while heads[top] is not None:
        yield known[top], heads[top][1], heads[top][2]
        heads[top] = next(runs[top], None)
        if heads[top] is not None:
            known[top] = heads[top][0]
        node = (top + size) // 2
        while node:
            top, losers[node] = play(top, losers[node])
            node //= 2


class Groups:
    """Collects groups of records of one anchor and finds the windows that occur twice."""

    def __init__(self, length: int):
        self.length, self.hasher = length, Hasher(1 << 20)
        self.rows, self.group, self.bytes = [], 0, 0
        self.reset()

    def reset(self) -> None:
        self.keys, self.owner, self.start = [], [], []
        self.ka, self.kb, self.copies, self.groups, self.windows = [], [], [], [], 0

    def add(self, k: bytes, payload: tuple) -> None:
        head, ka, kb, p, n = payload
        self.put(self.group, len(head), head + k[8:], ka, kb, p, n)

    def put(self, group: int, off: int, z: bytes, ka: int, kb: int, p: int, n: int) -> None:
        self.rows.append((group, off, z, ka, kb, p, n))
        self.bytes += len(z)
        if self.bytes > 1 << 19:
            self.hash()

    def hash(self) -> None:
        if not self.rows:
            return
        group, off, z, ka, kb, p, n = zip(*self.rows)
        size = np.array([len(x) for x in z])
        each = size - self.length + 1
        at = np.concatenate(([0], np.cumsum(size)[:-1]))
        who = np.repeat(np.arange(len(z)), each)
        i = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        h = self.hasher(np.frombuffer(b"".join(z), np.uint8), self.length, at[who] + i)
        place = np.array(group, np.uint64)[who] * np.uint64(1 << 20) + (np.array(off)[who] - i + self.length).astype(np.uint64)
        self.keys.append(h ^ (place + np.uint64(1)) * np.uint64(0xC4CEB9FE1A85EC53))
        self.owner.append(who + len(self.ka))
        self.start.append(np.array(p, np.int64)[who] + i)
        self.ka += ka
        self.kb += kb
        self.copies += n
        self.groups += group
        self.windows += len(h)
        self.rows, self.bytes = [], 0

    def spans(self) -> list | None:
        """Spans of repeated windows of all collected groups."""
        self.hash()
        if not self.keys:
            return None
        keys, owner, start = map(np.concatenate, (self.keys, self.owner, self.start))
        order = np.argsort(keys)
        out = self.twice(owner, start, order, keys[order][1:] == keys[order][:-1])
        self.reset()
        return out

    def first_windows(self) -> tuple[list, list]:
        """Of all collected groups, named by their grams: spans of repeated windows, and (gram, hash,
        ka, kb, start) of one window each."""
        self.hash()
        keys, owner, start = map(np.concatenate, (self.keys, self.owner, self.start))
        gram = np.array(self.groups, np.uint64)[owner]
        order = np.lexsort((keys, gram))
        same = (keys[order][1:] == keys[order][:-1]) & (gram[order][1:] == gram[order][:-1])
        at = order[np.concatenate(([True], ~same))]
        one = [gram[at].view(np.int64), keys[at].view(np.int64), np.array(self.ka, np.int64)[owner[at]],
               np.array(self.kb, np.int64)[owner[at]], start[at]]
        out = self.twice(owner, start, order, same)
        self.reset()
        return out, one

    def twice(self, owner, start, order, same) -> list:
        """Spans of the windows that equal a neighbour in ``order``."""
        twice = np.zeros(len(order), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        twice &= np.array(self.copies)[owner] == 1       # spans of copies have left with their run
        owner, start = owner[twice], start[twice]
        new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)))[:len(owner)]
        first = np.flatnonzero(new)
        last = np.concatenate((first[1:] - 1, [len(owner) - 1]))[:len(first)]
        return joined_spans(np.array(self.ka, np.int64)[owner[first]], np.array(self.kb, np.int64)[owner[first]],
                            start[first], start[last] + self.length)


_BLOBS = pa.schema([("range", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])
_SPANS = pa.schema([("ka", pa.int64()), ("kb", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])


_COUNTS = pa.schema([("gram", pa.int64()), ("n", pa.int64())])
_WINDOWS = pa.schema([("sure", pa.bool_()), ("gram", pa.int64()), ("hash", pa.int64()), *_SPANS])


def _rows(schema: pa.Schema, cols: list, most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(cols[0]), most):
        yield pa.RecordBatch.from_arrays([pa.array(c[i:i + most], f.type) for c, f in zip(cols, schema)], schema=schema)


def _anchored(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple]:
    """(ka, kb, text, its bytes as an array, anchors of a block) of all texts."""
    hasher = Hasher(BLOCK + length)
    for b in batches:
        for ka, kb, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            text = text.as_buffer().to_pybytes() if text.is_valid else b""
            a = np.frombuffer(text, np.uint8)
            for part in anchors(a, length, hasher):
                yield ka, kb, text, a, part


def _gram_counts(length: int):
    """(gram, different records) of the grams that a run's worth of records holds more than once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, cols, held = Hasher(BLOCK + length), [], 0

        def flush():
            gram, record = (np.concatenate(c) for c in zip(*cols))
            order = np.lexsort((record, gram))
            gram, record = gram[order], record[order]
            new = np.concatenate(([True], (gram[1:] != gram[:-1]) | (record[1:] != record[:-1])))
            gram, n = np.unique(gram[new], return_counts=True)
            return _rows(_COUNTS, [gram[n > 1].view(np.int64), n[n > 1]])
        for _, _, _, a, (at, first, last, grams) in _anchored(batches, length):
            size, lo = last - first + length, first[0]
            record = hasher(a[lo:last[-1] + length], size, first - lo)
            cols.append((grams, record ^ (at - first).astype(np.uint64) * np.uint64(_RADIX)))
            held += int(size.sum())
            if held > RUN_BYTES:
                yield from flush()
                cols, held = [], 0
        if cols:
            yield from flush()
    return run


def hot_grams(texts: DataFrame, length: int) -> np.ndarray:
    """Sorted hashes of the grams with more than ``HOT`` different records: one in ``HOT`` anchors at most."""
    rows = texts.mapInArrow(_gram_counts(length), "gram bigint, n bigint").groupBy("gram").agg(
        F.sum("n").alias("n")).where(F.col("n") > HOT).select("gram").collect()
    return np.sort(np.array([r["gram"] for r in rows], np.int64).view(np.uint64))


def _is_hot(grams: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(grams), bool)
    return hot[np.minimum(np.searchsorted(hot, grams), len(hot) - 1)] == grams


def _sorted_runs(length: int, ranges: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Run(ranges)

        def flush():
            for row in now.blobs():
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _BLOBS)], schema=_BLOBS)
        for ka, kb, text, _, part in _anchored(batches, length):
            keep = ~_is_hot(part[3], hot)
            now.add(ka, kb, text, length, *(c[keep] for c in part))
            if now.bytes > RUN_BYTES:
                yield from flush()
                now = Run(ranges)
        yield from flush()
    return run


def _hot_windows(length: int, hot: np.ndarray):
    """Windows of hot anchors: ``sure`` rows are spans of windows that repeat inside a run, the others
    are one window each, once a run."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, groups = Run(1), Groups(length)

        def sure(cols):
            return _rows(_WINDOWS, [np.ones(len(cols[0]), bool), cols[0], cols[2], *cols])

        def flush():
            if now.spans[0]:
                yield from sure(joined_spans(*now.spans))
            for (off, z), (gram, *rest) in now.records.items():
                groups.put(int.from_bytes(gram), off, z, *rest)
            if now.records:
                spans, one = groups.first_windows()
                yield from sure(spans)
                yield from _rows(_WINDOWS, [np.zeros(len(one[0]), bool), *one, one[4] + length])
        for ka, kb, text, _, part in _anchored(batches, length):
            keep = _is_hot(part[3], hot)
            if keep.any():
                now.add(ka, kb, text, length, *(c[keep] for c in part))
                if now.bytes > RUN_BYTES >> 2:
                    yield from flush()
                    now = Run(1)
        yield from flush()
    return run


def _joined_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from _rows(_SPANS, joined_spans(*(c.to_numpy(zero_copy_only=False) for c in b.columns)))


def _hot_spans(texts: DataFrame, length: int, hot: np.ndarray, n: int) -> DataFrame:
    rows = texts.mapInArrow(_hot_windows(length, hot), "sure boolean, gram bigint, hash bigint, ka bigint, kb bigint, lo bigint, hi bigint")
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("sure", "gram", "hash")))     # at most one row a run
    return rows.where("sure or n > 1").select("ka", "kb", "lo", "hi").repartition(n, "ka", "kb").sortWithinPartitions(
        "ka", "kb", "lo").mapInArrow(_joined_batches, "ka bigint, kb bigint, lo bigint, hi bigint")


def _merged_spans(length: int):
    def resolve(blobs: list) -> Iterator[pa.RecordBatch]:
        groups = Groups(length)

        def batch(cols):
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=_SPANS)
        pending = None       # a record is a group's first only when a second follows
        for same, k, payload in merge([read_run(b) for b in blobs]):
            if same >= 8 + GRAM:
                if pending is not None:
                    groups.add(*pending)
                    pending = None
                groups.add(k, payload)
                continue
            if groups.windows > 1 << 20:
                if (cols := groups.spans()) is not None:
                    yield batch(cols)
            groups.group += 1
            pending = (k, payload)
        if (cols := groups.spans()) is not None:
            yield batch(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        held, at = [], None
        for b in batches:
            for r, kind, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                got = pickle.loads(unpack(blob.as_py()))
                if kind == 0:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in got], schema=_SPANS)
                    continue
                if r != at and held:
                    yield from resolve(held)
                    held = []
                at = r
                held.append(got)
        if held:
            yield from resolve(held)
    return run


def repeated_spans(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text",
                   ranges_per_partition: int = 4) -> DataFrame:
    """(ka, kb, lo, hi): byte spans covered by repeated strings; spans of a text may overlap."""
    if length <= GRAM:
        raise ValueError(f"length must be over {GRAM}")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = keyed(docs, id_col, text_col).where(F.octet_length("text") >= length).select(
        *KEY, F.col("text").cast("binary"))
    hot = hot_grams(texts, length)
    runs = texts.mapInArrow(_sorted_runs(length, n * ranges_per_partition, hot), "range int, kind int, blob binary")
    spans = runs.repartition(n, "range").sortWithinPartitions("range").mapInArrow(
        _merged_spans(length), "ka bigint, kb bigint, lo bigint, hi bigint")
    return spans.unionByName(_hot_spans(texts, length, hot, n)) if len(hot) else spans


def _joined(docs: DataFrame, length: int, id_col: str, text_col: str) -> DataFrame:
    spans = repeated_spans(docs, length, id_col, text_col).groupBy(F.col("ka").alias(KEY[0]), F.col("kb").alias(KEY[1])).agg(
        F.collect_list(F.struct("lo", "hi")).alias("__llm_spans"))      # a text has at most one span per window
    return with_key(docs, id_col, text_col).join(spans, KEY, "left").drop(*KEY)


def _cut(text: bytes, spans: list | None) -> tuple[bytes, int]:
    """(kept bytes, number of maximal removed runs)."""
    kept, at, runs = [], 0, 0
    top = -1
    for s in sorted((s["lo"], s["hi"]) for s in (spans if spans is not None else ())):
        if s[0] > top:
            runs += 1
            kept.append(text[at:s[0]])
        top = at = max(top, s[1])
    return b"".join([*kept, text[at:]]), runs


def removed(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept BINARY) per row."""
    def run(batches):
        for b in batches:
            texts = [t or b"" for t in b.column(1).to_pylist()]
            cut = [_cut(t, s) for t, s in zip(texts, b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([len(t) for t in texts], pa.int64()),
                pa.array([len(t) - len(c) for t, (c, _) in zip(texts, cut)], pa.int64()),
                pa.array([n for _, n in cut], pa.int64()), pa.array([c for c, _ in cut], pa.binary())],
                names=["id", "n_bytes", "n_removed", "n_spans", "kept"])
    rows = _joined(docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")), length, "id", "text")
    return rows.select("id", F.col("text").cast("binary"), "__llm_spans").mapInArrow(
        run, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def cut_texts(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with repeated strings cut out of the text."""
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        # Spark runs the UDF on every row, also where the WHEN branch below decides
        return pd.Series([None if t is None else _cut(t, s)[0].decode("utf-8", "ignore") for t, s in zip(text, spans)], dtype=object)
    cut.__annotations__ = {"text": pd.Series, "spans": pd.Series, "return": pd.Series}
    rows = _joined(docs, length, id_col, text_col)
    t = F.col(text_col)
    return rows.withColumn(text_col, F.when(F.col("__llm_spans").isNull(), t).otherwise(
        pandas_udf(cut, "string")(t.cast("binary"), F.col("__llm_spans")))).drop("__llm_spans")
