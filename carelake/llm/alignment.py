"""Cross-tokenizer alignment by pointer jumping (operator 13).

A text behind one space is encoded by a byte-level tokenizer (A) and by a sentence model (B, which
adds that space itself). The tokens of each side cover the same bytes, and places where
a token of both sides ends cut them into groups.

Pointer jumping: every token points to the farthest-right token that overlaps it, which is the
token of the other side that holds its last byte; where both end there, the B token
points to itself and is the terminal token of its component. Replacing each pointer by
its successor's pointer doubles the steps, so all tokens of a chunk of texts reach their
terminal, which labels the group, after log2 of the longest chain of array operations.

Links are the pairs of an A and a B token that share bytes; between two neighbouring ends of
either side lies exactly one. An id pair's count is the number of documents that hold
it linked. A block of documents (``BLOCK`` bytes of text, or one longer text) returns one row per
document, with its pairs as numbers of the block's list of pairs, and one row per
pair of that list with the block's number of documents, so that the frequent pairs,
which nearly every document has, are aggregated before they are shuffled. These rows are
written once; Spark sums the counts by pair, takes the maximum by A id, joins both back to
the pairs of the blocks, and a cogroup by block sums them over each document's links.

Long texts are cut where no token crosses (``encoding.parts``), which ends a group anyway, and
go through the arrays part by part.

Defined results: null and empty texts, and texts whose joined A or B bytes differ from a space and
the text, have no tokens (zeros, '' as digest); every row is its own document, repeated
rows and null ids included; an empty table gives an empty result; other columns,
whatever their names, are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.llm.common import written
from carelake.llm.encoding import Tokens, default_path, parts, text_of

BLOCK, CHUNK, PART_CHARS = 4 << 20, 1 << 20, 1 << 18
_ROW = pa.schema([("block", pa.int64()), ("id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                  ("n_links", pa.int64()), ("digest", pa.string()), ("groups", pa.string()), ("pairs", pa.list_(pa.int32())),
                  ("times", pa.list_(pa.int32())), ("k", pa.int32()), ("pair", pa.int64()), ("docs", pa.int64())])
_ROW_DDL = ("block bigint, id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, digest string, groups string, "
            "pairs array<int>, times array<int>, k int, pair bigint, docs bigint")


def terminals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The terminal B token of every A and every B token, given the sorted byte ends of both sides."""
    n = len(ends_a)
    over_b = np.searchsorted(ends_b, ends_a)        # the B token that holds the last byte of an A token
    over_a = np.searchsorted(ends_a, ends_b)
    both = ends_a[over_a] == ends_b
    to = np.concatenate((n + over_b, np.where(both, n + np.arange(len(ends_b)), over_a)))
    while True:
        further = to[to]
        if np.array_equal(further, to):
            return to[:n] - n, to[n:] - n
        to = further


class Sides:
    """Both tokenizers, and what their ids stand for."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = Tokens(path_a, plain_specials=True), Tokens(path_b)
        self.cuts = self.b if self.a.cuts else self.a
        self.bytes_a, self.bytes_b = self.a.token_bytes(), self.b.token_bytes()
        self.len_a, self.len_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.text_a = [np.array([f"{i}{c}".encode() for i in range(self.a.size)], object) for c in ",|"]
        self.text_b = [np.array([f"{i}{c}".encode() for i in range(self.b.size)], object) for c in ",;"]


class Block:
    """The rows of one block of documents."""

    def __init__(self, sides: Sides, number: int, with_groups: bool):
        self.sides, self.number, self.with_groups = sides, number, with_groups
        self.ids, self.bad, self.bytes = [], set(), 0
        self.digests, self.texts, self.totals = [], [], []      # totals: n_a, n_b, n_groups, n_links of a document
        self.waiting, self.waiting_bytes = [], 0                # (document, part) that no array pass has seen
        self.keys, self.times = [], []                          # distinct (document, pair) and its links

    def add(self, name: int | None, text: str) -> None:
        doc = len(self.ids)
        self.ids.append(name)
        self.digests.append(hashlib.sha256())
        self.texts.append([])
        self.totals.append(np.zeros(4, np.int64))
        for part in parts(text, PART_CHARS, self.sides.cuts) if text else ():
            self.waiting.append((doc, part))
            size = len(part.encode("utf-8", "surrogatepass"))
            self.waiting_bytes += size
            self.bytes += size
            if self.waiting_bytes >= CHUNK:
                self.work()

    def work(self) -> None:
        """Encode and align the waiting parts in one array pass."""
        waiting, self.waiting, self.waiting_bytes = self.waiting, [], 0
        s, docs, of_a, of_b = self.sides, [], [], []
        spaced = [" " + t for _, t in waiting]
        for (doc, text), whole, a, b in zip(waiting, spaced, s.a(spaced), s.b([t for _, t in waiting])):
            want = whole.encode("utf-8", "surrogatepass")
            if b"".join([s.bytes_a[i] for i in a]) != want or b"".join([s.bytes_b[i] for i in b]) != want:
                self.bad.add(doc)
                continue
            docs.append(doc)
            of_a.append(a)
            of_b.append(b)
        if not docs:
            return
        n_a, n_b = (np.array([len(x) for x in side], np.int64) for side in (of_a, of_b))
        a, b = (np.concatenate([np.array(x, np.int64) for x in side]) for side in (of_a, of_b))
        ends_a, ends_b = np.cumsum(s.len_a[a]), np.cumsum(s.len_b[b])
        last_a, last_b = terminals(ends_a, ends_b)
        terminal = np.zeros(len(b), bool)
        terminal[last_b] = True
        label = np.cumsum(terminal) - 1
        group_a, group_b = label[last_a], label[last_b]
        part_of_b = np.repeat(np.arange(len(docs)), n_b)
        n_groups = np.bincount(part_of_b[terminal], minlength=len(docs))
        ends = np.sort(np.concatenate((ends_a, ends_b[~terminal])), kind="stable")
        link_a, link_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        part_of = part_of_b[link_b]
        n_links = np.bincount(part_of, minlength=len(docs))
        for k, doc in enumerate(docs):
            self.totals[doc] += (n_a[k], n_b[k], n_groups[k], n_links[k])
        pair = a[link_a] * s.b.size + b[link_b]
        key, times = np.unique(np.array(docs)[part_of] * (s.a.size * s.b.size) + pair, return_counts=True)
        self.keys.append(key)
        self.times.append(times)
        self.write_groups(docs, a, b, n_a, n_b, group_a, group_b)

    def write_groups(self, docs, a, b, n_a, n_b, group_a, group_b) -> None:
        """`a1,a2|b1;a3|b2,b3` of every part, each token behind those of the groups before it."""
        s, in_a, in_b = self.sides, np.bincount(group_a), np.bincount(group_b)
        at_a = np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]
        at_b = np.arange(len(b)) + np.cumsum(in_a)[group_b]
        out = np.empty(len(a) + len(b), object)
        out[at_a], out[at_b] = s.text_a[0][a], s.text_b[0][b]
        end_a, end_b = np.cumsum(in_a) - 1, np.cumsum(in_b) - 1
        out[at_a[end_a]], out[at_b[end_b]] = s.text_a[1][a[end_a]], s.text_b[1][b[end_b]]
        at = 0
        for doc, n in zip(docs, (n_a + n_b).tolist()):
            text = b"".join(out[at:at + n].tolist())[:-1]
            at += n
            if self.texts[doc]:
                self.digests[doc].update(b";")
            self.digests[doc].update(text)
            self.texts[doc].append(text if self.with_groups else b"-")

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.waiting:
            self.work()
        s = self.sides
        key, times = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (self.keys, self.times))
        if self.bad:
            fine = ~np.isin(key // (s.a.size * s.b.size), list(self.bad))
            key, times = key[fine], times[fine]
        if len(self.keys) > 1:      # a document may lie in several array passes
            key, back = np.unique(key, return_inverse=True)
            times = np.bincount(back, weights=times, minlength=len(key)).astype(np.int64)
        doc, pair = np.divmod(key, s.a.size * s.b.size)
        pairs, k, docs = np.unique(pair, return_inverse=True, return_counts=True)
        has = [d not in self.bad and bool(t) for d, t in enumerate(self.texts)]
        totals = np.array([t * h for t, h in zip(self.totals, has)], np.int64).reshape(-1, 4)
        cuts = pa.array(np.searchsorted(doc, np.arange(len(self.ids) + 1)), pa.int32())
        cols = {"id": self.ids, **{c: totals[:, i] for i, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))},
                "digest": [d.hexdigest() if h else "" for d, h in zip(self.digests, has)],
                "groups": [b";".join(t).decode() if h else "" for t, h in zip(self.texts, has)] if self.with_groups else None,
                "pairs": pa.ListArray.from_arrays(cuts, pa.array(k.astype(np.int32))),
                "times": pa.ListArray.from_arrays(cuts, pa.array(times.astype(np.int32)))}
        yield from self.batch(cols, len(self.ids))
        yield from self.batch({"k": np.arange(len(pairs), dtype=np.int32), "pair": pairs, "docs": docs}, len(pairs))

    def batch(self, cols: dict, n: int) -> Iterator[pa.RecordBatch]:
        cols = {**cols, "block": np.full(n, self.number, np.int64)}
        if n:
            yield pa.RecordBatch.from_arrays([
                pa.nulls(n, f.type) if cols.get(f.name) is None else c if isinstance(c := cols[f.name], pa.Array) else pa.array(c, f.type)
                for f in _ROW], schema=_ROW)


def _blocks(path_a: str, path_b: str, with_groups: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, first = Sides(path_a, path_b), TaskContext.get().partitionId() << 32
        block = Block(sides, first, with_groups)
        for b in batches:
            for name, v in zip(b.column(0).to_pylist(), b.column(1)):
                block.add(name, text_of(v.as_py()))
                if block.bytes >= BLOCK:
                    yield from block.rows()
                    block = Block(sides, block.number + 1, with_groups)
        if block.ids:
            yield from block.rows()
    return run


def _score(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """Sums over the links of each document of one block, from the counts of the block's pairs."""
    k = pairs.column("k").to_numpy()
    count, best = np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
    count[k], best[k] = pairs.column("n").to_numpy(), pairs.column("best").to_numpy()
    of, times = (docs.column(c).combine_chunks() for c in ("pairs", "times"))
    ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(of.value_lengths().to_numpy(zero_copy_only=False))))
    at, times = of.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)

    def total(v):
        sums = np.concatenate((np.zeros(1, np.int64), np.cumsum(v[at] * times)))
        return pa.array(sums[ends[1:]] - sums[ends[:-1]])
    return pa.table({"id": docs.column("id"), **{c: docs.column(c) for c in ("n_a", "n_b", "n_groups", "n_links")},
                     "n_best": total(best), "count_sum": total(count), "groups_sha256": docs.column("digest"),
                     "groups": docs.column("groups")})


def align(docs: DataFrame, tokenizer_a: str | None = None, tokenizer_b: str | None = None, with_groups: bool = False,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256[, groups]) per row of ``docs``.

    ``groups`` is `a1,a2|b1;a3|b2,b3`: the A and B ids of each group in order; its SHA-256 is taken
    in the task that made it, so that the text itself need not be moved.
    """
    path_a, path_b = tokenizer_a or default_path(), tokenizer_b or default_path("piece_bpe_32k.model")
    size_b = Tokens(path_b).size
    made = written(docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("binary")).mapInArrow(
        _blocks(path_a, path_b, with_groups), _ROW_DDL), "alignment")
    pairs = made.where("pair is not null").select("block", "k", "pair", "docs")
    counts = pairs.groupBy("pair").agg(F.sum("docs").alias("n")).withColumn("a", F.floor(F.col("pair") / size_b))
    top = counts.groupBy("a").agg(F.max("n").alias("top"))
    scored = counts.join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).cast("bigint").alias("best"))
    back = pairs.join(scored, "pair").select(F.col("block").alias("of"), "k", "n", "best")
    rows = made.where("pair is null").select("block", "id", "n_a", "n_b", "n_groups", "n_links", "digest", "groups", "pairs", "times")
    out = rows.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(
        _score, "id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, "
                "groups_sha256 string, groups string")
    return out if with_groups else out.drop("groups")
