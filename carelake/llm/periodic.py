"""Periodic run detection by recursive frequency splitting (operator 12).

Words are runs of bytes other than white space (0x20, 0x09-0x0D). A run is a stretch of words with
smallest period q, of at least ``min_length`` words and ``min_repeats`` periods, that no
neighbouring word extends.

Splitting. A word of a run stands at least ``min_repeats`` times in it (a run of one
word, ``min_length`` times). So a word that occurs more rarely than that in its segment
is in no run and splits the segment; the counts of the pieces are smaller, so they
are split again, until nothing changes. All segments of a chunk of texts are split in one pass of
array operations, and only segments that changed go to the next pass. Prose falls
apart in a few passes.

Lag scan of what survives: for each lag q up to a ``min_repeats``-th of the segment, words q apart
are compared. A run of q matches lag q for at least (``min_repeats`` - 1) q words, so that many
multiples of q in a row match: those n/q words are compared first, and the matches
around a hit are extended to both sides, in doubling steps. Lags ascend, and a hit
inside a known run whose period divides q has that smaller period and is left out, so
even one word a million times over takes n log n comparisons.

Defined results: null, empty and white texts have no words and no runs and collapse to the
empty text; every row is its own document, repeated rows and null ids included; an
empty table gives an empty result; other columns, whatever their names, are ignored.
Overlapping runs are all returned, by start, then period.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 20      # bytes of texts that are split together
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_OUT = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])


def survivors(codes: np.ndarray, owner: np.ndarray, least: int, shortest: int) -> list[tuple[int, int]]:
    """[begin, end) of the stretches of ``codes`` in which every word occurs ``least`` times.

    ``owner`` names the text of each word, ascending; stretches never span texts.
    """
    at, seg, done = np.arange(len(codes)), owner, []
    while len(at):
        _, back, n = np.unique(seg.astype(np.int64) * (int(codes.max()) + 1) + codes[at], return_inverse=True, return_counts=True)
        keep = n[back] >= least
        rare = np.unique(seg[~keep])
        settled = ~np.isin(seg, rare)
        done.append(_stretches(at[settled], seg[settled]))
        go = keep & ~settled
        at, seg = at[go], seg[go]
        # words that were next to each other in one segment stay one; the others part
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (seg[1:] != seg[:-1])
        seg = np.cumsum(new) - 1
        long = np.bincount(seg)[seg] >= shortest if len(seg) else np.zeros(0, bool)
        at, seg = at[long], seg[long]
    found = np.concatenate(done) if done else np.zeros((0, 2), np.int64)
    return [(a, b) for a, b in found[np.argsort(found[:, 0])].tolist() if b - a >= shortest]


def _stretches(at: np.ndarray, seg: np.ndarray) -> np.ndarray:
    first = np.flatnonzero(np.diff(seg, prepend=-1))
    last = np.append(first[1:], len(seg)) - 1
    return np.stack((at[first], at[last] + 1), axis=1) if len(at) else np.zeros((0, 2), np.int64)


def _matches(w: np.ndarray, g: int, q: int) -> tuple[int, int]:
    """[first, end) of the starts around g at which w[i] == w[i + q]."""
    n = len(w) - q
    step, end = 64, g + 1
    while end < n:
        bad = np.flatnonzero(w[end:min(end + step, n)] != w[end + q:min(end + step, n) + q])
        if len(bad):
            end += int(bad[0])
            break
        end = min(end + step, n)
        step *= 2
    step, first = 64, g
    while first > 0:
        lo = max(first - step, 0)
        bad = np.flatnonzero(w[lo:first] != w[lo + q:first + q])
        if len(bad):
            first = lo + int(bad[-1]) + 1
            break
        first = lo
        step *= 2
    return first, end


def lag_scan(w: np.ndarray, min_length: int, min_repeats: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one segment of word codes."""
    n, runs = len(w), []
    for q in range(1, n // min_repeats + 1):
        need = max(min_length, min_repeats * q)
        if need > n:
            continue
        grid = w[::q]
        same = grid[1:] == grid[:-1]
        hit = same[:len(same) - min_repeats + 2].copy()
        for k in range(1, min_repeats - 1):
            hit &= same[k:len(same) - min_repeats + 2 + k]
        hits = np.flatnonzero(hit) * q
        if not len(hits):
            continue
        for s, length, p in runs:
            if length < need:
                break          # the longest come first; a shorter one holds no run of q
            if q % p == 0:
                hits = hits[(hits < s) | (hits >= s + length - q)]
        upto, found = -1, []
        for g in hits.tolist():
            if g < upto:
                continue
            first, upto = _matches(w, g, q)
            if upto - first + q >= need:
                found.append((first, upto - first + q, q))
        if found:
            runs = sorted(runs + found, key=lambda r: -r[1])
    return sorted(runs, key=lambda r: (r[0], r[2]))


def runs_of(texts: list[list[bytes]], min_length: int, min_repeats: int) -> list[list[tuple[int, int, int]]]:
    """The runs of every list of words, by start, then period."""
    number: dict[bytes, int] = {}
    codes = np.array([number.setdefault(w, len(number)) for words in texts for w in words], np.int64)
    sizes = np.array([len(words) for words in texts], np.int64)
    begin = np.cumsum(sizes) - sizes
    out: list[list] = [[] for _ in texts]
    if not len(codes):
        return out
    owner = np.repeat(np.arange(len(texts)), sizes)
    for a, b in survivors(codes, owner, min_repeats, max(min_length, min_repeats)):
        k = int(owner[a])
        out[k] += [(a - int(begin[k]) + s, length, p) for s, length, p in lag_scan(codes[a:b], min_length, min_repeats)]
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period, joined by one space."""
    keep = np.ones(len(words), bool)
    for s, length, p in runs:
        keep[s + p:s + length] = False
    return b" ".join(words if not runs else [words[i] for i in np.flatnonzero(keep).tolist()])


def periodic_runs(docs: DataFrame, min_length: int = 6, min_repeats: int = 4, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(id, n_words, runs ARRAY<STRUCT<start, length, period>>, collapsed STRING) per row of ``docs``."""
    if min_repeats < 2 or min_length < 2:
        raise ValueError("a run has two periods and two words at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, done, held = b.column(0), [], 0, 0
            for k, v in enumerate(b.column(1)):
                text = v.as_py() or b""
                texts.append(text.split())
                held += len(text)
                if held >= CHUNK or k + 1 == b.num_rows:
                    runs = runs_of(texts, min_length, min_repeats)
                    short = [collapse(t, r).decode("utf-8", "replace") for t, r in zip(texts, runs)]
                    rows = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs]
                    yield pa.RecordBatch.from_arrays([
                        ids.slice(done, len(texts)), pa.array([len(t) for t in texts], pa.int64()),
                        pa.array(rows, _OUT.field("runs").type), pa.array(short, pa.string())], schema=_OUT)
                    texts, done, held = [], k + 1, 0
    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("binary")).mapInArrow(
        run, "id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
