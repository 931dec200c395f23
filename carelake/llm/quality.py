"""Quality classifier: a byte-level convolutional network in numpy (operator 6).

The UTF-8 bytes of a text are cut into overlapping chunks of ``CHUNK`` bytes that cover
it whole. Learned filters over ``WIDTH`` bytes are max-pooled inside every chunk; a hidden
layer turns the pooled values (and how full the chunk is) into chunk features; the
largest and the mean feature over all chunks give one probability through a logistic
layer. It is trained with Adam, a fixed number of steps, on whole texts of a bounded,
documented sample of labelled rows (``rows`` per class). Training and scoring cover every byte
in blocks of bounded size, scoring without a shuffle; two table look-ups of byte pairs
replace the four taps of a filter.

Defined results: null and empty texts score as one empty chunk; without both classes
among the training rows every score is the smoothed rate of label 1; rows keep all
their columns, and repeated rows score alike.
A column of ``docs`` with the name of an output column (``out_col``) is replaced.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from carelake.llm.common import Adam, bounded_sample, crc_bucket, prior_shift, sigmoid

WIDTH, CHUNK, OVERLAP, FILTERS, HIDDEN = 4, 256, 3, 24, 12
STEP = CHUNK - OVERLAP       # windows of WIDTH bytes that begin in a chunk lie inside it
PER_BLOCK = 64               # chunks convolved at a time


def chunks_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(chunks, CHUNK) bytes and the number of windows in each; the last chunk is zero-filled."""
    a = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    n = max(1, -(-max(len(a) - OVERLAP, 1) // STEP))
    padded = np.zeros((n - 1) * STEP + CHUNK, np.uint8)
    padded[:len(a)] = a
    windows = np.full(n, STEP)
    windows[-1] = max(0, len(a) - (n - 1) * STEP - OVERLAP)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STEP], windows


class ByteCNN:
    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        self.p = {"K": r.normal(0, 0.5, (WIDTH, 256, FILTERS)).astype(np.float32),
                  "c": np.zeros(FILTERS, np.float32),
                  "W": r.normal(0, 0.3, (FILTERS + 1, HIDDEN)).astype(np.float32), "d": np.zeros(HIDDEN, np.float32),
                  "out": r.normal(0, 0.3, 2 * HIDDEN).astype(np.float32), "bias": np.zeros(1, np.float32)}

    def pooled(self, x: np.ndarray, windows: np.ndarray):
        """Largest filter value of each chunk and where it was, PER_BLOCK chunks at a time."""
        if len(x) > PER_BLOCK:
            each = [self.pooled(x[s:s + PER_BLOCK], windows[s:s + PER_BLOCK]) for s in range(0, len(x), PER_BLOCK)]
            return np.concatenate([z for z, _ in each]), np.concatenate([at for _, at in each])
        k = self.p["K"]
        c = k[0][x[:, :STEP]]
        for i in range(1, WIDTH):
            c += k[i][x[:, i:i + STEP]]
        c[np.arange(STEP)[None, :] >= windows[:, None]] = -9
        at = c.argmax(1)
        return np.take_along_axis(c, at[:, None, :], 1)[:, 0, :] + self.p["c"], at

    def fit(self, docs: list, y: np.ndarray, steps: int, batch: int = 32, rate: float = 0.01):
        """``steps`` batches of the shuffled texts, round after round."""
        r = np.random.default_rng(5)
        adam = Adam(self.p, rate)
        rounds = -(-steps * batch // len(docs))
        order = np.concatenate([r.permutation(len(docs)) for _ in range(rounds)])
        for s in range(0, steps * batch, batch):
            part = order[s:s + batch]
            adam.step(self._grads([docs[i] for i in part], y[part]))
        return self

    def _grads(self, docs: list, y: np.ndarray) -> dict:
        p = self.p
        x, win = np.concatenate([d[0] for d in docs]), np.concatenate([d[1] for d in docs])
        sizes = np.array([len(d[1]) for d in docs])
        first, doc = np.concatenate(([0], np.cumsum(sizes)[:-1])), np.repeat(np.arange(len(docs)), sizes)
        z, at = self.pooled(x, win)
        full = np.concatenate((np.maximum(z, 0), (win / STEP)[:, None]), 1).astype(np.float32)
        pre = full @ p["W"] + p["d"]
        h = np.tanh(pre)
        top, mean = np.maximum.reduceat(h, first), np.add.reduceat(h, first) / sizes[:, None]
        feat = np.concatenate((top, mean), 1)
        e = ((sigmoid(feat @ p["out"] + p["bias"][0]) - y) / len(docs)).astype(np.float32)
        g = {"out": feat.T @ e, "bias": np.array([e.sum()], np.float32)}
        df = e[:, None] * p["out"]
        dh = df[doc, HIDDEN:] / sizes[doc][:, None] + df[doc, :HIDDEN] * (h == top[doc])
        dpre = dh * (1 - h * h)
        g["W"], g["d"] = full.T @ dpre, dpre.sum(0)
        dz = (dpre @ p["W"].T)[:, :FILTERS] * (z > 0)
        g["c"] = dz.sum(0)
        g["K"] = np.zeros_like(p["K"])
        rows, f = np.arange(len(x))[:, None], np.arange(FILTERS)[None, :]
        for i in range(WIDTH):
            np.add.at(g["K"][i], (x[rows, at + i], np.broadcast_to(f, at.shape)), dz)
        return g

    def tables(self) -> dict:
        k = self.p["K"]
        pair = [(k[i][:, None, :] + k[i + 1][None, :, :]).reshape(65536, FILTERS) for i in (0, 2)]
        return {"pair": pair, "bias": float(self.p["bias"][0]), **{n: self.p[n].copy() for n in ("c", "W", "d", "out")}}


def score_texts(texts, model: dict) -> np.ndarray:
    """Probabilities of whole texts, any number of chunks, PER_BLOCK chunks at a time."""
    if "rate" in model:
        return np.full(len(texts), model["rate"])
    first, second = model["pair"]
    scores = np.empty(len(texts))
    for k, t in enumerate(texts):
        x, win = chunks_of(t)
        top, total = np.full(HIDDEN, -np.inf), np.zeros(HIDDEN)
        for s in range(0, len(x), PER_BLOCK):
            b = x[s:s + PER_BLOCK]
            pairs = b[:, :-1].astype(np.int32) * 256 + b[:, 1:]
            c = first.take(pairs[:, :STEP], axis=0)
            c += second.take(pairs[:, 2:2 + STEP], axis=0)
            w = win[s:s + PER_BLOCK]
            if w[-1] < STEP:
                c[-1, w[-1]:] = -9
            z = np.maximum(c.max(1) + model["c"], 0)
            h = np.tanh(np.concatenate((z, (w / STEP)[:, None]), 1) @ model["W"] + model["d"])
            top, total = np.maximum(top, h.max(0)), total + h.sum(0)
        scores[k] = sigmoid(np.concatenate((top, total / len(x))) @ model["out"] + model["bias"])
    return scores


def train(docs: DataFrame, labels: DataFrame, held_out, rows: int = 1000, steps: int = 630, label: str = "quality",
          id_col: str = "doc_id", text_col: str = "text") -> dict:
    """The scoring tables. ``held_out(id column)`` names rows whose labels are never read;
    ``rows`` bounds the training rows of each class."""
    got = bounded_sample(docs, labels, label, held_out, rows, id_col, text_col)
    y = np.array([r["_y"] for r in got], np.int64)
    if len(set(y.tolist())) < 2:
        return {"rate": float((y.sum() + 0.5) / (len(y) + 1))}
    model = ByteCNN().fit([chunks_of(r["_text"]) for r in got], y, steps).tables()
    model["bias"] += prior_shift(got)      # the sample is balanced, the labels are not
    return model


def score(docs: DataFrame, model: dict, out_col: str = "score", text_col: str = "text") -> DataFrame:
    """``docs`` with ``out_col``, the probability of the label; no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def quality(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series(score_texts(s.tolist(), held.value))
    quality.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn(out_col, pandas_udf(quality, "double")(F.col(text_col)))


def held_out(id_column):
    return crc_bucket(id_column, 4) == 2
