"""Toxicity: a convolutional text classifier over hashed word embeddings (operator 1).

A word's vector is the sum of two rows of one hashed table: the bucket of the word and the
bucket of its first five bytes, so inflected forms of a stem share weight. Filters of
width 1, 2 and 3 slide over the word vectors, each is max-pooled over the whole document,
and a logistic layer gives the probability. It is trained on every labelled row that is not
held out, by rounds of parameter mixing: each task takes Adam steps in numpy over its
part of the rows, starting from the round's model, and the changes are averaged by a Spark aggregate (a
bucket's over the tasks that touched it). The gradient of a max-pooled filter only
touches the window that won. Channel 0 of the table starts at the smoothed log-odds of the
bucket, counted over the same rows. The driver holds one model, whatever the number of rows.

Thresholds by language are the thresholds of least error over all those rows (0.5 for
languages with too few); they decide ``flagged``, never the score. Scoring is one pass without a
shuffle, in token blocks of bounded size, so texts of any length are scored whole.

Defined results: null, empty and wordless texts get the score of a document whose pooled
features are all zero; without both classes among the training rows every score is the
smoothed rate of label 1; rows keep all their columns, and repeated rows score alike.
A column of ``docs`` with the name of an output column (``out_col``, ``threshold``, ``flagged``) is replaced.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from carelake.llm.common import Adam, crc_bucket, sigmoid, text_bytes, written

BITS, DIM, FILTERS, WIDTHS = 17, 8, 4, (1, 2, 3)
BUCKETS = 1 << BITS
BLOCK = 1 << 15          # tokens convolved at a time
CHUNK = 1 << 18          # bytes hashed at a time, up to the last word that ends there
STEM = 5                 # bytes of a word's stem
ROUNDS, MANY = 3, 20_000     # passes over the rows; tables of fewer rows than MANY get more, up to 4 x ROUNDS
GRID = np.linspace(0.05, 0.95, 19)
IS_WORD = np.array([chr(i).isalnum() if i < 128 else True for i in range(256)])
_RADIX = 0x9E3779B97F4A7C15


def _powers(x: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, x, np.uint64))))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(_RADIX, n), _powers(pow(_RADIX, -1, 1 << 64), n)


_POWERS = _tables(CHUNK)


def _hash_chunk(a: np.ndarray) -> np.ndarray:
    """Buckets of the words of a byte array: differences of one prefix sum of b[j] * radix^j."""
    up, down = _POWERS if len(a) <= CHUNK else _tables(len(a))
    step = np.diff(np.concatenate(([0], IS_WORD[a].view(np.int8), [0])))
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((a.astype(np.uint64) + 1) * up[:len(a)])))
    out = np.empty((len(start), 2), np.int32)
    for j, (stop, mix) in enumerate(((end, 0xFF51AFD7ED558CCD), (np.minimum(end, start + STEM), 0xC4CEB9FE1A85EC53))):
        h = (total[stop] - total[start]) * down[start]
        h ^= h >> np.uint64(31)
        out[:, j] = (h * np.uint64(mix)) >> np.uint64(64 - BITS)
    return out


def encode(text: str | None) -> np.ndarray:
    """(words, 2): bucket of the lower-cased word and bucket of its stem."""
    a = np.frombuffer((text or "").lower().encode("utf-8", "replace"), np.uint8)
    parts, at = [np.empty((0, 2), np.int32)], 0
    while at < len(a):
        to = min(at + CHUNK, len(a))
        if to < len(a):
            gaps = np.flatnonzero(~IS_WORD[a[at:to]])
            while not len(gaps) and to < len(a):      # a word longer than a chunk stays one word
                gaps = np.flatnonzero(~IS_WORD[a[to:to + CHUNK]])[:1] + (to - at)
                to = min(to + CHUNK, len(a))
            to = at + int(gaps[-1]) + 1 if len(gaps) else to
        parts.append(_hash_chunk(a[at:to]))
        at = to
    return np.concatenate(parts)


class TextCNN:
    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        self.p = {"E": r.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32),
                  "out": np.full(FILTERS * len(WIDTHS), 0.3, np.float32), "bias": np.zeros(1, np.float32)}
        for w in WIDTHS:
            k = r.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32)
            k[:, 0, :] = np.abs(k[:, 0, :]) + 0.2      # every filter starts on the log-odds channel
            self.p[f"K{w}"], self.p[f"c{w}"] = k, np.zeros(FILTERS, np.float32)

    def pooled(self, ids: np.ndarray):
        """Pooled filter values and the winning window of each filter (-1: none active)."""
        e = self.p["E"][ids[:, 0]] + self.p["E"][ids[:, 1]]
        z, at = np.zeros(FILTERS * len(WIDTHS), np.float32), np.full(FILTERS * len(WIDTHS), -1)
        for j, w in enumerate(WIDTHS):
            n = len(ids) - w + 1
            if n < 1:
                continue
            c = sum(e[i:i + n] @ self.p[f"K{w}"][i] for i in range(w)) + self.p[f"c{w}"]
            a = c.argmax(0)
            v = c[a, np.arange(FILTERS)]
            z[j * FILTERS:(j + 1) * FILTERS] = np.maximum(v, 0)
            at[j * FILTERS:(j + 1) * FILTERS] = np.where(v > 0, a, -1)
        return z, at

    def start(self, hits: np.ndarray, n: np.ndarray):
        """Log-odds of the buckets (``hits``: class x bucket, ``n``: rows of each class) and of the classes."""
        odds = np.log((hits[1] + 0.5) / (n[1] + 1)) - np.log((hits[0] + 0.5) / (n[0] + 1))
        odds[hits.sum(0) < 3] = 0
        self.p["E"][:, 0] = np.clip(odds, -3, 6) / 6
        self.p["bias"][0] = np.log((n[1] + 0.5) / (n[0] + 0.5))
        return self

    def fit(self, batches, seed: int = 5, batch: int = 32, rate: float = 0.02) -> int:
        """One pass over an iterator of (encoded texts, labels); returns the rows seen."""
        r, adam, seen = np.random.default_rng(seed), Adam(self.p, rate), 0
        for docs, y in batches:
            order = r.permutation(len(docs))
            for s in range(0, len(order), batch):
                g = {k: np.zeros_like(v) for k, v in self.p.items()}
                part = order[s:s + batch]
                for i in part:
                    self._grads(docs[i], y[i], g, 1 / len(part))
                adam.step(g)
            seen += len(docs)
        return seen

    def flat(self) -> np.ndarray:
        """All parameters as rows of DIM values: the buckets first, then the rest, filled up with zeros."""
        rest = np.concatenate([self.p[k].ravel() for k in sorted(self.p) if k != "E"])
        return np.concatenate((self.p["E"], np.pad(rest, (0, -len(rest) % DIM)).reshape(-1, DIM))).astype(np.float64)

    def load(self, flat: np.ndarray):
        at, rest = 0, flat[BUCKETS:].ravel()
        for k in sorted(self.p):
            if k != "E":
                self.p[k] = rest[at:at + self.p[k].size].reshape(self.p[k].shape).astype(np.float32)
                at += self.p[k].size
        self.p["E"] = flat[:BUCKETS].astype(np.float32)
        return self

    def _grads(self, ids, y, g, share):
        z, at = self.pooled(ids)
        d = (sigmoid(z @ self.p["out"] + self.p["bias"][0]) - y) * share
        g["out"] += d * z
        g["bias"] += d
        for j, w in enumerate(WIDTHS):
            for f in range(FILTERS):
                a = at[j * FILTERS + f]
                if a < 0:
                    continue
                dz = d * self.p["out"][j * FILTERS + f]
                g[f"c{w}"][f] += dz
                for i in range(w):
                    x, y2 = ids[a + i]
                    g[f"K{w}"][i, :, f] += dz * (self.p["E"][x] + self.p["E"][y2])
                    k = dz * self.p[f"K{w}"][i, :, f]
                    g["E"][x] += k
                    g["E"][y2] += k

    def tables(self) -> dict:
        """The scoring form: one projected row per bucket, all filter taps side by side."""
        taps = np.concatenate([self.p[f"K{w}"][i] for w in WIDTHS for i in range(w)], axis=1)
        return {"P": (self.p["E"] @ taps).astype(np.float32), "bias": float(self.p["bias"][0]),
                "c": np.concatenate([self.p[f"c{w}"] for w in WIDTHS]), "out": self.p["out"].copy()}


def score_texts(texts, model: dict) -> np.ndarray:
    """Probabilities of whole texts; words gather their projected rows, documents go block by block."""
    if "rate" in model:
        return np.full(len(texts), model["rate"])
    scores, proj = np.empty(len(texts)), model["P"]
    for k, t in enumerate(texts):
        ids = encode(t)
        best = np.full(FILTERS * len(WIDTHS), -np.inf, np.float32)
        for s in range(0, len(ids), BLOCK):
            part = ids[s:s + BLOCK + WIDTHS[-1] - 1]      # blocks overlap by the widest filter
            rows = np.ascontiguousarray((proj.take(part[:, 0], axis=0) + proj.take(part[:, 1], axis=0)).T)
            tap = 0
            for j, w in enumerate(WIDTHS):
                n = len(part) - w + 1
                if n > 0:
                    c = rows[tap * FILTERS:(tap + 1) * FILTERS, :n]
                    for i in range(1, w):
                        c = c + rows[(tap + i) * FILTERS:(tap + i + 1) * FILTERS, i:i + n]
                    q = slice(j * FILTERS, (j + 1) * FILTERS)
                    best[q] = np.maximum(best[q], c.max(1))
                tap += w
        z = np.maximum(best + model["c"], 0)
        scores[k] = sigmoid(z @ model["out"] + model["bias"])
    return scores


def training_rows(docs: DataFrame, labels: DataFrame, held_out, label: str, lang_col: str, id_col: str, text_col: str) -> DataFrame:
    """(text, lang, y) of every document with a label 0 or 1 whose id is not held out; an id with
    different labels counts as 1. Labels of held-out ids are dropped before the join."""
    lab = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("y")).where(
        F.col("y").isin(0, 1) & ~held_out(F.col("_id"))).groupBy("_id").agg(F.max("y").alias("y"))
    of = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    # labels grow with the documents: the join moves both sides at every size
    return of.where(~held_out(F.col("_id"))).join(lab.hint("merge"), "_id").select("text", "lang", "y")


def _read(batch: pa.RecordBatch) -> tuple[list[np.ndarray], list[int]]:
    return [encode(b.decode("utf-8", "replace")) for b in text_bytes(batch)], batch.column("y").to_pylist()


def bucket_counts(rows: DataFrame) -> np.ndarray:
    """(class, bucket): rows of the class with the bucket."""
    def count(batches):
        hits = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for ids, y in zip(*_read(batch)):
                hits[y, np.unique(ids)] += 1
        key = np.flatnonzero(hits.any(0))
        yield pa.RecordBatch.from_pydict({"key": key.astype(np.int32), "n0": hits[0, key], "n1": hits[1, key]})
    # one row per bucket of the table at most
    got = rows.mapInArrow(count, "key int, n0 bigint, n1 bigint").groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    hits = np.zeros((2, BUCKETS))
    for k in (0, 1):
        hits[k, got["key"].to_numpy()] = got[f"n{k}"].to_numpy()
    return hits


def mixing_round(rows: DataFrame, net: TextCNN, seed: int) -> TextCNN:
    """One pass over ``rows``: tasks train copies of ``net`` on their rows, and the changes are averaged."""
    dims = [f"d{i}" for i in range(DIM)]
    held = rows.sparkSession.sparkContext.broadcast(net.flat())

    def learn(batches):
        before = held.value
        mine = TextCNN().load(before)
        seen = mine.fit((_read(b) for b in batches), seed)
        change = mine.flat() - before
        key = np.flatnonzero(change.any(1))
        yield pa.RecordBatch.from_pydict({"key": key.astype(np.int32), "n": np.full(len(key), float(seen)),
                                          **{c: np.ascontiguousarray(change[key, i]) for i, c in enumerate(dims)}})
    moved = rows.mapInArrow(learn, ", ".join(["key int", "n double", *[f"{c} double" for c in dims]]))
    mean = moved.groupBy("key").agg(*[(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in dims]).toArrow()
    after = held.value.copy()
    after[mean["key"].to_numpy()] += np.stack([mean[c].to_numpy() for c in dims], 1)
    held.unpersist()
    return net.load(after)


def thresholds(scored: DataFrame, score_col: str = "score") -> dict:
    """{language: threshold of least error} over rows (lang, y, score); ties go to the one next to 0.5."""
    above = sum((F.col(score_col) >= F.lit(float(c))).cast("int") for c in GRID)      # thresholds that flag the row
    counts = scored.where(F.col("lang").isNotNull()).groupBy("lang", "y", above.alias("above")).agg(F.count(F.lit(1)).alias("n"))
    table: dict = {}
    for r in counts.collect():      # 40 rows per language at most
        table.setdefault(r["lang"], np.zeros((2, len(GRID) + 1), np.int64))[r["y"], r["above"]] = r["n"]
    cut = {}
    for lang, t in sorted(table.items()):
        if t.sum() >= 10 and t.sum(1).all():
            below = t.cumsum(1)[:, :-1]      # rows that threshold k leaves unflagged
            errors = below[1] + (t[0].sum() - below[0])
            ties = GRID[errors == errors.min()]
            cut[lang] = float(ties[np.abs(ties - 0.5).argmin()])
    return cut


def train(docs: DataFrame, labels: DataFrame, held_out, label: str = "toxic",
          lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> tuple[dict, dict]:
    """(model, thresholds by language) of all labelled rows. ``held_out(id column)`` names rows whose labels
    are never read."""
    rows = written(training_rows(docs, labels, held_out, label, lang_col, id_col, text_col), "toxicity-rows")
    got = rows.agg(F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1")).first()
    n = np.array([got["n0"], got["n1"]], np.float64)
    if not n.all():
        return {"rate": float((n[1] + 0.5) / (n.sum() + 1))}, {}
    net = TextCNN().start(bucket_counts(rows), n)
    for k in range(int(min(max(ROUNDS, ROUNDS * MANY // n.sum()), 4 * ROUNDS))):
        net = mixing_round(rows, net, 5 + k)
    model = net.tables()
    return model, thresholds(score(rows, model))


def score(docs: DataFrame, model: dict, out_col: str = "score", text_col: str = "text") -> DataFrame:
    """``docs`` with ``out_col``, the probability of the label; no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def toxicity(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series(score_texts(s.tolist(), held.value))
    toxicity.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn(out_col, pandas_udf(toxicity, "double")(F.col(text_col)))


def flag(scored: DataFrame, cut: dict, score_col: str = "score", lang_col: str = "lang") -> DataFrame:
    """Adds ``threshold`` (of the row's language, else 0.5) and ``flagged``."""
    t = F.lit(0.5)
    for lang, v in sorted(cut.items()):
        t = F.when(F.col(lang_col) == lang, F.lit(v)).otherwise(t)
    return scored.withColumn("threshold", t).withColumn("flagged", F.col(score_col) >= F.col("threshold"))


def held_out(id_column):
    return crc_bucket(id_column, 5) == 0
