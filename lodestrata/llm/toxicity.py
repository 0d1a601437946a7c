"""Toxicity by a factorization machine over hashed terms.

A text's features are the distinct hashed terms it holds: lower-case words and their beginnings of
4 to 8 characters, so that inflected forms share a term. The score is
sigmoid(w0 + sum w_i + 1/2 sum_f ((sum v_if)^2 - sum v_if^2)): linear weights and, through the factor
vectors, every pairwise interaction of terms. Weights are kept in tables of 2**BITS cells, so the
model broadcast to the executors has a fixed size (BITS, FACTORS), whatever the corpus.

The model is fitted on the driver to a sample of labelled rows bounded by `max_rows`; the cells that
the sample's labels inform most (at most `active` of them) carry weights, the others none. Scoring
reads whole texts.

Defined cases: null and empty texts have no terms and get the intercept's score; rows of `labels`
with null id, null label or no document are not learned from; a document labelled more than once
counts each time; without labelled rows of both kinds the score is the share of toxic rows (0 without
any); a null doc_id counts as '' in the held-out rule; repeated rows are scored each.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import done, kept_rows, remainder, small_batches, staged

BITS = 20
FACTORS = 4
WORD = re.compile(r"\w+")
BEGINNINGS = (4, 5, 6, 7, 8)
#: Bound of the labelled sample that the model is fitted to.
MAX_ROWS = 10_000
#: Bound of the cells that carry weights.
ACTIVE = 1 << 10


@dataclass
class Machine:
    w0: float
    w: np.ndarray
    v: np.ndarray

    def logit(self, cells: np.ndarray) -> float:
        if not len(cells):
            return self.w0
        v = self.v[cells]
        s = v.sum(axis=0)
        return float(self.w0 + self.w[cells].sum() + 0.5 * (s @ s - (v * v).sum()))


class Hasher:
    """Cells of a text's distinct terms; the memory of words is bounded."""

    def __init__(self, bits: int = BITS, active: np.ndarray | None = None, most: int = 100_000) -> None:
        """active: marks the cells that carry weights; without it all cells are returned."""
        self.mask, self.active, self.most, self.known = (1 << bits) - 1, active, most, {}

    def cells(self, text: str | None) -> np.ndarray:
        known, out = self.known, set()
        for w in set(WORD.findall(text.lower())) if text else ():
            c = known.get(w)
            if c is None:
                if len(known) >= self.most:
                    known.clear()
                c = known[w] = tuple({zlib.crc32(t.encode("utf-8", "surrogatepass")) & self.mask for t in (w, *[w[:k] + "-" for k in BEGINNINGS if len(w) >= k])})
                if self.active is not None:
                    c = known[w] = tuple(x for x in c if self.active[x])
            out.update(c)
        return np.fromiter(out, np.int32, len(out))


def _informative(samples: list[tuple[int, np.ndarray]], size: int, active: int) -> np.ndarray:
    """Cells that carry weights, of those in at least three rows: three quarters are those with the most information about the label (G statistic over presence); the rest are the most frequent others, which may count only together with another term."""
    n, k = np.zeros(size), np.zeros(size)
    total, pos = float(len(samples)), 0.0
    for label, cells in samples:
        n[cells] += 1
        if label:
            k[cells] += 1
            pos += 1
    ids = np.flatnonzero(n >= 3)
    n, k = n[ids], k[ids]

    def part(a, b):
        return np.where(a > 0, a * np.log(np.maximum(a, 1e-12) / np.maximum(b, 1e-12)), 0.0)

    g = part(k, n * pos / total) + part(n - k, n * (total - pos) / total) + part(pos - k, (total - n) * pos / total) + part((total - n) - (pos - k), (total - n) * (total - pos) / total)
    informative = np.lexsort((ids, -g))[: active - active // 4]
    others = np.setdiff1d(np.arange(len(ids)), informative)
    frequent = others[np.lexsort((ids[others], -n[others]))[: active // 4]]
    return ids[np.concatenate([informative, frequent])]


def fit(samples: list[tuple[int, np.ndarray]], *, bits: int = BITS, factors: int = FACTORS, active: int = ACTIVE, epochs: int = 40, rate: float = 0.2, l2: float = 2e-4, batch: int = 128, seed: int = 7) -> Machine:
    """Mini-batch AdaGrad on the logistic loss; samples are (label, cells) in a fixed order."""
    size = 1 << bits
    w, v = np.zeros(size, np.float32), np.zeros((size, factors), np.float32)
    y = np.array([a for a, _ in samples], np.float64)
    if not len(y):
        return Machine(-30.0, w, v)
    pos = min(max(y.mean(), 1e-6), 1 - 1e-6)
    w0 = float(np.log(pos / (1 - pos)))
    if y.min() == y.max():
        return Machine(w0, w, v)
    chosen = np.sort(_informative(samples, size, active))
    if not len(chosen):
        return Machine(w0, w, v)
    local = np.full(size, -1, np.int32)
    local[chosen] = np.arange(len(chosen), dtype=np.int32)
    feats = [local[c][local[c] >= 0] for _, c in samples]
    rng = np.random.default_rng(seed)
    n = len(chosen)
    a, f = np.zeros(n), rng.normal(0, 0.01, (n, factors))
    ga, gf, g0 = np.full(n, 1e-2), np.full((n, factors), 1e-2), 1e-2
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for s in range(0, len(y), batch):
            rows = order[s : s + batch]
            sizes = np.array([len(feats[i]) for i in rows])
            idx = np.concatenate([feats[i] for i in rows]) if sizes.sum() else np.zeros(0, np.int32)
            row = np.repeat(np.arange(len(rows)), sizes)
            sv = np.zeros((len(rows), factors))
            np.add.at(sv, row, f[idx])
            s2 = np.bincount(row, weights=(f[idx] ** 2).sum(axis=1), minlength=len(rows))
            z = w0 + np.bincount(row, weights=a[idx], minlength=len(rows)) + 0.5 * ((sv**2).sum(axis=1) - s2)
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)
            e0 = err.sum()
            g0 += e0 * e0
            w0 -= rate * 0.1 * e0 / np.sqrt(g0)
            used, where = np.unique(idx, return_inverse=True)
            da = np.bincount(where, weights=err[row], minlength=len(used)) + l2 * a[used]
            df = np.zeros((len(used), factors))
            np.add.at(df, where, err[row][:, None] * (sv[row] - f[idx]))
            df += l2 * f[used]
            ga[used] += da**2
            gf[used] += df**2
            a[used] -= rate * da / np.sqrt(ga[used])
            f[used] -= rate * 0.25 * df / np.sqrt(gf[used])
    w[chosen], v[chosen] = a, f
    return Machine(w0, w, v)


def labelled_sample(docs: DataFrame, labels: DataFrame, *, max_rows: int = MAX_ROWS, bits: int = BITS) -> list[tuple[int, np.ndarray]]:
    """At most max_rows labelled rows outside the held-out fifth, those with the smallest keyed hash, as (label, cells)."""
    small_batches(docs.sparkSession)
    marked = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (remainder(F.col("doc_id")) != 0)).withColumn("draw", F.xxhash64("doc_id", F.lit("toxic")))
    n = marked.count()
    if n > max_rows:
        # The share drawn is set so that the expected sample is the bound; the exact bound is applied below.
        marked = marked.where(F.pmod("draw", F.lit(1 << 30)) < int((1 << 30) * max_rows / n))
    rows = marked.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "draw", "toxic", "text")
    schema = pa.schema([("doc_id", pa.string()), ("draw", pa.int64()), ("toxic", pa.int32()), ("cells", pa.binary())])

    def run(batches):
        h = Hasher(bits)
        for b in batches:
            cells = [np.sort(h.cells(x.as_py())).astype("<i4").tobytes() for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.string()), b.column("draw"), b.column("toxic"), pa.array(cells, pa.binary())], schema=schema)

    # Staged, so that all tasks extract at once. The exact bound is applied before anything reaches the driver, whatever ids
    # are given over and over; it orders keys only, and the driver then reads a few MB at a time.
    drawn = staged(rows.mapInArrow(run, "doc_id string, draw long, toxic int, cells binary").withColumn("row", F.monotonically_increasing_id()), "tox-sample")
    order = [F.pmod("draw", F.lit(1 << 30)), F.col("doc_id"), F.col("toxic"), F.col("same"), F.col("row")]
    first = drawn.withColumn("same", F.md5("cells")).drop("cells").orderBy(*order).limit(max_rows)
    first = staged(first.select("row", F.row_number().over(Window.orderBy(*order)).alias("nth")), "tox-first")
    bounded = staged(drawn.join(first, "row").select("nth", "toxic", "cells").repartition(16), "tox-bounded")
    kept = sorted((r["nth"], r["toxic"], bytes(r["cells"])) for r in bounded.toLocalIterator())
    done(drawn, first, bounded)
    return [(t, np.frombuffer(c, "<i4")) for _, t, c in kept]


def learn(docs: DataFrame, labels: DataFrame, **how) -> Machine:
    return fit(labelled_sample(docs, labels), **how)


def score(docs: DataFrame, machine: Machine, *, bits: int = BITS) -> DataFrame:
    """The input's columns with tox_score (0 to 1) added; a column of that name is replaced."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast((machine.w0, machine.w, machine.v))
    docs = docs.drop("tox_score")
    keep = docs.columns
    fields = T.StructType([*docs.schema.fields, T.StructField("tox_score", T.DoubleType())])

    def run(batches):
        m = Machine(*shared.value)
        h = Hasher(bits, bytes((m.w != 0) | m.v.any(axis=1)))
        for b in batches:
            s = [1 / (1 + np.exp(-min(30.0, max(-30.0, m.logit(h.cells(x.as_py())))))) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(s, pa.float64())], names=[*keep, "tox_score"])

    return docs.mapInArrow(run, fields)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    scored = score(docs.select("doc_id", "text"), learn(docs, labels))
    return scored.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents, all columns, that the machine doesn't call toxic."""
    machine = learn(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast((machine.w0, machine.w, machine.v))

    def keep():
        m = Machine(*shared.value)
        h = Hasher(BITS, bytes((m.w != 0) | m.v.any(axis=1)))
        return lambda texts: [1 / (1 + np.exp(-min(30.0, max(-30.0, m.logit(h.cells(x)))))) < threshold for x in texts]

    return kept_rows(docs, keep)
