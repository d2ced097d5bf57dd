"""Toxicity by a factorization machine over hashed terms.

A text's terms (lower-cased words and their stems' first bytes) are hashed to buckets. Besides a
weight for each bucket the machine has a factor vector for each, so that a pair of terms, such as an
insult and the mention of a group, scores more than both alone. Buckets that tell nothing of the
label in the training sample have weight 0, so that a long text isn't swamped by noise.

Defined results: null and empty texts get the score of the bias alone. Rows repeat as they came.
Rows without a label teach nothing; a doc_id labelled twice counts as toxic if either says so. With
no label of one class among the documents at all, every score is 0 and a warning says so. Very long
texts count whole, as sets of terms. Ties in the sample's order don't matter: such rows are equal.
An empty table gives no rows. Extra columns of the input are left out.
"""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm import common

BITS, FACTORS = 20, 8
#: The training sample has at most so many rows of each label; so many buckets at most get weights.
TOXIC_ROWS, CLEAN_ROWS, KEPT = 3000, 5000, 4096
THRESHOLD = 0.7
_BLANK = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))


def terms(text: str | None) -> set[int]:
    """Hashed terms of a whole text: its words, and the first 4, 5 and 6 bytes of longer ones."""
    mask, crc, out = (1 << BITS) - 1, zlib.crc32, set()
    for w in set((text or "").lower().encode("utf-8", "replace").translate(_BLANK).split()):
        out.add(crc(w) & mask)
        if len(w) > 5:
            out.add(crc(w[:4], 1) & mask)
            out.add(crc(w[:5], 2) & mask)
            out.add(crc(w[:6], 3) & mask)
    return out


class Machine:
    """score(x) = sigmoid(a * (w0 + sum w_i + sum_{i<j} v_i . v_j) + b) over the kept buckets of x."""

    def __init__(self, kept: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray, a: float, b: float):
        self.kept, self.w0, self.w, self.v, self.a, self.b = kept, w0, w, v, a, b
        self.slot = None

    def slots(self, ids: set[int] | np.ndarray) -> np.ndarray:
        if isinstance(ids, np.ndarray):
            return np.searchsorted(self.kept, np.intersect1d(self.kept, ids))
        if self.slot is None:
            self.slot = {int(k): i for i, k in enumerate(self.kept)}
        return np.fromiter((self.slot[i] for i in sorted(self.slot.keys() & ids)), dtype=np.int64)

    def raw(self, at: np.ndarray) -> float:
        v = self.v[at]
        return self.w0 + self.w[at].sum() + 0.5 * float((v.sum(0) ** 2).sum() - (v**2).sum())

    def score(self, ids: set[int]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.a * self.raw(self.slots(ids)) + self.b, -30, 30))))


NOTHING = Machine(np.zeros(0, np.int64), 0.0, np.zeros(0), np.zeros((0, FACTORS)), 0.0, -30.0)


def _telling(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Buckets by their log-likelihood ratio with the label, the best KEPT of those above chance."""
    pos, neg = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32)
    for r, label in zip(rows, y):
        (pos if label else neg)[r] += 1
    n1, n0 = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    seen = pos + neg
    with np.errstate(divide="ignore", invalid="ignore"):
        p = seen / (n1 + n0)
        part = lambda k, n, q: np.where(k > 0, k * np.log(np.where(k > 0, k / (n * q), 1)), 0)
        g = 2 * (part(pos, n1, p) + part(neg, n0, p) + part(n1 - pos, n1, 1 - p) + part(n0 - neg, n0, 1 - p))
    g = np.where((seen >= 2) & np.isfinite(g), g, 0)
    best = np.argsort(-g, kind="stable")[:KEPT]
    return np.sort(best[g[best] > 12])


def train(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, epochs: int = 25, seed: int = 7) -> Machine:
    """Adagrad over single rows; a fifth of them is kept apart for the calibration (Platt)."""
    if not len(y) or y.min() == y.max():
        return NOTHING
    fold = np.arange(len(y)) % 5 == 4
    kept = _telling([r for r, f in zip(rows, fold) if not f], y[~fold])
    rng = np.random.default_rng(seed)
    m = Machine(kept, 0.0, np.zeros(len(kept)), rng.normal(0, 0.01, (len(kept), FACTORS)), 1.0, 0.0)
    at = [m.slots(r) for r in rows]
    g0, gw, gv = 1e-8, np.full(len(kept), 1e-8), np.full((len(kept), FACTORS), 1e-8)
    train_at = np.flatnonzero(~fold)
    for _ in range(epochs):
        for i in rng.permutation(train_at):
            x = at[i]
            v = m.v[x]
            total = v.sum(0)
            z = m.w0 + m.w[x].sum() + 0.5 * float((total**2).sum() - (v**2).sum())
            d = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i]
            g0 += d * d
            m.w0 -= 0.2 * d / np.sqrt(g0)
            if len(x) and abs(d) > 1e-3:
                g = d + 1e-4 * m.w[x]
                gw[x] += g * g
                m.w[x] -= 0.2 * g / np.sqrt(gw[x])
                g = d * (total - v) + 1e-3 * v
                gv[x] += g * g
                m.v[x] -= 0.05 * g / np.sqrt(gv[x])
    z, t, wt = np.array([m.raw(at[i]) for i in np.flatnonzero(fold)]), y[fold], weight[fold]
    if len(t) and t.min() != t.max():
        m.a, m.b = platt(z, t, wt)
    return m


def platt(z: np.ndarray, t: np.ndarray, wt: np.ndarray) -> tuple[float, float]:
    """Weighted logistic fit of t on z by Newton steps, with a small ridge towards a = 1, b = 0."""
    a, b, ridge = 1.0, 0.0, 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        r, h = wt * (p - t), wt * p * (1 - p) + 1e-9
        grad = np.array([(r * z).sum() + ridge * (a - 1), r.sum() + ridge * b])
        hess = np.array([[(h * z * z).sum() + ridge, (h * z).sum()], [(h * z).sum(), h.sum() + ridge]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-6:
            break
    return float(max(a, 0.05)), float(b)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    common.make_room()
    for b in batches:
        out = [sorted(terms(t)) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("toxic"), b.column("spot"), pa.array(out, pa.list_(pa.int32()))], names=["toxic", "spot", "terms"])


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> Machine:
    """A machine from labelled rows whose crc32(doc_id) mod 3 isn't 1.

    Bound: at most toxic_rows and clean_rows labelled rows of docs, chosen by a hash of doc_id, then of
    the row where an id repeats; only their hashed terms come to the driver. Labels of rows that docs
    hasn't are left out before the choice.
    """
    spark = docs.sparkSession
    common.bound_batches(spark)
    known = labels.filter("doc_id is not null and toxic is not null").filter(~common.held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = common.written(known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi"), "labelled")
    counts = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    spot = F.xxhash64("doc_id", F.lit("sample"))
    sample = [r for label, n in ((1, toxic_rows), (0, clean_rows)) for r in known.filter(F.col("toxic") == label).orderBy(spot, "doc_id").limit(n).collect()]
    if len({r[1] for r in sample}) < 2:
        warnings.warn("no labelled document of one class: every score is 0", stacklevel=2)
        return NOTHING
    # by Arrow: rows of Python would start workers of another kind, which stay
    picked = spark.createDataFrame(pa.table({"doc_id": pa.array([r[0] for r in sample], pa.int64()), "toxic": pa.array([r[1] for r in sample], pa.int32())}))
    # the sample's size is bounded by the two parameters, so it may be broadcast
    spot = F.xxhash64("doc_id", "text", F.lit("row"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id").select("toxic", spot.alias("spot"), "text").mapInArrow(_hashed, "toxic int, spot long, terms array<int>")
    got = pa.concat_tables([rows.filter(F.col("toxic") == label).orderBy("spot").limit(n).drop("spot").toArrow() for label, n in ((1, toxic_rows), (0, clean_rows))])
    held = [x.values.to_numpy() for x in got.column("terms")]  # arrays of 32-bit buckets, sorted
    order = sorted(range(len(held)), key=lambda i: zlib.crc32(held[i].tobytes()))
    y = got.column("toxic").to_numpy().astype(float)[order]
    weight = np.where(y == 1, counts.get(1, 0) / max(1, y.sum()), counts.get(0, 0) / max(1, (1 - y).sum()))
    return train([held[i] for i in order], y, weight / max(weight.mean(), 1e-9) if len(y) else weight)


def score(docs: DataFrame, machine: Machine, flag: Column | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score in 0..1 of every row's whole text, and predicted: 1 where it is at least the threshold."""
    return scored(docs.select("doc_id", *([flag.alias("held_out")] if flag is not None else []), F.col("text").alias("text_")), machine, threshold)


def scored(rows: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """Rows with score and predicted in the place of their last column, text_."""
    common.bound_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.make_room()
        for b in batches:
            found = [machine.score(terms(t)) for t in b.column("text_").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.float64()), pa.array([int(s >= threshold) for s in found], pa.int32())], names=[*b.schema.names[:-1], "score", "predicted"])

    return rows.mapInArrow(run, common.with_fields(rows.drop("text_").schema, "score double, predicted int"))


def op2(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, fit(docs, common.table(spark, sf_dir, "labels")), flag=common.held_out("doc_id"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic, with their columns."""
    machine = fit(docs, common.table(spark, sf_dir, "labels"))
    return common.unpacked(scored(common.packed(docs), machine).filter("predicted = 0"), docs.columns)
