"""Exact top-k inner products over norm-sorted vectors with Cauchy-Schwarz pruning.

Vectors become integers, floor(scale * x), kept as doubles, which hold them exactly. Candidates lie
sorted by descending length within their partition. Queries, in blocks of bounded size, are sent to
all partitions, block after block; a block's results are written and its broadcast is released
before the next one is sent. A partition goes through its candidates in pieces: it stops for a query
once the lengths' product can't reach the query's k-th score; before that, each piece is scored on
the first few coordinates of a rotation (right singular vectors of all rows, so that these carry
most of the energy), and only candidates whose partial sum plus the product of the residual lengths
reaches the k-th score are scored exactly. Each partition gives k rows a query; the best k of these
are the result.

A pair whose lengths' product is under 2^53 is scored by floating point, all of whose sums are then
exact; other pairs are scored by whole numbers of any size. Scores are kept as two 63-bit halves.

Defined results: vectors that are null or hold null or non-finite components, and rows with a null
id, take no part. Ranks go by the exact score up to +-2^125; a score beyond 64 bits is returned as
the nearest 64-bit value. Only vectors of a query's dimension are its candidates (the empty vector
is one of dimension 0 and scores 0); rows with the query's id are not. Ties go to the smaller
vec_id, repeated candidate rows each count, a repeated query row counts once. Empty tables, and
tables without candidates, give no rows. Extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm import common

K, EVERY, SCALE = 5, 50, 256
#: Queries sent at once and bytes of them, queries scored at once, energy that the first rotated coordinates carry.
QUERY_BLOCK, QUERY_BYTES, SLICE, ENERGY = 16_384, 64 << 20, 2_048, 0.9
#: Sums of whole numbers under this are exact in floating point.
_EXACT = float(1 << 53)
_HALF = 63
_MOST = (1 << 125) - 1


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, dim, norm and the integers (packed doubles) of each usable row."""
    usable = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(scale * x) != float("inf")), F.lit(False)))
    usable = usable.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(finite)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [np.floor(scale * x.values.to_numpy(zero_copy_only=False)).astype("<f8") for x in b.column("v")]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array([len(x) for x in out], pa.int32()), pa.array([float(np.sqrt((x**2).sum())) for x in out], pa.float64()), pa.array([x.tobytes() for x in out], pa.binary())], names=["vec_id", "dim", "norm", "v"])

    return usable.mapInArrow(run, "vec_id long, dim int, norm double, v binary")


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="<f8").reshape(len(column), dim)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        dims = b.column("dim").to_numpy()
        v = np.array(b.column("v").to_pylist(), dtype=object)
        for d in np.unique(dims[dims > 0]).tolist():
            m = _matrix(v[dims == d], d)
            total[d] = total.get(d, 0.0) + m.T @ m
    for d, g in total.items():
        i, j = np.divmod(np.arange(d * d), d)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(g.ravel(), pa.float64())], names=["dim", "i", "j", "g"])


def rotations(ints: DataFrame, energy: float = ENERGY) -> dict[int, tuple[np.ndarray, int]]:
    """By dimension: the right singular vectors of all rows and how many of them carry the energy asked for."""
    sums = ints.select("dim", "v").mapInArrow(_grams, "dim int, i int, j int, g double").groupBy("dim", "i", "j").agg(F.sum("g").alias("g"))
    grams: dict[int, np.ndarray] = {}
    for r in sums.toLocalIterator():
        grams.setdefault(r.dim, np.zeros((r.dim, r.dim)))[r.i, r.j] = r.g
    out = {0: (np.zeros((0, 0)), 0)}
    for d, g in grams.items():
        if not np.isfinite(g).all():  # lengths beyond floating point: no rotation, nothing pruned by it
            out[d] = (np.eye(d), d)
            continue
        values, vectors = np.linalg.eigh((g + g.T) / 2)
        values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
        share = np.cumsum(values) / max(values.sum(), 1e-300)
        out[d] = (np.ascontiguousarray(vectors), int(min(d, 1 + np.searchsorted(share, energy))))
    return out


def halves(scores) -> tuple[np.ndarray, np.ndarray]:
    """High and low 63 bits of whole numbers, cut to +-2^125."""
    if isinstance(scores, np.ndarray):
        whole = scores.astype(np.int64)
        return whole >> _HALF, whole & np.int64((1 << _HALF) - 1)
    cut = [max(-_MOST, min(_MOST, x)) for x in scores]
    return np.array([x >> _HALF for x in cut], dtype=np.int64), np.array([x & ((1 << _HALF) - 1) for x in cut], dtype=np.int64)


class Best:
    """The k best (score, vec_id) so far of each of some queries, and the pruned scoring of candidates."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, rotation: np.ndarray, depth: int, k: int):
        self.ids, self.q, self.k, self.rotation, self.depth = ids, q, k, rotation, depth
        turned = q @ rotation
        self.head, self.rest = turned[:, :depth], np.sqrt((turned[:, depth:] ** 2).sum(1))
        self.norm = np.sqrt((q**2).sum(1))
        self.of, self.high, self.low, self.vec = (np.zeros(0, np.int64) for _ in range(4))
        self.least = np.full(len(ids), -np.inf)

    def _keep(self, of: np.ndarray, high: np.ndarray, low: np.ndarray, vec: np.ndarray) -> None:
        of, high, low, vec = (np.concatenate(p) for p in ((self.of, of), (self.high, high), (self.low, low), (self.vec, vec)))
        order = np.lexsort((vec, -low, -high, of))
        of, high, low, vec = (x[order] for x in (of, high, low, vec))
        rank = np.arange(len(of)) - np.searchsorted(of, of)
        kth = rank == self.k - 1
        self.least[of[kth]] = high[kth] * 2.0**_HALF + low[kth]
        self.of, self.high, self.low, self.vec = (x[rank < self.k] for x in (of, high, low, vec))

    def _scores(self, rows: np.ndarray, c: np.ndarray, norm: np.ndarray, i: np.ndarray, j: np.ndarray, dense: bool) -> tuple[np.ndarray, np.ndarray]:
        """Exact scores of the pairs (rows[i], c[j])."""
        safe = self.norm[rows[i]] * norm[j] < _EXACT
        high, low = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        a, b = i[safe], j[safe]
        if len(a):
            if dense:
                found = (self.q[rows] @ c.T)[a, b]
            else:
                found = np.concatenate([(self.q[rows[a[s : s + 65536]]] * c[b[s : s + 65536]]).sum(1) for s in range(0, len(a), 65536)])
            high[safe], low[safe] = halves(found)
        if not safe.all():
            whole = {}

            def ints(key, x) -> list[int]:
                if key not in whole:
                    whole[key] = [int(y) for y in x]
                return whole[key]

            pairs = zip(i[~safe].tolist(), j[~safe].tolist())
            high[~safe], low[~safe] = halves([sum(x * y for x, y in zip(ints(("q", m), self.q[rows[m]]), ints(("c", n), c[n]))) for m, n in pairs])
        return high, low

    def add(self, vec: np.ndarray, c: np.ndarray, norm: np.ndarray) -> bool:
        """Scores a piece of candidates, sorted by descending norm; False once no later one can matter."""
        slack = 1e-6 * self.norm * norm[0] + 1e-3
        live = np.flatnonzero(~(self.norm * norm[0] + slack < self.least))  # lengths beyond floating point prune nothing
        if not len(live):
            return False
        turned = c @ self.rotation
        head, rest = turned[:, : self.depth], np.sqrt((turned[:, self.depth :] ** 2).sum(1))
        for at in range(0, len(live), SLICE):
            rows = live[at : at + SLICE]
            bound = self.head[rows] @ head.T + self.rest[rows, None] * rest
            may = ~(bound + slack[rows, None] < self.least[rows, None])
            may &= self.ids[rows, None] != vec
            i, j = np.nonzero(may)
            if not len(i):
                continue
            high, low = self._scores(rows, c, norm, i, j, 8 * len(i) > may.size)
            good = ~(high * 2.0**_HALF + low + slack[rows[i]] < self.least[rows[i]])
            self._keep(rows[i[good]], high[good], low[good], vec[j[good]])
        return True


def search(ints: DataFrame, queries: DataFrame, k: int = K, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of ints for each row of queries (both as of integers())."""
    spark = ints.sparkSession
    common.bound_batches(spark)
    ints = common.written(ints.sortWithinPartitions("dim", F.desc("norm"), "vec_id"), "vectors")
    queries = common.written(queries.select("vec_id", "dim", "v").distinct(), "queries")
    turns = rotations(ints)
    schema = "query_id long, query_key long, vec_id long, high long, low long"
    path = common.scratch(spark, "best")
    count, size = queries.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("v")), F.lit(0))).first()
    n = max(-(-count // query_block), -(-size // QUERY_BYTES), 1)
    for block in range(n):
        rows = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == block).toArrow()
        # about query_block rows or QUERY_BYTES, whatever the table's size
        sent = spark.sparkContext.broadcast({d: (ids, keys, q) for d in sorted(turns) for ids, keys, q in [_block(rows, d)] if len(ids)})

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            best: dict[int, Best] = {}
            done: dict[int, float] = {}
            for b in batches:
                dims, norms, vec = (b.column(c).to_numpy() for c in ("dim", "norm", "vec_id"))
                v = np.array([*b.column("v").to_pylist(), None], dtype=object)[:-1]
                for d in np.unique(dims).tolist():
                    if d not in sent.value:
                        continue
                    if d not in best:
                        ids, _, q = sent.value[d]
                        best[d] = Best(ids, q, *turns[d], k)
                    at = np.flatnonzero(dims == d)
                    at = at[np.argsort(-norms[at], kind="stable")]
                    for s in [0, *range(64, len(at), 1024)]:  # a short piece first gives bounds to prune by
                        piece = at[s : 64 if s == 0 else s + 1024]
                        if norms[piece[0]] > done.get(d, np.inf) or d not in done:
                            if not best[d].add(vec[piece], _matrix(v[piece], d), norms[piece]):
                                done[d] = norms[piece[0]]
            for d, found in best.items():
                ids, keys, _ = sent.value[d]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[found.of], keys[found.of], found.vec, found.high, found.low)], names=["query_id", "query_key", "vec_id", "high", "low"])

        ints.mapInArrow(run, schema).write.parquet(f"{path}/block={block}")
        sent.destroy()
    out = spark.read.schema(schema).parquet(*(f"{path}/block={block}" for block in range(n)))
    rank = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(F.desc("high"), F.desc("low"), "vec_id"))
    least, most = -(1 << 63), (1 << 63) - 1
    score = F.when(F.col("high") == 0, F.col("low")).when(F.col("high") == -1, F.col("low") + F.lit(least)).otherwise(F.when(F.col("high") > 0, F.lit(most)).otherwise(F.lit(least)))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))


def _block(rows: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, keys (one for each distinct row) and vectors of the rows of one dimension."""
    at = np.flatnonzero(rows.column("dim").to_numpy() == dim)
    v = np.array([*rows.column("v").to_pylist(), None], dtype=object)[:-1][at]
    ids = rows.column("vec_id").to_numpy()[at].astype(np.int64)
    keys = np.array([int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True) for x in v], dtype=np.int64)
    return ids, keys, _matrix(v, dim)


def op10(spark, sf_dir: str) -> DataFrame:
    ints = common.written(integers(common.table(spark, sf_dir, "embeddings")), "integers")
    return search(ints, ints.filter(F.col("vec_id") % EVERY == 0))
