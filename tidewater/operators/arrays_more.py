"""Further operators on arrays in long form: selection, assembly, einsum, hypothesis tests, dense factorisations."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce as _fold

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators.arrays import concatenate, from_numpy, small_linalg


def argwhere(a: DataFrame, condition: Column) -> DataFrame:
    """Indices of the cells that meet a condition on v."""
    return a.filter(condition).select(*(c for c in a.columns if c != "v"))


def nonzero(a: DataFrame) -> DataFrame:
    return argwhere(a, F.col("v") != 0)


def compress(a: DataFrame, axis: str, keep: list[bool]) -> DataFrame:
    return a.filter(F.col(axis).isin([i for i, k in enumerate(keep) if k]))


def choose(index: Column, choices: list[Column]) -> Column:
    return F.get(F.array(*choices), index)


def piecewise(c: Column, conditions: list[Column], values: list, default=0.0) -> Column:
    out = F.when(conditions[0], values[0])
    for k, v in zip(conditions[1:], values[1:]):
        out = out.when(k, v)
    return out.otherwise(default)


def unravel(flat: Column, shape: tuple[int, ...]) -> list[Column]:
    out = []
    for n in reversed(shape):
        out.append((flat % n).cast("long"))
        flat = F.floor(flat / n)
    return out[::-1]


def percentile(a: DataFrame, q: list[float], exact: bool = True) -> DataFrame:
    """(q, v) for percents q."""
    p = [x / 100 for x in q]
    values = F.percentile("v", p) if exact else F.percentile_approx("v", p, 10_000)
    return a.agg(values.alias("x")).select(F.posexplode("x").alias("n", "v")).select(F.get(F.array(*map(F.lit, q)), F.col("n")).alias("q"), "v")


def isclose(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= atol + rtol * F.abs(b)


def allclose(a: DataFrame, b: DataFrame) -> DataFrame:
    keys = [c for c in a.columns if c != "v"]
    j = a.withColumnRenamed("v", "x").join(b.withColumnRenamed("v", "y"), keys, "full")
    return j.agg(F.bool_and(F.coalesce(isclose(F.col("x"), F.col("y")), F.lit(False))).alias("allclose"))


def insert(a: DataFrame, axis: str, at: int, rows: DataFrame, count: int) -> DataFrame:
    """`count` slices put before index `at`; rows' indices count from 0."""
    moved = a.withColumn(axis, F.when(F.col(axis) >= at, F.col(axis) + count).otherwise(F.col(axis)))
    return moved.unionByName(rows.withColumn(axis, F.col(axis) + at))


def vstack(parts: list[DataFrame], sizes: list[int]) -> DataFrame:
    return concatenate(parts, "i", sizes)


def hstack(parts: list[DataFrame], sizes: list[int]) -> DataFrame:
    return concatenate(parts, "j", sizes)


def block(grid: list[list[DataFrame]], heights: list[int], widths: list[int]) -> DataFrame:
    return vstack([hstack(row, widths) for row in grid], heights)


def repeat(a: DataFrame, axis: str, times: int) -> DataFrame:
    return a.withColumn("r_", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn(axis, F.col(axis) * times + F.col("r_")).drop("r_")


def tile(a: DataFrame, axis: str, times: int, size: int) -> DataFrame:
    return a.withColumn("r_", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn(axis, F.col(axis) + F.col("r_") * size).drop("r_")


def pad(a: DataFrame, axis: str, before: int, after: int, size: int, mode: str = "edge", value: float = 0.0) -> DataFrame:
    """Cells before and after the axis's ends: the edge's values or a constant."""
    moved = a.withColumn(axis, F.col(axis) + before)
    ends = []
    for at, first, n in ((0, 0, before), (size - 1, before + size, after)):
        if n:
            edge = a.filter(F.col(axis) == at).withColumn(axis, F.explode(F.sequence(F.lit(first).cast("long"), F.lit(first + n - 1).cast("long"))))
            ends.append(edge if mode == "edge" else edge.withColumn("v", F.lit(value)))
    return _fold(DataFrame.unionByName, ends, moved)


def fromfunction(spark: SparkSession, rows: int, columns: int, f: Callable[[Column, Column], Column]) -> DataFrame:
    cells = spark.range(rows * columns).select(F.floor(F.col("id") / columns).alias("i"), (F.col("id") % columns).alias("j"))
    return cells.select("i", "j", f(F.col("i"), F.col("j")).cast("double").alias("v"))


def meshgrid(x: DataFrame, y: DataFrame) -> DataFrame:
    """(i, j, x, y) of two axes (i, v)."""
    return x.select(F.col("i").alias("j"), F.col("v").alias("x")).crossJoin(y.select("i", F.col("v").alias("y"))).select("i", "j", "x", "y")


def diag(v: DataFrame) -> DataFrame:
    """A diagonal matrix of a vector (i, v)."""
    return v.select("i", F.col("i").alias("j"), "v")


def einsum(text: str, *operands: DataFrame) -> DataFrame:
    """Einstein sums, such as ij,jk->ik: joins on shared letters, then sums. Operands' index columns go by position."""
    inputs, output = text.replace(" ", "").split("->")
    out = None
    for n, (letters, d) in enumerate(zip(inputs.split(","), operands, strict=True)):
        names = [c for c in d.columns if c != "v"]
        own = d.select(*(F.col(c).alias(x) for c, x in zip(names, letters, strict=True)), F.col("v").alias(f"v{n}"))
        if out is None:
            out = own
        else:
            shared = [x for x in letters if x in out.columns]
            out = out.join(own, shared) if shared else out.crossJoin(own)
    product = _fold(lambda p, q: p * q, (F.col(f"v{n}") for n in range(len(operands))))
    return out.groupBy(*output).agg(F.sum(product).alias("v")) if output else out.agg(F.sum(product).alias("v"))


def apply_along_axis(a: DataFrame, axis: str, f: Callable[[np.ndarray], float]) -> DataFrame:
    """f of each slice along an axis; a slice must fit in one task."""
    keys = [c for c in a.columns if c not in ("v", axis)]
    kinds = dict(a.dtypes)

    def run(p):
        import pandas as pd

        return pd.DataFrame([{**{k: p[k].iloc[0] for k in keys}, "v": float(f(p.sort_values(axis).v.to_numpy()))}])

    return a.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", v double")


def vdot(a: DataFrame, b: DataFrame) -> DataFrame:
    """The sum of products of equal cells, whatever the number of axes."""
    keys = [c for c in a.columns if c != "v"]
    return a.withColumnRenamed("v", "x").join(b.withColumnRenamed("v", "y"), keys).agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0.0)).alias("vdot"))


def swapaxes(a: DataFrame, one: str, other: str) -> DataFrame:
    return a.select(*(F.col({one: other, other: one}.get(c, c)).alias(c) for c in a.columns))


def squeeze(a: DataFrame, axis: str) -> DataFrame:
    """Without an axis of length one; cells beyond its first index are an error."""
    return a.filter(F.when(F.col(axis) == 0, F.lit(True)).otherwise(F.raise_error(F.lit(f"axis {axis} isn't of length one")).cast("boolean"))).drop(axis)


def dstack(parts: list[DataFrame]) -> DataFrame:
    """Matrices side by side along a third axis, k."""
    return _fold(DataFrame.unionByName, (p.withColumn("k", F.lit(n).cast("long")) for n, p in enumerate(parts)))


def union1d(a: DataFrame, b: DataFrame) -> DataFrame:
    """The distinct values of both."""
    return a.select("v").union(b.select("v")).distinct()


def ediff1d(a: DataFrame, axis: str = "i") -> DataFrame:
    """Differences of neighbours of a vector."""
    from tidewater.operators.arrays import diff

    return diff(a, axis)


def extract(a: DataFrame, condition: Column) -> DataFrame:
    """The values that meet a condition, with their indices."""
    return a.filter(condition)


def apply_over_axes(a: DataFrame, how: str, axes: list[str]) -> DataFrame:
    """A reduction over some axes, which stay with length one."""
    from tidewater.operators.arrays import REDUCTIONS

    keys = [c for c in a.columns if c != "v" and c not in axes]
    return a.groupBy(*keys).agg(REDUCTIONS[how]("v").alias("v")).select(*((F.lit(0).cast("long").alias(c) if c in axes else F.col(c)) for c in a.columns if c != "v"), "v")


def indices(spark: SparkSession, shape: tuple[int, int]) -> DataFrame:
    """(axis, i, j, v): each cell's own indices."""
    cells = spark.range(shape[0] * shape[1]).select(F.floor(F.col("id") / shape[1]).alias("i"), (F.col("id") % shape[1]).alias("j"))
    return cells.select(F.posexplode(F.array("i", "j")).alias("axis", "v"), "i", "j").select("axis", "i", "j", "v")


def full_like(a: DataFrame, value: float) -> DataFrame:
    return a.withColumn("v", F.lit(value).cast("double"))


def zeros_like(a: DataFrame) -> DataFrame:
    return full_like(a, 0.0)


def ones_like(a: DataFrame) -> DataFrame:
    return full_like(a, 1.0)


def apply_gufunc(f: Callable[[np.ndarray], np.ndarray], rows: DataFrame, row: str, vector: str) -> DataFrame:
    """f of a stack of rows' vectors along its last axis, batch by batch: (..., n) to (..., m)."""

    def run(batches):
        for b in batches:
            sizes = b[vector].map(len)
            for _, part in b.groupby(sizes):
                found = np.asarray(f(np.array(part[vector].tolist(), dtype=float)))
                yield part.assign(**{vector: list(found.reshape(len(part), -1))})

    return rows.select(row, vector).mapInPandas(run, f"{row} {dict(rows.dtypes)[row]}, {vector} array<double>")


def sfqr(spark: SparkSession, rows: DataFrame, row: str, vector: str, height: int) -> tuple[np.ndarray, DataFrame]:
    """Q and R of a matrix with few rows (height) and many columns, given as columns (row: column number, vector: its cells).

    Q is of the first `height` columns, on the driver; the rest of R is Q' times each column, in place.
    """
    first = rows.orderBy(row).limit(height).toPandas().sort_values(row)
    q, _ = np.linalg.qr(np.array(first[vector].tolist(), dtype=float).T)
    return q, apply_gufunc(lambda x: x @ q, rows, row, vector)


# Tests of hypotheses -------------------------------------------------------------------------------------


def power_divergence(df: DataFrame, observed: str, expected: str, power: float = 1.0) -> DataFrame:
    """The Cressie-Read family: 1 is Pearson's, 0 the log-likelihood ratio."""
    o, e = F.col(observed).cast("double"), F.col(expected).cast("double")
    if power == 0:
        stat = 2 * F.sum(F.when(o > 0, o * F.ln(o / e)).otherwise(0.0))
    elif power == -1:
        stat = 2 * F.sum(e * F.ln(e / o))
    else:
        stat = 2 / (power * (power + 1)) * F.sum(o * (F.pow(o / e, F.lit(power)) - 1))
    return df.agg(stat.alias("statistic"))


def skewtest(c: str) -> Column:
    """z of D'Agostino's test of skewness."""
    n = F.count(c).cast("double")
    y = F.skewness(c) * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    delta, alpha = 1 / F.sqrt(0.5 * F.ln(w2)), F.sqrt(2 / (w2 - 1))
    return delta * F.ln(y / alpha + F.sqrt((y / alpha) * (y / alpha) + 1))


def kurtosistest(c: str) -> Column:
    """z of Anscombe's and Glynn's test of kurtosis."""
    n = F.count(c).cast("double")
    x = (F.kurtosis(c) + 3 - 3 * (n - 1) / (n + 1)) / F.sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)))
    b = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / b * (2 / b + F.sqrt(1 + 4 / (b * b)))
    d = 1 + x * F.sqrt(2 / (a - 4))
    return (1 - 2 / (9 * a) - F.signum(d) * F.pow((1 - 2 / a) / F.abs(d), F.lit(1 / 3))) / F.sqrt(2 / (9 * a))


def normaltest(c: str) -> Column:
    s, k = skewtest(c), kurtosistest(c)
    return s * s + k * k


# Dense matrices of known, small size, on the driver ------------------------------------------------------


def qr(spark: SparkSession, rows: DataFrame, row: str, vector: str, size: int, fan: int = 64) -> tuple[DataFrame, np.ndarray]:
    """Q (row, vector) and R of a tall matrix of rows, by a tree of small QRs: R of each partition, then of stacks of `fan` Rs.

    As stable as QR itself. Only the last R, size x size, comes to the driver; Q is solved from it row by row.
    """

    def stacked(batches):
        import pandas as pd

        held = np.zeros((0, size))
        for b in batches:
            x = np.concatenate([held, np.array(b["x"].tolist(), dtype=float).reshape(-1, size)])
            held = np.linalg.qr(x, mode="r")
        if len(held):  # a partition may have no rows, and an empty column has no type of arrays
            yield pd.DataFrame({"x": list(held)})

    data = rows.select(F.col(vector).cast("array<double>").alias("x"))
    parts = data.rdd.getNumPartitions()
    data = data.mapInPandas(stacked, "x array<double>")
    while parts > 1:
        parts = -(-parts // fan)
        data = data.repartition(parts).mapInPandas(stacked, "x array<double>")
    r = np.linalg.qr(np.array([x[0] for x in data.collect()], dtype=float).reshape(-1, size), mode="r")
    r = r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]
    q = apply_gufunc(lambda x: np.linalg.solve(r.T, x.T).T, rows.select(row, F.col(vector).cast("array<double>").alias(vector)), row, vector)
    return q, r


def svd_compressed(rows: DataFrame, vector: str, size: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest singular values and their right vectors."""
    from tidewater.operators.arrays import svd

    s, v = svd(rows, vector, size)
    return s[:k], v[:, :k]


def inv(spark: SparkSession, a: DataFrame) -> DataFrame:
    return from_numpy(spark, small_linalg(a, np.linalg.inv))


def cholesky(spark: SparkSession, a: DataFrame) -> DataFrame:
    return from_numpy(spark, small_linalg(a, np.linalg.cholesky))


def solve(spark: SparkSession, a: DataFrame, b: DataFrame) -> DataFrame:
    """x of a x = b, for b as a matrix of columns."""
    from tidewater.operators.arrays import to_numpy

    return from_numpy(spark, np.linalg.solve(to_numpy(a), to_numpy(b)))


def lu(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P, L, U with partial pivoting."""
    n = len(a)
    u, low, p = a.astype(float).copy(), np.eye(n), np.eye(n)
    for k in range(n - 1):
        at = k + int(np.argmax(abs(u[k:, k])))
        if at != k:
            u[[k, at]], p[[k, at]] = u[[at, k]], p[[at, k]]
            low[[k, at], :k] = low[[at, k], :k]
        if u[k, k]:
            low[k + 1 :, k] = u[k + 1 :, k] / u[k, k]
            u[k + 1 :] -= np.outer(low[k + 1 :, k], u[k])
    return p.T, low, np.triu(u)


def solve_triangular(a: np.ndarray, b: np.ndarray, lower: bool = True) -> np.ndarray:
    x = np.zeros_like(b, dtype=float)
    order = range(len(a)) if lower else range(len(a) - 1, -1, -1)
    for i in order:
        x[i] = (b[i] - a[i] @ x) / a[i, i]
    return x


def norm(a: DataFrame, kind: str = "fro") -> DataFrame:
    if kind == "fro":
        return a.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    by = "j" if kind == "1" else "i"
    return a.groupBy(by).agg(F.sum(F.abs("v")).alias("s")).agg(F.max("s").alias("norm"))


def f_sf_normal(z: float) -> float:
    """Two-sided p of a normal statistic."""
    return math.erfc(abs(z) / math.sqrt(2))
