"""N-d arrays in long form: one row a cell, index columns and a value `v`. Zero cells may be left out of matrices."""

from __future__ import annotations

from functools import reduce as _fold

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NAN = float("nan")


def from_vectors(df: DataFrame, row: str, vector: str) -> DataFrame:
    """(i, j, v) from rows with an array column."""
    return df.select(F.col(row).cast("long").alias("i"), F.posexplode(vector).alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))


def from_numpy(spark: SparkSession, a: np.ndarray) -> DataFrame:
    i, j = np.indices(a.shape).reshape(2, -1)
    return spark.createDataFrame(list(zip(i.tolist(), j.tolist(), a.ravel().astype(float).tolist())), "i long, j long, v double")


def to_numpy(a: DataFrame) -> np.ndarray:
    """On the driver: for arrays of known, small size."""
    rows = a.toPandas()
    i, j = (rows[c].to_numpy().astype(int) for c in a.columns if c != "v")
    out = np.zeros((int(i.max()) + 1, int(j.max()) + 1)) if len(rows) else np.zeros((0, 0))
    out[i, j] = rows["v"]
    return out


def _nan_as_null(c: str) -> Column:
    return F.when(~F.isnan(c), F.col(c))


REDUCTIONS = {
    "sum": lambda c: F.sum(c), "prod": lambda c: F.product(F.col(c)), "min": F.min, "max": F.max, "any": lambda c: F.bool_or(F.col(c) != 0), "all": lambda c: F.bool_and(F.col(c) != 0), "mean": F.avg, "var": F.var_pop, "std": F.stddev_pop, "median": F.median, "count_nonzero": lambda c: F.count_if(F.col(c) != 0), "ptp": lambda c: F.max(c) - F.min(c), "skew": F.skewness, "kurtosis": F.kurtosis, "norm": lambda c: F.sqrt(F.sum(F.col(c) * F.col(c))),
    "nansum": lambda c: F.coalesce(F.sum(_nan_as_null(c)), F.lit(0.0)), "nanmin": lambda c: F.min(_nan_as_null(c)), "nanmax": lambda c: F.max(_nan_as_null(c)), "nanmean": lambda c: F.avg(_nan_as_null(c)), "nanprod": lambda c: F.product(_nan_as_null(c)), "nanvar": lambda c: F.var_pop(_nan_as_null(c)), "nanstd": lambda c: F.stddev_pop(_nan_as_null(c)), "nanmedian": lambda c: F.median(_nan_as_null(c)),
}


def reduce(a: DataFrame, how: str | list[str], axis: str | None = None) -> DataFrame:
    """Reductions over one axis (the other index stays) or over all cells."""
    names = [how] if isinstance(how, str) else how
    keys = [c for c in a.columns if c not in ("v", axis)] if axis else []
    return a.groupBy(*keys).agg(*(REDUCTIONS[n]("v").alias(n) for n in names))


def moment(a: DataFrame, n: int) -> DataFrame:
    """n-th central moment of all cells."""
    m = a.agg(F.avg("v").alias("m_"))
    return a.crossJoin(F.broadcast(m)).agg(F.avg(F.pow(F.col("v") - F.col("m_"), F.lit(n))).alias("moment"))  # one row


def arg(a: DataFrame, how: str, axis: str) -> DataFrame:
    """argmin or argmax along an axis; ties go to the smaller index."""
    keys = [c for c in a.columns if c not in ("v", axis)]
    best = F.max(F.struct("v", (-F.col(axis)).alias("x")))["x"] * -1 if how == "max" else F.min(F.struct("v", F.col(axis).alias("x")))["x"]
    return a.groupBy(*keys).agg(best.alias(f"arg{how}"))


def cumulate(a: DataFrame, how: str, axis: str) -> DataFrame:
    keys = [c for c in a.columns if c not in ("v", axis)]
    w = Window.partitionBy(*keys).orderBy(axis).rowsBetween(Window.unboundedPreceding, 0)
    return a.withColumn("v", (F.sum("v") if how == "sum" else F.product(F.col("v"))).over(w))


def diff(a: DataFrame, axis: str, n: int = 1) -> DataFrame:
    keys = [c for c in a.columns if c not in ("v", axis)]
    for _ in range(n):
        w = Window.partitionBy(*keys).orderBy(axis)
        a = a.withColumn("v", F.lead("v").over(w) - F.col("v")).filter("v is not null")
    return a


def gradient(a: DataFrame, axis: str) -> DataFrame:
    """Central differences, one-sided at the ends."""
    keys = [c for c in a.columns if c not in ("v", axis)]
    w = Window.partitionBy(*keys).orderBy(axis)
    before, after = F.lag("v").over(w), F.lead("v").over(w)
    return a.withColumn("v", F.when(before.isNull(), after - F.col("v")).when(after.isNull(), F.col("v") - before).otherwise((after - before) / 2))


def topk(a: DataFrame, k: int) -> DataFrame:
    """The k greatest cells with their indices."""
    return a.orderBy(F.desc("v"), *(c for c in a.columns if c != "v")).limit(k)


def histogram(a: DataFrame, bins: int, low: float, high: float) -> DataFrame:
    """(bin, n) over even bins; the last one is closed; bins without cells count 0."""
    at = F.least(F.floor((F.col("v") - low) * bins / (high - low)).cast("int"), F.lit(bins - 1))
    counts = a.filter(F.col("v").between(low, high)).groupBy(at.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = a.sparkSession.range(bins).toDF("bin")
    return every.join(counts, "bin", "left").select(F.col("bin").cast("int").alias("bin"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def digitize(c: str, edges: list[float]) -> Column:
    """Index of the bin: how many edges are at or below the value."""
    return _fold(lambda x, y: x + y, ((F.col(c) >= F.lit(e)).cast("int") for e in edges), F.lit(0))


def bincount(a: DataFrame) -> DataFrame:
    return a.groupBy(F.col("v").cast("long").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def unique(a: DataFrame) -> DataFrame:
    return a.groupBy("v").agg(F.count(F.lit(1)).alias("n"))


def average(a: DataFrame, weight: Column, axis: str) -> DataFrame:
    keys = [c for c in a.columns if c not in ("v", axis)]
    return a.groupBy(*keys).agg((F.sum(F.col("v") * weight) / F.sum(weight)).alias("average"))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """Matrix product: a join on the inner index, then sums."""
    return a.select("i", F.col("j").alias("k"), F.col("v").alias("x")).join(b.select(F.col("i").alias("k"), "j", F.col("v").alias("y")), "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def gram(df: DataFrame, vector: str, size: int) -> DataFrame:
    """(i, j, v) of X'X for rows of vectors of one known size: dense products by Arrow batch, then sums of the cells."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros((size, size))
        for b in batches:
            x = np.array(b.column(0).to_pylist(), dtype=float).reshape(-1, size)
            total += x.T @ x
        i, j = np.indices((size, size)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], names=["i", "j", "p"])

    rows = df.select(F.col(vector).cast("array<double>").alias("x")).filter(F.size("x") == size)
    return rows.mapInArrow(run, "i int, j int, p double").groupBy("i", "j").agg(F.sum("p").alias("v"))


def outer(a: DataFrame, b: DataFrame, index_a: str = "i", index_b: str = "i") -> DataFrame:
    return a.select(F.col(index_a).alias("i"), F.col("v").alias("x")).crossJoin(b.select(F.col(index_b).alias("j"), F.col("v").alias("y"))).select("i", "j", (F.col("x") * F.col("y")).alias("v"))


def tensordot(a: DataFrame, b: DataFrame, over: list[tuple[str, str]]) -> DataFrame:
    left = [c for c in a.columns if c != "v" and c not in {x for x, _ in over}]
    right = [c for c in b.columns if c != "v" and c not in {y for _, y in over}]
    x = a.select(*(F.col(c).alias(f"a_{c}") for c in a.columns))
    y = b.select(*(F.col(c).alias(f"b_{c}") for c in b.columns))
    cond = _fold(lambda p, q: p & q, (F.col(f"a_{m}") == F.col(f"b_{n}") for m, n in over))
    return x.join(y, cond).groupBy(*(f"a_{c}" for c in left), *(f"b_{c}" for c in right)).agg(F.sum(F.col("a_v") * F.col("b_v")).alias("v"))


def elementwise(a: DataFrame, b: DataFrame, f) -> DataFrame:
    """f of the values of equal cells."""
    keys = [c for c in a.columns if c != "v"]
    return a.withColumnRenamed("v", "x").join(b.withColumnRenamed("v", "y"), keys).select(*keys, f(F.col("x"), F.col("y")).alias("v"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def roll(a: DataFrame, axis: str, shift: int, size: int) -> DataFrame:
    return a.withColumn(axis, F.pmod(F.col(axis) + shift, F.lit(size)).cast("long"))


def flip(a: DataFrame, axis: str, size: int) -> DataFrame:
    return a.withColumn(axis, F.lit(size - 1) - F.col(axis))


def coarsen(a: DataFrame, how: str, axis: str, width: int) -> DataFrame:
    keys = [c for c in a.columns if c not in ("v", axis)]
    return a.groupBy(*keys, F.floor(F.col(axis) / width).alias(axis)).agg(REDUCTIONS[how]("v").alias("v"))


def take(a: DataFrame, axis: str, indices: list[int]) -> DataFrame:
    return a.filter(F.col(axis).isin(indices))


def concatenate(parts: list[DataFrame], axis: str, sizes: list[int]) -> DataFrame:
    out, offset = None, 0
    for p, n in zip(parts, sizes):
        moved = p.withColumn(axis, F.col(axis) + offset)
        out, offset = moved if out is None else out.unionByName(moved), offset + n
    return out


def stack(parts: list[DataFrame], axis: str = "k") -> DataFrame:
    return _fold(DataFrame.unionByName, (p.withColumn(axis, F.lit(n)) for n, p in enumerate(parts)))


def reshape(a: DataFrame, columns: int, to_columns: int) -> DataFrame:
    at = F.col("i") * columns + F.col("j")
    return a.select(F.floor(at / to_columns).alias("i"), (at % to_columns).alias("j"), "v")


def ravel(a: DataFrame, columns: int) -> DataFrame:
    return a.select((F.col("i") * columns + F.col("j")).alias("i"), "v")


def triangle(a: DataFrame, upper: bool = True) -> DataFrame:
    return a.filter("j >= i" if upper else "j <= i")


def diagonal(a: DataFrame) -> DataFrame:
    return a.filter("i = j").select("i", "v")


def trace(a: DataFrame) -> DataFrame:
    return diagonal(a).agg(F.sum("v").alias("trace"))


def eye(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))


def full(spark: SparkSession, rows: int, columns: int, value: float) -> DataFrame:
    return spark.range(rows * columns).select(F.floor(F.col("id") / columns).alias("i"), (F.col("id") % columns).alias("j"), F.lit(value).alias("v"))


def arange(spark: SparkSession, start: float, stop: float, step: float = 1.0) -> DataFrame:
    n = max(0, int(np.ceil((stop - start) / step)))
    return spark.range(n).select(F.col("id").alias("i"), (F.lit(start) + F.col("id") * step).alias("v"))


def linspace(spark: SparkSession, start: float, stop: float, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), (F.lit(start) + F.col("id") * ((stop - start) / max(1, n - 1))).alias("v"))


def random(spark: SparkSession, rows: int, columns: int, kind: str = "normal", seed: int = 0, **p) -> DataFrame:
    """Cells drawn from a distribution, by inverse functions of a uniform one."""
    u, z = F.rand(seed), F.randn(seed)
    tiny = F.greatest(u, F.lit(1e-16))
    kinds = {"uniform": lambda: p.get("low", 0.0) + (p.get("high", 1.0) - p.get("low", 0.0)) * u, "normal": lambda: p.get("loc", 0.0) + p.get("scale", 1.0) * z, "exponential": lambda: -p.get("scale", 1.0) * F.ln(tiny), "lognormal": lambda: F.exp(p.get("mean", 0.0) + p.get("sigma", 1.0) * z), "logistic": lambda: p.get("loc", 0.0) + p.get("scale", 1.0) * F.ln(tiny / (1 - tiny)), "gumbel": lambda: p.get("loc", 0.0) - p.get("scale", 1.0) * F.ln(-F.ln(tiny)), "laplace": lambda: p.get("loc", 0.0) - p.get("scale", 1.0) * F.signum(u - 0.5) * F.ln(1 - 2 * F.abs(u - 0.5)), "pareto": lambda: F.pow(tiny, F.lit(-1.0 / p.get("a", 1.0))) - 1, "weibull": lambda: F.pow(-F.ln(tiny), F.lit(1.0 / p.get("a", 1.0))), "rayleigh": lambda: p.get("scale", 1.0) * F.sqrt(-2 * F.ln(tiny)), "cauchy": lambda: F.tan(np.pi * (u - 0.5)), "integers": lambda: F.floor(p.get("low", 0) + (p.get("high", 2) - p.get("low", 0)) * u), "bernoulli": lambda: (u < p.get("p", 0.5)).cast("double"), "geometric": lambda: F.ceil(F.ln(tiny) / np.log(1 - p.get("p", 0.5)))}
    return full(spark, rows, columns, 0.0).withColumn("v", kinds[kind]().cast("double"))


def small_linalg(a: DataFrame, f) -> np.ndarray:
    """A dense factorisation or solution of a matrix that fits the driver: f of the numpy matrix."""
    return f(to_numpy(a))


def svd(df: DataFrame, vector: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right singular vectors of rows of vectors: from the size x size Gram matrix, summed in one pass."""
    g = to_numpy(gram(df, vector, size))
    values, vectors = np.linalg.eigh(g)
    return np.sqrt(np.maximum(values[::-1], 0)), vectors[:, ::-1]


def lstsq(df: DataFrame, features: list[str], target: str) -> np.ndarray:
    """Least squares with an intercept, by the normal equations: sums in one pass, solved on the driver."""
    x = [F.lit(1.0), *(F.col(c).cast("double") for c in features)]
    y = F.col(target).cast("double")
    n = len(x)
    sums = df.agg(*(F.sum(x[i] * x[j]).alias(f"a{i}_{j}") for i in range(n) for j in range(n)), *(F.sum(x[i] * y).alias(f"b{i}") for i in range(n))).first()
    return np.linalg.solve(np.array([[sums[f"a{i}_{j}"] for j in range(n)] for i in range(n)]), np.array([sums[f"b{i}"] for i in range(n)]))


FFT = ("fft", "ifft", "rfft", "irfft", "hfft", "ihfft")


def fft_rows(df: DataFrame, row: str, vector: str, kind: str = "fft", imaginary: str | None = None) -> DataFrame:
    """(row, k, re, im) of each row's transform, one of FFT; rows of one length are transformed together.

    imaginary: a column with the imaginary parts, if there are any.
    """
    if kind not in FFT:
        raise ValueError(f"{kind} isn't one of {', '.join(FFT)}")

    def run(batches):
        import pandas as pd

        for b in batches:
            for n, part in b.groupby(b["v_"].map(len)):
                if not n:
                    continue
                x = np.array(part["v_"].tolist(), dtype=float)
                if imaginary:
                    x = x + 1j * np.array(part["w_"].tolist(), dtype=float)
                f = np.atleast_2d(getattr(np.fft, kind)(x, axis=-1))
                k = f.shape[1]
                yield pd.DataFrame({row: np.repeat(part[row].to_numpy(), k), "k": np.tile(np.arange(k), len(part)), "re": f.real.ravel(), "im": np.imag(f).ravel()})

    columns = [F.col(row), F.col(vector).alias("v_"), *([F.col(imaginary).alias("w_")] if imaginary else [])]
    return df.select(*columns).mapInPandas(run, f"{row} {dict(df.dtypes)[row]}, k long, re double, im double")


def fft2(df: DataFrame, row: str, vector: str) -> DataFrame:
    """(row, k, re, im) of the two-dimensional transform of a matrix given by rows 0, 1, ...: rows first, then columns."""
    first = fft_rows(df, row, vector)
    columns = first.groupBy("k").agg(F.array_sort(F.collect_list(F.struct(row, "re", "im"))).alias("x"))
    columns = columns.select("k", F.transform("x", lambda x: x["re"]).alias("re"), F.transform("x", lambda x: x["im"]).alias("im"))
    second = fft_rows(columns.withColumnRenamed("k", "column"), "column", "re", imaginary="im")
    return second.select(F.col("k").cast(dict(df.dtypes)[row]).alias(row), F.col("column").alias("k"), "re", "im")
