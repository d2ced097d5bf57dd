"""Operators of the relational algebra."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def named(df: DataFrame) -> DataFrame:
    """Columns without a name of their own become _COLUMN<i>_."""
    return df.toDF(*(c if c and c.isidentifier() else f"_COLUMN{i}_" for i, c in enumerate(df.columns)))


def select(df: DataFrame, condition: Column | str) -> DataFrame:
    return df.filter(condition)


def apply(df: DataFrame, **emitters: Column | str) -> DataFrame:
    return df.select(*((F.expr(e) if isinstance(e, str) else e).alias(n) for n, e in emitters.items()))


def project(df: DataFrame, *columns: str) -> DataFrame:
    """Columns as a set of rows."""
    return df.select(*columns).distinct()


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def union_all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, parts)


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def cross_product(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.crossJoin(b)


def join(a: DataFrame, b: DataFrame, condition: Column, output: list | None = None) -> DataFrame:
    out = a.join(b, condition, "inner")
    return out.select(*output) if output else out


def nary_join(parts: list[DataFrame], conditions: list[Column], output: list | None = None) -> DataFrame:
    """Joins left to right, with each part the conditions that its columns complete; Catalyst reorders."""
    out = reduce(lambda x, y: x.crossJoin(y), parts)
    out = out.filter(reduce(lambda x, y: x & y, conditions)) if conditions else out
    return out.select(*output) if output else out


def group_by(df: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*(c.alias(n) for n, c in aggregates.items()))


def stateful_apply(df: DataFrame, partition: list[str], order: list[str], running: dict[str, Column]) -> DataFrame:
    """Each row with aggregates over the rows up to it, in order, within its partition."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.select("*", *(c.over(w).alias(n) for n, c in running.items()))


def hypercube_shuffle(df: DataFrame, hashed: dict[str, int], dims: list[int]) -> DataFrame:
    """Each row at every coordinate of a cube that its hashed columns (to dimension) leave open."""
    sides = []
    by_dim = {d: c for c, d in hashed.items()}
    for d, n in enumerate(dims):
        sides.append(F.array(F.pmod(F.hash(by_dim[d]), F.lit(n))) if d in by_dim else F.sequence(F.lit(0), F.lit(n - 1)))
    out, at = df, F.lit(0)
    for d, n in enumerate(dims):
        out = out.withColumn(f"dim{d}_", F.explode(sides[d]))
        at = at * n + F.col(f"dim{d}_")
    total = reduce(lambda x, y: x * y, dims, 1)
    return out.withColumn("cell_", at).drop(*(f"dim{d}_" for d in range(len(dims)))).repartition(total, "cell_")


def shuffle(df: DataFrame, columns: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    return df.repartition(*([partitions] if partitions else []), *(columns or [])) if partitions or columns else df


def collect_one(df: DataFrame) -> DataFrame:
    """All rows in one partition."""
    return df.coalesce(1)


def broadcast(df: DataFrame, limit_bytes: int = 64 << 20) -> DataFrame:
    """Marked to be sent whole to all executors if Spark's estimate of its size is within the limit; else as it is."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString()
    return F.broadcast(df) if int(size) <= limit_bytes else df


def sample_scan(df: DataFrame, size: float, percent: bool = False, replace: bool = True, seed: int = 0) -> DataFrame:
    """A sample by percent of the rows or, without replacement, of exactly `size` rows; with it, of about that many."""
    if percent:
        return df.sample(replace, size / 100, seed)
    if not replace:
        return df.orderBy(F.rand(seed)).limit(int(size))
    n = df.count()
    return df.sample(True, size / n, seed) if n else df


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def singleton(spark: SparkSession) -> DataFrame:
    """One row without columns."""
    return spark.range(1).select()


def store(df: DataFrame, path: str, partition_by: list[str] | None = None, append: bool = False) -> None:
    w = df.write.mode("append" if append else "overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def sink(df: DataFrame) -> None:
    """Computes df and discards it."""
    df.write.format("noop").mode("overwrite").save()


def parallel(*actions: Callable[[], object]) -> list:
    """Independent actions at once; Spark schedules their jobs together."""
    with ThreadPoolExecutor(max(1, min(8, len(actions)))) as pool:
        return list(pool.map(lambda f: f(), actions))


def sequence(*actions: Callable[[], object]) -> list:
    return [f() for f in actions]


class Temps:
    """Named temporary relations: store, append, scan."""

    def __init__(self):
        self.of: dict[str, DataFrame] = {}

    def store(self, name: str, df: DataFrame) -> None:
        self.of[name] = df
        df.createOrReplaceTempView(name)

    def append(self, name: str, df: DataFrame) -> None:
        self.store(name, self.of[name].union(df) if name in self.of else df)

    def scan(self, name: str) -> DataFrame:
        return self.of[name]
