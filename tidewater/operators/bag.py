"""Bags: unordered collections, as DataFrames with one column, `value`. Functions are Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

V = "value"


class Bag:
    def __init__(self, df: DataFrame, column: str | None = None):
        self.df = df.select(F.col(column or df.columns[0]).alias(V))

    @classmethod
    def from_sequence(cls, spark: SparkSession, items: Iterable, kind: str) -> Bag:
        return cls(spark.createDataFrame([(x,) for x in items], f"{V} {kind}"))

    @classmethod
    def range(cls, spark: SparkSession, n: int) -> Bag:
        return cls(spark.range(n))

    def _of(self, c: Column) -> Bag:
        return Bag(self.df.select(c.alias(V)))

    def map(self, f: Callable[[Column], Column]) -> Bag:
        return self._of(f(F.col(V)))

    def starmap(self, f: Callable[..., Column]) -> Bag:
        """f of the fields of each struct."""
        return self._of(f(*(F.col(f"{V}.{n}") for n in self.df.schema[V].dataType.names)))

    def filter(self, p: Callable[[Column], Column]) -> Bag:
        return Bag(self.df.filter(p(F.col(V))))

    def remove(self, p: Callable[[Column], Column]) -> Bag:
        return Bag(self.df.filter(~p(F.col(V))))

    def random_sample(self, p: float, seed: int = 0) -> Bag:
        return Bag(self.df.sample(False, p, seed))

    def map_partitions(self, f: Callable, kind: str) -> Bag:
        """f on pandas Series, batch by batch."""
        return Bag(self.df.mapInPandas(lambda batches: (f(b[V]).to_frame(V) for b in batches), f"{V} {kind}"))

    def pluck(self, key: str | int, default=None) -> Bag:
        got = F.col(V)[key] if not isinstance(key, int) else F.get(V, F.lit(key))
        return self._of(got if default is None else F.coalesce(got, F.lit(default)))

    def unzip(self) -> list[Bag]:
        return [self._of(F.col(f"{V}.{n}")) for n in self.df.schema[V].dataType.names]

    def flatten(self) -> Bag:
        return self._of(F.explode(V))

    def fold(self, aggregate: Callable[[Column], Column]) -> DataFrame:
        """An associative reduction, named as an aggregate; combined by partition first."""
        return self.df.agg(aggregate(F.col(V)).alias(V))

    def foldby(self, key: Callable[[Column], Column], aggregate: Callable[[Column], Column]) -> DataFrame:
        return self.df.groupBy(key(F.col(V)).alias("key")).agg(aggregate(F.col(V)).alias(V))

    def groupby(self, key: Callable[[Column], Column]) -> DataFrame:
        """(key, items). A key's items are one array: use foldby where keys may have many."""
        return self.df.groupBy(key(F.col(V)).alias("key")).agg(F.collect_list(V).alias("items"))

    def frequencies(self) -> DataFrame:
        return self.df.groupBy(V).agg(F.count(F.lit(1)).alias("count"))

    def topk(self, k: int, key: Callable[[Column], Column] | None = None) -> DataFrame:
        order = key(F.col(V)) if key else F.col(V)
        return self.df.orderBy(order.desc_nulls_last(), F.col(V).desc()).limit(k)

    def distinct(self, key: Callable[[Column], Column] | None = None) -> Bag:
        """With a key: the least item of each key."""
        if key is None:
            return Bag(self.df.distinct())
        return Bag(self.df.groupBy(key(F.col(V)).alias("k")).agg(F.min(V).alias(V)).select(V))

    def _agg(self, c: Column) -> DataFrame:
        return self.df.agg(c.alias(V))

    def sum(self) -> DataFrame:
        return self._agg(F.sum(V))

    def max(self) -> DataFrame:
        return self._agg(F.max(V))

    def min(self) -> DataFrame:
        return self._agg(F.min(V))

    def any(self) -> DataFrame:
        return self._agg(F.bool_or(F.col(V).cast("boolean")))

    def all(self) -> DataFrame:
        return self._agg(F.bool_and(F.col(V).cast("boolean")))

    def count(self) -> DataFrame:
        return self._agg(F.count(F.lit(1)))

    def mean(self) -> DataFrame:
        return self._agg(F.avg(V))

    def var(self, ddof: int = 0) -> DataFrame:
        return self._agg((F.var_samp if ddof else F.var_pop)(V))

    def std(self, ddof: int = 0) -> DataFrame:
        return self._agg((F.stddev_samp if ddof else F.stddev_pop)(V))

    def join(self, other: DataFrame, on_self: Callable[[Column], Column], on_other: str) -> DataFrame:
        return self.df.join(other, on_self(F.col(V)) == F.col(on_other))

    def product(self, other: Bag) -> DataFrame:
        return self.df.crossJoin(other.df.withColumnRenamed(V, "other"))

    def take(self, k: int) -> list:
        return [r[0] for r in self.df.take(k)]

    def accumulate(self, how: str, order: Callable[[Column], Column], partition: Callable[[Column], Column]) -> DataFrame:
        """A running aggregate in order within each partition."""
        w = Window.partitionBy(partition(F.col(V))).orderBy(order(F.col(V))).rowsBetween(Window.unboundedPreceding, 0)
        return self.df.select(V, {"sum": F.sum, "max": F.max, "min": F.min}[how](V).over(w).alias("running"))

    def repartition(self, n: int) -> Bag:
        return Bag(self.df.repartition(n))

    def to_dataframe(self) -> DataFrame:
        return self.df.select(f"{V}.*") if self.df.schema[V].dataType.typeName() == "struct" else self.df

    def concat(self, *others: Bag) -> Bag:
        out = self.df
        for o in others:
            out = out.union(o.df)
        return Bag(out)

    def choices(self, k: int, seed: int = 0) -> Bag:
        """About k items, with replacement."""
        n = self.df.count()
        return Bag(self.df.sample(True, k / n, seed) if n else self.df)

    def sample(self, k: int, seed: int = 0) -> Bag:
        """k items, without replacement."""
        return Bag(self.df.orderBy(F.rand(seed)).limit(k))

    def glob(self, pattern: str) -> Bag:
        """Strings that match a file-name pattern."""
        like = pattern.replace("%", "\\%").replace("_", "\\_").replace("*", "%").replace("?", "_")
        return Bag(self.df.filter(F.col(V).like(like)))


def zip_bags(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Pairs of two bags whose items carry a row key."""
    return a.join(b, key)
