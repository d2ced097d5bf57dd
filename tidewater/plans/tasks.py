"""Lazy functions and futures: the task interface over threads and Spark jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession


class Delayed:
    """A call that waits for compute(); arguments may be delayed themselves. Each is computed once."""

    def __init__(self, f: Callable, args: tuple, kwargs: dict):
        self.f, self.args, self.kwargs, self._value, self._done = f, args, kwargs, None, False

    def compute(self):
        if not self._done:
            get = lambda x: x.compute() if isinstance(x, Delayed) else x
            self._value, self._done = self.f(*map(get, self.args), **{k: get(v) for k, v in self.kwargs.items()}), True
        return self._value


def delayed(f: Callable) -> Callable[..., Delayed]:
    return lambda *args, **kwargs: Delayed(f, args, kwargs)


class Client:
    """Futures on the driver, whose jobs run on the cluster together."""

    def __init__(self, spark: SparkSession, threads: int = 8):
        self.spark, self.pool = spark, ThreadPoolExecutor(threads)

    def submit(self, f: Callable, *args, **kwargs) -> Future:
        return self.pool.submit(f, *args, **kwargs)

    def map(self, f: Callable, items: Iterable) -> list[Future]:
        return [self.submit(f, x) for x in items]

    def gather(self, futures: list[Future]) -> list:
        return [f.result() for f in futures]

    def scatter(self, value):
        """A value sent to all executors; for values of known, small size."""
        return self.spark.sparkContext.broadcast(value)

    def compute(self, *frames: DataFrame) -> list:
        return self.gather([self.submit(d.collect) for d in frames])

    def persist(self, df: DataFrame) -> DataFrame:
        df = df.persist()
        df.count()
        return df

    def publish_dataset(self, name: str, df: DataFrame) -> None:
        df.createOrReplaceGlobalTempView(name)

    def get_dataset(self, name: str) -> DataFrame:
        return self.spark.table(f"global_temp.{name}")

    def visualize(self, df: DataFrame) -> str:
        mode = self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        return df._jdf.queryExecution().explainString(mode)

    def close(self) -> None:
        self.pool.shutdown()
