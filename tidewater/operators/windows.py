"""Rolling windows, shifts, resampling and order operators of the frame interface."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def shift(c: str, partition: list[str], order: list[str], n: int = 1) -> Column:
    w = Window.partitionBy(*partition).orderBy(*order)
    return F.lag(c, n).over(w) if n >= 0 else F.lead(c, -n).over(w)


def diff(c: str, partition: list[str], order: list[str], n: int = 1) -> Column:
    return F.col(c) - shift(c, partition, order, n)


class Rolling:
    """Aggregates over the last `rows` rows of a partition in order, or over `seconds` before each row's time.

    Null until min_periods values are there (all rows' worth, or 1 for times). center: as many rows
    after as before, one less of an even number.
    """

    def __init__(self, partition: list[str], order: list[str], rows: int | None = None, seconds: float | None = None, min_periods: int | None = None, center: bool = False):
        w: WindowSpec = Window.partitionBy(*partition)
        if rows is not None:
            after = (rows - 1) // 2 if center else 0
            self.w = w.orderBy(*order).rowsBetween(after - rows + 1, after)
            self.least = rows if min_periods is None else min_periods
        else:
            micros = F.unix_micros(F.col(order[0]).cast("timestamp"))
            self.w = w.orderBy(micros).rangeBetween(-int(seconds * 1_000_000) + 1, 0)
            self.least = 1 if min_periods is None else min_periods

    def _kept(self, c: str, value: Column) -> Column:
        return F.when(F.count(c).over(self.w) >= self.least, value)

    def _sorted(self, c: str) -> Column:
        return F.array_sort(F.collect_list(c).over(self.w))

    def count(self, c: str) -> Column:
        return F.count(c).over(self.w)

    def sum(self, c: str) -> Column:
        return self._kept(c, F.sum(c).over(self.w))

    def mean(self, c: str) -> Column:
        return self._kept(c, F.avg(c).over(self.w))

    def min(self, c: str) -> Column:
        return self._kept(c, F.min(c).over(self.w))

    def max(self, c: str) -> Column:
        return self._kept(c, F.max(c).over(self.w))

    def std(self, c: str, ddof: int = 1) -> Column:
        return self._kept(c, (F.stddev_samp if ddof else F.stddev_pop)(c).over(self.w))

    def var(self, c: str, ddof: int = 1) -> Column:
        return self._kept(c, (F.var_samp if ddof else F.var_pop)(c).over(self.w))

    def cov(self, a: str, b: str) -> Column:
        return self._kept(a, F.covar_samp(a, b).over(self.w))

    def skew(self, c: str) -> Column:
        n = F.count(c).over(self.w).cast("double")
        return self._kept(c, F.when(n > 2, F.skewness(c).over(self.w) * F.sqrt(n * (n - 1)) / (n - 2)))

    def kurt(self, c: str) -> Column:
        n = F.count(c).over(self.w).cast("double")
        return self._kept(c, F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c).over(self.w) + 6)))

    def quantile(self, c: str, q: float) -> Column:
        """Linear interpolation; the window's values are held in an array."""
        x = self._sorted(c)
        at = (F.size(x) - 1) * F.lit(q)
        low, high = F.get(x, F.floor(at).cast("int")), F.get(x, F.ceil(at).cast("int"))
        return self._kept(c, low + (high - low) * (at - F.floor(at)))

    def median(self, c: str) -> Column:
        return self.quantile(c, 0.5)

    def apply(self, c: str, func: Callable[[Column], Column]) -> Column:
        """func of the array of the window's values."""
        return self._kept(c, func(F.collect_list(c).over(self.w)))


# Windows over a whole frame, without a partition key ----------------------------------------------------


def numbered(df: DataFrame, order: list[str], partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """df dealt by ranges of its order, with its range part_ and its place pos_ in the whole (from 0); and (part_, start_, n_) of each range.

    Rows of equal order share a range; the second frame has a row for each range.
    """
    from tidewater.plans.recursion import settle

    dealt = settle((df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)).withColumn("part_", F.spark_partition_id()))
    sizes = dealt.groupBy("part_").agg(F.count(F.lit(1)).alias("n_"))
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    ranges = settle(sizes.withColumn("start_", F.coalesce(F.sum("n_").over(before), F.lit(0).cast("long"))))
    own = F.row_number().over(Window.partitionBy("part_").orderBy(*order)) - 1
    return dealt.join(F.broadcast(ranges.select("part_", "start_")), "part_").withColumn("pos_", F.col("start_") + own).drop("start_"), ranges


def overlapped(df: DataFrame, order: list[str], before: int, after: int, partitions: int | None = None) -> DataFrame:
    """numbered(), each range with copies of the `before` rows ahead of it and the `after` rows behind it, which have halo_ set."""
    rows, ranges = numbered(df, order, partitions)
    spans = [(r.part_, r.start_, r.start_ + r.n_) for r in ranges.collect()]  # one for each range
    other = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(a).alias("a"), F.lit(b).alias("b")) for p, a, b in spans)) if spans else F.array().cast("array<struct<p:int,a:long,b:long>>")
    near = F.filter(other, lambda s: (s.p != F.col("part_")) & (F.col("pos_") >= s.a - before) & (F.col("pos_") < s.b + after))
    copies = F.transform(near, lambda s: F.struct(s.p.alias("part_"), F.lit(True).alias("halo_")))
    to = F.concat(F.array(F.struct(F.col("part_"), F.lit(False).alias("halo_"))), copies)
    return rows.withColumn("to_", F.explode(to)).withColumn("part_", F.col("to_.part_")).withColumn("halo_", F.col("to_.halo_")).drop("to_")


def over_frame(df: DataFrame, order: list[str], before: int, after: int, columns, partitions: int | None = None) -> DataFrame:
    """Window expressions over the whole frame in order, that look at most so many rows back and ahead.

    columns(partition, order) gives them by name for the partition and order that it is told, as shift(), diff() and Rolling() take.
    """
    rows = overlapped(df, order, before, after, partitions)
    made = rows.select("*", *(c.alias(n) for n, c in columns(["part_"], ["pos_"]).items()))
    return made.filter(~F.col("halo_")).drop("part_", "pos_", "halo_")


def cumulative_frame(df: DataFrame, c: str, how: str, order: list[str], out: str, partitions: int | None = None) -> DataFrame:
    """A running sum, prod, max or min over the whole frame in order: within ranges, on what the ranges before add up to."""
    f = {"sum": F.sum, "prod": lambda x: F.product(F.col(x) if isinstance(x, str) else x), "max": F.max, "min": F.min}[how]
    join = {"sum": lambda a, b: a + b, "prod": lambda a, b: a * b, "max": F.greatest, "min": F.least}[how]
    rows, _ = numbered(df, order, partitions)
    totals = rows.groupBy("part_").agg(f(c).alias("t_")).withColumn("carry_", f("t_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)))  # a row for each range
    own = f(c).over(Window.partitionBy("part_").orderBy("pos_").rowsBetween(Window.unboundedPreceding, 0))
    made = rows.join(F.broadcast(totals.select("part_", "carry_")), "part_").withColumn("own_", own)
    both = F.when(F.col("carry_").isNull(), F.col("own_")).when(F.col("own_").isNull(), F.col("carry_")).otherwise(join(F.col("carry_"), F.col("own_")))
    return made.withColumn(out, both).drop("part_", "pos_", "carry_", "own_")


def fill_frame(df: DataFrame, c: str, order: list[str], out: str, forward: bool = True, partitions: int | None = None) -> DataFrame:
    """Nulls filled with the last value before (or the next one behind) in the whole frame's order."""
    rows, _ = numbered(df, order, partitions)
    ends = rows.filter(F.col(c).isNotNull()).groupBy("part_").agg((F.max_by(c, "pos_") if forward else F.min_by(c, "pos_")).alias("e_"))
    parts = rows.groupBy("part_").agg(F.count(F.lit(1)).alias("n_")).join(ends, "part_", "left")
    w = Window.orderBy(F.col("part_") if forward else F.desc("part_")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    carry = parts.select("part_", F.last("e_", ignorenulls=True).over(w).alias("carry_"))
    at = Window.partitionBy("part_").orderBy(F.col("pos_") if forward else F.desc("pos_")).rowsBetween(Window.unboundedPreceding, 0)
    made = rows.join(F.broadcast(carry), "part_").withColumn(out, F.coalesce(F.last(c, ignorenulls=True).over(at), F.col("carry_")))
    return made.drop("part_", "pos_", "carry_")


def resample(df: DataFrame, ts: str, width: str, aggs: dict[str, Column], keys: list[str] | None = None, empty: bool = True, label: str = "left") -> DataFrame:
    """Aggregates by tumbling buckets of time, empty ones included, from the first to the last of all rows (or of each key)."""
    keys = keys or []
    at = F.window(ts, width)
    out = df.groupBy(*keys, at.alias("w_")).agg(*(c.alias(n) for n, c in aggs.items()))
    side = "w_.start" if label == "left" else "w_.end"
    out = out.select(*keys, F.col(side).cast("timestamp_ntz").alias(ts), *aggs)
    if not empty:
        return out
    span = out.groupBy(*keys).agg(F.min(ts).alias("a_"), F.max(ts).alias("b_"))
    grid = span.select(*keys, F.explode(F.sequence("a_", "b_", F.expr(f"INTERVAL {width}"))).alias(ts))
    return grid.join(out, [*keys, ts], "left")


def first_span(df: DataFrame, ts: str, interval: str) -> DataFrame:
    """Rows within the interval from the earliest time."""
    low = df.agg(F.min(ts).alias("low_"))
    return df.crossJoin(F.broadcast(low)).filter(F.col(ts) < F.col("low_") + F.expr(f"INTERVAL {interval}")).drop("low_")  # one row


def last_span(df: DataFrame, ts: str, interval: str) -> DataFrame:
    high = df.agg(F.max(ts).alias("high_"))
    return df.crossJoin(F.broadcast(high)).filter(F.col(ts) > F.col("high_") - F.expr(f"INTERVAL {interval}")).drop("high_")  # one row


def nlargest(df: DataFrame, n: int, columns: list[str], tie: list[str] | None = None) -> DataFrame:
    return df.orderBy(*(F.desc_nulls_last(c) for c in columns), *(tie or [])).limit(n)


def nsmallest(df: DataFrame, n: int, columns: list[str], tie: list[str] | None = None) -> DataFrame:
    return df.orderBy(*(F.asc_nulls_last(c) for c in columns), *(tie or [])).limit(n)


def head(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def tail(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    return df.orderBy(*(F.desc(c) for c in order)).limit(n)


def sample(df: DataFrame, frac: float, replace: bool = False, seed: int = 0) -> DataFrame:
    return df.sample(replace, frac, seed)


def random_split(df: DataFrame, weights: list[float], seed: int = 0) -> list[DataFrame]:
    return df.randomSplit(weights, seed)


def set_index(df: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """Dealt by ranges of the key and sorted within each: together, sorted."""
    return (df.repartitionByRange(partitions, key) if partitions else df.repartitionByRange(key)).sortWithinPartitions(key)


def partition_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"))


def get_partition(df: DataFrame, n: int) -> DataFrame:
    return df.filter(F.spark_partition_id() == n)


def repartition_by_freq(df: DataFrame, ts: str, unit: str, partitions: int | None = None) -> DataFrame:
    """Dealt by ranges of time, a unit (day, month) never split over two partitions."""
    at = F.date_trunc(unit, F.col(ts))
    return df.repartitionByRange(partitions, at) if partitions else df.repartitionByRange(at)


def repartition_by_size(df: DataFrame, partition_bytes: int) -> DataFrame:
    """As many partitions as Spark's estimate of the size asks for."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(1, -(-size // partition_bytes)))


def ohlc(c: str, order: str) -> dict[str, Column]:
    """Aggregates for resample(): open, high, low, close."""
    return {"open": F.min_by(c, order), "high": F.max(c), "low": F.min(c), "close": F.max_by(c, order)}
