"""Reductions, group-wise reductions and statistics of frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import aggregates

#: Aggregates of the frame interface by name: nulls are skipped, deviations are of samples.
BY_NAME: dict[str, Callable[[str], Column]] = {
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)), "prod": lambda c: F.coalesce(F.product(F.col(c)), F.lit(1.0)), "min": F.min, "max": F.max, "count": F.count, "mean": F.avg, "var": F.var_samp, "std": F.stddev_samp, "sem": aggregates.sem,
    "any": lambda c: F.bool_or(F.col(c).cast("boolean")), "all": lambda c: F.bool_and(F.col(c).cast("boolean")), "nunique": F.count_distinct, "median": F.median, "list": lambda c: F.collect_list(c), "unique": lambda c: F.array_sort(F.collect_set(c)), "size": lambda c: F.count(F.lit(1)), "skew": F.skewness, "kurt": F.kurtosis,
}


def reduce(df: DataFrame, spec: dict[str, str | list[str]], keys: list[str] | None = None, dropna: bool = True) -> DataFrame:
    """spec: column to aggregate names; results are named column_aggregate. Rows with a null key are left out if dropna.

    Distinct counts are made apart from the others and joined by key: together, all aggregates would
    be kept for each key and value first.
    """
    wanted = [(c, a) for c, names in spec.items() for a in ([names] if isinstance(names, str) else names)]
    agg = lambda c, a: BY_NAME[a](c).alias(f"{c}_{a}")
    if not keys:
        return df.agg(*(agg(c, a) for c, a in wanted))
    if dropna:
        for k in keys:
            df = df.filter(F.col(k).isNotNull())
    plain, apart = [w for w in wanted if w[1] != "nunique"], [w for w in wanted if w[1] == "nunique"]
    if not plain or not apart:
        return df.groupBy(*keys).agg(*(agg(c, a) for c, a in wanted))
    out = df.groupBy(*keys).agg(*(agg(c, a) for c, a in plain))
    for c, a in apart:
        own = df.groupBy(*(F.col(k).alias(f"key_{k}") for k in keys)).agg(agg(c, a))
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"key_{k}"))
        out = out.join(own, same).drop(*(f"key_{k}" for k in keys))
    return out.select(*keys, *(f"{c}_{a}" for c, a in wanted))


def first(c: str, order: str) -> Column:
    """First non-null value in order, as an aggregate."""
    return F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order)))


def last(c: str, order: str) -> Column:
    return F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order)))


def idxmax(c: str, index: str) -> Column:
    """Smallest index of the greatest value."""
    return F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), (-F.col(index)).alias("i"))))["i"] * -1


def idxmin(c: str, index: str) -> Column:
    return F.min(F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), F.col(index).alias("i"))))["i"]


def mode(df: DataFrame, c: str, keys: list[str] | None = None) -> DataFrame:
    """All most frequent values."""
    counts = df.filter(F.col(c).isNotNull()).groupBy(*(keys or []), c).agg(F.count(F.lit(1)).alias("n"))
    most = counts.groupBy(*(keys or [])).agg(F.max("n").alias("most"))
    joined = counts.join(most, keys) if keys else counts.crossJoin(F.broadcast(most))  # one row
    return joined.filter("n = most").select(*(keys or []), c, "n")


def quantile(c: str, q: float | list[float], exact: bool = True) -> Column:
    return F.percentile(c, q) if exact else F.percentile_approx(c, q, 10_000)


#: Values that quantiles_exact() sorts at once at the end.
FEW = 100_000


def quantiles_exact(df: DataFrame, c: str, qs: list[float], few: int = FEW) -> list[float | None]:
    """Quantiles by linear interpolation over all rows, exact, in memory that doesn't grow with the data.

    Approximate percentiles on both sides of the place looked for are counted exactly: either one of them stands there, or it
    lies on a known side of them, where the search goes on until at most `few` values are left, which are sorted.
    """
    values = df.select(F.col(c).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    n = values.count()
    if not n:
        return [None] * len(qs)

    def at(rank: int) -> float:
        inside, size, left = values, n, rank  # the value is the one at `left` of the `size` values inside
        while size > few:
            a, b = inside.agg(F.percentile_approx("v", [max(0.0, (left + 0.5) / size - 0.002), min(1.0, (left + 0.5) / size + 0.002)], 10_000)).first()[0]
            v = F.col("v")
            under, upto, before, last = inside.agg(F.count_if(v < a), F.count_if(v <= a), F.count_if(v < b), F.count_if(v <= b)).first()
            if under <= left < upto:
                return a
            if before <= left < last:
                return b
            if left < under:
                inside, size = inside.filter(v < a), under
            elif left < before:
                inside, size, left = inside.filter((v > a) & (v < b)), before - upto, left - upto
            else:
                inside, size, left = inside.filter(v > b), size - last, left - last
        return inside.orderBy("v").offset(left).limit(1).first().v

    out = []
    for q in qs:
        place = q * (n - 1)
        first = at(int(place))
        out.append(first if place == int(place) else first + (at(int(place) + 1) - first) * (place - int(place)))
    return out


def describe(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """A row for each column: count, mean, std, min, quartiles, max. One pass.

    Exact quartiles hold a count of each distinct value; with exact=False they are approximate and of bounded size.
    """
    q = lambda c, p: F.percentile(c, p) if exact else F.percentile_approx(c, p, 10_000).cast("double")
    stats = lambda c: F.struct(F.lit(c).alias("column"), F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"), q(c, 0.25).alias("q25"), q(c, 0.5).alias("q50"), q(c, 0.75).alias("q75"), F.max(c).cast("double").alias("max"))
    return df.agg(F.array(*map(stats, columns)).alias("s")).select(F.inline("s"))


def nunique_approx(c: str, lg_k: int = 16) -> Column:
    """Distinct values by a HyperLogLog sketch: an error of about 1 / sqrt(2^lg_k), 0.4 % by default."""
    return F.hll_sketch_estimate(F.hll_sketch_agg(c, F.lit(lg_k)))


def value_counts(df: DataFrame, c: str, keys: list[str] | None = None) -> DataFrame:
    return df.filter(F.col(c).isNotNull()).groupBy(*(keys or []), c).agg(F.count(F.lit(1)).alias("count"))


def drop_duplicates(df: DataFrame, subset: list[str], order: list[Column | str]) -> DataFrame:
    """The first row in order of each distinct subset."""
    w = Window.partitionBy(*subset).orderBy(*order)
    return df.withColumn("rn_", F.row_number().over(w)).filter("rn_ = 1").drop("rn_")


def pairs(df: DataFrame, columns: list[str], what: str = "corr", keys: list[str] | None = None) -> DataFrame:
    """The correlation or covariance matrix in long form (x, y, value), by group if keys are given. One pass."""
    f = F.corr if what == "corr" else F.covar_samp
    cells = F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), f(F.col(a).cast("double"), F.col(b).cast("double")).alias("value")) for a in columns for b in columns))
    grouped = df.groupBy(*keys) if keys else df
    return grouped.agg(cells.alias("m")).select(*(keys or []), F.inline("m"))


def autocorr(df: DataFrame, c: str, partition: list[str], order: list[str], lag: int = 1) -> DataFrame:
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.select(*partition, F.col(c).cast("double").alias("a"), F.lag(c, lag).over(w).cast("double").alias("b")).groupBy(*partition).agg(F.corr("a", "b").alias("autocorr"))


def group_apply(df: DataFrame, keys: list[str], func: Callable, schema: str) -> DataFrame:
    """func on each group's pandas frame; a group must fit in one task."""
    return df.groupBy(*keys).applyInPandas(func, schema)


def group_transform(df: DataFrame, keys: list[str], c: str, aggregate: str, out: str) -> DataFrame:
    """The group's aggregate on each of its rows."""
    return df.withColumn(out, BY_NAME[aggregate](c).over(Window.partitionBy(*keys)))


def cumulative(c: str | None, how: str, partition: list[str], order: list[str]) -> Column:
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if how == "count":
        return F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1
    return {"sum": F.sum, "prod": lambda x: F.product(F.col(x)), "max": F.max, "min": F.min}[how](c).over(w)


def skew_unbiased(c: str) -> Column:
    n = F.count(c).cast("double")
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def kurt_unbiased(c: str) -> Column:
    n = F.count(c).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


# Tests of hypotheses: statistics in one pass ----------------------------------------------------------


def ttest_ind(a: Column, b: Column, equal_var: bool = True) -> Column:
    """t of two samples, as columns that are null for the other sample's rows."""
    na, nb = F.count(a).cast("double"), F.count(b).cast("double")
    va, vb = F.var_samp(a), F.var_samp(b)
    if equal_var:
        pooled = ((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)
        return (F.avg(a) - F.avg(b)) / F.sqrt(pooled * (1 / na + 1 / nb))
    return (F.avg(a) - F.avg(b)) / F.sqrt(va / na + vb / nb)


def ttest_1samp(c: Column, mean: float) -> Column:
    return (F.avg(c) - mean) / (F.stddev_samp(c) / F.sqrt(F.count(c).cast("double")))


def ttest_rel(a: Column, b: Column) -> Column:
    return ttest_1samp(a - b, 0.0)


def chisquare(df: DataFrame, c: str) -> DataFrame:
    """Pearson's statistic of the counts of c's values against even counts."""
    return df.groupBy(c).agg(F.count(F.lit(1)).cast("double").alias("o")).agg((F.sum(F.col("o") * F.col("o")) * F.count(F.lit(1)) / F.sum("o") - F.sum("o")).alias("chisquare"))


def f_oneway(df: DataFrame, group: str, c: str) -> DataFrame:
    """F of a one-way analysis of variance, from each group's count, sum and sum of squares."""
    g = df.filter(F.col(c).isNotNull()).groupBy(group).agg(F.count(c).cast("double").alias("n"), F.sum(c).alias("s"), F.sum(F.col(c) * F.col(c)).alias("q"))
    total = g.agg(F.count(F.lit(1)).cast("double").alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    between = (F.col("b") - F.col("s") * F.col("s") / F.col("n")) / (F.col("k") - 1)
    within = (F.col("q") - F.col("b")) / (F.col("n") - F.col("k"))
    return total.select((between / within).alias("f"))
