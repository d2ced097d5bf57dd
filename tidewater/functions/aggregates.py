"""Aggregates with the relational language's conventions, and user-defined ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(c) -> Column:
    """Sum; 0 for no rows."""
    return F.coalesce(F.sum(c), F.lit(0))


def stdev(c) -> Column:
    """Population deviation; 0 for fewer than two rows."""
    return F.when(F.count(c) < 2, F.lit(0.0)).otherwise(F.stddev_pop(c))


def lexmin(*columns) -> Column:
    return F.min(F.struct(*columns))


def sem(c) -> Column:
    return F.stddev_samp(c) / F.sqrt(F.count(c).cast("double"))


def moment(c: str, n: int, mean: float) -> Column:
    """n-th moment around a mean that an earlier pass has found."""
    return F.avg(F.pow(F.col(c) - F.lit(mean), F.lit(n)))


def fold(df: DataFrame, keys: list[str], order: list[str], init: Column, update: Callable[[Column, Column], Column], emit: Callable[[Column], Column], out: str = "value", carry: list[str] | None = None) -> DataFrame:
    """A user-defined aggregate: the state `init` is updated by each row of a group in order, then emitted.

    The rows of a group must fit in one task, as a fold in order needs them there; use decomposable()
    where order doesn't matter.
    """
    carry = carry or [c for c in df.columns if c not in keys]
    rows = F.array_sort(F.collect_list(F.struct(*order, *(c for c in carry if c not in order))))
    return df.groupBy(*keys).agg(F.aggregate(rows, init, update, emit).alias(out))


def decomposable(df: DataFrame, keys: list[str], local: dict[str, Column], merge: dict[str, Column], final: dict[str, Column]) -> DataFrame:
    """A user-defined aggregate in two steps: local by key and salt, merged by key, then finished.

    local: state columns from rows; merge: the same from partial states; final: output from states.
    A key's rows meet only as partial states, at most SALTS of them.
    """
    salted = df.withColumn("salt_", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)))
    partial = salted.groupBy(*keys, "salt_").agg(*(c.alias(n) for n, c in local.items()))
    whole = partial.groupBy(*keys).agg(*(c.alias(n) for n, c in merge.items()))
    return whole.select(*keys, *(c.alias(n) for n, c in final.items()))


SALTS = 32
