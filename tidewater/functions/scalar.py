"""Scalar functions of the relational language as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def divide(a, b) -> Column:
    """Always double; a division by zero is an error, as everywhere in ANSI mode."""
    return _c(a).cast("double") / _c(b)


def idivide(a, b) -> Column:
    """Integer quotient, truncated towards zero."""
    q = _c(a).cast("double") / _c(b)
    return F.when(q < 0, F.ceil(q)).otherwise(F.floor(q)).cast("long")


def mod(a, b) -> Column:
    """Remainder with the sign of the divisor."""
    return ((_c(a) % _c(b)) + _c(b)) % _c(b)


def safe_div(n, d, default=0.0) -> Column:
    return F.when(_c(d) == 0, F.lit(default).cast("double")).otherwise(_c(n).cast("double") / F.nullif(_c(d), F.lit(0)))


def ceil(x) -> Column:
    return F.ceil(_c(x)).cast("double")


def floor(x) -> Column:
    return F.floor(_c(x)).cast("double")


def md5_long(x) -> Column:
    """The first 64 bits of the MD5 digest as an unsigned integer."""
    return F.conv(F.substring(F.md5(_c(x).cast("string").cast("binary")), 1, 16), 16, 10).cast("decimal(20,0)")


def substr(s, begin: int, end: int) -> Column:
    """Characters begin (0-based) to end, exclusive."""
    return F.substring(_c(s), begin + 1, max(0, end - begin))


def byterange(b, begin: int, end: int) -> Column:
    return F.substring(_c(b).cast("binary"), begin + 1, max(0, end - begin))


def head(s, n: int) -> Column:
    return F.left(_c(s), F.lit(n))


def tail(s, n: int) -> Column:
    return F.right(_c(s), F.lit(n))


def greatest(*xs) -> Column:
    return F.greatest(*map(_c, xs))


def least(*xs) -> Column:
    return F.least(*map(_c, xs))


def lexmin(*tuples) -> Column:
    """The lexicographically least of structs of one shape."""
    return F.array_min(F.array(*map(_c, tuples)))


def flip(p: float, seed: int | None = None) -> Column:
    return (F.rand(seed) if seed is not None else F.rand()) < p


def the_answer() -> Column:
    return F.lit(42)


def worker_id() -> Column:
    return F.spark_partition_id()


# Flat-map functions: arrays, for explode() ---------------------------------------------------------


def split(s, separator: str) -> Column:
    """Pieces between literal separators."""
    return F.split(_c(s), F.concat(F.lit("\\Q"), F.lit(separator), F.lit("\\E")))


def sequence(n) -> Column:
    """0 to n - 1; empty for n < 1."""
    return F.when(_c(n) > 0, F.sequence(F.lit(0).cast("long"), _c(n).cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))


def ngram(s, n: int) -> Column:
    """All runs of n characters."""
    count = F.length(_c(s)) - n + 1
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.substr(_c(s), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def bitset(b) -> Column:
    """Bits of a blob, the least significant bit of each byte first."""
    hexed = F.hex(_c(b).cast("binary"))
    n = F.length(hexed) * 4
    byte = lambda i: F.conv(F.substr(hexed, (F.floor(i / 8) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("long")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.floor(byte(i) / F.pow(F.lit(2.0), i % 8)).cast("long") % 2 == 1)).otherwise(F.array().cast("array<boolean>"))
