"""Elementwise functions by name, as of array libraries, on columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _float(c: Column) -> Column:
    return c.cast("double")


def _logaddexp(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def _nan(c: Column) -> Column:
    return F.coalesce(F.isnan(_float(c)), F.lit(False))


def _whole(f, c: Column) -> Column:
    """f, which gives 64-bit integers, as doubles; doubles from 2^52 on are whole already, infinite or no number."""
    x = _float(c)
    return F.when((F.abs(x) < 2.0**52) & ~_nan(c), f(x).cast("double")).otherwise(x)


def _trunc(c: Column) -> Column:
    return _whole(lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)), c)


def _ignoring_nan(f):
    return lambda a, b: F.when(_nan(a), _float(b)).when(_nan(b), _float(a)).otherwise(f(a, b))


def _passing_nan(f):
    return lambda a, b: F.when(a.isNull() | b.isNull(), None).when(_nan(a) | _nan(b), F.lit(math.nan)).otherwise(f(a, b))


def _frexp(c: Column) -> tuple[Column, Column]:
    """Mantissa in [0.5, 1) and exponent; the logarithm may be off by one beside powers of 2."""
    x = _float(c)
    guess = F.floor(F.log2(F.abs(F.nullif(x, F.lit(0.0))))).cast("int") + 1
    half = F.floor(guess / 2).cast("int")
    m = x / F.pow(F.lit(2.0), half) / F.pow(F.lit(2.0), guess - half)
    zero, odd = F.coalesce(x == 0, F.lit(False)), _nan(c) | F.coalesce(F.abs(x) == math.inf, F.lit(False))
    mantissa = F.when(zero | odd, x).when(F.abs(m) >= 1, m / 2).when(F.abs(m) < 0.5, m * 2).otherwise(m)
    exponent = F.when(zero | odd, F.lit(0)).when(F.abs(m) >= 1, guess + 1).when(F.abs(m) < 0.5, guess - 1).otherwise(guess)
    return mantissa, exponent


def _i0(c: Column) -> Column:
    """The modified Bessel function of order 0: the mean of exp(x cos t) over half a turn, exact to rounding by even steps."""
    n = 256
    x = F.abs(_float(c))
    total = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0.0), lambda a, k: a + F.exp(x * (F.cos((k + 0.5) * (math.pi / n)) - 1)))
    return F.exp(x) * total / n


def _floor_divide(a: Column, b: Column) -> Column:
    return _whole(F.floor, _float(a) / b)


UNARY = {
    "abs": F.abs, "absolute": F.abs, "fabs": lambda c: F.abs(_float(c)), "negative": lambda c: -c, "positive": lambda c: c,
    "sqrt": F.sqrt, "square": lambda c: c * c, "cbrt": F.cbrt, "reciprocal": lambda c: 1.0 / _float(c), "sign": lambda c: F.signum(c),
    "exp": F.exp, "exp2": lambda c: F.pow(F.lit(2.0), c), "expm1": F.expm1, "log": F.ln, "log2": F.log2, "log10": F.log10, "log1p": F.log1p,
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "arcsin": F.asin, "arccos": F.acos, "arctan": F.atan,
    "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "arcsinh": F.asinh, "arccosh": F.acosh, "arctanh": F.atanh,
    "deg2rad": F.radians, "radians": F.radians, "rad2deg": F.degrees, "degrees": F.degrees,
    "floor": lambda c: _whole(F.floor, c), "ceil": lambda c: _whole(F.ceil, c), "rint": F.rint, "fix": _trunc, "trunc": _trunc,
    "logical_not": lambda c: ~c.cast("boolean"), "invert": F.bitwise_not, "isnan": lambda c: F.isnan(_float(c)), "isfinite": lambda c: ~F.isnan(_float(c)) & (F.abs(_float(c)) != math.inf), "isinf": lambda c: F.abs(_float(c)) == math.inf,
    "signbit": lambda c: (c < 0) | (_float(c).cast("string") == "-0.0"), "spacing": lambda c: F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(_float(c)))), F.lit(-1022)) - 52),
    "nan_to_num": lambda c: F.greatest(F.least(F.nanvl(_float(c), F.lit(0.0)), F.lit(1.7976931348623157e308)), F.lit(-1.7976931348623157e308)), "i0": _i0, "sinc": lambda c: F.when(c == 0, F.lit(1.0)).otherwise(F.sin(c * math.pi) / (F.nullif(_float(c), F.lit(0.0)) * math.pi)),
    "modf_fraction": lambda c: F.when(F.abs(_float(c)) == math.inf, F.lit(0.0)).otherwise(_float(c) - _trunc(c)), "modf_whole": _trunc, "modf": lambda c: F.struct(UNARY["modf_fraction"](c).alias("fraction"), _trunc(c).alias("whole")), "real": lambda c: c, "imag": lambda c: F.lit(0.0), "conj": lambda c: c, "angle": lambda c: F.when(c < 0, F.lit(math.pi)).otherwise(F.lit(0.0)), "iscomplex": lambda c: F.lit(False), "isreal": lambda c: F.lit(True),
    "frexp_exponent": lambda c: _frexp(c)[1], "frexp_mantissa": lambda c: _frexp(c)[0], "frexp": lambda c: F.struct(_frexp(c)[0].alias("mantissa"), _frexp(c)[1].alias("exponent")),
}
BINARY = {
    "add": lambda a, b: a + b, "subtract": lambda a, b: a - b, "multiply": lambda a, b: a * b, "divide": lambda a, b: _float(a) / b, "true_divide": lambda a, b: _float(a) / b,
    "floor_divide": _floor_divide, "divmod": lambda a, b: F.struct(_floor_divide(a, b).alias("quotient"), (((a % b) + b) % b).alias("remainder")), "power": F.pow, "float_power": F.pow, "mod": lambda a, b: ((a % b) + b) % b, "remainder": lambda a, b: ((a % b) + b) % b, "fmod": lambda a, b: a % b,
    "maximum": _passing_nan(F.greatest), "minimum": _passing_nan(F.least), "fmax": _ignoring_nan(F.greatest), "fmin": _ignoring_nan(F.least),
    "nextafter": lambda a, b: F.call_function("reflect", F.lit("java.lang.Math"), F.lit("nextAfter"), _float(a), _float(b)).cast("double"),
    "arctan2": F.atan2, "hypot": F.hypot, "logaddexp": _logaddexp, "logaddexp2": lambda a, b: _logaddexp(a * math.log(2), b * math.log(2)) / math.log(2), "copysign": lambda a, b: F.when(b < 0, -F.abs(a)).otherwise(F.abs(a)),
    "equal": lambda a, b: a == b, "not_equal": lambda a, b: a != b, "less": lambda a, b: a < b, "less_equal": lambda a, b: a <= b, "greater": lambda a, b: a > b, "greater_equal": lambda a, b: a >= b,
    "logical_and": lambda a, b: a.cast("boolean") & b.cast("boolean"), "logical_or": lambda a, b: a.cast("boolean") | b.cast("boolean"), "logical_xor": lambda a, b: a.cast("boolean") != b.cast("boolean"),
    "bitwise_and": lambda a, b: a.bitwiseAND(b), "bitwise_or": lambda a, b: a.bitwiseOR(b), "bitwise_xor": lambda a, b: a.bitwiseXOR(b), "left_shift": lambda a, n: F.call_function("shiftleft", a, n), "right_shift": lambda a, n: F.call_function("shiftright", a, n),
    "ldexp": lambda a, n: a * F.pow(F.lit(2.0), n), "isclose": lambda a, b: F.abs(a - b) <= 1e-8 + 1e-5 * F.abs(b),
}


def apply(name: str, *columns) -> Column:
    """The function of that name on columns or column names."""
    args = [F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c) for c in columns]
    found = UNARY if len(args) == 1 else BINARY
    if name not in found:
        raise ValueError(f"{name} isn't an elementwise function of {len(args)} arguments")
    return found[name](*args)


def clip(c, low, high) -> Column:
    return F.least(F.greatest(F.col(c) if isinstance(c, str) else c, F.lit(low)), F.lit(high))
