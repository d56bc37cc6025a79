"""Null- and NaN-safe operators, casts and mathematical functions on Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF, NAN = float("inf"), float("nan")


def fractional(kind: T.DataType) -> bool:
    return isinstance(kind, (T.FloatType, T.DoubleType))


def numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType) or isinstance(kind, T.BooleanType)


def missing(c: Column, kind: T.DataType) -> Column:
    """Null, or NaN of a floating type."""
    return c.isNull() | F.isnan(c) if fractional(kind) else c.isNull()


def valid(c: Column, kind: T.DataType) -> Column:
    """The value, null where it is missing."""
    return F.when(~F.isnan(c), c) if fractional(kind) else c


def by_zero(a: Column) -> Column:
    return F.when(a > 0, INF).when(a < 0, -INF).when(a.isNotNull(), NAN)


def truediv(a: Column, b: Column) -> Column:
    a, b = a.cast("double"), b.cast("double")
    return F.when(b == 0, by_zero(a)).otherwise(a / b)


def floordiv(a: Column, b: Column) -> Column:
    """The floor of the quotient; floor() gives longs, so what has no fraction anyway, infinities and NaN stay as they are."""
    a, b = a.cast("double"), b.cast("double")
    q = truediv(a, b)
    return F.when(F.abs(q) < 2.0**53, F.floor(q).cast("double")).otherwise(q)


def mod(a: Column, b: Column) -> Column:
    """The remainder with the sign of the divisor; null by zero."""
    safe = F.when(b != 0, b)
    return ((a % safe) + safe) % safe


def power(a: Column, b: Column) -> Column:
    return F.pow(a.cast("double"), b.cast("double"))


def subtract(a: Column, b: Column, ka: T.DataType, kb: T.DataType) -> Column:
    """Numbers by value; timestamps as whole seconds, dates as days."""
    times = (T.TimestampType, T.TimestampNTZType)
    if isinstance(ka, times):
        return F.unix_seconds(a.cast("timestamp")) - F.unix_seconds(b.cast("timestamp"))
    if isinstance(ka, T.DateType):
        return F.datediff(a, b).cast("long")
    return a - b


def plus(a: Column, b: Column, ka: T.DataType, kb: T.DataType) -> Column:
    return F.concat(a, b) if isinstance(ka, T.StringType) and isinstance(kb, T.StringType) else a + b


def compare(name: str, a: Column, b: Column) -> Column:
    """A comparison where a missing side gives False (True for ne)."""
    out = {"eq": a == b, "ne": a != b, "lt": a < b, "le": a <= b, "gt": a > b, "ge": a >= b}[name]
    return F.coalesce(out, F.lit(name == "ne"))


def to_bool(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return F.coalesce(F.length(c) > 0, F.lit(False))
    if isinstance(kind, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    return F.coalesce(F.when(F.isnan(c), True).otherwise(c != 0) if fractional(kind) else c != 0, F.lit(False))


def to_text(c: Column, kind: T.DataType) -> Column:
    empty = "NaT" if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else "nan" if numeric(kind) else "None"
    text = F.when(c, "True").otherwise("False") if isinstance(kind, T.BooleanType) else c.cast("string")
    return F.when(c.isNull(), F.lit(empty)).otherwise(text)


def cast(c: Column, kind: T.DataType, to: T.DataType) -> Column:
    """astype: strings are tried, so a bad one becomes null instead of an error."""
    if isinstance(to, T.BooleanType):
        return to_bool(c, kind)
    if isinstance(to, T.StringType):
        return to_text(c, kind)
    return c.try_cast(to) if isinstance(kind, T.StringType) else c.cast(to)


def to_numeric(c: Column) -> Column:
    return c.try_cast("double")


def bucket_of(c: Column, low: float, high: float, bins: int) -> Column:
    """The equi-width bin from 0; the highest value falls in the last one."""
    width = (high - low) / bins or 1.0
    return F.least(F.floor((c - low) / width), F.lit(bins - 1)).cast("long")


def _two(name: str):
    return lambda a, b: getattr(F, name)(a, b)


#: One-argument functions by their NumPy names.
UNARY = {
    "abs": F.abs, "absolute": F.abs, "arccos": F.acos, "arccosh": F.acosh, "arcsin": F.asin, "arcsinh": F.asinh, "arctan": F.atan, "arctanh": F.atanh,
    "bitwise_not": F.bitwise_not, "invert": F.bitwise_not, "cbrt": F.cbrt, "ceil": F.ceil, "cos": F.cos, "cosh": F.cosh, "deg2rad": F.radians, "degrees": F.degrees,
    "exp": F.exp, "exp2": lambda c: F.pow(F.lit(2.0), c), "expm1": F.expm1, "fabs": lambda c: F.abs(c.cast("double")), "floor": F.floor,
    "isfinite": lambda c: ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != INF), "isinf": lambda c: F.abs(c.cast("double")) == INF,
    "isnan": lambda c: F.isnan(c.cast("double")), "isnat": lambda c: c.isNull(), "log": lambda c: F.log(c.cast("double")), "log10": F.log10, "log1p": F.log1p, "log2": F.log2,
    "logical_not": lambda c: ~c.cast("boolean"), "matmul": None, "negative": lambda c: -c, "positive": lambda c: c, "rad2deg": F.degrees, "radians": F.radians,
    "reciprocal": lambda c: truediv(F.lit(1), c), "rint": F.rint, "sign": F.signum, "signbit": lambda c: c < 0, "sin": F.sin, "sinh": F.sinh,
    "spacing": lambda c: _spacing(c), "sqrt": F.sqrt, "square": lambda c: c * c, "tan": F.tan, "tanh": F.tanh, "trunc": lambda c: F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)),
}
del UNARY["matmul"]


UNARY["modf"] = lambda c: c.cast("double") - F.when(c < 0, F.ceil(c)).otherwise(F.floor(c))  # the fractional part


def _spacing(c: Column) -> Column:
    """The distance to the next double of larger magnitude, by the value's binary exponent."""
    a = F.abs(c.cast("double"))
    exponent = F.floor(F.log2(a))
    exponent = exponent + F.when(F.pow(F.lit(2.0), exponent + 1) <= a, 1).when(F.pow(F.lit(2.0), exponent) > a, -1).otherwise(0)
    size = F.pow(F.lit(2.0), F.greatest(exponent - 52, F.lit(-1074)))
    return F.when(a == 0, F.lit(math.ulp(0.0))).otherwise(F.when(c < 0, -size).otherwise(size))


def _gcd(a: Column, b: Column) -> Column:
    """Euclid's algorithm as a fold: 92 steps suffice for any two longs."""
    start = F.struct(F.abs(a.cast("long")).alias("x"), F.abs(b.cast("long")).alias("y"))
    step = lambda s, _: F.struct(F.when(s["y"] == 0, s["x"]).otherwise(s["y"]).alias("x"), F.when(s["y"] == 0, F.lit(0).cast("long")).otherwise(s["x"] % F.when(s["y"] != 0, s["y"])).alias("y"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s["x"])


#: Two-argument functions by their NumPy names.
BINARY = {
    "arctan2": F.atan2, "bitwise_and": lambda a, b: a.bitwiseAND(b), "bitwise_or": lambda a, b: a.bitwiseOR(b), "bitwise_xor": lambda a, b: a.bitwiseXOR(b),
    "copysign": lambda a, b: F.when(b < 0, -F.abs(a.cast("double"))).otherwise(F.abs(a.cast("double"))), "float_power": power,
    "floor_divide": floordiv, "fmax": lambda a, b: F.greatest(a, b), "fmin": lambda a, b: F.least(a, b), "fmod": lambda a, b: a % F.when(b != 0, b), "gcd": _gcd,
    "heaviside": lambda a, b: F.when(a < 0, 0.0).when(a > 0, 1.0).otherwise(b.cast("double")), "hypot": F.hypot, "lcm": lambda a, b: F.abs(a.cast("long") * b.cast("long")).try_cast("long") / F.when(_gcd(a, b) != 0, _gcd(a, b)),
    "ldexp": lambda a, b: a * F.pow(F.lit(2.0), b), "left_shift": lambda a, b: F.call_function("shiftleft", a, b), "right_shift": lambda a, b: F.call_function("shiftright", a, b),
    "logaddexp": lambda a, b: F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b))), "logaddexp2": lambda a, b: F.greatest(a, b) + F.log2(1 + F.pow(F.lit(2.0), -F.abs(a - b))),
    "logical_and": lambda a, b: a.cast("boolean") & b.cast("boolean"), "logical_or": lambda a, b: a.cast("boolean") | b.cast("boolean"), "logical_xor": lambda a, b: a.cast("boolean") != b.cast("boolean"),
    "maximum": lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b)), "minimum": lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.least(a, b)), "mod": mod, "remainder": mod,
    "nextafter": lambda a, b: F.when(a == b, b.cast("double")).when(b > a, a + F.abs(_spacing(a))).otherwise(a - F.abs(_spacing(a))),
    "power": power, "true_divide": truediv, "divide": truediv,
}
