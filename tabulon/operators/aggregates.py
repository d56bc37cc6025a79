"""Reducers by name, each one aggregate expression over a column."""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import reduce as fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import fractional, missing, to_bool, valid


def _number(c: Column, kind: T.DataType) -> Column:
    return c.cast("long") if isinstance(kind, T.BooleanType) else valid(c, kind)


def _min_count(value: Column, c: Column, kind: T.DataType, least: int) -> Column:
    return F.when(F.count(valid(c, kind)) >= least, value) if least > 0 else value


def sum_(c, kind, min_count=0):
    total = F.sum(_number(c, kind))
    return _min_count(F.coalesce(total, F.lit(0).cast(_sum_type(kind))), c, kind, min_count)


def _sum_type(kind):
    return "double" if fractional(kind) else kind.simpleString() if isinstance(kind, T.DecimalType) else "long"


def prod(c, kind, min_count=0):
    value = F.coalesce(F.product(_number(c, kind).cast("double")), F.lit(1.0))
    return _min_count(value if fractional(kind) else F.round(value).cast("long"), c, kind, min_count)


def var(c, kind, ddof=1):
    x = _number(c, kind).cast("double")
    return F.var_pop(x) if ddof == 0 else F.var_samp(x) if ddof == 1 else F.when(F.count(x) > ddof, F.var_pop(x) * F.count(x) / (F.count(x) - ddof))


def std(c, kind, ddof=1):
    x = _number(c, kind).cast("double")
    return F.stddev_pop(x) if ddof == 0 else F.stddev_samp(x) if ddof == 1 else F.sqrt(var(c, kind, ddof))


def quantile(c, kind, q=0.5, accuracy=None):
    """As one aggregate: with an accuracy, approximate in bounded memory, else exact with all distinct values as its state (see quantiles())."""
    x = _number(c, kind).cast("double")
    return F.percentile_approx(x, q, accuracy) if accuracy else F.percentile(x, q)


def first(c, kind, order=None):
    """The first valid value in the order given."""
    x = valid(c, kind)
    return F.min_by(x, F.when(x.isNotNull(), order)) if order is not None else F.first(x, ignorenulls=True)


def last(c, kind, order=None):
    x = valid(c, kind)
    return F.max_by(x, F.when(x.isNotNull(), order)) if order is not None else F.last(x, ignorenulls=True)


def nunique(c, kind, dropna=True, approx=False, rsd=0.05):
    n = F.approx_count_distinct(valid(c, kind), rsd) if approx else F.count_distinct(valid(c, kind))
    return n if dropna else n + F.max(F.when(valid(c, kind).isNull(), 1).otherwise(0))


def mode(c, kind):
    return F.mode(valid(c, kind), deterministic=True)


REDUCERS: dict[str, Callable[..., Column]] = {
    "count": lambda c, k: F.count(valid(c, k)),
    "size": lambda c, k: F.count(F.lit(1)),
    "sum": sum_,
    "prod": prod,
    "product": prod,
    "mean": lambda c, k: F.avg(_number(c, k).cast("double") if not isinstance(k, T.DecimalType) else c),
    "min": lambda c, k: F.min(valid(c, k)),
    "max": lambda c, k: F.max(valid(c, k)),
    "var": var,
    "std": std,
    "sem": lambda c, k, ddof=1: std(c, k, ddof) / F.sqrt(F.count(valid(c, k))),
    "skew": lambda c, k: F.skewness(_number(c, k).cast("double")),
    "kurt": lambda c, k: F.kurtosis(_number(c, k).cast("double")),
    "kurtosis": lambda c, k: F.kurtosis(_number(c, k).cast("double")),
    "median": lambda c, k, accuracy=None: quantile(c, k, 0.5, accuracy),
    "quantile": quantile,
    "nunique": nunique,
    "all": lambda c, k: F.coalesce(F.min(F.when(valid(c, k).isNull(), True).otherwise(to_bool(c, k))), F.lit(True)),
    "any": lambda c, k: F.coalesce(F.max(F.when(valid(c, k).isNull(), False).otherwise(to_bool(c, k))), F.lit(False)),
    "first": first,
    "last": last,
    "mode": mode,
    "unique": lambda c, k: F.sort_array(F.collect_set(c)),
}

#: Reducers that only numbers have.
NUMERIC = frozenset("sum prod product mean var std sem skew kurt kurtosis median quantile".split())


#: Reducers that a missing value makes missing where it isn't skipped.
SKIPPING = NUMERIC | {"min", "max"}


def reduce(name: str, c: Column, kind: T.DataType, skipna: bool = True, **options) -> Column:
    if name not in REDUCERS:
        raise ValueError(f"no reducer is named {name!r}")
    value = REDUCERS[name](c, kind, **options)
    if skipna or name not in SKIPPING:
        return value
    return F.when(~F.coalesce(F.max(missing(c, kind)), F.lit(False)), value)


def across(name: str, columns: list[tuple[Column, T.DataType]], skipna: bool = True, ddof: int = 1, min_count: int = 0) -> Column:
    """The named reducer over the columns of a row."""
    if name == "count":
        return fold(operator.add, [(~missing(c, k)).cast("long") for c, k in columns])
    every = F.array(*[_number(c, k).cast("double") for c, k in columns])
    x = F.filter(every, lambda v: v.isNotNull())
    n = F.size(x).cast("double")
    total = lambda f: F.aggregate(x, F.lit(0.0), lambda s, v: s + f(v))
    mean = total(lambda v: v) / F.when(n > 0, n)
    moment = lambda p: total(lambda v: F.pow(v - mean, F.lit(float(p)))) / F.when(n > 0, n)
    var = moment(2) * n / F.when(n > ddof, n - ddof)
    line = F.sort_array(x)
    low, high = F.floor((n - 1) / 2).cast("int"), F.ceil((n - 1) / 2).cast("int")
    made = {
        "sum": lambda: F.when(n >= min_count, total(lambda v: v)),
        "prod": lambda: F.when(n >= min_count, F.aggregate(x, F.lit(1.0), lambda s, v: s * v)),
        "mean": lambda: mean,
        "min": lambda: F.array_min(x),
        "max": lambda: F.array_max(x),
        "var": lambda: var,
        "std": lambda: F.sqrt(var),
        "sem": lambda: F.sqrt(var) / F.sqrt(n),
        "skew": lambda: moment(3) / F.pow(F.when(moment(2) > 0, moment(2)), F.lit(1.5)),
        "kurt": lambda: moment(4) / F.pow(F.when(moment(2) > 0, moment(2)), F.lit(2.0)) - 3,
        "median": lambda: (F.get(line, low) + F.get(line, high)) / 2,
        "mad": lambda: total(lambda v: F.abs(v - mean)) / F.when(n > 0, n),
    }
    name = {"product": "prod", "kurtosis": "kurt"}.get(name, name)
    if name not in made:
        raise ValueError(f"{name} isn't offered across columns")
    return made[name]() if skipna else F.when(n == len(columns), made[name]())


def quantiles(df: DataFrame, keys: list[Column], values: list[Column], qs: list[float]) -> DataFrame:
    """k0, k1, ... (the keys), i (number of the value), q (array of its exact quantiles at *qs*).

    Values are counted first; their running counts in sorted order come from blocks of a range sort, so
    neither a column nor a hot group has to fit a task. Quantiles are interpolated between two ranks.
    """
    from ..plans import ordered

    names = [f"k{i}" for i in range(len(keys))]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), v.cast("double").alias("x")) for i, v in enumerate(values)])).alias("e")
    freq = df.select(*[k.alias(n) for k, n in zip(keys, names)], each).where("e.x is not null").groupBy(*names, F.col("e.i").alias("i"), F.col("e.x").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    past = lambda n, p: F.sum(n).over(p)
    run = ordered.running(freq, [F.asc_nulls_first(c) for c in (*names, "i", "x")], lambda w: {"local": F.sum("n").over(w)}, {"past": F.sum("n")}, past)
    run = run.select(*names, "i", "x", "n", (F.col("local") + F.coalesce("past", F.lit(0)) - F.col("n")).alias("before"))
    whole = run.groupBy(*names, "i").agg(F.min("before").alias("start"), F.sum("n").alias("total"))
    renamed = whole.select(*[F.col(c).alias(f"w{c}") for c in (*names, "i")], "start", "total")
    same = fold(operator.and_, [F.col(c).eqNullSafe(F.col(f"w{c}")) for c in (*names, "i")])
    at = run.join(renamed, same).withColumn("before", F.col("before") - F.col("start"))
    place = lambda q: F.lit(float(q)) * (F.col("total") - 1)
    holds = lambda r: (F.col("before") <= r) & (r < F.col("before") + F.col("n"))
    ends = [F.max(F.when(holds(f(place(q))), F.col("x"))).alias(f"{s}{j}") for j, q in enumerate(qs) for s, f in (("a", F.floor), ("b", F.ceil))]
    got = at.groupBy(*names, "i").agg(F.max("total").alias("total"), *ends)
    part = lambda q: place(q) - F.floor(place(q))
    return got.select(*names, "i", F.array(*[F.col(f"a{j}") + F.when(F.col(f"a{j}") == F.col(f"b{j}"), 0.0).otherwise(F.col(f"b{j}") - F.col(f"a{j}")) * part(q) for j, q in enumerate(qs)]).alias("q"))
