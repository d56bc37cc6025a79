"""Order-dependent columns: shifts, running values, ranks, fills and row windows, with or without groups.

With groups, a window partitioned by them does the work. Without, the table is cut into ordered
blocks (plans.ordered), so no task ever sorts the whole table.
"""

from __future__ import annotations

from itertools import count
from typing import NamedTuple

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..frame import ROW, Frame, Unsupported, physical
from ..functions import scalar as S
from ..plans import ordered
from ..series import Series

RUNNING = {"cumsum", "cumprod", "cummin", "cummax"}


_made = count()


class Spec(NamedTuple):
    """One windowed column: its input, groups, and the name and settings of the operator."""

    col: Column
    kind: T.DataType
    by: list[Column]
    name: str
    settings: dict


def columns(frame: Frame, specs: dict[str, Spec], keep: bool = False) -> Frame:
    """*specs* (new column -> spec) over *frame*'s rows, in one sort for all; with *keep*, its own columns too.

    The frame's table remembers what it was made from, so that ``Frame.assign`` computes columns of several
    such frames together instead of joining them.
    """
    inputs, groups = {}, {}
    for i, s in enumerate(specs.values()):
        inputs.setdefault(repr(s.col) + s.kind.simpleString(), (f"__v{i}__", s))
        for c in s.by:
            groups.setdefault(repr(c), (f"__g{len(groups)}__", c))
    named = {v: S.valid(s.col, s.kind) for v, s in inputs.values()} | dict(groups.values())
    own = {x: F.col(f"`{c}`") for x, c in zip(frame._labels, frame._cols)} if keep else {}
    base = frame._select(own | named)
    order = [] if base._order == [ROW] and not groups else base._by
    if not all(s.by for s in specs.values()):
        base = base._rows(ordered.positioned(frame.df, base.df, [] if base._order == [ROW] else base._by))
    together: dict[str, list[str]] = {}
    for m, s in specs.items():
        together.setdefault(repr((s.name, s.by, sorted(s.settings.items()))), []).append(m)
    for mine in together.values():
        first = specs[mine[0]]
        vals, kinds = [inputs[repr(specs[m].col) + specs[m].kind.simpleString()][0] for m in mine], [specs[m].kind for m in mine]
        df = _column(base, vals, mine, kinds, [groups[repr(c)][0] for c in first.by], order, first.name, **first.settings)
        base = base._rows(df.select(*[F.col(f"`{c}`") for c in [*base.df.columns, *mine]]))
    kept = list(dict.fromkeys([*base._keys, *base._order, *[physical(x) for x in own], *specs]))
    df = base.df.select(*[F.col(f"`{c}`") for c in kept])
    df.__dict__["_tabulon_windows"] = frame, specs
    return base._new(df=df, labels=[*own, *specs], cols=[*[physical(x) for x in own], *specs])


def _column(base: Frame, vals, made, kinds, groups, order, name: str, **options):
    if name == "rank":
        return _rank(base, vals, made, groups, order, **options)
    if name in RUNNING:
        return _running(base, vals, made, groups, order, name, kinds, **options)
    if name in ("ffill", "bfill"):
        return _fill(base, vals, made, groups, order, name == "bfill", options.get("limit"))
    if name == "rows":
        return _rows_window(base, vals, made, groups, order, **options)
    f, back, ahead = _reach(name, kinds, **options)
    new = lambda w: {m: f(F.col(v), w, i) for i, (v, m) in enumerate(zip(vals, made))}
    if groups:
        return base.df.withColumns(new(Window.partitionBy(*groups).orderBy(*order)))
    return ordered.bounded(base.df, order, back, ahead, new)


#: Parameters of each operator, in the order that callers may give them in.
PARAMETERS = {
    "shift": ("periods", "fill_value"), "diff": ("periods", "axis"), "pct_change": ("periods",), "rank": ("method", "ascending"),
    "ffill": ("axis", "inplace", "limit"), "bfill": ("axis", "inplace", "limit"), **{n: ("skipna",) for n in RUNNING},
}


def settings_of(name: str, args: tuple, options: dict) -> dict:
    """The given parameters by name; those that aren't offered, or not for these values, raise."""
    given = dict(zip(PARAMETERS[name], args)) | options
    for k, v in list(given.items()):
        if k not in PARAMETERS[name]:
            raise TypeError(f"{name} has no parameter {k!r}")
        if k == "axis" and v not in (None, 0, "index"):
            raise Unsupported(f"{name} goes along rows")
        if k in ("axis", "inplace"):
            given.pop(k)
    return given


def compute(frame: Frame, series: list[Series], by: list[Column], name: str, *args, **options) -> Frame:
    """The named column for each series over *frame*."""
    settings = settings_of(name, args, options)
    labels = [s.name if s.name is not None else "0" for s in series]
    made = [f"__w{next(_made)}__" for _ in series]
    out = columns(frame, {m: Spec(s.col, s.kind, by, name, settings) for m, s in zip(made, series)})
    return out._new(labels=labels)


def _reach(name, kinds, periods=1, fill_value=None):
    back, ahead = max(periods, 0), max(-periods, 0)
    lag = lambda c, w: F.lag(c, periods).over(w) if periods >= 0 else F.lead(c, -periods).over(w)
    if name == "shift":
        fill = None if fill_value is None else F.lit(fill_value)
        there = lambda w: (F.lag(F.lit(1), periods) if periods >= 0 else F.lead(F.lit(1), -periods)).over(w)
        return (lambda c, w, i: lag(c, w) if fill is None else F.when(there(w).isNull(), fill).otherwise(lag(c, w))), back, ahead
    if name == "diff":
        return (lambda c, w, i: S.subtract(c, lag(c, w), kinds[i], kinds[i])), back, ahead
    return (lambda c, w, i: S.truediv(c - lag(c, w), lag(c, w))), back, ahead


def _running(base, vals, made, groups, order, name, kinds, skipna=True):
    agg = {"cumsum": F.sum, "cumprod": lambda c: F.product(c.cast("double")), "cummin": F.min, "cummax": F.max}[name]
    join = {"cumsum": lambda a, b: F.coalesce(a, F.lit(0)) + b, "cumprod": lambda a, b: F.coalesce(a, F.lit(1.0)) * b, "cummin": lambda a, b: F.least(a, b), "cummax": lambda a, b: F.greatest(a, b)}[name]
    shape = lambda c, i: F.round(c).cast("long") if name == "cumprod" and isinstance(kinds[i], T.IntegralType) else c
    keep = (lambda c, v: F.when(F.col(v).isNotNull(), c)) if skipna else (lambda c, v: c)
    value = [F.col(v).cast("long") if isinstance(k, T.BooleanType) else F.col(v) for v, k in zip(vals, kinds)]
    if groups:
        w = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        df = base.df.withColumns({m: keep(shape(agg(c).over(w), i), v) for i, (v, c, m) in enumerate(zip(vals, value, made))})
        nulls = None if skipna else w
    else:
        totals = {f"__t{i}__": agg(c) for i, c in enumerate(value)} | {f"__z{i}__": F.max(F.col(v).isNull()) for i, v in enumerate(vals)}
        carry = lambda n, p: (F.max if n.startswith("__z") else agg)(F.col(n)).over(p)
        df = ordered.running(base.df, order, lambda w: {f"__l{i}__": agg(c).over(w) for i, c in enumerate(value)} | {f"__y{i}__": F.max(F.col(v).isNull()).over(w) for i, v in enumerate(vals)}, totals, carry)
        both = lambda i: F.when(F.col(f"__l{i}__").isNull(), F.col(f"__t{i}__")).otherwise(join(F.col(f"__t{i}__"), F.col(f"__l{i}__")))
        df = df.withColumns({m: keep(shape(both(i), i), v) for i, (v, m) in enumerate(zip(vals, made))})
        if not skipna:
            df = df.withColumns({m: F.when(~(F.coalesce(F.col(f"__z{i}__"), F.lit(False)) | F.col(f"__y{i}__")), F.col(m)) for i, m in enumerate(made)})
        return df
    if nulls is not None:
        df = df.withColumns({m: F.when(~F.max(F.col(v).isNull()).over(nulls), F.col(m)) for v, m in zip(vals, made)})
    return df


def _fill(base, vals, made, groups, order, back, limit):
    """The last valid value so far; backwards over the reversed order, as a frame open to the end is recomputed for each row."""
    so_far = lambda w: w.rowsBetween(-limit if limit else Window.unboundedPreceding, Window.currentRow)
    new = lambda w: {m: F.last(v, ignorenulls=True).over(so_far(w)) for v, m in zip(vals, made)}
    if groups:
        by = [F.desc_nulls_last(c) for c in base._order] if back else order
        return base.df.withColumns(new(Window.partitionBy(*groups).orderBy(*by)))
    if limit:
        ahead = lambda w: {m: F.first(v, ignorenulls=True).over(w.rowsBetween(Window.currentRow, limit)) for v, m in zip(vals, made)}
        return ordered.bounded(base.df, order, 0 if back else limit, limit if back else 0, ahead if back else new)
    rows = (base.df if ordered.POS in base.df.columns else ordered.positions(base.df, order)).withColumn(ordered.BLK, F.floor(F.col(ordered.POS) / ordered.BLOCK))
    edge, way = (F.min_by, F.desc) if back else (F.max_by, F.asc)
    sums = rows.groupBy(ordered.BLK).agg(*[edge(v, F.when(F.col(v).isNotNull(), F.col(ordered.POS))).alias(f"__t{i}__") for i, v in enumerate(vals)])
    past = Window.orderBy(way(ordered.BLK)).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(ordered.BLK, *[F.last(f"__t{i}__", ignorenulls=True).over(past).alias(f"__t{i}__") for i in range(len(vals))])
    local = new(Window.partitionBy(ordered.BLK).orderBy(way(ordered.POS)))
    df = rows.join(F.broadcast(sums), ordered.BLK).withColumns(local)  # one row for each block
    return df.withColumns({m: F.coalesce(m, f"__t{i}__") for i, m in enumerate(made)}).drop(ordered.BLK)


def _rank(base, vals, made, groups, order, method="average", ascending=True):
    """Ranks by counts of distinct values: copies are summed up before any sort."""
    df = base.df
    for v, m in zip(vals, made):
        up = F.asc(v) if ascending else F.desc(v)
        if method == "first":
            if groups:
                df = df.withColumn(m, F.when(F.col(v).isNotNull(), F.row_number().over(Window.partitionBy(*groups, F.col(v).isNull()).orderBy(up, *order)).cast("double")))
            else:
                there = ordered.positions(df.where(F.col(v).isNotNull()), [up, *base._by], m).withColumn(m, (F.col(m) + 1).cast("double"))
                df = there.unionByName(df.where(F.col(v).isNull()).withColumn(m, F.lit(None).cast("double")))
            continue
        freq = df.where(F.col(v).isNotNull()).groupBy(*groups, v).agg(F.count(F.lit(1)).alias("__n__"))
        if groups:
            w = Window.partitionBy(*groups).orderBy(up)
            freq = freq.withColumn("__to__", F.sum("__n__").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("__dense__", F.row_number().over(w))
        else:
            past = lambda n, p: F.sum(n).over(p)
            freq = ordered.running(freq, [up], lambda w: {"__local__": F.sum("__n__").over(w)}, {"__past__": F.sum("__n__")}, past)
            freq = freq.withColumn("__to__", F.col("__local__") + F.coalesce("__past__", F.lit(0))).withColumn("__dense__", F.col(ordered.POS) + 1).drop("__local__", "__past__", ordered.POS)
        low = F.col("__to__") - F.col("__n__") + 1
        rank = {"average": (low + F.col("__to__")) / 2, "min": low, "max": F.col("__to__"), "dense": F.col("__dense__")}[method].cast("double")
        freq = freq.select(*[F.col(g).alias(f"__f{i}__") for i, g in enumerate(groups)], F.col(v).alias("__fv__"), rank.alias(m))
        same = F.col(v) == F.col("__fv__")
        for i, g in enumerate(groups):
            same = same & F.col(g).eqNullSafe(F.col(f"__f{i}__"))
        df = df.join(freq, same, "left").drop("__fv__", *[f"__f{i}__" for i in range(len(groups))])
    return df


def rolling(target, by: list[Column], n: int | None, least: int, name: str):
    """Windows of n rows (None: all so far). A value shows where enough rows of its window are valid."""
    frame = target if isinstance(target, Frame) else target._frame
    series = target._each(S.numeric) if isinstance(target, Frame) else [target]
    made = [f"__w{next(_made)}__" for _ in series]
    settings = {"n": n, "least": least, "what": name}
    out = columns(frame, {m: Spec(s.col, s.kind, by, "rows", settings) for m, s in zip(made, series)})
    out = out._new(labels=[s.name if s.name is not None else "0" for s in series])
    return out if isinstance(target, Frame) else out._series(out._labels[0]).rename(target.name)


def _rows_window(base, vals, made, groups, order, n, least, what):
    agg = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max, "mean": F.avg, "std": F.stddev_samp, "var": F.var_samp}[what]

    def gated(c, w):
        enough = F.count(c).over(w) if n is not None or what != "count" else F.count(F.lit(1)).over(w)
        value = agg(c).over(w).cast("double")
        return value if what == "count" and n is not None else F.when(enough >= least, value)

    if not groups and n is None:
        return _expanding(base, vals, made, order, what, least)
    span = lambda w: w.rowsBetween(-(n - 1) if n is not None else Window.unboundedPreceding, Window.currentRow)
    new = lambda w: {m: gated(F.col(v).cast("double"), span(w)) for v, m in zip(vals, made)}
    return base.df.withColumns(new(Window.partitionBy(*groups).orderBy(*order))) if groups else ordered.bounded(base.df, order, max(n - 1, 0), 0, new)


def _expanding(base, vals, made, order, name, least):
    """Counts, sums, extremes and squared deviations of the block and of the blocks before, combined."""
    parts = {"n": lambda c: F.count(c), "s": lambda c: F.sum(c), "lo": lambda c: F.min(c), "hi": lambda c: F.max(c), "d": lambda c: F.var_pop(c) * F.count(c), "r": lambda c: F.count(F.lit(1))}
    cols = {i: F.col(v).cast("double") for i, v in enumerate(vals)}
    which = {f"__{k}{i}__": (k, i) for k in parts for i in cols}
    totals = {key: parts[k](cols[i]) for key, (k, i) in which.items()}

    def carry(key, past):
        k, i = which[key]
        if k in ("lo", "hi"):
            return (F.min if k == "lo" else F.max)(key).over(past)
        if k == "d":  # deviations within the blocks, and of their means
            n, s = F.col(f"__n{i}__"), F.col(f"__s{i}__")
            whole_n, whole_s = F.sum(n).over(past), F.sum(s).over(past)
            return F.sum(key).over(past) + F.sum(F.when(n > 0, s * s / n)).over(past) - F.when(whole_n > 0, whole_s * whole_s / whole_n)
        return F.sum(key).over(past)

    local = lambda w: {f"__l{k}{i}__": (F.var_pop(c).over(w) * F.count(c).over(w) if k == "d" else f(c).over(w)) for k, f in parts.items() for i, c in cols.items()}
    df = ordered.running(base.df, order, local, totals, carry)
    out = {}
    for i, m in enumerate(made):
        a = {k: F.coalesce(F.col(f"__{k}{i}__"), F.lit(0)) for k in ("n", "s", "d", "r")}
        b = {k: F.coalesce(F.col(f"__l{k}{i}__"), F.lit(0)) for k in ("n", "s", "d", "r")}
        n, s = a["n"] + b["n"], a["s"] + b["s"]
        gap = F.when(b["n"] > 0, b["s"] / b["n"]) - F.when(a["n"] > 0, a["s"] / a["n"])
        dev = a["d"] + b["d"] + F.coalesce(gap * gap * a["n"] * b["n"] / F.when(n > 0, n), F.lit(0.0))
        var = F.when(n > 1, dev / (n - 1))
        value = {"count": n, "sum": s, "mean": s / F.when(n > 0, n), "min": F.least(f"__lo{i}__", f"__llo{i}__"), "max": F.greatest(f"__hi{i}__", f"__lhi{i}__"), "var": var, "std": F.sqrt(var)}[name]
        out[m] = F.when((a["r"] + b["r"] if name == "count" else n) >= least, value.cast("double"))
    return df.withColumns(out)


def over_frame(frame: Frame, by, name, *args, **options) -> Frame:
    only = None if name in ("shift", "ffill", "bfill") else S.numeric
    return compute(frame, frame._each(only), by, name, *args, **options)


def over_series(s: Series, by, name, *args, **options) -> Series:
    out = compute(s._frame, [s], by, name, *args, **options)
    return out._series(out._labels[0]).rename(s.name)
