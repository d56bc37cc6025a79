"""Melt, pivot, stack, unstack and dummies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import get_option
from ..frame import ROW, Frame, as_list, key_column, physical
from .aggregates import reduce


def spread_values(df, c) -> list:
    """The sorted distinct values of a column that become columns or categories; raises above compute.max_columns."""
    most = get_option("compute.max_columns")
    found = [r[0] for r in df.select(c.alias("v")).where("v is not null").distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than compute.max_columns ({most}) distinct values; raise the option to spread them")
    return sorted(found)


def melt(frame: Frame, id_vars=None, value_vars=None, var_name="variable", value_name="value") -> Frame:
    ids = as_list(id_vars) if id_vars is not None else []
    values = as_list(value_vars) if value_vars is not None else [x for x in frame._labels if x not in ids]
    pairs = F.array(*[F.struct(F.lit(physical(x)).alias("k"), F.col(f"`{frame._where_label(x)}`").alias("v")) for x in values])
    rows = frame.df.select(*[F.col(f"`{frame._where_label(x)}`") for x in ids], F.explode(pairs).alias("__p__"))
    out = rows.select(*[F.col(f"`{frame._where_label(x)}`") for x in ids], F.col("__p__.k").alias(var_name), F.col("__p__.v").alias(value_name))
    return Frame(out)


def pivot_table(frame: Frame, values=None, index=None, columns=None, aggfunc="mean", fill_value=None) -> Frame:
    """Groups by index and spreads one column's distinct values; they are found first unless few are given."""
    index = as_list(index) if index is not None else None
    vals = as_list(values)
    by = [frame._series(x).col.alias(key_column(i)) for i, x in enumerate(index)] if index else [F.col(k).alias(key_column(i)) for i, k in enumerate(frame._keys)]
    names = index or frame._s["names"]
    spread = spread_values(frame.df, frame._series(columns).col)
    fun = lambda v: aggfunc[v] if isinstance(aggfunc, dict) else aggfunc
    c = frame._series(columns).col
    made = {}
    for v in vals:
        for x in spread:
            s = frame._series(v)
            label = x if len(vals) == 1 and not isinstance(values, list) else (v, x)
            hit = F.when(c == F.lit(x), s.col)
            made[label] = F.first(hit, ignorenulls=True) if fun(v) == "first" else F.when(F.count(F.when(c == F.lit(x), 1)) > 0, reduce(fun(v), hit, s.kind))
    df = frame.df.groupBy(*by).agg(*[(F.coalesce(a, F.lit(fill_value)) if fill_value is not None else a).alias(physical(k)) for k, a in made.items()])
    keys = [key_column(i) for i in range(len(by))]
    return Frame(_state={"df": df, "keys": keys, "names": list(names), "labels": list(made), "cols": [physical(k) for k in made], "order": keys})


def stack(frame: Frame):
    """Labels move into a last index level; missing values are dropped."""
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(physical(x)).alias("k"), F.col(f"`{c}`").alias("v")) for i, (x, c) in enumerate(zip(frame._labels, frame._cols))])
    n = len(frame._keys)
    rows = frame.df.select(*frame._keys, *[c for c in frame._order if c not in frame._keys], F.explode(pairs).alias("p")).where("p.v is not null")
    df = rows.select(*frame._keys, *[c for c in frame._order if c not in frame._keys], F.col("p.k").alias(key_column(n)), F.col("p.i").alias("__i__"), F.col("p.v").alias("0"))
    out = Frame(_state={"df": df, "keys": [*frame._keys, key_column(n)], "names": [*frame._s["names"], None], "labels": ["0"], "cols": ["0"], "order": [*frame._order, "__i__"]})
    return out._series("0").rename(None)


def unstack_series(s, level=-1) -> Frame:
    """An index level's distinct values become labels."""
    f = s._frame
    names = f._s["names"]
    at = names.index(level) if level in names else level % len(f._keys)
    spread = spread_values(f.df, F.col(f._keys[at]))
    left = [k for i, k in enumerate(f._keys) if i != at]
    df = f.df.groupBy(*[F.col(k).alias(key_column(i)) for i, k in enumerate(left)]).agg(*[F.first(F.when(F.col(f._keys[at]) == F.lit(x), s.col), ignorenulls=True).alias(physical(x)) for x in spread])
    keys = [key_column(i) for i in range(len(left))]
    return Frame(_state={"df": df, "keys": keys, "names": [n for i, n in enumerate(names) if i != at], "labels": spread, "cols": [physical(x) for x in spread], "order": keys})


def unstack_frame(frame: Frame):
    """Over an index of one level: a series with the label as the first level."""
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(physical(x)).alias("k"), F.col(f"`{c}`").alias("v")) for i, (x, c) in enumerate(zip(frame._labels, frame._cols))])
    order = [c for c in frame._order if c not in frame._keys]
    rows = frame.df.select(*frame._keys, *order, F.explode(pairs).alias("p"))
    n = len(frame._keys)
    df = rows.select(F.col("p.k").alias(key_column(0)), *[F.col(k).alias(key_column(i + 1)) for i, k in enumerate(frame._keys)], *order, F.col("p.i").alias("__i__"), F.col("p.v").alias("0"))
    order = ["__i__", *[key_column(frame._keys.index(c) + 1) if c in frame._keys else c for c in frame._order]]
    out = Frame(_state={"df": df, "keys": [key_column(i) for i in range(n + 1)], "names": [None, *frame._s["names"]], "labels": ["0"], "cols": ["0"], "order": order})
    return out._series("0").rename(None)


def get_dummies(data, prefix=None, prefix_sep="_", dummy_na=False, columns=None, drop_first=False, dtype="tinyint") -> Frame:
    from pyspark.sql import types as T

    from ..series import Series

    frame = data.to_frame() if isinstance(data, Series) else data
    picked = as_list(columns) if columns is not None else list(frame._labels) if isinstance(data, Series) else [s.name for s in frame._each(lambda k: isinstance(k, T.StringType))]
    kept = {x: F.col(f"`{frame._where_label(x)}`") for x in frame._labels if x not in picked}
    for i, x in enumerate(picked):
        c = frame._series(x).col
        values = spread_values(frame.df, c)
        lead = (prefix[x] if isinstance(prefix, dict) else prefix[i] if isinstance(prefix, list) else prefix) if prefix is not None else None if isinstance(data, Series) else physical(x)
        name = lambda v: v if lead is None else f"{lead}{prefix_sep}{v}"
        kept |= {name(v): F.coalesce((c == F.lit(v)).cast(dtype), F.lit(0).cast(dtype)) for v in values[bool(drop_first) :]}
        if dummy_na:
            kept[name("nan")] = c.isNull().cast(dtype)
    return frame._select(kept)
