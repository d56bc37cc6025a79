"""Grouped tables."""

from __future__ import annotations

from collections import namedtuple
from functools import reduce as fold
import operator

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frame import Frame, _Named, as_list, only, from_pandas, key_column, physical
from .functions import scalar as S
from .operators.aggregates import NUMERIC, quantiles, reduce
from .series import Index, Rolling, Series

NamedAgg = namedtuple("NamedAgg", ["column", "aggfunc"])
#: A quantile of a column by groups, which _grouped computes apart.
Quantile = namedtuple("Quantile", ["col", "q"])


def _marked(s: Series, q: float) -> Quantile:
    return Quantile(S.valid(s.col.cast("long") if isinstance(s.kind, T.BooleanType) else s.col, s.kind).cast("double"), q)


class GroupBy(_Named):
    """Rows of a frame by keys: labels, or series of the same frame."""

    _scope = "GroupBy"

    def __init__(self, frame: Frame, by, as_index=True, dropna=True, picked=None, single=False):
        self._by_series = [b if isinstance(b, Series) else frame._series(b) for b in as_list(by)]
        if any(b._frame.df is not frame.df for b in self._by_series):
            base = frame
            for i, b in enumerate(self._by_series):
                base = base._assigned({f"__by{i}__": b})
            self._by_series = [Series(base, F.col(f"__by{i}__"), b.name) for i, b in enumerate(self._by_series)]
            picked, frame = picked or [x for x in frame._labels if x not in [b.name for b in self._by_series]], base
        self._f, self._as_index, self._dropna = frame, as_index, dropna
        names = [b.name for b in self._by_series]
        self._picked = picked if picked is not None else [x for x in frame._labels if x not in names and not str(x).startswith("__by")]
        self._single = single

    def __getattr__(self, name):
        if not name.startswith("_") and name in self._f._labels:
            return self[name]
        return super().__getattr__(name)

    def __getitem__(self, key) -> "GroupBy":
        one = not isinstance(key, list)
        return GroupBy(self._f, self._by_series, self._as_index, self._dropna, as_list(key), one)

    @property
    def _keys(self):
        return [b.col for b in self._by_series]

    @property
    def _rows(self):
        """Rows with valid keys: dropped before the shuffle."""
        if not self._dropna:
            return self._f.df
        return self._f.df.where(fold(operator.and_, [~S.missing(b.col, b.kind) for b in self._by_series]))

    def _grouped(self, columns: dict) -> Frame | Series:
        """label -> aggregate, as a frame indexed by the keys."""
        keys = [c.alias(key_column(i)) for i, c in enumerate(self._keys)]
        names = [physical(k) for k in columns]
        marks = {n: c for n, c in zip(names, columns.values()) if isinstance(c, Quantile)}
        plain = [c.alias(n) for n, c in zip(names, columns.values()) if n not in marks]
        df = self._rows.groupBy(*keys).agg(*plain) if plain else self._rows.select(*keys).distinct()
        if marks:  # of all groups and values in one go, joined to the other aggregates
            values = {repr(m.col): m.col for m in marks.values()}
            qs = sorted({m.q for m in marks.values()})
            got = quantiles(self._rows, self._keys, list(values.values()), qs)
            where = {x: i for i, x in enumerate(values)}
            mine = [F.max(F.when(F.col("i") == where[repr(m.col)], F.get("q", F.lit(qs.index(m.q))))).alias(n) for n, m in marks.items()]
            got = got.groupBy(*[f"k{i}" for i in range(len(keys))]).agg(*mine)
            same = fold(operator.and_, [F.col(key_column(i)).eqNullSafe(F.col(f"k{i}")) for i in range(len(keys))])
            df = df.join(got, same, "left").select(*[key_column(i) for i in range(len(keys))], *[F.col(f"`{n}`") for n in names])
        order = [key_column(i) for i in range(len(keys))]
        out = Frame(_state={"df": df, "keys": order, "names": [b.name for b in self._by_series], "labels": list(columns), "cols": names, "order": order})
        return out if self._as_index else out.reset_index()

    def _reduced(self, name, **options):
        kept = [s for s in map(self._f._series, self._picked) if name not in NUMERIC or S.numeric(s.kind)]
        if name in ("first", "last"):
            options["order"] = F.struct(*self._f._order)
        out = self._grouped({s.name: _marked(s, 0.5) if name == "median" and not options.get("accuracy") else reduce(name, s.col, s.kind, **options) for s in kept})
        return out._series(out._labels[-1]) if self._single and self._as_index else out

    def agg(self, func=None, **named):
        """By a name, names, a dict of label -> names, or keyword = (label, name)."""
        if named:
            pairs = {k: NamedAgg(*v) if isinstance(v, tuple) else NamedAgg(self._picked[0], v) for k, v in named.items()}
            return self._grouped({k: self._one(v.column, v.aggfunc) for k, v in pairs.items()})
        if isinstance(func, str):
            return getattr(self, func)()
        wanted = {k: v for k, v in func.items()} if isinstance(func, dict) else {x: list(func) for x in self._picked}
        if not any(isinstance(v, list) for v in wanted.values()):
            return self._grouped({k: self._one(k, f) for k, f in wanted.items()})
        return self._grouped({(f if self._single else (k, f)): self._one(k, f) for k, fs in wanted.items() for f in as_list(fs)})

    aggregate = agg

    def _one(self, label, name):
        s = self._f._series(label)
        if name == "median":
            return _marked(s, 0.5)
        return reduce(name, s.col, s.kind, **({"order": F.struct(*self._f._order)} if name in ("first", "last") else {}))

    def size(self) -> Series:
        out = self._grouped({"size": F.count(F.lit(1))})
        return out._series("size").rename(None) if self._as_index else out

    def describe(self) -> Frame:
        kept = [s for s in map(self._f._series, self._picked) if isinstance(s.kind, T.NumericType)]
        made = {}
        for s in kept:
            for n in ("count", "mean", "std", "min"):
                made[(s.name, n)] = reduce(n, s.col, s.kind).cast("double")
            for q in (0.25, 0.5, 0.75):
                made[(s.name, f"{100 * q:g}%")] = _marked(s, q)
            made[(s.name, "max")] = reduce("max", s.col, s.kind).cast("double")
        return self._grouped(made)

    def _edge(self, largest):
        key = F.col(self._f._keys[0])
        made = {}
        for s in map(self._f._series, self._picked):
            x = S.valid(s.col, s.kind)
            v = -x.cast("double") if largest else x.cast("double")
            made[s.name] = F.min_by(key, F.when(x.isNotNull(), F.struct(v.alias("v"), *[F.col(c) for c in self._f._order])))
        out = self._grouped(made)
        return out._series(out._labels[-1]) if self._single else out

    def idxmax(self, skipna=True):
        only(skipna=(skipna, True))
        return self._edge(True)

    def idxmin(self, skipna=True):
        only(skipna=(skipna, True))
        return self._edge(False)

    def value_counts(self, sort=True, ascending=False, dropna=True) -> Series:
        s = self._f._series(self._picked[0])
        inner = GroupBy(self._f, [*self._by_series, s], True, dropna)
        counts = inner.size().rename(s.name)
        if not sort:
            return counts
        f = counts._frame
        n, order = F.col("size"), [*f._keys[:-1], "__rank__", f._keys[-1]]
        return Series(f._rows(f.df.withColumn("__rank__", n if ascending else -n))._new(order=order), counts.col, s.name)

    def unique(self) -> Series:
        return self._reduced("unique")

    def get_group(self, name):
        values = name if isinstance(name, tuple) else (name,)
        rows = self._f._rows(self._f.df.where(fold(operator.and_, [b.col == F.lit(v) for b, v in zip(self._by_series, values)])))
        return rows._series(self._picked[0]) if self._single else rows

    # ---- rows within groups ------------------------------------------------------------------------
    def _over(self, name, *args, **options):
        from .operators.windows import compute

        frame = self._f._rows(self._rows)
        kept = [Series(frame, s.col, s.name) for s in map(self._f._series, self._picked) if name in ("shift", "ffill", "bfill") or S.numeric(s.kind)]
        out = compute(frame, kept, self._keys, name, *args, **options)
        return out._series(out._labels[0]) if self._single else out

    def cumcount(self, ascending=True) -> Series:
        w = Window.partitionBy(*self._keys).orderBy(*(self._f._by if ascending else [F.desc_nulls_last(c) for c in self._f._order]))
        frame = self._f._rows(self._rows)._select({"cumcount": (F.row_number().over(w) - 1).cast("long")})
        return frame._series("cumcount").rename(None)

    def fillna(self, value=None, method=None, axis=None, inplace=False, limit=None):
        if method is not None:
            only(axis=(axis, None, 0, "index"), inplace=(inplace, False))
            return self._over("ffill" if method in ("ffill", "pad") else "bfill", limit=limit)
        only(axis=(axis, None, 0, "index"), inplace=(inplace, False), limit=(limit, None))
        return self._f._rows(self._rows)[self._picked].fillna(value)

    def _limited(self, n, first):
        by = self._f._by if first else [F.desc_nulls_last(c) for c in self._f._order]
        rows = self._rows.withColumn("__n__", F.row_number().over(Window.partitionBy(*self._keys).orderBy(*by)))
        out = self._f._rows(rows.where(F.col("__n__") <= n).drop("__n__"))
        return out._series(self._picked[0]) if self._single else out

    def head(self, n=5):
        return self._limited(n, True)

    def tail(self, n=5):
        return self._limited(n, False)

    def _top(self, n, largest) -> Series:
        s = self._f._series(self._picked[0])
        rank = F.row_number().over(Window.partitionBy(*self._keys).orderBy(s.col.desc_nulls_last() if largest else s.col.asc_nulls_last(), *self._f._by))
        rows = self._rows.withColumn("__n__", rank).where((F.col("__n__") <= n) & s.col.isNotNull())
        keys = self._keys + [F.col(k) for k in self._f._keys]
        names = [b.name for b in self._by_series] + self._f._s["names"]
        made = rows.select(*[k.alias(key_column(i)) for i, k in enumerate(keys)], "__n__", s.col.alias(physical(s.name)))
        order = [key_column(i) for i in range(len(self._keys))] + ["__n__"]
        return Frame(_state={"df": made, "keys": [key_column(i) for i in range(len(keys))], "names": names, "labels": [s.name], "cols": [physical(s.name)], "order": order})._series(s.name)

    def nlargest(self, n=5):
        return self._top(n, True)

    def nsmallest(self, n=5):
        return self._top(n, False)

    def rolling(self, window, min_periods=None):
        return self._windows(window, min_periods)

    def expanding(self, min_periods=1):
        return self._windows(None, min_periods)

    def _windows(self, window, least):
        frame = self._f._rows(self._rows)
        target = frame._series(self._picked[0]) if self._single else frame._new(labels=self._picked, cols=[frame._where_label(x) for x in self._picked])
        return Rolling(target, self._keys, window, least)

    # ---- functions ---------------------------------------------------------------------------------
    def apply(self, func, *args, schema=None, **kwargs):
        from .operators.batches import group_apply

        return group_apply(self, func, args, kwargs, schema)

    def transform(self, func, *args, schema=None, **kwargs):
        from .operators.batches import group_transform

        return group_transform(self, func, args, kwargs, schema)

    def filter(self, func) -> Frame:
        from .operators.batches import group_filter

        return group_filter(self, func)


for _n in ("count", "sum", "mean", "min", "max", "std", "var", "median", "nunique", "any", "all", "first", "last"):
    setattr(GroupBy, _n, (lambda m: lambda self, numeric_only=None, **o: self._reduced(m, **o))(_n))
for _n in ("cumsum", "cumprod", "cummin", "cummax", "shift", "diff", "rank", "ffill", "bfill"):
    setattr(GroupBy, _n, (lambda m: lambda self, *a, **o: self._over(m, *a, **o))(_n))
GroupBy.pad, GroupBy.backfill = GroupBy.ffill, GroupBy.bfill
