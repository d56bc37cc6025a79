"""Labelled tables: Frame, Series and Index over one Spark DataFrame.

A Frame is immutable state (a DataFrame, its index columns, its labelled data columns, its order
columns); methods return new ones, and in-place forms rebind the wrapper. A Series is a column
expression on a Frame. Series of the same Frame combine as expressions; others join on the index,
which the option compute.ops_on_diff_frames must allow.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import reduce as fold

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .config import get_option
from .functions import scalar as S
from .functions import strings, temporal
from .operators.aggregates import NUMERIC, across, quantiles, reduce
from .plans import ordered

ROW = "__row__"
PAIRS = ("add", "sub", "mul", "truediv", "floordiv", "mod", "pow")
COMPARISONS = ("eq", "ne", "lt", "le", "gt", "ge")
ALIASES = {"div": "truediv", "divide": "truediv", "multiply": "mul", "subtract": "sub", "rdiv": "rtruediv"}


def key_column(i: int) -> str:
    return f"__index_{i}__"


def physical(label) -> str:
    return label if isinstance(label, str) else str(label)


def as_list(x) -> list:
    return list(x) if isinstance(x, (list, pd.Index, np.ndarray)) else [x]


def spark_type(hint) -> T.DataType:
    """The Spark type of a dtype, Python type or DDL string."""
    if isinstance(hint, T.DataType):
        return hint
    if isinstance(hint, str) and hint not in ("str", "object"):
        try:
            return T._parse_datatype_string({"int": "long", "float": "double", "bool": "boolean", "datetime64[ns]": "timestamp"}.get(hint, hint))
        except Exception:
            pass
    named = {int: "long", float: "double", str: "string", bool: "boolean", bytes: "binary", "str": "string", "object": "string"}
    if hint in named:
        return T._parse_datatype_string(named[hint])
    from pyspark.sql.pandas.types import from_arrow_type
    import pyarrow as pa

    return from_arrow_type(pa.from_numpy_dtype(np.dtype(str(pd.api.types.pandas_dtype(hint)).lower())))


class Unsupported(NotImplementedError):
    """A name of the pandas API that is known and not offered."""


#: Pandas names that are declared and not offered.
UNSUPPORTED = {
    "Frame": (
        "asfreq asof boxplot combine combine_first compare convert_dtypes corrwith cov ewm infer_objects interpolate lookup mode reorder_levels resample set_axis slice_shift to_feather to_gbq to_hdf to_period to_sql to_stata to_timestamp tshift tz_convert tz_localize to_pickle memory_usage to_xarray "
        "convert_objects select to_panel get_values compound reindex_axis blocks ftypes is_copy ix as_blocks as_matrix clip_lower clip_upper get_ftype_counts get_value set_value to_dense to_sparse to_msgpack"
    ).split(),
    "Series": (
        "asfreq autocorr combine convert_dtypes cov ewm infer_objects interpolate reorder_levels resample searchsorted set_axis slice_shift to_hdf to_period to_sql to_timestamp tshift tz_convert tz_localize view array nbytes memory_usage to_pickle to_xarray ravel real "
        "convert_objects nonzero reindex_axis select get_values blocks ftypes ftype is_copy ix asobject strides imag itemsize data base flags as_blocks as_matrix clip_lower clip_upper compress get_ftype_counts get_value set_value valid to_dense to_sparse to_msgpack compound put ptp"
    ).split(),
    "Index": (
        "nbytes argsort asof_locs format get_indexer get_indexer_for get_indexer_non_unique get_loc get_slice_bound get_value groupby is_ is_lexsorted_for_tuple join map putmask ravel reindex searchsorted slice_indexer slice_locs sortlevel to_flat_index to_native_types where is_mixed set_value array duplicated memory_usage get_values strides data itemsize base flags get_duplicates summary contains "
        "nanosecond date time timetz tz freq freqstr inferred_freq snap tz_convert tz_localize to_period to_perioddelta to_pydatetime mean std "
        "rename_categories reorder_categories add_categories remove_categories remove_unused_categories set_categories as_ordered as_unordered categories ordered "
        "equal_levels get_loc_level get_locs is_lexsorted remove_unused_levels reorder_levels set_codes set_levels truncate codes levels set_labels labels to_hierarchical"
    ).split(),
    "GroupBy": "corr corrwith cov dtype dtypes groups hist indices is_monotonic_decreasing is_monotonic_increasing mad ngroups plot quantile skew tshift boxplot ngroup nth ohlc pct_change pipe prod resample sem take".split(),
    "Rolling": "agg aggregate apply corr cov kurt median quantile skew validate exclusions is_datetimelike is_freq_type ndim".split(),
}


def only(**given) -> None:
    """Raises for a parameter whose value isn't one of those offered: name=(value, *offered)."""
    for name, (value, *offered) in given.items():
        if not any(value is x or (type(value) is type(x) and value == x) for x in offered):
            raise Unsupported(f"{name}={value!r} is not offered")


class _Named:
    """Raises for declared names that aren't offered."""

    _scope = ""

    def __getattr__(self, name):
        if name in UNSUPPORTED.get(self._scope, ()):
            raise Unsupported(f"{self._scope}.{name} is not offered")
        raise AttributeError(f"{type(self).__name__} has no attribute {name!r}")


class Frame(_Named):
    """A labelled table."""

    _scope = "Frame"

    def __init__(self, data=None, index_col=None, order=None, *, _state=None):
        if _state is None:
            _state = _wrap(data, index_col, order)
        self._s = _state

    # ---- state -------------------------------------------------------------------------------------
    @property
    def df(self) -> DataFrame:
        return self._s["df"]

    @property
    def _keys(self) -> list[str]:
        return self._s["keys"]

    @property
    def _labels(self) -> list:
        return self._s["labels"]

    @property
    def _cols(self) -> list[str]:
        return self._s["cols"]

    @property
    def _order(self) -> list[str]:
        return self._s["order"]

    @property
    def _by(self) -> list[Column]:
        return [F.asc_nulls_first(c) for c in self._order]

    def _new(self, **changes) -> "Frame":
        return Frame(_state=self._s | ({"origin": None} if "df" in changes else {}) | changes)

    def _select(self, columns: dict, df: DataFrame | None = None) -> "Frame":
        """The same rows with other data columns: label -> Column."""
        names = [physical(k) for k in columns]
        kept = list(dict.fromkeys([*self._keys, *[c for c in self._order if c not in names]]))
        hidden = {c: f"__o_{i}__" if c in names else c for i, c in enumerate(self._order)}
        df = self.df if df is None else df
        extra = [F.col(f"`{c}`").alias(h) for c, h in hidden.items() if h != c]
        out = df.select(*[F.col(f"`{k}`") for k in kept], *extra, *[c.alias(physical(k)) for k, c in columns.items()])
        origin = (self.df, dict(columns), self) if df is self.df else None
        return self._new(df=out, labels=list(columns), cols=names, order=[hidden[c] for c in self._order], origin=origin)

    def _over(self, base: "Frame") -> "Frame | None":
        """label -> series over *base*'s table, if this is that table or made from it column by column."""
        if self.df is base.df:
            return {x: self._series(x) for x in self._labels}
        table, made, _ = self._s.get("origin") or (None, {}, None)
        return {x: Series(base, c, x) for x, c in made.items()} if table is base.df else None

    def _plain(self, s: "Series") -> bool:
        """Whether *s* is a column of its own frame as it stands."""
        return repr(s.col) == repr(F.col(f"`{physical(s.name)}`"))

    def _rows(self, df: DataFrame) -> "Frame":
        """The same columns over other rows."""
        return self._new(df=df)

    def _where_label(self, label) -> str:
        if label in self._labels:
            return self._cols[self._labels.index(label)]
        raise KeyError(label)

    def _series(self, label) -> "Series":
        return Series(self._new(), F.col(f"`{self._where_label(label)}`"), label)  # a series keeps the state it was taken from

    def _each(self, only=None) -> list["Series"]:
        return [s for s in map(self._series, self._labels) if only is None or only(s.kind)]

    def _map(self, f: Callable, only=None) -> "Frame":
        return self._select({s.name: f(s) for s in self._each(only)})

    # ---- access ------------------------------------------------------------------------------------
    @property
    def columns(self) -> pd.Index:
        return pd.MultiIndex.from_tuples(self._labels) if self._labels and all(isinstance(x, tuple) for x in self._labels) else pd.Index(self._labels)

    @columns.setter
    def columns(self, labels) -> None:
        labels = list(labels)
        if len(labels) != len(self._labels):
            raise ValueError(f"{len(self._labels)} labels are needed")
        self._s = self._select({n: F.col(f"`{c}`") for n, c in zip(labels, self._cols)})._s

    def keys(self):
        return self.columns

    def __dir__(self):
        return [*super().__dir__(), *[x for x in self._labels if isinstance(x, str) and x.isidentifier()]]

    def __getattr__(self, name):
        if name.startswith("_"):
            raise AttributeError(name)
        if name in self._labels:
            return self._series(name)
        return super().__getattr__(name)

    def __getitem__(self, key):
        if isinstance(key, Series):
            return self._filter(key)
        if isinstance(key, slice):
            return self.iloc[key] if isinstance(key.start, int) or isinstance(key.stop, int) else self.loc[key]
        if isinstance(key, (list, pd.Index, np.ndarray)):
            return self._new(labels=list(key), cols=[self._where_label(k) for k in key])  # the same table, so operands still fit
        if key not in self._labels and any(isinstance(x, tuple) and x[0] == key for x in self._labels):
            inner = {x[1:] if len(x) > 2 else x[1]: F.col(f"`{self._where_label(x)}`") for x in self._labels if isinstance(x, tuple) and x[0] == key}
            return self._select(inner)
        return self._series(key)

    def __setitem__(self, key, value) -> None:
        self._s = self._assigned(dict(zip(key, value)) if isinstance(key, list) else {key: value})._s

    def get(self, key, default=None):
        try:
            return self[key]
        except KeyError:
            return default

    def pop(self, item) -> "Series":
        out = self[item]
        self._s = self.drop(columns=[item])._s
        return out

    def insert(self, loc: int, column, value, allow_duplicates: bool = False) -> None:
        if column in self._labels and not allow_duplicates:
            raise ValueError(f"cannot insert {column}, already exists")
        made = self._assigned({column: value})
        labels = [x for x in made._labels if x != column]
        labels.insert(loc, column)
        self._s = made[labels]._s

    def _assigned(self, new: dict) -> "Frame":
        """Columns added or replaced; series of other tables join on the index, all in one go."""
        new = {k: v(self) if callable(v) and not isinstance(v, (Series, Column)) else v for k, v in new.items()}
        for k, v in new.items():  # a column of a table that is made from this one column by column
            if isinstance(v, Series) and v._frame.df is not self.df and (here := (v._frame._over(self) or {}).get(v.name)) is not None and self._plain(v):
                new[k] = here
        foreign = {k: v for k, v in new.items() if isinstance(v, Series) and v._frame.df is not self.df}
        table, made, source = self._s.get("origin") or (None, {}, None)
        made = {x: made[x] for x in self._labels} if all(x in made for x in self._labels) else None
        if foreign and len(foreign) == len(new) and made is not None:  # are both columns of the table that this one is made from?
            of = lambda v: v.col if v._frame.df is table else (v._frame._over(source) or {}).get(v.name) if self._plain(v) else None
            found = {k: of(v) for k, v in foreign.items()}
            if all(v is not None for v in found.values()):
                return source._select(made | {k: v.col if isinstance(v, Series) else v for k, v in found.items()})
        frame = _windowed(self, list(foreign.values())) if foreign else None
        if frame is not None:  # windows over the rows of one table: computed together, nothing to join
            made = made if made is not None and self.df is not frame[0] else {x: F.col(f"`{c}`") for x, c in zip(self._labels, self._cols)}
            rest = {k: v.col if isinstance(v, (Series)) else v if isinstance(v, Column) else F.lit(v) for k, v in new.items()}
            return frame[1]._select(made | rest)
        frame, found = _aligned(self, list(foreign.values()), "left") if foreign else (self, [])
        new |= dict(zip(foreign, found))
        cols = {k: v.col if isinstance(v, Series) else v if isinstance(v, Column) else F.lit(v) for k, v in new.items()}
        base = {k: F.col(f"`{frame._where_label(k)}`") for k in frame._labels}
        return frame._select(base | cols)

    def assign(self, **new) -> "Frame":
        """Functions see the columns given before them."""
        frame, ready = self, {}
        for k, v in new.items():
            if callable(v) and not isinstance(v, (Series, Column)):
                frame, ready = frame._assigned(ready)._assigned({k: v}) if ready else frame._assigned({k: v}), {}
            else:
                ready[k] = v
        return frame._assigned(ready) if ready else frame

    def drop(self, labels=None, axis=1, columns=None, index=None) -> "Frame":
        if index is not None or axis in (0, "index") and labels is not None:
            return self._filter(~self.index.isin(as_list(index if index is not None else labels)))
        gone = as_list(columns if columns is not None else labels)
        for x in gone:
            if x not in self._labels and not any(isinstance(y, tuple) and y[0] == x for y in self._labels):
                raise KeyError(x)
        return self[[x for x in self._labels if x not in gone and not (isinstance(x, tuple) and x[0] in gone)]]

    def filter(self, items=None, like=None, regex=None, axis=None) -> "Frame":
        import re

        if sum(x is not None for x in (items, like, regex)) != 1:
            raise TypeError("give exactly one of items, like, regex")
        if axis in (0, "index"):
            c = F.col(self._keys[0]).cast("string")
            test = F.col(self._keys[0]).isin(list(items)) if items is not None else c.contains(like) if like is not None else c.rlike(regex)
            return self._rows(self.df.where(test))
        keep = (lambda x: x in set(items)) if items is not None else (lambda x: like in physical(x)) if like is not None else (lambda x: re.search(regex, physical(x)))
        return self[[x for x in self._labels if keep(x)]]

    def select_dtypes(self, include=None, exclude=None) -> "Frame":
        groups = {"number": lambda k: isinstance(k, T.NumericType), "object": lambda k: isinstance(k, T.StringType), "bool": lambda k: isinstance(k, T.BooleanType), "datetime": lambda k: isinstance(k, (T.TimestampType, T.TimestampNTZType))}
        hits = lambda kind, xs: any(groups[x](kind) if isinstance(x, str) and x in groups else kind == spark_type(x) for x in as_list(xs))
        return self[[s.name for s in self._each() if (include is None or hits(s.kind, include)) and (exclude is None or not hits(s.kind, exclude))]]

    def rename(self, mapper=None, index=None, columns=None, axis="index", inplace=False, level=None, errors="ignore"):
        if mapper is not None:
            index, columns = (mapper, columns) if axis in (0, "index") else (index, mapper)
        out = self
        if columns is not None:
            if isinstance(columns, dict) and errors == "raise" and set(columns) - set(self._labels):
                raise KeyError(set(columns) - set(self._labels))
            to = columns if callable(columns) else lambda x: columns.get(x, x)
            out = out._select({to(x): F.col(f"`{c}`") for x, c in zip(out._labels, out._cols)})
        if index is not None:
            if not isinstance(index, dict):
                raise Unsupported("rename maps index values by a dict")
            key = out._keys[level or 0]
            pairs = F.create_map(*[F.lit(x) for kv in index.items() for x in kv])
            out = out._rows(out.df.withColumn(key, F.coalesce(pairs[F.col(key)], F.col(key))))
        return self._into(out, inplace)

    def _into(self, out: "Frame", inplace: bool):
        if not inplace:
            return out
        self._s = out._s

    def add_prefix(self, prefix: str) -> "Frame":
        return self.rename(columns=lambda x: prefix + physical(x))

    def add_suffix(self, suffix: str) -> "Frame":
        return self.rename(columns=lambda x: physical(x) + suffix)

    def rename_axis(self, mapper=None, index=None, columns=None, axis=0, inplace=False):
        only(axis=(axis, 0, "index"), columns=(columns, None))
        names = mapper if mapper is not None else index
        names = [names] if not isinstance(names, (list, tuple, dict)) else names
        if isinstance(names, dict):
            names = [names.get(x, x) for x in self._s["names"]]
        return self._into(self._new(names=list(names)), inplace)

    @property
    def dtypes(self) -> pd.Series:
        return pd.Series([s.dtype for s in self._each()], index=self.columns, dtype=object)

    @property
    def shape(self):
        return len(self), len(self._labels)

    def __len__(self):
        return self.df.count()

    def __iter__(self):
        return iter(self._labels)

    def __bool__(self):
        raise ValueError("the truth value of a table is ambiguous")

    ndim = 2

    @property
    def size(self):
        return len(self) * len(self._labels)

    @property
    def empty(self):
        return not self._labels or self.df.isEmpty()

    @property
    def axes(self):
        return [self.index, self.columns]

    def copy(self, deep=None) -> "Frame":
        return self._new()

    @staticmethod
    def from_dict(data, orient="columns", dtype=None, columns=None) -> "Frame":
        return from_pandas(pd.DataFrame.from_dict(data, orient, dtype, columns))

    @staticmethod
    def from_records(data, index=None, exclude=None, columns=None, coerce_float=False, nrows=None) -> "Frame":
        return from_pandas(pd.DataFrame.from_records(data, index, exclude, columns, coerce_float, nrows))

    def bool(self) -> bool:
        rows = self.df.select(*[F.col(f"`{c}`") for c in self._cols]).take(2)
        if len(rows) != 1 or len(self._cols) != 1 or not isinstance(rows[0][0], (bool, np.bool_)):
            raise ValueError("only a table of one boolean has a truth value")
        return rows[0][0]

    def get_dtype_counts(self) -> pd.Series:
        return self.dtypes.map(str).value_counts()

    def spark_schema(self, index_col=None):
        return self.to_spark(index_col).schema

    def print_schema(self, index_col=None) -> None:
        self.to_spark(index_col).printSchema()

    def __array_ufunc__(self, ufunc, method, *inputs, **kwargs):
        """By column; another frame is taken label by label."""
        if method != "__call__" or kwargs:
            return NotImplemented
        over = [x._over(self) or dict(x.items()) if isinstance(x, Frame) else None for x in inputs]
        return self._map(lambda s: ufunc(*[o[s.name] if o is not None else x for o, x in zip(over, inputs)]).col)

    def pipe(self, func, *args, **kwargs):
        if isinstance(func, tuple):
            func, target = func
            return func(*args, **kwargs, **{target: self})
        return func(self, *args, **kwargs)

    def squeeze(self, axis=None):
        only(axis=(axis, None, 1, "columns"))
        return self[self._labels[0]].squeeze() if len(self._labels) == 1 else self

    def items(self):
        return ((x, self._series(x)) for x in self._labels)

    iteritems = items

    def iterrows(self):
        for r in self._local():
            yield self._key_of(r), pd.Series([r[c] for c in self._cols], index=self.columns)

    def itertuples(self, index=True, name="Row"):
        from collections import namedtuple

        kind = namedtuple(name, ["Index", *map(physical, self._labels)] if index else list(map(physical, self._labels)), rename=True)
        for r in self._local():
            yield kind(*([self._key_of(r)] if index else []), *[r[c] for c in self._cols])

    def _local(self):
        return self.df.orderBy(*self._by).select(*self._keys, *[F.col(f"`{c}`") for c in self._cols]).toLocalIterator()

    def _key_of(self, r):
        return r[self._keys[0]] if len(self._keys) == 1 else tuple(r[k] for k in self._keys)

    # ---- export ------------------------------------------------------------------------------------
    def to_spark(self, index_col=None) -> DataFrame:
        """The data columns; with *index_col*, the index columns under these names first."""
        names = [] if index_col is None else as_list(index_col)
        if names and len(names) != len(self._keys):
            raise ValueError(f"{len(self._keys)} index names are needed")
        return self.df.select(*[F.col(k).alias(n) for k, n in zip(self._keys, names)], *[F.col(f"`{c}`").alias(physical(x)) for x, c in zip(self._labels, self._cols)])

    def to_pandas(self) -> pd.DataFrame:
        rows = self.df.orderBy(*self._by).select(*self._keys, *[F.col(f"`{c}`") for c in self._cols]).toPandas()
        rows = rows.set_index(self._keys)
        rows.index.names, rows.columns = self._s["names"], self.columns
        return rows

    toPandas = to_pandas

    def to_numpy(self):
        return self.to_pandas().to_numpy()

    values = property(to_numpy)

    def __repr__(self):
        n = get_option("display.max_rows")
        head = self.head(n + 1).to_pandas()
        return repr(head.iloc[:n]) + (f"\n\nShowing only the first {n} rows" if len(head) > n else "")

    def _repr_html_(self):
        return self.head(get_option("display.max_rows")).to_pandas()._repr_html_()

    def info(self, verbose=None, buf=None, max_cols=None, null_counts=None):
        counts = self.count().to_pandas()
        print(f"{type(self).__name__}: {len(self)} rows\n" + "\n".join(f"{x}  {counts[x]} valid  {s.dtype}" for x, s in self.items()), file=buf)

    @property
    def style(self):
        return self.head(get_option("compute.max_rows")).to_pandas().style

    # ---- index -------------------------------------------------------------------------------------
    @property
    def index(self) -> "Index":
        return Index(self, [F.col(k) for k in self._keys], self._s["names"])

    def set_index(self, keys, drop=True, append=False, inplace=False):
        keys = as_list(keys)
        cols = [F.col(f"`{self._where_label(k)}`") for k in keys]
        old = [F.col(k) for k in self._keys] if append else []
        names = (self._s["names"] if append else []) + keys
        rest = [x for x in self._labels if not (drop and x in keys)]
        order = {c: f"__o_{i}__" for i, c in enumerate(self._order)}
        df = self.df.select(*[c.alias(key_column(i)) for i, c in enumerate(old + cols)], *[F.col(f"`{c}`").alias(o) for c, o in order.items()], *[F.col(f"`{self._where_label(x)}`") for x in rest])
        return self._into(Frame(_state={"df": df, "keys": [key_column(i) for i in range(len(names))], "names": names, "labels": rest, "cols": [self._where_label(x) for x in rest], "order": list(order.values())}), inplace)

    def reset_index(self, level=None, drop=False, inplace=False, col_level=0, col_fill=""):
        which = range(len(self._keys)) if level is None else [self._s["names"].index(x) if x in self._s["names"] else x for x in as_list(level)]
        moved = {}
        if not drop:
            for i in which:
                name = self._s["names"][i]
                moved[("index" if len(self._keys) == 1 else f"level_{i}") if name is None else name] = F.col(self._keys[i])
        data = moved | {x: F.col(f"`{c}`") for x, c in zip(self._labels, self._cols)}
        left = [i for i in range(len(self._keys)) if i not in which]
        out = self._select(data)
        if left:
            out = out._new(keys=[self._keys[i] for i in left], names=[self._s["names"][i] for i in left])
        else:
            out = _default_index(out)
        return self._into(out, inplace)

    def droplevel(self, level, axis=0) -> "Frame":
        only(axis=(axis, 0, "index"))
        gone = {self._s["names"].index(x) if x in self._s["names"] else x for x in as_list(level)}
        left = [i for i in range(len(self._keys)) if i not in gone]
        return self._new(keys=[self._keys[i] for i in left], names=[self._s["names"][i] for i in left])

    def swaplevel(self, i=-2, j=-1, axis=0) -> "Frame":
        only(axis=(axis, 0, "index"))
        keys, names = list(self._keys), list(self._s["names"])
        i, j = (names.index(x) if x in names else x for x in (i, j))
        keys[i], keys[j], names[i], names[j] = keys[j], keys[i], names[j], names[i]
        return self._new(keys=keys, names=names)

    # ---- rows --------------------------------------------------------------------------------------
    def _filter(self, test: "Series") -> "Frame":
        frame = self
        if test._frame.df is not self.df:
            frame, (test,) = _aligned(self, [test], "left")
        return frame._rows(frame.df.where(F.coalesce(test.col.cast("boolean"), F.lit(False))))

    def query(self, expr: str, inplace=False):
        return self._into(self._rows(self.df.where(F.expr(expr.replace("==", "=").replace("&&", " and ")))), inplace)

    def eval(self, expr: str, inplace=False):
        out = self
        for line in filter(None, (x.strip() for x in expr.split("\n"))):
            name, eq, body = line.partition("=")
            if eq and not body.startswith("=") and name.strip().isidentifier():
                out = out._assigned({name.strip(): F.expr(body)})
            else:
                return Series(out, F.expr(line), None)
        return self._into(out, inplace)

    def where(self, cond, other=np.nan) -> "Frame":
        return self._masked(cond, other, True)

    def mask(self, cond, other=np.nan) -> "Frame":
        return self._masked(cond, other, False)

    def _masked(self, cond, other, keep: bool) -> "Frame":
        found = {id(x): x._over(self) or dict(x.items()) for x in (cond, other) if isinstance(x, Frame)}
        pick = lambda x, s: found[id(x)][s.name] if isinstance(x, Frame) else x
        return self._map(lambda s: (s.where if keep else s.mask)(pick(cond, s), pick(other, s)).col)

    def isin(self, values) -> "Frame":
        return self._map(lambda s: (s.isin(values.get(s.name, [])) if isinstance(values, dict) else s.isin(values)).col)

    def isna(self) -> "Frame":
        return self._map(lambda s: s.isna().col)

    isnull = isna

    def notna(self) -> "Frame":
        return self._map(lambda s: s.notna().col)

    notnull = notna

    def head(self, n: int = 5) -> "Frame":
        if n < 0:
            n = max(0, len(self) + n)
        return self._rows(self.df.orderBy(*self._by).limit(n))

    def tail(self, n: int = 5) -> "Frame":
        if n < 0:
            n = max(0, len(self) + n)
        return self._rows(self.df.orderBy(*[F.desc_nulls_last(c) for c in self._order]).limit(n))

    def take(self, indices, axis=0) -> "Frame":
        return self[[self._labels[i] for i in indices]] if axis in (1, "columns") else self.iloc[list(indices)]

    def sample(self, n=None, frac=None, replace=False, random_state=None, ignore_index=False) -> "Frame":
        if n is not None:
            raise Unsupported("sample takes a fraction")
        out = self._rows(self.df.sample(withReplacement=replace, fraction=frac, seed=random_state))
        return out.reset_index(drop=True) if ignore_index else out

    def truncate(self, before=None, after=None, axis=None, copy=True) -> "Frame":
        if axis in (1, "columns"):
            return self[[x for x in self._labels if (before is None or x >= before) and (after is None or x <= after)]]
        return self.loc[before:after]

    def xs(self, key, axis=0, level=None) -> "Frame":
        only(axis=(axis, 0, "index"))
        key = key if isinstance(key, tuple) else (key,)
        at = [self._s["names"].index(x) if x in self._s["names"] else x for x in as_list(level)] if level is not None else list(range(len(key)))
        test = fold(operator.and_, [F.col(self._keys[i]) == k for i, k in zip(at, key)])
        left = [i for i in range(len(self._keys)) if i not in at] or list(range(len(self._keys)))
        return self._rows(self.df.where(test))._new(keys=[self._keys[i] for i in left], names=[self._s["names"][i] for i in left])

    def between_time(self, start_time, end_time, include_start=True, include_end=True, axis=0) -> "Frame":
        only(axis=(axis, 0, "index"))
        clock = F.date_format(F.col(self._keys[0]), "HH:mm:ss.SSSSSS")
        a, b = (str(pd.Timestamp(str(x)).time().isoformat("microseconds")) for x in (start_time, end_time))
        low, high = (clock >= a if include_start else clock > a), (clock <= b if include_end else clock < b)
        return self._rows(self.df.where(low & high if a <= b else low | high))

    def at_time(self, time, asof=False, axis=0) -> "Frame":
        only(asof=(asof, False))
        return self.between_time(time, time, axis=axis)

    def first(self, offset) -> "Frame":
        start = self.df.agg(F.min(self._keys[0])).first()[0]
        return self._rows(self.df.where(F.col(self._keys[0]) < F.lit(pd.Timestamp(start) + pd.tseries.frequencies.to_offset(offset))))

    def last(self, offset) -> "Frame":
        end = self.df.agg(F.max(self._keys[0])).first()[0]
        return self._rows(self.df.where(F.col(self._keys[0]) > F.lit(pd.Timestamp(end) - pd.tseries.frequencies.to_offset(offset))))

    def first_valid_index(self):
        return self._edge_index(self.df.orderBy(*self._by))

    def last_valid_index(self):
        return self._edge_index(self.df.orderBy(*[F.desc_nulls_last(c) for c in self._order]))

    def _edge_index(self, rows):
        some = fold(operator.or_, [~S.missing(s.col, s.kind) for s in self._each()])
        r = rows.where(some).select(*self._keys).first()
        return None if r is None else r[0] if len(r) == 1 else tuple(r)

    @property
    def loc(self):
        return _Loc(self)

    @property
    def iloc(self):
        return _ILoc(self)

    @property
    def at(self):
        return _At(self)

    @property
    def iat(self):
        return _IAt(self)

    # ---- sort --------------------------------------------------------------------------------------
    def sort_values(self, by, ascending=True, inplace=False, na_position="last", ignore_index=False):
        by, up = as_list(by), as_list(ascending)
        up = up * len(by) if len(up) == 1 else up
        out = self._sorted([S.valid(self._series(x).col, self._series(x).kind) for x in by], up, na_position)
        return self._into(out.reset_index(drop=True) if ignore_index else out, inplace)

    def sort_index(self, axis=0, level=None, ascending=True, inplace=False, kind=None, na_position="last"):
        if axis in (1, "columns"):
            return self._into(self[sorted(self._labels, reverse=not ascending)], inplace)
        at = range(len(self._keys)) if level is None else [self._s["names"].index(x) if x in self._s["names"] else x for x in as_list(level)]
        up = as_list(ascending)
        return self._into(self._sorted([F.col(self._keys[i]) for i in at], up * len(at) if len(up) == 1 else up, na_position), inplace)

    def _sorted(self, cols, up, na_position):
        """Sorted rows take new row ids; ties keep their order."""
        to = {(True, "last"): Column.asc_nulls_last, (True, "first"): Column.asc_nulls_first, (False, "last"): Column.desc_nulls_last, (False, "first"): Column.desc_nulls_first}
        return self._renumbered(self.df.orderBy(*[to[bool(a), na_position](c) for c, a in zip(cols, up)], *self._by))

    def _renumbered(self, rows: DataFrame) -> "Frame":
        rows = rows.drop(*[c for c in self._order if c not in self._cols and c not in self._keys]).withColumn(ROW, F.monotonically_increasing_id())
        return self._new(df=rows, order=[ROW])

    def nlargest(self, n, columns) -> "Frame":
        return self._top(n, columns, False)

    def nsmallest(self, n, columns) -> "Frame":
        return self._top(n, columns, True)

    def _top(self, n, columns, up):
        cols = [self._series(x).col for x in as_list(columns)]
        rows = self.df.where(fold(operator.and_, [c.isNotNull() for c in cols])).orderBy(*[c.asc() if up else c.desc() for c in cols], *self._by).limit(n)
        return self._renumbered(rows)

    # ---- aggregates --------------------------------------------------------------------------------
    def _reduced(self, name: str, numeric_only=None, axis=0, **options) -> "Series":
        """One aggregate job; the result has a row for each column, or with axis=1 one for each row."""
        if axis in (1, "columns"):
            kept = self._each(None if name == "count" and not numeric_only else S.numeric)
            return Series(self, across(name, [(s.col, s.kind) for s in kept], **options), None)
        kept = self._each(S.numeric if name in NUMERIC or numeric_only else None)
        if name in ("median", "quantile") and not options.get("accuracy") and options.get("skipna", True):
            got = self._quantiles([options.get("q", 0.5)], kept)
            return Series.of(pd.Series([v[0] for v in got], index=[s.name for s in kept], dtype=float))
        row = self.df.agg(*[reduce(name, s.col, s.kind, **options).alias(f"c{i}") for i, s in enumerate(kept)]).first() if kept else []
        return Series.of(pd.Series(list(row), index=[s.name for s in kept]))

    def _quantiles(self, qs: list, kept: list["Series"]) -> list[list]:
        """The exact quantiles of each series."""
        rows = quantiles(self.df, [], [S.valid(s.col.cast("long") if isinstance(s.kind, T.BooleanType) else s.col, s.kind) for s in kept], qs).collect() if kept else []  # a row for each
        found = {r.i: r.q for r in rows}
        return [found.get(i, [None] * len(qs)) for i in range(len(kept))]

    def quantile(self, q=0.5, axis=0, numeric_only=True, accuracy=None):
        only(axis=(axis, 0, "index"), numeric_only=(numeric_only, True))
        if not isinstance(q, (list, tuple)):
            return self._reduced("quantile", q=q, accuracy=accuracy)
        kept = self._each(S.numeric)
        if accuracy is None:
            row = self._quantiles(list(q), kept)
        else:
            row = self.df.agg(*[reduce("quantile", s.col, s.kind, q=list(q), accuracy=accuracy).alias(f"c{i}") for i, s in enumerate(kept)]).first()
        return from_pandas(pd.DataFrame({s.name: v for s, v in zip(kept, row)}, index=list(q)))

    def mad(self, axis=0):
        if axis in (1, "columns"):
            return self._reduced("mad", axis=1)
        kept = self._each(S.numeric)
        means = self.df.agg(*[reduce("mean", s.col, s.kind) for s in kept]).first()
        row = self.df.agg(*[F.avg(F.abs(s.col - F.lit(m))) for s, m in zip(kept, means)]).first()
        return Series.of(pd.Series(list(row), index=[s.name for s in kept]))

    def nunique(self, axis=0, dropna=True, approx=False, rsd=0.05):
        only(axis=(axis, 0, "index"))
        return self._reduced("nunique", dropna=dropna, approx=approx, rsd=rsd)

    def agg(self, func) -> "Frame":
        """By names: a list, or a dict of label -> name or names. One job for all of them."""
        if isinstance(func, str):
            return getattr(self, func)()
        wanted = {k: as_list(v) for k, v in func.items()} if isinstance(func, dict) else {x: as_list(func) for x in self._labels}
        pairs = [(k, f) for k, fs in wanted.items() for f in fs]
        row = self.df.agg(*[reduce(f, self._series(k).col, self._series(k).kind).alias(f"c{i}") for i, (k, f) in enumerate(pairs)]).first()
        if isinstance(func, dict) and not any(isinstance(v, list) for v in func.values()):
            return Series.of(pd.Series(list(row), index=[k for k, _ in pairs]))
        table = {}
        for (k, f), v in zip(pairs, row):
            table.setdefault(k, {})[f] = v
        return from_pandas(pd.DataFrame(table).reindex(list(dict.fromkeys(f for _, f in pairs))))

    aggregate = agg

    def describe(self, percentiles=None) -> "Frame":
        marks = sorted({0.5, *(percentiles if percentiles is not None else (0.25, 0.5, 0.75))})
        kept, rows = self._each(lambda k: isinstance(k, T.NumericType)), ["count", "mean", "std", "min"]
        if not kept:
            raise ValueError("there is no numeric column to describe")
        cols = [F.struct(*[reduce(f, s.col, s.kind).cast("double").alias(f) for f in (*rows, "max")]).alias(f"c{i}") for i, s in enumerate(kept)]
        got, at = self.df.agg(*cols).first(), self._quantiles(marks, kept)
        names = [*rows, *[f"{100 * q:g}%" for q in marks], "max"]
        return from_pandas(pd.DataFrame({s.name: [*[r[f] for f in rows], *q, r["max"]] for s, r, q in zip(kept, got, at)}, index=names))

    def corr(self, method="pearson") -> "Frame":
        kept = self._each(S.numeric)
        if method == "spearman":
            return self[[s.name for s in kept]].rank()._pairwise()
        return self[[s.name for s in kept]]._pairwise()

    def _pairwise(self) -> "Frame":
        kept, n = self._each(), len(self._labels)
        xs = [S.valid(s.col, s.kind).cast("double") for s in kept]
        row = self.df.agg(*[F.corr(xs[i], xs[j]) for i in range(n) for j in range(i)] or [F.lit(0)]).first()
        out, at = np.eye(n), 0
        for i in range(n):
            for j in range(i):
                out[i, j] = out[j, i] = np.nan if row[at] is None else row[at]
                at += 1
        return from_pandas(pd.DataFrame(out, index=self._labels, columns=self._labels))

    def idxmax(self, axis=0):
        only(axis=(axis, 0, "index"))
        return self._extreme(F.max_by, True)

    def idxmin(self, axis=0):
        only(axis=(axis, 0, "index"))
        return self._extreme(F.min_by, False)

    def _extreme(self, by, largest):
        kept = self._each(S.numeric)
        row = self.df.agg(*[_edge(s, by, largest) for s in kept]).first()
        return Series.of(pd.Series(list(row), index=[s.name for s in kept]))

    def abs(self) -> "Frame":
        return self._map(lambda s: F.abs(s.col), S.numeric)

    def round(self, decimals=0) -> "Frame":
        at = lambda s: decimals.get(s.name) if isinstance(decimals, dict) else decimals
        return self._map(lambda s: s.round(at(s)).col if isinstance(s.kind, T.NumericType) and at(s) is not None else s.col)

    def astype(self, dtype) -> "Frame":
        to = lambda s: dtype.get(s.name) if isinstance(dtype, dict) else dtype
        return self._map(lambda s: s.astype(to(s)).col if to(s) is not None else s.col)

    def applymap(self, func) -> "Frame":
        out = self
        for s in self._each():
            out = out._assigned({s.name: Series(out, out._series(s.name).apply(func).col, s.name)})
        return out

    def clip(self, lower=None, upper=None) -> "Frame":
        return self._map(lambda s: s.clip(lower, upper).col if S.numeric(s.kind) else s.col)

    def dot(self, other):
        if isinstance(other, Series):  # only the values at this table's labels are fetched
            frame = other.to_frame()
            other = Series(frame._rows(frame.df.where(F.col(frame._keys[0]).isin(self._labels))), F.col(f"`{frame._cols[0]}`"), other.name).to_pandas()
        weights = other[self._labels]
        return Series(self, fold(operator.add, [s.col * F.lit(float(w)) for s, w in zip(self._each(), weights)]), None)

    __matmul__ = dot

    # ---- missing -----------------------------------------------------------------------------------
    def fillna(self, value=None, method=None, axis=None, inplace=False, limit=None):
        only(axis=(axis, None, 0, "index"), limit=(limit if method is None else None, None))
        if method is not None:
            return self._into({"ffill": self.ffill, "pad": self.ffill, "bfill": self.bfill, "backfill": self.bfill}[method](limit=limit), inplace)
        pick = lambda s: value.get(s.name) if isinstance(value, dict) else value
        return self._into(self._map(lambda s: s.fillna(pick(s)).col if pick(s) is not None and _fits(pick(s), s.kind) else s.col), inplace)

    def dropna(self, axis=0, how="any", thresh=None, subset=None, inplace=False):
        kept = [self._series(x) for x in (as_list(subset) if subset is not None else self._labels)]
        there = fold(operator.add, [(~S.missing(s.col, s.kind)).cast("int") for s in kept])
        least = thresh if thresh is not None else len(kept) if how == "any" else 1
        if axis in (1, "columns"):
            n, row = len(self), self.df.agg(*[F.count(S.valid(s.col, s.kind)) for s in self._each()]).first()
            bar = thresh if thresh is not None else n if how == "any" else 1
            return self._into(self[[x for x, v in zip(self._labels, row) if v >= bar]], inplace)
        return self._into(self._rows(self.df.where(there >= least)), inplace)

    def replace(self, to_replace=None, value=None, inplace=False, limit=None, regex=False, method="pad"):
        only(limit=(limit, None), method=(method, "pad"))
        per = isinstance(to_replace, dict) and any(k in self._labels for k in to_replace) and (value is not None or any(isinstance(v, dict) for v in to_replace.values()))
        one = lambda s: s.replace(to_replace[s.name], value, regex=regex) if per and s.name in to_replace else s if per else s.replace(to_replace, value, regex=regex)
        return self._into(self._map(lambda s: one(s).col), inplace)

    # ---- duplicates --------------------------------------------------------------------------------
    def duplicated(self, subset=None, keep="first") -> "Series":
        cols = [F.col(f"`{self._where_label(x)}`") for x in (as_list(subset) if subset is not None else self._labels)]
        if keep is False:
            test = F.count(F.lit(1)).over(Window.partitionBy(*cols)) > 1
        else:
            by = self._by if keep == "first" else [F.desc_nulls_last(c) for c in self._order]
            test = F.row_number().over(Window.partitionBy(*cols).orderBy(*by)) > 1
        return Series(self._rows(self.df.withColumn("__dup__", test)), F.col("__dup__"), None)

    def drop_duplicates(self, subset=None, keep="first", inplace=False):
        dup = self.duplicated(subset, keep)
        return self._into(self._rows(dup._frame.df.where(~F.col("__dup__")).drop("__dup__")), inplace)

    def equals(self, other) -> bool:
        return isinstance(other, Frame) and self._labels == other._labels and self.to_pandas().equals(other.to_pandas())

    def append(self, other, ignore_index=False, verify_integrity=False, sort=False) -> "Frame":
        from .api import concat

        only(sort=(sort, False))
        if verify_integrity and not ignore_index and not self.index.intersection(other.index).empty:
            raise ValueError("both tables have a row of the same index")
        return concat([self, other], ignore_index=ignore_index)

    # ---- windows -----------------------------------------------------------------------------------
    def rolling(self, window, min_periods=None):
        return Rolling(self, [], window, min_periods)

    def expanding(self, min_periods=1):
        return Rolling(self, [], None, min_periods)

    # ---- groups, joins, reshaping ------------------------------------------------------------------
    def groupby(self, by, axis=0, as_index=True, dropna=True) -> "GroupBy":
        from .groupby import GroupBy

        only(axis=(axis, 0, "index"))
        return GroupBy(self, by, as_index, dropna)

    def merge(self, right, how="inner", on=None, left_on=None, right_on=None, left_index=False, right_index=False, suffixes=("_x", "_y")):
        from .operators.joins import merge

        return merge(self, right, how, on, left_on, right_on, left_index, right_index, suffixes)

    def join(self, right, on=None, how="left", lsuffix="", rsuffix=""):
        from .operators.joins import merge

        right = right.to_frame() if isinstance(right, Series) else right
        if on is not None:
            return merge(self, right, how, left_on=on, right_index=True, suffixes=(lsuffix, rsuffix))
        return merge(self, right, how, left_index=True, right_index=True, suffixes=(lsuffix, rsuffix))

    def hint(self, name, *parameters) -> "Frame":
        return self._rows(self.df.hint(name, *parameters))

    def update(self, other, join="left", overwrite=True) -> None:
        only(join=(join, "left"))
        other = other.to_frame() if isinstance(other, Series) else other
        shared = [x for x in self._labels if x in other._labels]
        frame, found = _aligned(self, [other[x] for x in shared], "left")
        data = {x: F.col(f"`{frame._where_label(x)}`") for x in frame._labels}
        for x, s in zip(shared, found):
            new = S.valid(s.col, s.kind)
            data[x] = F.coalesce(new, data[x]) if overwrite else F.coalesce(data[x], new)
        self._s = frame._select(data)._s

    def combine_first(self, other) -> "Frame":
        from .operators.joins import combine_first

        return combine_first(self, other)

    def align(self, other, join="outer", axis=None, copy=True):
        from .operators.joins import align

        return align(self, other, join, axis)

    def reindex(self, labels=None, index=None, columns=None, axis=None, copy=True, fill_value=None) -> "Frame":
        if labels is not None:
            index, columns = (labels, columns) if axis in (None, 0, "index") else (index, labels)
        out = self
        if index is not None:
            values = index.to_pandas() if isinstance(index, Index) else pd.Index(index)
            wanted = from_pandas(pd.DataFrame(index=values))
            cols = wanted.df.select(F.col(key_column(0)).alias("__want__"), F.col(wanted._order[0]).alias("__wrow__"))
            rows = cols.join(self.df, F.col("__want__").eqNullSafe(F.col(self._keys[0])), "left")
            data = {x: (F.when(F.col(self._keys[0]).isNull(), F.lit(fill_value).cast(self.df.schema[c].dataType)).otherwise(F.col(f"`{c}`")) if fill_value is not None else F.col(f"`{c}`")) for x, c in zip(self._labels, self._cols)}
            rows = rows.select(F.col("__want__").alias(key_column(0)), F.col("__wrow__").alias(ROW), *[v.alias(physical(k)) for k, v in data.items()])
            out = self._new(df=rows, keys=[key_column(0)], cols=[physical(x) for x in self._labels], order=[ROW])
        if columns is not None:
            fill = F.lit(fill_value)
            out = out._select({x: F.col(f"`{out._where_label(x)}`") if x in out._labels else fill for x in columns})
        return out

    def reindex_like(self, other, copy=True) -> "Frame":
        return self.reindex(index=other.index, columns=other._labels)

    def melt(self, id_vars=None, value_vars=None, var_name="variable", value_name="value"):
        from .operators.reshape import melt

        return melt(self, id_vars, value_vars, var_name, value_name)

    def pivot_table(self, values=None, index=None, columns=None, aggfunc="mean", fill_value=None):
        from .operators.reshape import pivot_table

        return pivot_table(self, values, index, columns, aggfunc, fill_value)

    def pivot(self, index=None, columns=None, values=None):
        return self.pivot_table(values, index, columns, "first")

    def stack(self):
        from .operators.reshape import stack

        return stack(self)

    def unstack(self):
        from .operators.reshape import unstack_frame

        return unstack_frame(self)

    def explode(self, column) -> "Frame":
        c = self._where_label(column)
        return self._select({x: F.explode_outer(F.col(f"`{c}`")) if x == column else F.col(f"`{p}`") for x, p in zip(self._labels, self._cols)})

    def transpose(self) -> "Frame":
        """For tables of at most compute.max_rows rows, whose index becomes the labels."""
        n = get_option("compute.max_rows")
        rows = self.head(n + 1).to_pandas()
        if len(rows) > n:
            raise ValueError(f"a transposed table has a column for each row; at most compute.max_rows = {n} are taken")
        return from_pandas(rows.T)

    T = property(transpose)

    def swapaxes(self, i, j, copy=True) -> "Frame":
        return self.copy() if i == j else self.transpose()

    # ---- functions in batches ----------------------------------------------------------------------
    def map_in_pandas(self, func, schema=None) -> "Frame":
        """``func(pandas.DataFrame) -> pandas.DataFrame`` on batches of rows; *schema* as DDL, else from a return hint or a few rows."""
        from .operators.batches import frame_batches

        return frame_batches(self, func, schema)

    apply_batch = map_in_pandas

    def transform_batch(self, func, schema=None) -> "Frame":
        from .operators.batches import frame_batches

        return frame_batches(self, func, schema, same_length=True)

    def apply(self, func, axis=0, args=(), schema=None, **kwds):
        from .operators.batches import frame_apply

        return frame_apply(self, func, axis, args, schema, kwds)

    def transform(self, func, axis=0, *args, **kwargs) -> "Frame":
        only(axis=(axis, 0, "index"))
        return self._select({s.name: s.transform(func, 0, *args, **kwargs).col for s in self._each()})

    # ---- execution ---------------------------------------------------------------------------------
    @property
    def spark(self):
        return _SparkFrame(self)

    def cache(self):
        return Cached(self._rows(self.df.persist(StorageLevel.MEMORY_AND_DISK)))

    def persist(self, storage_level=StorageLevel.MEMORY_AND_DISK):
        return Cached(self._rows(self.df.persist(storage_level)))

    def explain(self, extended=None, mode=None):
        self.to_spark().explain(extended, mode)

    @property
    def plot(self):
        from .plot import Plot

        return Plot(self)

    def hist(self, bins=10, **kwds):
        return self.plot.hist(bins=bins, **kwds)

    def kde(self, bw_method=None, ind=None, **kwds):
        return self.plot.kde(bw_method=bw_method, ind=ind, **kwds)

    @property
    def batch(self):
        return _Batch(self)

    # ---- sinks -------------------------------------------------------------------------------------
    def _sink(self):
        from .sources import sinks

        return sinks

    def to_csv(self, path=None, **options):
        return self._sink().to_csv(self, path, **options)

    def to_json(self, path=None, **options):
        return self._sink().to_json(self, path, **options)

    def to_parquet(self, path, mode="overwrite", partition_cols=None, compression=None, index_col=None, **options):
        self._sink().save(self, path, "parquet", mode, partition_cols, index_col, options | ({"compression": compression} if compression else {}))

    def to_orc(self, path, mode="overwrite", partition_cols=None, index_col=None, **options):
        self._sink().save(self, path, "orc", mode, partition_cols, index_col, options)

    def to_delta(self, path, mode="overwrite", partition_cols=None, index_col=None, **options):
        self._sink().save(self, path, "delta", mode, partition_cols, index_col, options)

    def to_spark_io(self, path=None, format=None, mode="overwrite", partition_cols=None, index_col=None, **options):
        self._sink().save(self, path, format, mode, partition_cols, index_col, options)

    def to_table(self, name, format=None, mode="overwrite", partition_cols=None, index_col=None, **options):
        self._sink().to_table(self, name, format, mode, partition_cols, index_col, options)


def _on_driver(name: str):
    """A renderer of pandas, over the collected table."""

    def method(self, *args, **kwargs):
        return getattr(self.to_pandas(), name)(*args, **kwargs)

    method.__name__ = name
    return method


for _name in ("to_html", "to_string", "to_latex", "to_dict", "to_records", "to_clipboard", "to_excel", "to_markdown"):
    setattr(Frame, _name, _on_driver(_name))


class Cached(Frame):
    """A persisted frame; leaving its context unpersists it."""

    def __init__(self, frame: Frame):
        super().__init__(_state=frame._s)

    def __enter__(self):
        return self

    def __exit__(self, *exc):
        self.unpersist()

    @property
    def storage_level(self):
        return self.df.storageLevel

    def unpersist(self):
        self.df.unpersist()


class _SparkFrame:
    """Plan and cache control."""

    def __init__(self, frame: Frame):
        self._f = frame

    def frame(self, index_col=None) -> DataFrame:
        return self._f.to_spark(index_col)

    def schema(self, index_col=None):
        return self._f.to_spark(index_col).schema

    def print_schema(self, index_col=None):
        self._f.to_spark(index_col).printSchema()

    def explain(self, extended=None, mode=None):
        self._f.explain(extended, mode)

    def cache(self):
        return self._f.cache()

    def persist(self, storage_level=StorageLevel.MEMORY_AND_DISK):
        return self._f.persist(storage_level)

    def hint(self, name, *parameters):
        return self._f.hint(name, *parameters)

    def repartition(self, n):
        return self._f._rows(self._f.df.repartition(n))

    def coalesce(self, n):
        return self._f._rows(self._f.df.coalesce(n))

    def checkpoint(self, eager=True):
        """The rows written into the folder that executors share, and read back, at once."""
        only(eager=(eager, True))
        return self._f._rows(ordered.cut(self._f.df))

    #: A local checkpoint is lost with its executor, so the shared one is taken here too.
    local_checkpoint = checkpoint

    @property
    def analyzed(self) -> Frame:
        """The same rows as columns of a table of their own: earlier series no longer combine with it."""
        return self._f._select({x: F.col(f"`{c}`") for x, c in zip(self._f._labels, self._f._cols)})

    def apply(self, func, index_col=None) -> Frame:
        out = func(self._f.to_spark(index_col))
        return Frame(out, index_col)

    def to_table(self, *a, **k):
        self._f.to_table(*a, **k)

    def to_spark_io(self, *a, **k):
        self._f.to_spark_io(*a, **k)


class _Batch:
    """Functions on batches of rows, and row ids."""

    def __init__(self, frame: Frame):
        self._f = frame

    def apply_batch(self, func, schema=None) -> Frame:
        return self._f.map_in_pandas(func, schema)

    def transform_batch(self, func, schema=None) -> Frame:
        return self._f.transform_batch(func, schema)

    def attach_id_column(self, id_type: str, column) -> Frame:
        """A column of ids: 'sequence' and 'distributed-sequence' from 0 in order, 'distributed' unique with gaps."""
        from .config import option_context

        with option_context("compute.default_index_type", id_type):
            numbered = _default_index(self._f._new(keys=[], names=[], df=self._f.df.withColumns({f"__k{i}__": F.col(k) for i, k in enumerate(self._f._keys)})))
        keys = [f"__k{i}__" for i in range(len(self._f._keys))]
        df = numbered.df.withColumn(physical(column), F.col(key_column(0))).drop(key_column(0), *self._f._keys)
        df = df.withColumnsRenamed(dict(zip(keys, self._f._keys)))
        return self._f._new(df=df, labels=[*self._f._labels, column], cols=[*self._f._cols, physical(column)], order=numbered._order)


# ---- construction ------------------------------------------------------------------------------------
def _wrap(data, index_col, order) -> dict:
    if isinstance(data, DataFrame):
        if data.isStreaming:
            raise ValueError("a streaming DataFrame has no stored rows; use it inside foreachBatch")
        keys = [] if index_col is None else as_list(index_col)
        rest = [c for c in data.columns if c not in keys]
        by = as_list(order) if order is not None else []
        cols = [F.col(f"`{k}`").alias(key_column(i)) for i, k in enumerate(keys)]
        hidden = [F.col(f"`{c}`").alias(f"__o_{i}__") for i, c in enumerate(by)] or [F.monotonically_increasing_id().alias(ROW)]
        df = data.select(*cols, *hidden, *[F.col(f"`{c}`") for c in rest])
        state = {"df": df, "keys": [key_column(i) for i in range(len(keys))], "names": keys, "labels": rest, "cols": rest, "order": [f"__o_{i}__" for i in range(len(by))] or [ROW]}
        return state if keys else _default_index(Frame(_state=state))._s
    if isinstance(data, Frame):
        return data._s
    if isinstance(data, Series):
        return data.to_frame()._s
    return from_pandas(data if isinstance(data, pd.DataFrame) else pd.DataFrame(data, index=index_col))._s


def _default_index(frame: Frame) -> Frame:
    """An index for a table that has none, by the option compute.default_index_type."""
    how, key = get_option("compute.default_index_type"), key_column(0)
    df = frame.df.drop(*[k for k in frame._s["keys"] if k in frame.df.columns])
    if how == "distributed":
        return frame._new(df=df.withColumn(key, F.monotonically_increasing_id()), keys=[key], names=[None])
    if how == "sequence":
        df = df.withColumn(key, (F.row_number().over(Window.orderBy(*frame._by)) - 1).cast("long"))
    else:
        df = ordered.positions(df, [] if frame._order == [ROW] else frame._by, key)
    return frame._new(df=df, keys=[key], names=[None])


def from_pandas(pdf) -> Frame | "Series" | "Index":
    """A pandas object as a distributed one."""
    from pyspark.sql import SparkSession

    if isinstance(pdf, pd.Series):
        return Series.of(pdf)
    if isinstance(pdf, pd.Index):
        return from_pandas(pd.DataFrame(index=pdf)).index
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    flat, names, labels = pdf.reset_index(allow_duplicates=True), list(pdf.index.names), list(pdf.columns)
    n = len(names)
    flat.columns = [*[key_column(i) for i in range(n)], *map(physical, labels)]
    flat[ROW] = np.arange(len(flat))
    for c in flat.columns:
        if isinstance(flat[c].dtype, pd.CategoricalDtype):
            flat[c] = flat[c].astype(flat[c].cat.categories.dtype)
    if len(flat) == 0 or any(flat[c].dtype == object and flat[c].isna().all() for c in flat.columns):
        import pyarrow as pa
        from pyspark.sql.pandas.types import from_arrow_schema

        schema = from_arrow_schema(pa.Schema.from_pandas(flat, preserve_index=False))
        schema = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.NullType) else f.dataType) for f in schema.fields])
        df = spark.createDataFrame(flat, schema)
    else:
        df = spark.createDataFrame(flat)
    return Frame(_state={"df": df, "keys": [key_column(i) for i in range(n)], "names": names, "labels": labels, "cols": [physical(x) for x in labels], "order": [ROW]})


def _fits(value, kind: T.DataType) -> bool:
    return isinstance(value, str) == isinstance(kind, T.StringType)


def _edge(s: "Series", by, largest: bool) -> Column:
    """The index value of the extreme; the first in order among ties."""
    keys = [F.col(k) for k in s._frame._keys]
    key = keys[0] if len(keys) == 1 else F.struct(*keys)
    x, order = S.valid(s.col, s.kind), [F.col(c) for c in s._frame._order]
    sign = x.cast("double")
    return F.min_by(key, F.when(x.isNotNull(), F.struct((-sign if largest else sign).alias("v"), *order)))


def _windowed(frame: Frame, others: list["Series"]):
    """If *others* are windows over one table that *frame* is, or is made from column by column: (that table, all of them over it)."""
    from .operators.windows import columns

    remembered = lambda df: df.__dict__.get("_tabulon_windows")
    table = (frame._s.get("origin") or (None,))[0]
    mine = remembered(frame.df) or (remembered(table) if table is not None else None)
    source = mine[0] if mine else frame
    specs = dict(mine[1]) if mine else {}
    for s in others:
        theirs = remembered(s._frame.df)
        if theirs is None or theirs[0].df is not source.df:
            return None
        specs |= theirs[1]
    return source.df, columns(source, specs, keep=mine is None)


def _aligned(frame: Frame, others: list["Series"], how: str = "outer"):
    """*frame* joined on the index with other frames' series: the joined frame and the series over it."""
    if not get_option("compute.ops_on_diff_frames"):
        raise ValueError("the operands belong to different tables; set the option compute.ops_on_diff_frames to join them on their index")
    keys, out, df, found = frame._keys, frame, frame.df, []
    anchors = {id(s._frame.df): s._frame for s in others}
    for n, (key, other) in enumerate(anchors.items()):
        mine = [s for s in others if id(s._frame.df) == key]
        names = [f"__a{n}_{i}__" for i in range(len(mine))]
        right = other.df.select(*[F.col(k).alias(f"__r{n}_{i}__") for i, k in enumerate(other._keys)], *[s.col.alias(x) for s, x in zip(mine, names)], *[F.col(f"`{c}`").alias(f"__ro{n}_{i}__") for i, c in enumerate(other._order)])
        same = fold(operator.and_, [F.col(k).eqNullSafe(F.col(f"__r{n}_{i}__")) for i, k in enumerate(keys)])
        df = df.join(right, same, {"outer": "full", "left": "left", "inner": "inner"}[how])
        if how == "outer":
            df = df.withColumns({k: F.coalesce(F.col(k), F.col(f"__r{n}_{i}__")) for i, k in enumerate(keys)})
        found += [(s, x) for s, x in zip(mine, names)]
    order = frame._order if how != "outer" else [*keys, *frame._order]
    out = frame._new(df=df, order=order)
    by = {id(s): Series(out, F.col(x), s.name) for s, x in found}
    return out, [by[id(s)] for s in others]


from .series import Index, Rolling, Series, _At, _IAt, _ILoc, _Loc  # noqa: E402


def _frame_binary(name: str):
    def method(self, other, fill_value=None):
        if isinstance(other, Frame):
            shared, extra = [x for x in self._labels if x in other._labels], [x for x in self._labels + other._labels if (x in self._labels) != (x in other._labels)]
            fill = {} if fill_value is None else {"fill_value": fill_value}
            here = other._over(self)
            frame, found = (self, [here[x] for x in shared]) if here is not None else _aligned(self, [other[x] for x in shared])
            data = {x: getattr(Series(frame, F.col(f"`{frame._where_label(x)}`"), x), name)(s, **fill).col for x, s in zip(shared, found)}
            return frame._select(data | {x: F.lit(None).cast("double") for x in extra})
        fill = {} if fill_value is None else {"fill_value": fill_value}
        return self._map(lambda s: getattr(s, name)(other, **fill).col)

    method.__name__ = name
    return method


def _frame_reducer(name: str):
    def method(self, axis=0, numeric_only=None, skipna=True, **options):
        only(axis=(axis, None, 0, "index", *(() if name in ("any", "all") else (1, "columns"))))
        return self._reduced(name, numeric_only, axis, **({} if name in ("count", "any", "all") else {"skipna": skipna}), **options)

    method.__name__ = name
    return method


def _frame_series_window(name: str):
    def method(self, *args, **kwargs):
        from .operators.windows import over_frame

        return over_frame(self, [], name, *args, **kwargs)

    method.__name__ = name
    return method


for _n in (*PAIRS, *[f"r{x}" for x in PAIRS], *COMPARISONS, *ALIASES):
    setattr(Frame, _n, _frame_binary(_n))
for _n in PAIRS:
    setattr(Frame, f"__{_n}__", _frame_binary(_n))
    setattr(Frame, f"__r{_n}__", _frame_binary(f"r{_n}"))
for _n in COMPARISONS:
    setattr(Frame, f"__{_n}__", _frame_binary(_n))
Frame.__hash__ = object.__hash__
Frame.__neg__ = lambda self: self._map(lambda s: -s.col, S.numeric)
Frame.__abs__ = Frame.abs
Frame.__invert__ = lambda self: self._map(lambda s: ~s.col.cast("boolean"))
for _n in ("count", "sum", "prod", "product", "mean", "min", "max", "var", "std", "sem", "skew", "kurt", "kurtosis", "median", "any", "all"):
    setattr(Frame, _n, _frame_reducer(_n))
for _n in ("shift", "diff", "pct_change", "cumsum", "cumprod", "cummin", "cummax", "rank", "ffill", "bfill"):
    setattr(Frame, _n, _frame_series_window(_n))
Frame.pad, Frame.backfill = Frame.ffill, Frame.bfill
