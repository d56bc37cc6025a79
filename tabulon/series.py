"""Series, Index, their accessors and indexers; windows over ordered rows."""

from __future__ import annotations

import operator
from functools import cached_property
from functools import reduce as fold

import numpy as np
import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .config import get_option
from .frame import ALIASES, COMPARISONS, PAIRS, ROW, Frame, Unsupported, _aligned, _edge, _Named, as_list, only, from_pandas, key_column, physical, spark_type
from .functions import scalar as S
from .functions import strings, temporal
from .operators.aggregates import reduce


class Series(_Named):
    """A column expression on a Frame."""

    _scope = "Series"

    def __init__(self, data, col=None, name=None, index=None, dtype=None):
        if not isinstance(data, Frame):
            made = Series.of(pd.Series(data, index=index, dtype=dtype, name=name))
            data, col, name = made._frame, made.col, made.name
        self._frame, self.col, self.name, self.categories_ = data, col, name, None

    @classmethod
    def of(cls, s: pd.Series) -> "Series":
        label = s.name if s.name is not None else "0"
        frame = from_pandas(s.rename(label).to_frame())
        return cls(frame, F.col(f"`{physical(label)}`"), s.name)

    @cached_property
    def kind(self) -> T.DataType:
        return self._frame.df.select(self.col.alias("x")).schema[0].dataType

    def _as(self, col: Column, name=...) -> "Series":
        return Series(self._frame, col, self.name if name is ... else name)

    # ---- metadata ----------------------------------------------------------------------------------
    ndim = 1

    @property
    def dtype(self):
        k = self.kind
        if isinstance(k, (T.TimestampType, T.TimestampNTZType)):
            return np.dtype("datetime64[ns]")
        names = {"tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float32", "double": "float64", "boolean": "bool"}
        return np.dtype(names.get(k.simpleString(), "object"))

    dtypes = dtype

    @property
    def spark_type(self):
        return self.kind

    @property
    def spark_column(self) -> Column:
        return self.col

    @property
    def spark(self):
        return _SparkSeries(self)

    def get_dtype_counts(self):
        return pd.Series([1], index=[str(self.dtype)])

    @property
    def index(self) -> "Index":
        return self._frame.index

    @property
    def axes(self):
        return [self.index]

    @property
    def shape(self):
        return (len(self),)

    def __len__(self):
        return len(self._frame)

    size = property(__len__)

    @property
    def empty(self):
        return self._frame.df.isEmpty()

    @property
    def hasnans(self):
        return bool(self._one(F.max(S.missing(self.col, self.kind))))

    @property
    def is_unique(self):
        n, d = self._frame.df.agg(F.count(self.col), F.count_distinct(self.col)).first()
        return n == d

    def __bool__(self):
        raise ValueError("the truth value of a series is ambiguous")

    def keys(self):
        return self.index

    def __getattr__(self, name):
        if name.startswith("_"):
            raise AttributeError(name)
        if name in self.__dict__.get("kind", T.NullType()).__dict__.get("names", ()) or isinstance(self.kind, T.StructType) and name in self.kind.names:
            return self._as(self.col.getField(name), name)
        return super().__getattr__(name)

    def __getitem__(self, key):
        if isinstance(key, Series):
            return self._where(key)
        if isinstance(key, slice):
            return self.iloc[key] if isinstance(key.start, int) else self.loc[key]
        return self.loc[key]

    def _where(self, test: "Series") -> "Series":
        if test._frame.df is self._frame.df:
            return Series(self._frame._filter(test), self.col, self.name)
        return self.to_frame()._filter(test)._series(self._label)

    @property
    def _label(self):
        return "0" if self.name is None else self.name

    def rename(self, index=None) -> "Series":
        return self._as(self.col, index)

    alias = rename

    def rename_axis(self, mapper=None, index=None, inplace=False) -> "Series":
        return self._into(Series(self._frame.rename_axis(mapper, index), self.col, self.name), inplace)

    def _into(self, out: "Series", inplace: bool):
        """In place, this object takes the other's rows and values; the frame it came from stays."""
        if not inplace:
            return out
        self.__dict__.pop("kind", None)
        self._frame, self.col = out._frame, out.col

    def _on_index(self, f) -> "Series":
        out = self.to_frame()
        return out._rows(out.df.withColumn(out._keys[0], f(F.col(out._keys[0]).cast("string"))))._series(self._label)

    def add_prefix(self, prefix):
        return self._on_index(lambda c: F.concat(F.lit(prefix), c))

    def add_suffix(self, suffix):
        return self._on_index(lambda c: F.concat(c, F.lit(suffix)))

    def to_frame(self, name=None) -> Frame:
        return self._frame._select({self._label if name is None else name: self.col})

    to_dataframe = to_frame

    def copy(self, deep=None):
        return self._as(self.col)

    def transpose(self):
        return self

    T = property(transpose)

    def swapaxes(self, i, j, copy=True):
        only(i=(i, 0, "index"), j=(j, 0, "index"))
        return self

    def pipe(self, func, *args, **kwargs):
        return func(self, *args, **kwargs)

    # ---- export ------------------------------------------------------------------------------------
    def to_spark(self, index_col=None):
        return self.to_frame().to_spark(index_col)

    def to_pandas(self) -> pd.Series:
        return self.to_frame().to_pandas().iloc[:, 0].rename(self.name)

    toPandas = to_pandas

    def to_numpy(self):
        return self.to_pandas().to_numpy()

    values = property(to_numpy)

    def to_list(self):
        return self.to_pandas().tolist()

    tolist = to_list

    def __iter__(self):
        return iter(self.to_list())

    def items(self):
        return ((k, row.iloc[0]) for k, row in self.to_frame().iterrows())

    iteritems = items

    def item(self):
        rows = self._frame.df.select(self.col.alias("x")).take(2)
        if len(rows) != 1:
            raise ValueError("only a series of one value has an item")
        return rows[0][0]

    def squeeze(self, axis=None):
        only(axis=(axis, None, 0, "index"))
        rows = self._frame.df.select(self.col.alias("x")).take(2)
        return rows[0][0] if len(rows) == 1 else self

    def bool(self):
        return bool(self.item())

    def get(self, key, default=None):
        try:
            return self[key]
        except KeyError:
            return default

    def pop(self, item):
        out = self[item]
        self._frame = self._frame._filter(~self.index.isin([item]))
        return out

    def __repr__(self):
        n = get_option("display.max_rows")
        return repr(self.head(n).to_pandas())

    # ---- operators ---------------------------------------------------------------------------------
    def _operands(self, other):
        """(series over one frame, the other operand as a Column, its type)."""
        if isinstance(other, Index):
            other = other.to_series()
        if isinstance(other, Series):
            if other._frame.df is self._frame.df:
                return self, other.col, other.kind
            frame, (mine, theirs) = _both(self, other)
            return mine, theirs.col, theirs.kind
        c = other if isinstance(other, Column) else F.lit(other)
        return self, c, self._frame.df.select(c.alias("x")).schema[0].dataType

    def _binary(self, name, other, back=False):
        me, c, kind = self._operands(other)
        (a, ka), (b, kb) = ((c, kind), (me.col, me.kind)) if back else ((me.col, me.kind), (c, kind))
        a, b = (x.cast("long") if isinstance(k, T.BooleanType) else x for x, k in ((a, ka), (b, kb)))
        if name == "add":
            out = S.plus(a, b, ka, kb)
        elif name == "sub":
            out = S.subtract(a, b, ka, kb)
        else:
            out = {"mul": lambda: a * b, "truediv": lambda: S.truediv(a, b), "floordiv": lambda: S.floordiv(a, b), "mod": lambda: S.mod(a, b), "pow": lambda: S.power(a, b)}[name]()
        return me._as(out)

    def divmod(self, other):
        return self // other, self % other

    def rdivmod(self, other):
        return other // self, other % self

    def __neg__(self):
        return self._as(-self.col)

    def __abs__(self):
        return self._as(F.abs(self.col))

    abs = __abs__

    def __invert__(self):
        return self._as(~self.col.cast("boolean"))

    def _logic(self, f, other):
        me, c, _ = self._operands(other)
        return me._as(F.coalesce(f(F.coalesce(me.col.cast("boolean"), F.lit(False)), F.coalesce(c.cast("boolean"), F.lit(False))), F.lit(False)))

    def __and__(self, other):
        return self._logic(operator.and_, other)

    def __or__(self, other):
        return self._logic(operator.or_, other)

    __rand__, __ror__ = __and__, __or__

    def __array_ufunc__(self, ufunc, method, *inputs, **kwargs):
        if method != "__call__" or kwargs:
            return NotImplemented
        if len(inputs) == 1:
            f = S.UNARY.get(ufunc.__name__)
            return NotImplemented if f is None else self._as(f(self.col))
        f = S.BINARY.get(ufunc.__name__)
        named = {"add": "add", "subtract": "sub", "multiply": "mul", "divide": "truediv", "true_divide": "truediv", "floor_divide": "floordiv", "remainder": "mod", "power": "pow", "equal": "eq", "not_equal": "ne", "less": "lt", "less_equal": "le", "greater": "gt", "greater_equal": "ge"}.get(ufunc.__name__)
        first = isinstance(inputs[0], Series)
        if named:
            return getattr(inputs[0], named)(inputs[1]) if first else getattr(inputs[1], f"r{named}" if named in PAIRS else {"lt": "gt", "le": "ge", "gt": "lt", "ge": "le"}.get(named, named))(inputs[0])
        if f is None:
            return NotImplemented
        if first:
            me, c, _ = inputs[0]._operands(inputs[1])
            return me._as(f(me.col, c))
        return inputs[1]._as(f(F.lit(inputs[0]), inputs[1].col))

    def astype(self, dtype) -> "Series":
        if isinstance(dtype, str) and dtype == "category" or isinstance(dtype, pd.CategoricalDtype):
            out = self._as(self.col)
            out.categories_ = list(dtype.categories) if isinstance(dtype, pd.CategoricalDtype) and dtype.categories is not None else None
            out._ordered = bool(getattr(dtype, "ordered", False))
            return out
        return self._as(S.cast(self.col, self.kind, spark_type(dtype)))

    def isin(self, values) -> "Series":
        return self._as(F.coalesce(self.col.isin(list(values)), F.lit(False)))

    def between(self, left, right, inclusive=True) -> "Series":
        return (self >= left) & (self <= right) if inclusive in (True, "both") else (self > left) & (self < right)

    def isna(self) -> "Series":
        return self._as(S.missing(self.col, self.kind))

    isnull = isna

    def notna(self) -> "Series":
        return self._as(~S.missing(self.col, self.kind))

    notnull = notna

    def where(self, cond, other=np.nan) -> "Series":
        return self._chosen(cond, other, True)

    def mask(self, cond, other=np.nan) -> "Series":
        return self._chosen(cond, other, False)

    def _chosen(self, cond, other, keep):
        me, test, _ = self._operands(cond)
        test = F.coalesce(test.cast("boolean"), F.lit(False))
        value = other.col if isinstance(other, Series) else F.lit(None) if isinstance(other, float) and np.isnan(other) else F.lit(other)
        return me._as(F.when(test if keep else ~test, me.col).otherwise(value))

    def round(self, decimals=0) -> "Series":
        return self._as(F.round(self.col, decimals))

    def clip(self, lower=None, upper=None) -> "Series":
        x = S.valid(self.col, self.kind)
        c = F.when(x < lower, F.lit(lower)).otherwise(self.col) if lower is not None else self.col
        return self._as(F.when(x > upper, F.lit(upper)).otherwise(c) if upper is not None else c)

    def fillna(self, value=None, method=None, axis=None, inplace=False, limit=None) -> "Series":
        only(axis=(axis, None, 0, "index"), limit=(limit if method is None else None, None))
        if method is not None:
            return self._into(self.ffill(limit=limit) if method in ("ffill", "pad") else self.bfill(limit=limit), inplace)
        c = value.col if isinstance(value, Series) else F.lit(value)
        return self._into(self._as(F.when(S.missing(self.col, self.kind), c).otherwise(self.col)), inplace)

    def dropna(self, axis=0, inplace=False) -> "Series":
        only(axis=(axis, 0, "index"))
        return self._into(self._where(self.notna()), inplace)

    def replace(self, to_replace=None, value=None, regex=False) -> "Series":
        if isinstance(to_replace, dict):
            pairs = list(to_replace.items())
        else:
            keys = to_replace if isinstance(to_replace, (list, tuple)) else [to_replace]
            pairs = list(zip(keys, value if isinstance(value, (list, tuple)) else [value] * len(keys)))
        c = self.col
        if regex:
            for k, v in pairs:
                c = F.regexp_replace(c, k, v)
            return self._as(c)
        out = None
        for k, v in pairs:
            test = S.missing(self.col, self.kind) if k is None or isinstance(k, float) and np.isnan(k) else self.col == F.lit(k)
            out = F.when(test, F.lit(v)) if out is None else out.when(test, F.lit(v))
        return self._as(out.otherwise(c) if out is not None else c)

    def map(self, arg) -> "Series":
        if isinstance(arg, dict):
            missing = getattr(type(arg), "__missing__", None)
            table = F.create_map(*[F.lit(x) for kv in arg.items() for x in kv]) if arg else None
            found = F.try_element_at(table, self.col) if arg else F.lit(None)
            return self._as(F.when(F.map_contains_key(table, self.col), found).otherwise(F.lit(arg.default_factory())) if missing and arg and hasattr(arg, "default_factory") else found)
        if isinstance(arg, pd.Series):
            return self.map(arg.to_dict())
        return self.apply(arg)

    def drop(self, labels=None, index=None, level=None) -> "Series":
        gone = as_list(labels if labels is not None else index)
        if level is None and len(self._frame._keys) == 1:
            return self._where(~self.index.isin(gone))
        names = self._frame._s["names"]
        key = F.col(self._frame._keys[names.index(level) if level in names else level or 0])
        return Series(self._frame._rows(self._frame.df.where(~key.isin(gone))), self.col, self.name)

    def filter(self, items=None, like=None, regex=None, axis=None) -> "Series":
        only(axis=(axis, None, 0, "index"))
        return self.to_frame().filter(items, like, regex, axis=0)._series(self._label)

    def repeat(self, repeats) -> "Series":
        n = repeats.col if isinstance(repeats, Series) else F.lit(repeats)
        frame = self.to_frame()
        base = self._frame._select({self._label: self.col, "__n__": n})
        rows = base.df.withColumn("__n__", F.explode(F.when(F.col("__n__") > 0, F.sequence(F.lit(1), F.col("__n__").cast("int"))))).drop("__n__")
        return frame._new(df=rows, order=base._order)._series(self._label)

    def explode(self) -> "Series":
        return self.to_frame().explode(self._label)._series(self._label)

    def apply(self, func, args=(), **kwds) -> "Series":
        from .operators.batches import series_apply

        return series_apply(self, lambda s: s.apply(func, args=args, **kwds), func)

    def transform(self, func, axis=0, *args, **kwargs):
        only(axis=(axis, 0, "index"))
        if isinstance(func, list):
            return self.to_frame()._select({f.__name__: self.transform(f).col for f in func})
        if isinstance(func, np.ufunc):
            return func(self)
        return self.apply(func, args, **kwargs)

    def transform_batch(self, func, *args, **kwargs) -> "Series":
        from .operators.batches import series_apply

        return series_apply(self, lambda s: func(s, *args, **kwargs), func)

    # ---- joins with other series -------------------------------------------------------------------
    def update(self, other) -> None:
        frame, (mine, theirs) = _both(self, other, "left")
        self._frame, self.col = frame, F.coalesce(S.valid(theirs.col, theirs.kind), mine.col)

    def combine_first(self, other) -> "Series":
        _, (mine, theirs) = _both(self, other)
        return mine._as(F.coalesce(S.valid(mine.col, mine.kind), theirs.col))

    def align(self, other, join="outer", axis=None, copy=True):
        only(axis=(axis, None, 0, "index"))
        _, (mine, theirs) = _both(self, other, join)
        return mine, theirs

    def compare(self, other, keep_shape=False, keep_equal=False) -> Frame:
        me, c, _ = self._operands(other)
        differs = ~me.col.eqNullSafe(c)
        show = lambda x: x if keep_equal else F.when(differs, x)
        out = me._frame._select({"self": show(me.col), "other": show(c), "__d__": differs})
        rows = out.df if keep_shape else out.df.where("__d__")
        return out._rows(rows)[["self", "other"]]

    def dot(self, other):
        me, c, _ = self._operands(other)
        return me._frame.df.agg(F.sum(me.col * c)).first()[0]

    __matmul__ = dot

    def reindex(self, index=None, fill_value=None) -> "Series":
        return self.to_frame().reindex(index=index, fill_value=fill_value)._series(self._label)

    def reindex_like(self, other) -> "Series":
        return self.reindex(other.index)

    def append(self, to_append, ignore_index=False, verify_integrity=False) -> "Series":
        from .api import concat

        if verify_integrity and not ignore_index and not self.index.intersection(to_append.index).empty:
            raise ValueError("both have a row of the same index")
        return concat([self, to_append], ignore_index=ignore_index)

    def drop_duplicates(self, keep="first", inplace=False) -> "Series":
        return self._into(self.to_frame().drop_duplicates(keep=keep)._series(self._label).rename(self.name), inplace)

    def duplicated(self, keep="first"):
        return self.to_frame().duplicated(keep=keep)

    def equals(self, other) -> bool:
        return self.to_pandas().equals(other.to_pandas())

    # ---- aggregates --------------------------------------------------------------------------------
    def _one(self, c: Column):
        return self._frame.df.agg(c).first()[0]

    def _reduced(self, name, **options):
        if name in ("median", "quantile") and not options.get("accuracy") and options.get("skipna", True):
            q = options.get("q", 0.5)
            (got,) = self._frame._quantiles(q if isinstance(q, list) else [q], [self])
            return got if isinstance(q, list) else got[0]
        return self._one(reduce(name, self.col, self.kind, **options))

    def quantile(self, q=0.5, accuracy=None):
        got = self._reduced("quantile", q=list(q) if isinstance(q, (list, tuple)) else q, accuracy=accuracy)
        return Series.of(pd.Series(got, index=list(q), name=self.name)) if isinstance(q, (list, tuple)) else got

    def mad(self):
        return self._one(F.avg(F.abs(self.col - F.lit(self.mean()))))

    def nunique(self, dropna=True, approx=False, rsd=0.05):
        return self._reduced("nunique", dropna=dropna, approx=approx, rsd=rsd)

    def agg(self, func):
        if isinstance(func, str):
            return getattr(self, func)()
        row = self._frame.df.agg(*[reduce(f, self.col, self.kind).alias(f) for f in func]).first()
        return Series.of(pd.Series(list(row), index=list(func), name=self.name))

    aggregate = agg

    def describe(self, percentiles=None):
        if isinstance(self.kind, T.NumericType):
            return self.to_frame().describe(percentiles)._series(self._label)
        n, u = self._frame.df.agg(F.count(self.col), F.count_distinct(self.col)).first()
        top = self._frame.df.where(self.col.isNotNull()).groupBy(self.col.alias("v")).count().orderBy(F.desc("count"), "v").first()
        return Series.of(pd.Series([str(n), str(u), *([str(top[0]), str(top[1])] if top else [None, None])], index=["count", "unique", "top", "freq"], name=self.name))

    def corr(self, other, method="pearson"):
        me, c, kind = self._operands(other)
        if method == "spearman":
            pair = me._frame._select({"a": me.col, "b": c}).dropna().rank()
            return pair["a"].corr(pair["b"])
        return me._frame.df.agg(F.corr(S.valid(me.col, me.kind).cast("double"), S.valid(c, kind).cast("double"))).first()[0]

    def idxmax(self, skipna=True):
        return self._idx(F.max_by, True, skipna)

    def idxmin(self, skipna=True):
        return self._idx(F.min_by, False, skipna)

    def _idx(self, by, largest, skipna):
        return self._one(_edge(self, by, largest) if skipna else F.when(~F.max(S.missing(self.col, self.kind)), _edge(self, by, largest)))

    def _argedge(self, largest):
        at = self._positioned()
        x = S.valid(F.col("__v__"), self.kind).cast("double")
        return at.agg(F.min_by(ordered.POS, F.when(x.isNotNull(), F.struct((-x if largest else x).alias("v"), F.col(ordered.POS))))).first()[0]

    def argmax(self):
        return self._argedge(True)

    def argmin(self):
        return self._argedge(False)

    def _positioned(self):
        frame = self._frame._select({"__v__": self.col})
        return ordered.positions(frame.df, [] if frame._order == [ROW] else frame._by)

    def mode(self, dropna=True) -> "Series":
        counts = self._counts(dropna)
        most = counts.agg(F.max("n").alias("most"))
        rows = counts.join(F.broadcast(most), F.col("n") == F.col("most"), "left_semi")  # one row
        return Frame(rows.select(F.col("v").alias(physical(self._label))), order=physical(self._label))._series(self._label)

    def _counts(self, dropna=True):
        rows = self._frame.df.select(S.valid(self.col, self.kind).alias("v"))
        return (rows.where("v is not null") if dropna else rows).groupBy("v").agg(F.count(F.lit(1)).alias("n"))

    def unique(self) -> "Series":
        """Distinct values in order of first appearance."""
        frame = self._frame._select({"__v__": self.col})
        rows = frame.df.groupBy("__v__").agg(F.min(F.struct(*frame._order)).alias("__first__"))
        return Frame(rows.select(F.col("__v__").alias(physical(self._label)), "__first__"), order="__first__")[[physical(self._label)]]._series(self._label)

    def value_counts(self, normalize=False, sort=True, ascending=False, bins=None, dropna=True) -> "Series":
        me = self
        if bins is not None:
            low, high = self._frame.df.agg(F.min(self.col), F.max(self.col)).first()
            width = (high - low) / bins
            me = self._as(F.lit(low) + S.bucket_of(self.col, low, high, bins) * F.lit(width))
        counts = me._counts(dropna)
        if normalize:
            counts = counts.withColumn("n", F.col("n") / F.lit(counts.agg(F.sum("n")).first()[0]))
        out = Frame(counts.select("v", F.col("n").alias("count")), index_col="v")
        out = out._sorted([F.col("`count`"), F.col(out._keys[0])], [ascending, True], "last") if sort else out
        return out._new(names=[self.name])._series("count").rename(self.name)

    def factorize(self, sort=True, na_sentinel=-1):
        """Codes of the sorted distinct values, and the values."""
        only(sort=(sort, True))
        values = self._counts().select("v")
        codes = ordered.positions(values, [F.col("v")], "__code__")
        frame = self._frame._select({"__v__": self.col})
        joined = frame._rows(frame.df.join(codes, F.col("__v__") == F.col("v"), "left"))
        most = get_option("compute.max_rows")
        found = codes.orderBy("__code__")
        found = [r.v for r in (found if most is None else found.limit(most + 1)).collect()]
        if most is not None and len(found) > most:
            raise ValueError(f"more than compute.max_rows ({most}) distinct values to return; raise the option to factorize them")
        return Series(joined, F.coalesce("__code__", F.lit(na_sentinel)), self.name), pd.Index(found)

    # ---- sort --------------------------------------------------------------------------------------
    def sort_values(self, ascending=True, inplace=False, na_position="last") -> "Series":
        return self._into(self.to_frame().sort_values(self._label, ascending, na_position=na_position)._series(self._label), inplace)

    def sort_index(self, axis=0, level=None, ascending=True, inplace=False, kind=None, na_position="last") -> "Series":
        only(axis=(axis, 0, "index"))
        return self._into(self.to_frame().sort_index(level=level, ascending=ascending, na_position=na_position)._series(self._label), inplace)

    def argsort(self) -> "Series":
        rows = self._positioned()
        at = ordered.positions(rows.withColumnRenamed(ordered.POS, "__from__"), [F.asc_nulls_last("__v__"), F.asc("__from__")])
        source = F.when(F.col("__v__").isNull(), -1).otherwise(F.col("__from__"))
        out = Frame(at.select(F.col(ordered.POS).alias("at"), source.alias("from")), index_col="at", order="at")
        return Series(out._new(names=[None]), F.col("from"), self.name)

    def nlargest(self, n=5) -> "Series":
        return self.to_frame().nlargest(n, self._label)._series(self._label)

    def nsmallest(self, n=5) -> "Series":
        return self.to_frame().nsmallest(n, self._label)._series(self._label)

    def head(self, n=5) -> "Series":
        return self.to_frame().head(n)._series(self._label)

    def tail(self, n=5) -> "Series":
        return self.to_frame().tail(n)._series(self._label)

    # ---- order -------------------------------------------------------------------------------------
    def asof(self, where):
        """The last valid value at or before each index value of *where*."""
        marks = as_list(where)
        key, x = F.col(self._frame._keys[0]), S.valid(self.col, self.kind)
        row = self._frame.df.agg(*[F.max_by(x, F.when(x.isNotNull() & (key <= F.lit(m)), key)) for m in marks]).first()
        return Series.of(pd.Series(list(row), index=marks, name=self.name)) if isinstance(where, (list, pd.Index)) else row[0]

    def _monotonic(self, ok) -> bool:
        frame = self._frame._select({"__v__": self.col})
        rows = ordered.bounded(frame.df, [] if frame._order == [ROW] else frame._by, 1, 0, lambda w: {"__p__": F.lag("__v__").over(w)})
        bad = F.col("__v__").isNull() | (F.col("__p__").isNotNull() & ~ok(F.col("__p__"), F.col("__v__")))
        return rows.where(bad).isEmpty()

    @property
    def is_monotonic_increasing(self):
        return self._monotonic(operator.le)

    is_monotonic = is_monotonic_increasing

    @property
    def is_monotonic_decreasing(self):
        return self._monotonic(operator.ge)

    def rolling(self, window, min_periods=None):
        return Rolling(self, [], window, min_periods)

    def expanding(self, min_periods=1):
        return Rolling(self, [], None, min_periods)

    def groupby(self, by, axis=0, as_index=True, dropna=True):
        from .groupby import GroupBy

        only(axis=(axis, 0, "index"))
        by = [b if isinstance(b, Series) else self._frame._series(b) for b in as_list(by)]
        base = self._frame._select({self._label: self.col} | {f"__by{i}__": b.col for i, b in enumerate(by)})
        keys = [Series(base, F.col(f"__by{i}__"), b.name) for i, b in enumerate(by)]
        return GroupBy(base, keys, as_index, dropna)[self._label]

    # ---- the rest ----------------------------------------------------------------------------------
    def reset_index(self, level=None, drop=False, name=None, inplace=False):
        out = self.to_frame(name).reset_index(level, drop)
        if inplace and not drop:
            raise TypeError("a series that becomes a table can't do so in place")
        return self._into(out._series(out._labels[-1]), inplace) if drop else out

    def droplevel(self, level):
        return self.to_frame().droplevel(level)._series(self._label)

    def swaplevel(self, i=-2, j=-1, copy=True):
        return self.to_frame().swaplevel(i, j)._series(self._label)

    def xs(self, key, level=None):
        return self.to_frame().xs(key, level=level)._series(self._label)

    def at_time(self, time, asof=False, axis=0):
        return self.to_frame().at_time(time, asof, axis)._series(self._label)

    def between_time(self, start_time, end_time, include_start=True, include_end=True, axis=0):
        return self.to_frame().between_time(start_time, end_time, include_start, include_end, axis)._series(self._label)

    def first(self, offset):
        return self.to_frame().first(offset)._series(self._label)

    def last(self, offset):
        return self.to_frame().last(offset)._series(self._label)

    def sample(self, n=None, frac=None, replace=False, random_state=None):
        return self.to_frame().sample(n, frac, replace, random_state)._series(self._label)

    def truncate(self, before=None, after=None, axis=None, copy=True):
        only(axis=(axis, None, 0, "index"))
        return self.to_frame().truncate(before, after)._series(self._label)

    def take(self, indices):
        return self.to_frame().take(indices)._series(self._label)

    def first_valid_index(self):
        return self.to_frame().first_valid_index()

    def last_valid_index(self):
        return self.to_frame().last_valid_index()

    def unstack(self, level=-1) -> Frame:
        from .operators.reshape import unstack_series

        return unstack_series(self, level)

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

    @property
    def str(self):
        return StringMethods(self)

    @property
    def dt(self):
        return DatetimeMethods(self)

    @property
    def cat(self):
        return CategoricalMethods(self)

    @property
    def plot(self):
        from .plot import Plot

        return Plot(self.to_frame())

    def hist(self, bins=10, **kwds):
        return self.plot.hist(bins=bins, **kwds)

    def to_csv(self, path=None, **options):
        return self.to_frame().to_csv(path, **options)

    def to_json(self, path=None, **options):
        return self.to_frame().to_json(path, **options)


def _both(a: Series, b: Series, how="outer"):
    """Two series of different tables over their join on the index."""
    if a._frame.df is b._frame.df:
        return a._frame, (a, b)
    base = a._frame._select({"__a__": a.col})
    frame, (theirs,) = _aligned(base, [b], how)
    return frame, (Series(frame, F.col("__a__"), a.name), theirs)


def _driver(name):
    def method(self, *args, **kwargs):
        return getattr(self.to_pandas(), name)(*args, **kwargs)

    method.__name__ = name
    return method


def _reducer(name):
    def method(self, axis=None, skipna=True, numeric_only=None, **options):
        only(axis=(axis, None, 0, "index"), numeric_only=(numeric_only, None, False, True))
        return self._reduced(name, **({} if name in ("count", "any", "all") else {"skipna": skipna}), **options)

    method.__name__ = name
    return method


def _arithmetic(name, back):
    def method(self, other, fill_value=None):
        """With *fill_value*, that stands for what is missing on one side only."""
        if isinstance(other, Frame):
            return NotImplemented
        if fill_value is None:
            return self._binary(name, other, back)
        me, c, kind = self._operands(other)
        gap, theirs = S.missing(me.col, me.kind), S.missing(c, kind)
        mine = me._as(F.when(gap & ~theirs, F.lit(fill_value)).otherwise(me.col))
        return mine._binary(name, Series(me._frame, F.when(theirs & ~gap, F.lit(fill_value)).otherwise(c), None), back)

    method.__name__ = name
    return method


def _comparison(name):
    def method(self, other):
        me, c, kind = self._operands(other)
        return me._as(S.compare(name, S.valid(me.col, me.kind), S.valid(c, kind)))

    method.__name__ = name
    return method


def _window(name):
    def method(self, *args, **kwargs):
        from .operators.windows import over_series

        return over_series(self, [], name, *args, **kwargs)

    method.__name__ = name
    return method


for _n in ("to_string", "to_latex", "to_dict", "to_clipboard", "to_excel", "to_markdown"):
    setattr(Series, _n, _driver(_n))
for _n in ("count", "sum", "prod", "product", "mean", "min", "max", "var", "std", "sem", "skew", "kurt", "kurtosis", "median", "any", "all"):
    setattr(Series, _n, _reducer(_n))
for _n in PAIRS:
    for _back in (False, True):
        setattr(Series, ("r" if _back else "") + _n, _arithmetic(_n, _back))
        setattr(Series, ("__r" if _back else "__") + _n + "__", _arithmetic(_n, _back))
for _n, _to in ALIASES.items():
    setattr(Series, _n, getattr(Series, _to))
for _n in COMPARISONS:
    setattr(Series, _n, _comparison(_n))
    setattr(Series, f"__{_n}__", _comparison(_n))
Series.__hash__ = object.__hash__
for _n in ("shift", "diff", "pct_change", "cumsum", "cumprod", "cummin", "cummax", "rank", "ffill", "bfill"):
    setattr(Series, _n, _window(_n))
Series.pad, Series.backfill = Series.ffill, Series.bfill


class Index(_Named):
    """The index columns of a frame."""

    _scope = "Index"

    def __init__(self, frame, cols=None, names=None):
        self.categories_, self._ordered = None, False
        if not isinstance(frame, Frame):
            given = frame if isinstance(frame, pd.Index) else pd.Index(frame)
            made = from_pandas(given)
            frame, cols, names = made._frame, made._cols, made.names
            if isinstance(given, pd.CategoricalIndex):
                self.categories_, self._ordered = list(given.categories), bool(given.ordered)
        self._frame, self._cols, self.names = frame, cols, list(names)

    @property
    def _s(self) -> Series:
        if len(self._cols) != 1:
            raise Unsupported("this needs an index of one level")
        return Series(self._frame, self._cols[0], self.names[0])

    name = property(lambda self: self.names[0] if len(self.names) == 1 else None)
    nlevels = property(lambda self: len(self._cols))
    kind = property(lambda self: self._s.kind)
    dtype = property(lambda self: self._s.dtype)
    spark_type = kind
    ndim = 1

    def rename(self, name, inplace=False):
        names = [name] if not isinstance(name, (list, tuple)) else list(name)
        if not inplace:
            return Index(self._frame._new(names=names), self._cols, names)
        self._frame, self.names = self._frame._new(names=names), names

    set_names = rename

    def get_level_values(self, level):
        i = self.names.index(level) if level in self.names else level
        return Index(self._frame, [self._cols[i]], [self.names[i]])

    def droplevel(self, level):
        gone = {self.names.index(x) if x in self.names else x for x in as_list(level)}
        left = [i for i in range(len(self._cols)) if i not in gone]
        return Index(self._frame, [self._cols[i] for i in left], [self.names[i] for i in left])

    def swaplevel(self, i=-2, j=-1):
        cols, names = list(self._cols), list(self.names)
        cols[i], cols[j], names[i], names[j] = cols[j], cols[i], names[j], names[i]
        return Index(self._frame, cols, names)

    @property
    def levshape(self):
        return tuple(self._frame.df.agg(*[F.count_distinct(c) for c in self._cols]).first())

    def to_series(self, name=None) -> Series:
        return Series(self._frame, self._cols[0], name or self.name)

    def to_frame(self, index=True, name=None) -> Frame:
        names = as_list(name) if name is not None else [n if n is not None else i for i, n in enumerate(self.names)]
        out = self._frame._select(dict(zip(names, self._cols)))
        return out if index else out.reset_index(drop=True)

    def to_pandas(self):
        rows = self._frame.df.orderBy(*self._frame._by).select(*[c.alias(f"k{i}") for i, c in enumerate(self._cols)]).toPandas()
        return pd.Index(rows["k0"], name=self.names[0]) if len(self._cols) == 1 else pd.MultiIndex.from_frame(rows, names=self.names)

    toPandas = to_pandas

    def to_numpy(self, dtype=None, copy=False):
        return self.to_pandas().to_numpy(dtype)

    values = property(to_numpy)

    def to_list(self):
        return self.to_pandas().tolist()

    tolist = to_list

    def __iter__(self):
        return iter(self.to_list())

    def __len__(self):
        return len(self._frame)

    def __bool__(self):
        raise ValueError("the truth value of an index is ambiguous")

    def __abs__(self):
        if len(self._cols) > 1:
            raise TypeError("an index of several levels has no absolute values")
        return Index(self._frame, [abs(self._s).col], self.names)

    size = property(__len__)
    shape = property(lambda self: (len(self),))
    empty = property(lambda self: self._frame.df.isEmpty())
    T = property(lambda self: self)

    def transpose(self):
        return self

    def copy(self, name=None):
        return Index(self._frame, self._cols, self.names) if name is None else self.rename(name)

    view = copy

    def __repr__(self):
        n = get_option("display.max_rows")
        return repr(Index(self._frame.head(n), self._cols, self.names).to_pandas())

    def _made(self, df, cols: list[str]):
        """An index over *df*'s columns, in their own order."""
        frame = Frame(df, index_col=cols, order=cols)
        return Index(frame, [F.col(k) for k in frame._keys], self.names)

    def _rows(self):
        return self._frame.df.select(*[c.alias(f"k{i}") for i, c in enumerate(self._cols)]), [f"k{i}" for i in range(len(self._cols))]

    def _other(self, other):
        return (other if isinstance(other, Index) else Index(other))._rows()[0]

    def isin(self, values):
        return self._s.isin(values)

    def isna(self):
        return self._s.isna()

    isnull = isna

    def notna(self):
        return self._s.notna()

    notnull = notna

    def astype(self, dtype):
        return Index(self._frame, [self._s.astype(dtype).col], self.names)

    def fillna(self, value):
        return Index(self._frame, [self._s.fillna(value).col], self.names)

    def dropna(self):
        return self._made(self._rows()[0].dropna(), self._rows()[1])

    def unique(self, level=None):
        if level is not None and len(self._cols) > 1:
            return self.get_level_values(level).unique()
        df, cols = self._rows()
        return self._made(df.distinct(), cols)

    def drop_duplicates(self):
        return self.unique()

    def union(self, other, sort=None):
        """Every value as often as in the side that holds it more often; sorted whatever *sort* is."""
        only(sort=(sort, None, False, True))
        df, cols = self._rows()
        a, b = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("na")), self._other(other).groupBy(*cols).agg(F.count(F.lit(1)).alias("nb"))
        both = a.unionByName(b, allowMissingColumns=True).groupBy(*cols).agg(F.greatest(F.coalesce(F.max("na"), F.lit(0)), F.coalesce(F.max("nb"), F.lit(0))).alias("n"))
        return self._made(both.select(*cols, F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select(*cols), cols)

    def intersection(self, other):
        df, cols = self._rows()
        return self._made(df.intersect(self._other(other)), cols)

    def difference(self, other, sort=None):
        only(sort=(sort, None, False, True))
        df, cols = self._rows()
        return self._made(df.subtract(self._other(other)), cols)

    def symmetric_difference(self, other, result_name=None, sort=None):
        only(sort=(sort, None, False, True))
        df, cols = self._rows()
        o = self._other(other)
        out = self._made(df.subtract(o).union(o.subtract(df)), cols)
        return out if result_name is None else out.rename(result_name)

    __xor__ = symmetric_difference

    def append(self, other):
        df, cols = self._rows()
        rows = df.withColumn("__n__", F.lit(0)).unionByName(self._other(other).withColumn("__n__", F.lit(1))).withColumn(ROW, F.monotonically_increasing_id())
        frame = Frame(rows, index_col=cols, order=["__n__", ROW])
        return Index(frame, [F.col(k) for k in frame._keys], self.names)

    def repeat(self, repeats):
        s = self.to_series("__x__").repeat(repeats)
        return s.index

    def insert(self, loc, item):
        values = self.to_pandas().insert(loc, item)
        return Index(values)

    def delete(self, loc):
        at = ordered.positions(self._frame.df, self._frame._by)
        kept = self._frame._rows(at.where(~F.col(ordered.POS).isin([x if x >= 0 else x + len(self) for x in as_list(loc)])).drop(ordered.POS))
        return kept.index

    def drop(self, labels, level=None):
        if len(self._cols) > 1:
            at = self.names.index(level) if level in self.names else level or 0
            return self._frame._rows(self._frame.df.where(~self._cols[at].isin(as_list(labels)))).index
        return self._frame._filter(~self.isin(as_list(labels))).index

    def equals(self, other):
        return self.to_pandas().equals(other.to_pandas())

    def identical(self, other):
        return self.names == other.names and self.equals(other)

    @property
    def spark_column(self) -> Column:
        return self._cols[0]

    def take(self, indices):
        return self._frame.iloc[list(indices)].index

    def sort(self):
        raise TypeError("an index is sorted by sort_values")

    def sort_values(self, ascending=True):
        return self._frame._sorted(self._cols, [ascending] * len(self._cols), "last").index

    def min(self):
        return self._edge(F.min)

    def max(self):
        return self._edge(F.max)

    def _edge(self, f):
        if len(self._cols) == 1:
            return self._frame.df.agg(f(self._cols[0])).first()[0]
        r = self._frame.df.agg(f(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(self._cols)]))).first()[0]
        return tuple(r) if r is not None else None

    def argmax(self):
        return self.to_series("__x__").argmax()

    def argmin(self):
        return self.to_series("__x__").argmin()

    def nunique(self, dropna=True, approx=False, rsd=0.05):
        return self._s.nunique(dropna, approx, rsd)

    def value_counts(self, **options):
        if len(self._cols) > 1:
            df, cols = self._rows()
            return Frame(df.groupBy(*cols).agg(F.count(F.lit(1)).alias("count")), index_col=cols, order=cols)._new(names=self.names)._series("count")
        return self._s.value_counts(**options)

    def factorize(self, sort=True, na_sentinel=-1):
        return self._s.factorize(sort, na_sentinel)

    def any(self):
        return self._s.any()

    def all(self):
        return self._s.all()

    def asof(self, label):
        return self._frame.df.where(self._cols[0] <= F.lit(label)).agg(F.max(self._cols[0])).first()[0]

    def shift(self, periods=1, fill_value=None):
        s = self.to_series("__x__").shift(periods, fill_value)
        return Index(s._frame, [s.col], self.names)

    @property
    def has_duplicates(self):
        df, cols = self._rows()
        return df.dropna().count() != df.dropna().distinct().count()

    is_unique = property(lambda self: not self.has_duplicates)
    hasnans = property(lambda self: self._s.hasnans)

    def _in_order(self, ok):
        x = self._cols[0] if len(self._cols) == 1 else F.struct(*self._cols)
        return Series(self._frame, x, "__x__")._monotonic(ok)

    is_monotonic_increasing = property(lambda self: self._in_order(operator.le))
    is_monotonic = is_monotonic_increasing
    is_monotonic_decreasing = property(lambda self: self._in_order(operator.ge))

    def is_numeric(self):
        return isinstance(self.kind, T.NumericType)

    def is_integer(self):
        return isinstance(self.kind, T.IntegralType)

    def is_floating(self):
        return S.fractional(self.kind)

    def is_boolean(self):
        return isinstance(self.kind, T.BooleanType)

    def is_object(self):
        return isinstance(self.kind, (T.StringType, T.ArrayType, T.StructType, T.MapType))

    def is_categorical(self):
        return self.categories_ is not None

    def _categorical(self) -> "CategoricalMethods":
        if self.categories_ is None:
            raise AttributeError("the index is not categorical")
        s = self._s
        s.categories_, s._ordered = list(self.categories_), self._ordered
        return CategoricalMethods(s)

    categories = property(lambda self: self._categorical().categories)
    ordered = property(lambda self: self._categorical().ordered)
    codes = property(lambda self: Index(self._frame, [self._categorical().codes.col], [None]))

    def is_interval(self):
        return False

    def is_type_compatible(self, kind):
        return kind == self.inferred_type

    def holds_integer(self):
        return self.is_integer()

    @property
    def is_all_dates(self):
        return isinstance(self.kind, (T.DateType, T.TimestampType, T.TimestampNTZType))

    @property
    def inferred_type(self):
        return "mixed" if self.nlevels > 1 else "integer" if self.is_integer() else "floating" if self.is_floating() else "boolean" if self.is_boolean() else "datetime64" if self.is_all_dates else "string"

    @property
    def asi8(self):
        return self.astype("long").to_numpy() if self.is_integer() else Index(self._frame, [F.unix_micros(self._cols[0].cast("timestamp")) * 1000], self.names).to_numpy() if self.is_all_dates else None

    def item(self):
        return self._s.item() if self.nlevels == 1 else next(iter(self.to_list()))

    def indexer_between_time(self, start_time, end_time, include_start=True, include_end=True):
        at = self._frame._rows(ordered.positions(self._frame.df, self._frame._by))
        most = get_option("compute.max_rows")
        found = at.between_time(start_time, end_time, include_start, include_end).df.select(ordered.POS).limit(most + 1).collect()
        if len(found) > most:
            raise ValueError(f"more than compute.max_rows ({most}) positions; raise the option to fetch them")
        return np.array(sorted(r[0] for r in found))

    def indexer_at_time(self, time, asof=False):
        only(asof=(asof, False))
        return self.indexer_between_time(time, time)

    def __getattr__(self, name):
        if name in temporal.PROPERTIES:
            return Index(self._frame, [temporal.PROPERTIES[name](self._cols[0])], self.names)
        if name in temporal.METHODS:
            return lambda *a, **k: Index(self._frame, [temporal.METHODS[name](self._cols[0], *a, **k)], self.names)
        return super().__getattr__(name)

    @staticmethod
    def from_tuples(tuples, sortorder=None, names=None):
        return Index(pd.MultiIndex.from_tuples(tuples, names=names))

    @staticmethod
    def from_arrays(arrays, sortorder=None, names=None):
        return Index(pd.MultiIndex.from_arrays(arrays, names=names))

    @staticmethod
    def from_product(iterables, sortorder=None, names=None):
        return Index(pd.MultiIndex.from_product(iterables, names=names))

    @staticmethod
    def from_frame(df: Frame, names=None):
        made = df.set_index(df._labels)
        return Index(made, [F.col(k) for k in made._keys], names or df._labels)


for _n in (*PAIRS, *COMPARISONS):
    setattr(Index, f"__{_n}__", (lambda m: lambda self, other: (lambda s: Index(s._frame, [s.col], self.names) if m in PAIRS else s)(getattr(self._s, m)(other._s if isinstance(other, Index) else other)))(_n))
    if _n in PAIRS:
        setattr(Index, f"__r{_n}__", (lambda m: lambda self, other: (lambda s: Index(s._frame, [s.col], self.names))(getattr(self._s, f"r{m}")(other)))(_n))
Index.__hash__ = object.__hash__


class StringMethods:
    """``Series.str``."""

    def __init__(self, series: Series):
        self._s = series

    def __getattr__(self, name):
        if name not in strings.FUNCTIONS:
            raise Unsupported(f"str.{name}") if name in ("cat", "extract", "extractall", "get_dummies") else AttributeError(name)
        f = strings.FUNCTIONS[name]

        def method(*args, expand=False, **kwargs):
            if name in ("contains", "match", "startswith", "endswith") and "na" in kwargs:
                na = kwargs.pop("na")
                return self._s._as(F.coalesce(f(self._s.col, *args, **kwargs), F.lit(na)))
            only(flags=(kwargs.pop("flags", 0), 0))
            c = f(self._s.col, *args, **kwargs)
            if name in ("split", "rsplit") and expand:
                n = kwargs.get("n", args[1] if len(args) > 1 else -1)
                if n <= 0:
                    raise ValueError("expand needs n, the number of splits")
                return self._s._frame._select({i: F.get(c, F.lit(i)) for i in range(n + 1)})
            return self._s._as(c)

        return method


class DatetimeMethods:
    """``Series.dt``."""

    def __init__(self, series: Series):
        self._s = series

    def __getattr__(self, name):
        if name in temporal.PROPERTIES:
            return self._s._as(temporal.PROPERTIES[name](self._s.col))
        if name in temporal.METHODS:
            return lambda *a, **k: self._s._as(temporal.METHODS[name](self._s.col, *a, **{x: y for x, y in k.items() if x == "freq" or x == "date_format"}))
        raise Unsupported(f"dt.{name}") if name in ("time", "timetz", "nanosecond", "tz_localize", "tz_convert", "to_period", "tz", "freq") else AttributeError(name)


class CategoricalMethods:
    """``Series.cat``: values stay as they are; categories are a short list on the driver."""

    def __init__(self, series: Series):
        self._s = series
        if series.categories_ is None:
            series.categories_ = spread_values(series._frame.df, series.col)

    @property
    def categories(self):
        return pd.Index(self._s.categories_)

    @property
    def ordered(self):
        return getattr(self._s, "_ordered", False)

    @property
    def codes(self) -> Series:
        table = F.create_map(*[F.lit(x) for i, c in enumerate(self._s.categories_) for x in (c, i)])
        return self._s._as(F.coalesce(F.try_element_at(table, self._s.col), F.lit(-1)))

    def _with(self, categories, col=None, ordered_=None):
        out = self._s._as(self._s.col if col is None else col)
        out.categories_, out._ordered = list(categories), self.ordered if ordered_ is None else ordered_
        return out

    def add_categories(self, new_categories):
        return self._with([*self._s.categories_, *as_list(new_categories)])

    def remove_categories(self, removals):
        gone = as_list(removals)
        return self._with([c for c in self._s.categories_ if c not in gone], F.when(~self._s.col.isin(gone), self._s.col))

    def remove_unused_categories(self):
        used = set(spread_values(self._s._frame.df, self._s.col))
        return self._with([c for c in self._s.categories_ if c in used])

    def rename_categories(self, new_categories):
        new = [new_categories.get(c, c) for c in self._s.categories_] if isinstance(new_categories, dict) else list(new_categories)
        return self._with(new, self._s.map(dict(zip(self._s.categories_, new))).col)

    def reorder_categories(self, new_categories, ordered=None):
        return self._with(new_categories, ordered_=ordered)

    def set_categories(self, new_categories, ordered=None):
        return self._with(new_categories, F.when(self._s.col.isin(list(new_categories)), self._s.col), ordered)

    def as_ordered(self):
        return self._with(self._s.categories_, ordered_=True)

    def as_unordered(self):
        return self._with(self._s.categories_, ordered_=False)


class _SparkSeries:
    def __init__(self, series: Series):
        self._s = series

    column = property(lambda self: self._s.col)
    data_type = property(lambda self: self._s.kind)
    analyzed = property(lambda self: self._s.to_frame()._series(self._s._label))
    nullable = property(lambda self: self._s._frame.df.select(self._s.col).schema[0].nullable)

    def transform(self, func):
        return self._s._as(func(self._s.col))

    def apply(self, func):
        out = self._s._frame.df.select(func(self._s.col).alias(physical(self._s._label)))
        return Frame(out)._series(physical(self._s._label))


class Rolling(_Named):
    """Row windows: of a fixed number of rows, or all rows so far (window None)."""

    _scope = "Rolling"

    def __init__(self, target, by: list, window, min_periods):
        if window is not None and (not isinstance(window, int) or window < 0):
            raise ValueError("window is a number of rows")
        self._t, self._by, self._n = target, by, window
        self._least = min_periods if min_periods is not None else (window if window is not None else 1)

    def __repr__(self):
        kind = "Expanding [" if self._n is None else f"Rolling [window={self._n},"
        return f"{kind}min_periods={self._least}]"

    def _apply(self, name):
        from .operators.windows import rolling

        return rolling(self._t, self._by, self._n, self._least, name)


for _n in ("count", "sum", "min", "max", "mean", "std", "var"):
    setattr(Rolling, _n, (lambda m: lambda self: self._apply(m))(_n))


class _Indexer:
    def __init__(self, target):
        self._t = target
        self._f = target if isinstance(target, Frame) else target.to_frame()

    def _out(self, frame: Frame, one: bool = False):
        if isinstance(self._t, Series):
            s = frame._series(self._t._label)
            return s.squeeze() if one else s
        return frame


class _Loc(_Indexer):
    """By label; slices are closed on both ends."""

    def _test(self, key) -> Column | None:
        f = self._f
        k = F.col(f._keys[0])
        if isinstance(key, slice):
            parts = [c for c in (None if key.start is None else k >= F.lit(key.start), None if key.stop is None else k <= F.lit(key.stop)) if c is not None]
            return fold(operator.and_, parts) if parts else None
        if isinstance(key, (list, pd.Index, np.ndarray)):
            return k.isin(list(key))
        if isinstance(key, tuple) and len(f._keys) > 1:
            return fold(operator.and_, [F.col(c) == F.lit(v) for c, v in zip(f._keys, key)])
        return k == F.lit(key)

    def __getitem__(self, key):
        cols = slice(None)
        if isinstance(key, tuple) and isinstance(self._t, Frame) and len(key) == 2 and len(self._f._keys) == 1:
            key, cols = key
        elif isinstance(key, tuple) and isinstance(self._t, Frame) and len(key) == 2 and isinstance(key[0], (tuple, slice, Series)):
            key, cols = key
        if isinstance(key, Series):
            out = self._f._filter(key)
        elif isinstance(key, Column):
            out = self._f._rows(self._f.df.where(key))
        else:
            test = self._test(key)
            out = self._f if test is None else self._f._rows(self._f.df.where(test))
        scalar = not isinstance(key, (slice, list, Series, Column, pd.Index, np.ndarray))
        if isinstance(self._t, Series):
            got = self._out(out, scalar)
            if scalar and isinstance(got, Series) and got.empty:
                raise KeyError(key)
            return got
        if isinstance(cols, slice):
            if cols != slice(None):
                a = 0 if cols.start is None else out._labels.index(cols.start)
                b = len(out._labels) if cols.stop is None else out._labels.index(cols.stop) + 1
                out = out[out._labels[a:b]]
            if scalar:
                rows = out.df.take(2)
                if not rows:
                    raise KeyError(key)
                if len(rows) == 1:
                    return pd.Series([rows[0][c] for c in out._cols], index=out._labels, name=key)
            return out
        return out[cols] if isinstance(cols, list) else out[cols].squeeze() if scalar else out[cols]

    def __setitem__(self, key, value):
        rows, cols = key if isinstance(key, tuple) and len(key) == 2 else (key, slice(None))
        f = self._f
        test = rows.col if isinstance(rows, Series) else self._test(rows)
        test = F.lit(True) if test is None else F.coalesce(test.cast("boolean"), F.lit(False))
        wanted = f._labels if isinstance(cols, slice) else as_list(cols)
        v = value.col if isinstance(value, Series) else F.lit(value)
        data = {x: F.when(test, v).otherwise(F.col(f"`{c}`")) if x in wanted else F.col(f"`{c}`") for x, c in zip(f._labels, f._cols)}
        data |= {x: F.when(test, v) for x in wanted if x not in f._labels}
        self._t._s = f._select(data)._s


class _ILoc(_Indexer):
    """By position in the order."""

    def __getitem__(self, key):
        rows, cols = key if isinstance(key, tuple) else (key, slice(None))
        f = self._f
        if isinstance(self._t, Frame) and cols != slice(None):
            picked = f._labels[cols] if isinstance(cols, (int, slice)) else [f._labels[i] for i in cols]
            one = isinstance(picked, (str, tuple)) or not isinstance(picked, list)
            f = f[[picked] if one else picked]
        else:
            one = False
        if isinstance(rows, slice) and rows.start in (None, 0) and rows.step in (None, 1) and rows.stop is not None and rows.stop >= 0:
            out = f.head(rows.stop)
        elif rows == slice(None):
            out = f
        else:
            at, p = ordered.positions(f.df, [] if f._order == [ROW] else f._by), F.col(ordered.POS)
            if isinstance(rows, slice):
                n = at.count()
                a, b, step = rows.indices(n)
                test = (p >= a) & (p < b) & (F.pmod(p - a, F.lit(step)) == 0) if step > 0 else (p <= a) & (p > b) & (F.pmod(F.lit(a) - p, F.lit(-step)) == 0)
                out = f._rows(at.where(test))
                if step < 0:
                    out = out._renumbered(out.df.orderBy(F.desc(ordered.POS)))
            else:
                wanted = as_list(rows)
                if any(x < 0 for x in wanted):
                    n = at.count()
                    wanted = [x + n if x < 0 else x for x in wanted]
                out = f._rows(at.where(p.isin(wanted)))
        single = isinstance(rows, (int, np.integer))
        if isinstance(self._t, Series):
            return self._out(out, single)
        if one:
            s = out._series(out._labels[0])
            return s.squeeze() if single else s
        if single:
            r = out.df.take(1)
            if not r:
                raise IndexError(rows)
            return pd.Series([r[0][c] for c in out._cols], index=out._labels)
        return out

    def __setitem__(self, key, value):
        rows, cols = key if isinstance(key, tuple) else (key, slice(None))
        f = self._f
        at = f._rows(ordered.positions(f.df, [] if f._order == [ROW] else f._by))
        labels = f._labels[cols] if isinstance(cols, (int, slice)) else [f._labels[i] for i in cols]
        n = at.df.count()
        p = F.col(ordered.POS)
        test = p.isin(list(range(*rows.indices(n)))) if isinstance(rows, slice) and n <= get_option("compute.max_rows") else (p >= rows.indices(n)[0]) & (p < rows.indices(n)[1]) if isinstance(rows, slice) else p.isin([x % n for x in as_list(rows)])
        wanted = as_list(labels)
        data = {x: F.when(test, F.lit(value)).otherwise(F.col(f"`{c}`")) if x in wanted else F.col(f"`{c}`") for x, c in zip(f._labels, f._cols)}
        self._t._s = at._select(data)._s


class _At(_Indexer):
    def __getitem__(self, key):
        row, col = key if isinstance(self._t, Frame) else (key, None)
        s = self._t[col] if col is not None else self._t
        got = _Loc(s)[row]
        return got.to_numpy() if isinstance(got, Series) else got


class _IAt(_Indexer):
    def __getitem__(self, key):
        row, col = key if isinstance(self._t, Frame) else (key, None)
        return _ILoc(self._t)[row, col] if col is not None else _ILoc(self._t)[row]


from .operators.reshape import spread_values  # noqa: E402
from .plans import ordered  # noqa: E402
