"""Top-level functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import OptionError, get_option, option_context, options, reset_option, set_option, show_options
from .frame import ROW, Frame, Unsupported, from_pandas, key_column, only, physical
from .groupby import GroupBy, NamedAgg
from .operators.reshape import get_dummies
from .series import Index, Series
from .sources.readers import (
    date_range,
    read_clipboard,
    read_csv,
    read_delta,
    read_excel,
    read_html,
    read_json,
    read_orc,
    read_parquet,
    read_spark_io,
    read_sql,
    read_sql_query,
    read_sql_table,
    read_table,
)
from .sources.models import load_model
from .sources.readers import range_ as range  # noqa: A004


def concat(objs, axis=0, join="outer", ignore_index=False, sort=False):
    """Rows one after the other by label, or (axis 1) columns side by side joined on the index."""
    objs = list(objs.values()) if isinstance(objs, dict) else list(objs)
    if not objs:
        raise ValueError("there is nothing to concatenate")
    if axis in (1, "columns"):
        frames = [o.to_frame() if isinstance(o, Series) else o for o in objs]
        out = frames[0]
        with option_context("compute.ops_on_diff_frames", True):
            for f in frames[1:]:
                twice = set(out._labels) & set(f._labels)
                if twice:
                    raise ValueError(f"labels occur twice: {sorted(map(str, twice))}")
                out = out.merge(f, "inner" if join == "inner" else "outer", left_index=True, right_index=True, suffixes=("", ""))
        return out
    if all(isinstance(o, Series) for o in objs):
        label = objs[0]._label if len({o._label for o in objs}) == 1 else "0"
        out = concat([o.to_frame(label) for o in objs], ignore_index=ignore_index)
        return out._series(label).rename(objs[0].name if label != "0" else None)
    frames = [o.to_frame() if isinstance(o, Series) else o for o in objs]
    labels = [x for x in frames[0]._labels if all(x in f._labels for f in frames)] if join == "inner" else list(dict.fromkeys(x for f in frames for x in f._labels))
    labels = sorted(labels, key=physical) if sort else labels
    parts = []
    for i, f in enumerate(frames):
        mine = f[[x for x in labels if x in f._labels]]
        if len(f._keys) != len(frames[0]._keys):
            raise ValueError("the tables have different index levels")
        parts.append(mine.df.select(*[F.col(k).alias(key_column(j)) for j, k in enumerate(mine._keys)], F.lit(i).alias("__part__"), *[F.col(f"`{c}`") for c in mine._cols]))
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p, allowMissingColumns=True)
    df = df.withColumn(ROW, F.monotonically_increasing_id())
    keys = [key_column(j) for j, _ in enumerate(frames[0]._keys)]
    out = Frame(_state={"df": df, "keys": keys, "names": frames[0]._s["names"], "labels": labels, "cols": [physical(x) for x in labels], "order": ["__part__", ROW]})
    return out.reset_index(drop=True) if ignore_index else out


def merge(obj, right, how="inner", **options_):
    return obj.merge(right, how, **options_)


def melt(frame, **options_):
    return frame.melt(**options_)


def broadcast(obj: Frame) -> Frame:
    """Mark a small table for a broadcast join; whoever calls it vouches for its size."""
    return obj._rows(F.broadcast(obj.df))


def isna(obj):
    return obj.isna() if hasattr(obj, "isna") else pd.isna(obj)


isnull = isna


def notna(obj):
    return obj.notna() if hasattr(obj, "notna") else pd.notna(obj)


notnull = notna


def to_numeric(arg):
    return arg._as(arg.col.try_cast("double"))


def to_datetime(arg, errors="raise", format=None, unit=None, origin="unix"):
    """Strings by Spark's parser (or a pattern), numbers as time since the epoch."""
    only(origin=(origin, "unix"))
    if isinstance(arg, Frame):
        c = F.make_timestamp(*[F.col(f"`{arg._where_label(k)}`") for k in ("year", "month", "day")], *[F.col(f"`{arg._where_label(k)}`") if k in arg._labels else F.lit(0) for k in ("hour", "minute", "second")])
        return Series(arg, c, None)
    if unit is not None:
        scale = {"s": 1_000_000, "ms": 1_000, "us": 1, "D": 86_400_000_000, "ns": 0.001}[unit]
        return arg._as(F.timestamp_micros((arg.col * scale).cast("long")))
    tried = F.try_to_timestamp(arg.col.cast("string"), F.lit(format)) if format else arg.col.cast("string").try_cast("timestamp")
    if errors == "raise":
        tried = F.when(arg.col.isNotNull() & tried.isNull(), F.raise_error(F.lit("not a time")).cast("timestamp")).otherwise(tried)
    return arg._as(tried)


def sql(query: str, **values) -> Frame:
    """``SELECT … FROM {orders} WHERE k IN {keys}``: tables by name, other values as literals."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()

    def given(v):
        if isinstance(v, (Frame, Series)):
            return v.to_spark()
        if isinstance(v, (list, tuple, pd.Index)):
            return None
        return v

    for k, v in values.items():
        if isinstance(v, (list, tuple, pd.Index)):
            parts = ", ".join("'" + str(x).replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(x, str) else str(x) for x in v)
            query = query.replace("{" + k + "}", f"({parts})")
    return Frame(spark.sql(query, **{k: given(v) for k, v in values.items() if not isinstance(v, (list, tuple, pd.Index))}))


def CategoricalIndex(data=None, categories=None, ordered=None, dtype=None, name=None) -> Index:
    """An index with categories: values of a series or index, or local ones."""
    if isinstance(data, (Series, Index)):
        s = (data if isinstance(data, Series) else data.to_series()).astype(dtype if dtype is not None else pd.CategoricalDtype(categories, ordered))
        out = Index(data._frame, [s.col], [name if name is not None else data.name])
        out.categories_, out._ordered = list(s.cat.categories), bool(ordered)
        return out
    return Index(pd.CategoricalIndex(data, categories, ordered, dtype, name=name))


def DatetimeIndex(data=None, freq=None, normalize=False, name=None) -> Index:
    """An index of times: values of a series or index, or local ones, whose *freq* must hold."""
    if isinstance(data, (Series, Index)):
        only(freq=(freq, None))
        c = (data.col if isinstance(data, Series) else data._cols[0]).cast("timestamp_ntz")
        return Index(data._frame, [F.date_trunc("day", c).cast("timestamp_ntz") if normalize else c], [name if name is not None else data.name])
    made = pd.DatetimeIndex(data, freq=freq, name=name)
    return Index(made.normalize() if normalize else made)


def wrap(df: DataFrame, index_col=None, order=None) -> Frame:
    """A Spark DataFrame as a labelled table."""
    return Frame(df, index_col, order)


def _accessor(kind):
    def register(name):
        def put(cls):
            setattr(kind, name, property(cls))
            return cls

        return put

    return register


register_dataframe_accessor = _accessor(Frame)
register_series_accessor = _accessor(Series)
register_index_accessor = _accessor(Index)
