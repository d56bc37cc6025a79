"""Python functions over Arrow batches and groups. A schema comes from a DDL string, a return hint, or a few rows."""

from __future__ import annotations

import inspect

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import get_option
from ..frame import ROW, Frame, from_pandas, key_column, physical, spark_type
from ..series import Series


def _few(frame: Frame, labels=None) -> pd.DataFrame:
    return (frame[labels] if labels else frame).head(get_option("compute.shortcut_limit")).to_pandas()


def _schema_of(pdf: pd.DataFrame) -> T.StructType:
    """The Spark schema of a pandas result, every column nullable."""
    made = from_pandas(pdf.reset_index(drop=True))
    fields = [T.StructField(c, T.StringType() if isinstance(made.df.schema[c].dataType, T.NullType) else made.df.schema[c].dataType) for c in made._cols]
    return T.StructType(fields)


def _as_schema(schema) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)


def frame_batches(frame: Frame, func, schema=None, same_length=False) -> Frame:
    """``func`` on each batch of data columns; with *same_length* the index is kept."""
    out = _as_schema(schema) if schema is not None else _schema_of(func(_few(frame)))
    labels, cols, keys = frame._labels, frame._cols, frame._keys
    if same_length:
        order = [c for c in frame._order if c not in keys]
        full = T.StructType([frame.df.schema[c] for c in (*keys, *order)] + out.fields)

        def kept(frames):
            for pdf in frames:
                got = func(pdf[cols].set_axis(labels, axis=1)).reset_index(drop=True)
                if len(got) != len(pdf):
                    raise ValueError("the function changed the number of rows")
                yield pd.concat([pdf[[*keys, *order]].reset_index(drop=True), got.set_axis(out.names, axis=1)], axis=1)

        df = frame.df.select(*keys, *order, *[F.col(f"`{c}`") for c in cols]).mapInPandas(kept, full)
        return frame._new(df=df, labels=list(out.names), cols=list(out.names))

    def mapped(frames):
        for pdf in frames:
            yield func(pdf.set_axis(labels, axis=1)).reset_index(drop=True).set_axis(out.names, axis=1)

    return Frame(frame.df.select(*[F.col(f"`{c}`") for c in cols]).mapInPandas(mapped, out))


def frame_apply(frame: Frame, func, axis=0, args=(), schema=None, kwds=None) -> Frame | Series:
    """axis 1: by row. axis 0: on each batch's columns, so only for functions that need no other rows."""
    kwds = kwds or {}

    def run(pdf):
        got = pdf.apply(func, axis=axis, args=args, **kwds)
        return got.to_frame("0") if isinstance(got, pd.Series) else got

    one = isinstance(_few(frame).apply(func, axis=axis, args=args, **kwds), pd.Series) if schema is None else len(_as_schema(schema).fields) == 1
    out = frame_batches(frame, run, schema, same_length=axis in (1, "columns"))
    return out._series(out._labels[0]).rename(None) if one and axis in (1, "columns") else out


def series_apply(s: Series, batch, func) -> Series:
    """``batch(pandas.Series)`` as a vectorised function; its type from the hint of *func* or a few values."""
    hint = inspect.signature(func).return_annotation if callable(func) and not isinstance(func, type) and func.__module__ != "builtins" else inspect.Signature.empty
    if isinstance(hint, str):
        hint = {"int": int, "float": float, "str": str, "bool": bool}.get(hint, inspect.Signature.empty)
    if hint in (int, float, str, bool):
        kind = spark_type(hint)
    else:
        few = s.to_frame().head(get_option("compute.shortcut_limit")).to_pandas().iloc[:, 0]
        kind = _schema_of(batch(few).to_frame("x")).fields[0].dataType

    def run(values: pd.Series) -> pd.Series:
        return batch(values)

    return s._as(F.pandas_udf(run, kind)(s.col))


def _group_parts(group, func, args, kwargs, schema):
    frame = group._f
    labels = [x for x in frame._labels if not str(x).startswith("__by")] if not group._single else list(group._picked)
    cols = [frame._where_label(x) for x in labels]
    keys = [c.alias(f"__g{i}__") for i, c in enumerate(group._keys)]
    rows = group._rows.select(*keys, *frame._keys, *[c for c in frame._order if c not in frame._keys], *[F.col(f"`{c}`") for c in cols])
    single = group._single

    def run(pdf):
        part = pdf[cols].set_axis(labels, axis=1)
        return func(part[labels[0]] if single else part, *args, **kwargs)

    return frame, rows, [f"__g{i}__" for i in range(len(keys))], cols, run


def group_apply(group, func, args=(), kwargs=None, schema=None) -> Frame:
    """``func`` on each group's rows, in order; a scalar or Series result becomes a row."""
    frame, rows, keys, cols, run = _group_parts(group, func, args, kwargs or {}, schema)
    order, names = list(frame._order), [b.name if b.name is not None else f"key{i}" for i, b in enumerate(group._by_series)]

    def shaped(pdf):
        got = run(pdf.sort_values(order))
        if isinstance(got, pd.Series) and group_single:
            return got.to_frame("0")
        return got if isinstance(got, pd.DataFrame) else got.to_frame().T if isinstance(got, pd.Series) else pd.DataFrame({"0": [got]})

    group_single = group._single
    if schema is None:
        few = rows.orderBy(*order).limit(get_option("compute.shortcut_limit")).toPandas()
        made = _schema_of(pd.concat([shaped(g) for _, g in few.groupby(keys, dropna=False)]))
    else:
        made = _as_schema(schema)
    kinds = [b.kind for b in group._by_series]
    full = T.StructType([T.StructField(f"__g{i}__", k) for i, k in enumerate(kinds)] + [T.StructField("__i__", T.LongType())] + made.fields)

    def per_group(pdf):
        got = shaped(pdf).reset_index(drop=True).set_axis(made.names, axis=1)
        for i, k in enumerate(keys):
            got.insert(i, k, pdf[k].iloc[0])
        got.insert(len(keys), "__i__", range(len(got)))
        return got

    df = rows.groupBy(*keys).applyInPandas(per_group, full)
    state = {"df": df, "keys": keys, "names": names, "labels": list(made.names), "cols": list(made.names), "order": [*keys, "__i__"]}
    return Frame(_state=state)


def group_transform(group, func, args=(), kwargs=None, schema=None):
    """``func`` on each column of each group, as long as the group."""
    kwargs = kwargs or {}
    frame, rows, keys, _, _ = _group_parts(group, func, args, kwargs, schema)
    labels = list(group._picked)
    cols = [frame._where_label(x) for x in labels]
    hidden = list(dict.fromkeys([*frame._keys, *frame._order]))
    if schema is None:
        few = rows.limit(get_option("compute.shortcut_limit")).toPandas()
        made = _schema_of(pd.DataFrame({c: few.groupby(keys, dropna=False)[c].transform(lambda s: func(s, *args, **kwargs)) for c in cols}))
    else:
        made = _as_schema(schema)
    full = T.StructType([rows.schema[c] for c in hidden] + [T.StructField(c, f.dataType) for c, f in zip(cols, made.fields)])
    order = list(frame._order)

    def per_group(pdf):
        pdf = pdf.sort_values(order).reset_index(drop=True)
        new = {c: func(pdf[c], *args, **kwargs) for c in cols}
        return pdf[hidden].assign(**new)

    out = frame._new(df=rows.groupBy(*keys).applyInPandas(per_group, full), labels=labels, cols=cols)
    return out._series(labels[0]) if group._single else out


def group_filter(group, func) -> Frame:
    """The rows of groups for which ``func(rows)`` is true."""
    frame, rows, keys, cols, run = _group_parts(group, func, (), {}, None)
    order = list(frame._order)

    def per_group(pdf):
        return pdf.drop(columns=keys) if bool(run(pdf.sort_values(order))) else pdf.drop(columns=keys).iloc[:0]

    schema = T.StructType([f for f in rows.schema.fields if f.name not in keys])
    labels = [x for x, c in zip(frame._labels, frame._cols) if c in cols]
    return frame._new(df=rows.groupBy(*keys).applyInPandas(per_group, schema), labels=labels, cols=cols)
