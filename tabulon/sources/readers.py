"""Readers: Spark scans wrapped as labelled tables."""

from __future__ import annotations

import io
import re

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..frame import Frame, as_list, from_pandas


def _spark() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def _framed(df, index_col=None, columns=None) -> Frame:
    if index_col is not None:
        for k in as_list(index_col):
            if k not in df.columns:
                raise KeyError(k)
    if columns is not None:
        unknown = [c for c in columns if c not in df.columns]
        if unknown:
            raise ValueError(f"unknown columns: {unknown}")
        df = df.select(*[f"`{c}`" for c in dict.fromkeys([*(as_list(index_col) if index_col is not None else []), *columns])])
    return Frame(df, index_col)


def range_(start, end=None, step=1, num_partitions=None) -> Frame:
    df = _spark().range(start, end, step, num_partitions) if end is not None else _spark().range(0, start, step, num_partitions)
    return Frame(df)


def read_csv(path, sep=",", header="infer", names=None, index_col=None, usecols=None, squeeze=False, mangle_dupe_cols=True, dtype=None, nrows=None, parse_dates=False, quotechar=None, escapechar=None, comment=None, **options):
    if not mangle_dupe_cols or parse_dates is not False:
        raise ValueError("mangle_dupe_cols=True and parse_dates=False are the only values")
    if header not in ("infer", 0, None):
        raise ValueError("header is 'infer', 0 or None")
    reader = _spark().read.option("sep", sep).options(**options)
    for k, v in (("quote", quotechar), ("escape", escapechar), ("comment", comment)):
        reader = reader.option(k, v) if v is not None else reader
    named = header in ("infer", 0) and names is None or header == 0
    reader = reader.option("header", named)
    df = reader.schema(names).csv(path) if isinstance(names, str) else reader.option("inferSchema", True).csv(path)
    if names is not None and not isinstance(names, str):
        df = df.toDF(*names)
    if usecols is not None:
        kept = [c for c in df.columns if usecols(c)] if callable(usecols) else [df.columns[c] if isinstance(c, int) else c for c in usecols]
        unknown = [c for c in kept if c not in df.columns]
        if unknown:
            raise ValueError(f"unknown columns: {unknown}")
        df = df.select(*[f"`{c}`" for c in kept])
    out = _framed(df.limit(nrows) if nrows is not None else df, index_col)
    out = out.astype(dtype) if dtype is not None else out
    return out[out._labels[0]] if squeeze and len(out._labels) == 1 else out


def read_json(path, lines=True, index_col=None, **options):
    if not lines:
        raise NotImplementedError("JSON is read by lines")
    return _framed(_spark().read.options(**options).json(path), index_col)


def read_parquet(path, columns=None, index_col=None, pandas_metadata=False, **options):
    if pandas_metadata and index_col is None:
        index_col = _pandas_index(path)
    return _framed(_spark().read.options(**options).parquet(path), index_col, columns)


def _pandas_index(path):
    """The index columns that pandas noted in a file's footer, read on an executor."""

    def footers(frames):
        import json

        import pyarrow.parquet as pq

        for pdf in frames:
            for content in pdf["content"]:
                meta = (pq.read_schema(io.BytesIO(content)).metadata or {}).get(b"pandas")
                yield pd.DataFrame({"names": [[x for x in json.loads(meta)["index_columns"] if isinstance(x, str)] if meta else []]})

    files = _spark().read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).limit(1)
    found = files.select("content").mapInPandas(footers, "names array<string>").first()
    return list(found.names) or None if found else None


def read_orc(path, columns=None, index_col=None, **options):
    return _framed(_spark().read.options(**options).orc(path), index_col, columns)


def read_delta(path, version=None, timestamp=None, index_col=None, **options):
    options |= {k: v for k, v in (("versionAsOf", version), ("timestampAsOf", timestamp)) if v is not None}
    return read_spark_io(path, "delta", index_col=index_col, **options)


def read_table(name, index_col=None):
    return _framed(_spark().read.table(name), index_col)


def read_spark_io(path=None, format=None, schema=None, index_col=None, **options):
    reader = _spark().read.options(**options)
    return _framed((reader.schema(schema) if schema is not None else reader).load(path, format=format), index_col)


def read_sql_table(table_name, con, schema=None, index_col=None, columns=None, **options):
    name = table_name if schema is None else f"{schema}.{table_name}"
    return _framed(_spark().read.format("jdbc").options(url=con, dbtable=name, **options).load(), index_col, columns)


def read_sql_query(sql, con, index_col=None, **options):
    return _framed(_spark().read.format("jdbc").options(url=con, query=sql, **options).load(), index_col)


def read_sql(sql, con, index_col=None, columns=None, **options):
    if re.search(r"\s", sql.strip()):
        return read_sql_query(sql, con, index_col, **options)
    return read_sql_table(sql, con, index_col=index_col, columns=columns, **options)


def read_excel(io_, sheet_name=0, header=0, names=None, index_col=None, schema=None, **options):
    """One workbook is read on the driver; a folder of them by executors, each file whole, with the columns of *schema* or the first one's."""
    read = lambda x: pd.read_excel(x, sheet_name=sheet_name, header=header, names=names, **options)
    if not isinstance(io_, str):
        return from_pandas(read(io_))
    files = _spark().read.format("binaryFile").load(io_)
    if schema is not None:
        made = _spark().createDataFrame([], schema).schema
    else:
        made = from_pandas(read(io.BytesIO(files.orderBy("path").select("content").first()[0]))).to_spark().schema

    def sheets(frames):
        for pdf in frames:
            for content in pdf["content"]:
                yield read(io.BytesIO(content)).set_axis(made.names, axis=1)

    return _framed(files.select("content").mapInPandas(sheets, made), index_col)


def read_html(io_, match=".+", **options):
    return [from_pandas(x) for x in pd.read_html(io_, match=match, **options)]


def read_clipboard(sep=r"\s+", **options):
    return from_pandas(pd.read_clipboard(sep, **options))


def date_range(start=None, end=None, periods=None, freq=None, tz=None, normalize=False, name=None, closed=None):
    """Fixed frequencies are generated by Spark; calendar ones are listed on the driver."""
    if tz is not None:
        raise NotImplementedError("time zones")
    listed = pd.date_range(start, end, periods, freq or ("D" if None in (start, end, periods) else None), normalize=normalize, name=name, inclusive=closed or "both")
    step = listed.freq.nanos // 1000 if listed.freq is not None and hasattr(listed.freq, "nanos") else None if not isinstance(listed.freq, pd.offsets.Day) else 86_400_000_000
    if step is None or not len(listed):
        return from_pandas(listed)
    first = int(listed[0].value // 1000)
    df = _spark().range(len(listed)).select(F.timestamp_micros(F.lit(first) + F.col("id") * F.lit(int(step))).alias("t"))
    return Frame(df, "t", "t")._new(names=[name]).index
