"""Writers: distributed folders, or text on the driver where no path is given."""

from __future__ import annotations

from ..frame import Frame, as_list


def _writer(frame: Frame, mode, partition_cols, index_col, options):
    w = frame.to_spark(index_col).write.mode(mode).options(**options)
    return w.partitionBy(*as_list(partition_cols)) if partition_cols is not None else w


def save(frame: Frame, path, format=None, mode="overwrite", partition_cols=None, index_col=None, options=None) -> None:
    w = _writer(frame, {"w": "overwrite", "a": "append"}.get(mode, mode), partition_cols, index_col, options or {})
    (w.format(format) if format else w).save(path)


def to_table(frame: Frame, name, format=None, mode="overwrite", partition_cols=None, index_col=None, options=None) -> None:
    w = _writer(frame, mode, partition_cols, index_col, options or {})
    (w.format(format) if format else w).saveAsTable(name)


def to_csv(frame: Frame, path=None, sep=",", na_rep="", columns=None, header=True, quotechar='"', date_format=None, escapechar=None, num_files=None, mode="overwrite", partition_cols=None, index_col=None, **options):
    frame = frame[columns] if columns is not None else frame
    if path is None:
        return frame.to_pandas().to_csv(sep=sep, na_rep=na_rep, header=header, quotechar=quotechar, date_format=date_format, escapechar=escapechar, index=False)
    given = {"sep": sep, "nullValue": na_rep, "header": header, "quote": quotechar} | ({"escape": escapechar} if escapechar else {}) | ({"timestampFormat": date_format, "dateFormat": date_format} if date_format else {})
    save(frame.spark.repartition(num_files) if num_files else frame, path, "csv", mode, partition_cols, index_col, given | options)


def to_json(frame: Frame, path=None, compression="uncompressed", num_files=None, mode="overwrite", orient="records", lines=True, partition_cols=None, index_col=None, **options):
    if orient != "records" or not lines:
        raise NotImplementedError("JSON is written as records by lines")
    if path is None:
        return frame.to_pandas().to_json(orient="records", lines=True)
    save(frame.spark.repartition(num_files) if num_files else frame, path, "json", mode, partition_cols, index_col, {"compression": compression} | options)
