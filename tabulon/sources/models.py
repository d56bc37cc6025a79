"""Fitted models as column functions, where the library that stores them is installed."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..frame import Frame, spark_type
from ..series import Series


def load_model(model_uri: str, predict_type="infer"):
    """A model stored by mlflow: ``predict(frame)`` gives a series, each executor loading the model once."""
    try:
        from mlflow import pyfunc
    except ImportError as e:
        raise ImportError("load_model needs mlflow") from e
    kind = spark_type(float if predict_type == "infer" else predict_type)

    def predict(frame: Frame) -> Series:
        loaded, labels = [], list(frame._labels)

        def run(*columns: pd.Series) -> pd.Series:
            if not loaded:
                loaded.append(pyfunc.load_model(model_uri))
            return pd.Series(loaded[0].predict(pd.concat(columns, axis=1).set_axis(labels, axis=1)))

        return Series(frame, F.pandas_udf(run, kind)(*[F.col(f"`{c}`") for c in frame._cols]), None)

    return predict
