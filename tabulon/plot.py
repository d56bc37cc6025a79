"""The distributed part of plots: what is drawn is computed by Spark; a backend draws it if there is one."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from .config import get_option
from .frame import Frame, Unsupported
from .functions import scalar as S


def top_n(frame: Frame) -> pd.DataFrame:
    return frame.head(get_option("plotting.max_rows")).to_pandas()


def sampled(frame: Frame) -> pd.DataFrame:
    ratio = get_option("plotting.sample_ratio") or min(1.0, get_option("plotting.max_rows") / max(1, len(frame)))
    return frame.sample(frac=ratio, random_state=0).to_pandas()


def histogram(frame: Frame, bins: int = 10) -> tuple[np.ndarray, dict]:
    """Edges over all numeric columns and the count in each bin, the last closed; one pass for the ends, one for the counts."""
    kept = frame._each(S.numeric)
    ends = frame.df.agg(*[f(S.valid(s.col, s.kind)).cast("double") for s in kept for f in (F.min, F.max)]).first()
    low, high = min(x for x in ends[::2] if x is not None), max(x for x in ends[1::2] if x is not None)
    edges = np.linspace(low, high, bins + 1)
    named = F.array(*[F.struct(F.lit(i).alias("i"), S.bucket_of(S.valid(s.col, s.kind).cast("double"), low, high, bins).alias("b")) for i, s in enumerate(kept)])
    rows = frame.df.select(F.explode(named).alias("x")).where("x.b is not null").groupBy("x.i", "x.b").count().collect()
    out = {s.name: np.zeros(bins, dtype=int) for s in kept}
    for r in rows:
        out[kept[r.i].name][r.b] = r["count"]
    return edges, out


def box(frame: Frame, label, whis: float = 1.5, fliers: int = 1000) -> dict:
    """Quartiles, fences, whiskers and the fliers farthest out."""
    s = frame._series(label)
    x = S.valid(s.col, s.kind).cast("double")
    mean = frame.df.agg(F.avg(x)).first()[0]
    ((q1, med, q3),) = frame._quantiles([0.25, 0.5, 0.75], [s])
    low, high = q1 - whis * (q3 - q1), q3 + whis * (q3 - q1)
    inside = x.between(low, high)
    a, b = frame.df.agg(F.min(F.when(inside, x)), F.max(F.when(inside, x))).first()
    out = frame.df.where(~inside).select(x.alias("x")).orderBy(F.desc(F.abs(F.col("x") - F.lit(med)))).limit(fliers)
    return {"mean": mean, "med": med, "q1": q1, "q3": q3, "lower_fence": low, "upper_fence": high, "whislo": a, "whishi": b, "fliers": [r.x for r in out.collect()]}


def kde(frame: Frame, label, bw_method=None, ind=None) -> tuple[np.ndarray, np.ndarray]:
    """A Gaussian density at *ind* points: each point's sum over all rows is one aggregate."""
    s = frame._series(label)
    x = S.valid(s.col, s.kind).cast("double")
    n, sd, low, high = frame.df.agg(F.count(x), F.stddev_samp(x), F.min(x), F.max(x)).first()
    factor = bw_method if isinstance(bw_method, (int, float)) else (n * 3 / 4) ** -0.2 if bw_method == "silverman" else n**-0.2
    h = factor * sd
    span = high - low
    points = np.linspace(low - 0.5 * span, high + 0.5 * span, ind if isinstance(ind, int) else 1000) if ind is None or isinstance(ind, int) else np.asarray(ind, dtype=float)
    spots = frame.df.sparkSession.createDataFrame([(i, float(p)) for i, p in enumerate(points)], "i int, p double")
    rows = frame.df.select(x.alias("x")).where("x is not null").groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    dense = F.transform(F.array(*[F.lit(float(p)) for p in points]), lambda p: F.exp(-0.5 * F.pow((F.col("x") - p) / F.lit(h), 2)) * F.col("n"))
    sums = rows.select(F.posexplode(dense).alias("i", "d")).groupBy("i").agg(F.sum("d").alias("d"))
    got = {r.i: r.d for r in spots.join(sums, "i").select("i", "d").collect()}
    return points, np.array([got.get(i, 0.0) for i in range(len(points))]) / (n * h * np.sqrt(2 * np.pi))


class Plot:
    """``frame.plot``: the data of each kind, drawn by pandas' backend where one is installed."""

    _kernels = {"bar": top_n, "barh": top_n, "pie": top_n, "scatter": top_n, "line": sampled, "area": sampled}

    def __init__(self, frame: Frame):
        self._f = frame

    def __call__(self, kind="line", **kwargs):
        return getattr(self, kind)(**kwargs)

    def __getattr__(self, kind):
        if kind == "hexbin":
            raise Unsupported("plot.hexbin")
        if kind not in self._kernels:
            raise AttributeError(kind)
        return lambda **kw: getattr(self._kernels[kind](self._f).plot, kind)(**kw)

    def hist(self, bins=10, **kw):
        edges, counts = histogram(self._f, bins)
        return pd.DataFrame(counts, index=pd.IntervalIndex.from_breaks(edges)).plot.bar(**kw)

    def box(self, whis=1.5):
        return pd.DataFrame({s.name: box(self._f, s.name, whis) for s in self._f._each(S.numeric)})

    def kde(self, bw_method=None, ind=None, **kw):
        lines = {x: pd.Series(*reversed(kde(self._f, x, bw_method, ind))) for x in self._f._labels}
        return pd.DataFrame(lines).plot.line(**kw)

    density = kde
