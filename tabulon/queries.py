"""Registered queries: each applies operators of the library to whole tables, with DuckDB SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api as tb
from .frame import Frame
from .functions import scalar as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def put(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = sql
        return f

    return put


def t(spark: SparkSession, sf: str, name: str, index=None, order=None) -> Frame:
    return tb.wrap(spark.read.parquet(f"{sf}/{name}.parquet"), index, order)


def events(spark, sf) -> Frame:
    return t(spark, sf, "events", "event_id", "event_id")


def orders(spark, sf) -> Frame:
    return t(spark, sf, "orders", "o_orderkey", "o_orderkey")


def holes(e: Frame) -> Frame:
    """Events with missing values where the key mod 7 is below 3; scaled, so that no mean falls on a rounding tie."""
    return e.assign(v=lambda f: (f["value"] * SCALE).mask(f.index.to_series() % 7 < 3))


SCALE = 0.98765432187
HOLES = f"SELECT *, CASE WHEN event_id % 7 < 3 THEN NULL ELSE value * {SCALE}::DOUBLE END AS v FROM events"


# ---- filters, arithmetic, grouped aggregates ---------------------------------------------------------
@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
 round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_quantity), 4) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
 FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark, sf):
    x = t(spark, sf, "lineitem").query("l_shipdate <= timestamp_ntz'1998-09-02'")
    x["disc_price"] = x["l_extendedprice"] * (1 - x["l_discount"])
    out = x.groupby(["l_returnflag", "l_linestatus"]).agg(sum_qty=("l_quantity", "sum"), sum_base_price=("l_extendedprice", "sum"), sum_disc_price=("disc_price", "sum"), avg_qty=("l_quantity", "mean"), avg_disc=("l_discount", "mean"), count_order=("l_quantity", "count"))
    for c in ("sum_qty", "sum_base_price", "sum_disc_price"):
        out[c] = out[c].round(2)
    out["avg_qty"], out["avg_disc"] = out["avg_qty"].round(4), out["avg_disc"].round(6)
    return out.to_spark(["l_returnflag", "l_linestatus"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'")
def filter_mask(spark, sf):
    o = orders(spark, sf)
    return o[(o["o_totalprice"] > 100000) & (o["o_orderstatus"] == "F")][["o_totalprice"]].to_spark("o_orderkey")


@query("SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 5, 9) OR p_brand = 'Brand#13'")
def filter_isin(spark, sf):
    p = t(spark, sf, "part", "p_partkey")
    return p[p["p_size"].isin([1, 5, 9]) | (p["p_brand"] == "Brand#13")][["p_size"]].to_spark("p_partkey")


@query("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20")
def filter_between(spark, sf):
    p = t(spark, sf, "part", "p_partkey")
    return p[p["p_size"].between(10, 20)][["p_size"]].to_spark("p_partkey")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN o_totalprice END AS big, CASE WHEN o_totalprice > 200000 THEN 0.0 ELSE o_totalprice END AS small FROM orders")
def where_mask(spark, sf):
    o = orders(spark, sf)
    big = o["o_totalprice"] > 200000
    return o.assign(big=o["o_totalprice"].where(big), small=o["o_totalprice"].mask(big, 0.0))[["big", "small"]].to_spark("o_orderkey")


@query("SELECT o_orderkey, o_totalprice * 2 + 1 AS twice, o_totalprice > 1000 AS large FROM orders")
def eval_expression(spark, sf):
    o = orders(spark, sf).eval("twice = o_totalprice * 2 + 1")
    return o.eval("large = o_totalprice > 1000")[["twice", "large"]].to_spark("o_orderkey")


@query("""SELECT event_id, event_id % 5 AS m, CASE WHEN event_id % 5 = 0 THEN CAST('inf' AS DOUBLE) ELSE value / (event_id % 5) END AS q,
 CASE WHEN event_id % 5 = 0 THEN CAST('inf' AS DOUBLE) ELSE floor(value / (event_id % 5)) END AS fl, -value AS neg, abs(value - 100) AS dist, value * value AS sq
 FROM events WHERE value > 0""")
def arithmetic(spark, sf):
    e = events(spark, sf)
    e = e[tb.Series(e, e["value"].col > 0)]  # SQL's comparison, in which NaN is above all numbers
    m = np.fmod(e.index.to_series(), 5)  # SQL's remainder has the sign of the dividend
    return e.assign(m=m, q=e["value"] / m, fl=e["value"] // m, neg=-e["value"], dist=(e["value"] - 100).abs(), sq=e["value"] * e["value"])[["m", "q", "fl", "neg", "dist", "sq"]].to_spark("event_id")


@query(f"SELECT event_id, coalesce(v < 50, false) AS lt, coalesce(v <> 50, true) AS ne, v IS NULL AS na, coalesce(v >= 50, false) OR event_id > 10 AS either FROM ({HOLES})")
def comparisons_with_missing(spark, sf):
    e = holes(events(spark, sf))
    return e.assign(lt=e["v"] < 50, ne=e["v"] != 50, na=e["v"].isna(), either=(e["v"] >= 50) | (e.index.to_series() > 10))[["lt", "ne", "na", "either"]].to_spark("event_id")


@query("""SELECT o_orderkey, CAST(o_totalprice AS BIGINT) AS whole, CAST(o_custkey AS VARCHAR) AS name, o_custkey <> 0 AS truth, CAST(split_part(o_orderpriority, '-', 1) AS DOUBLE) AS level
 FROM (SELECT * REPLACE (floor(o_totalprice) AS o_totalprice) FROM orders)""")
def casts(spark, sf):
    o = orders(spark, sf)
    whole = tb.Series(o, F.floor(o["o_totalprice"].col), "w").astype("int")
    return o.assign(whole=whole, name=o["o_custkey"].astype(str), truth=o["o_custkey"].astype(bool), level=tb.to_numeric(o["o_orderpriority"].str.slice(0, 1)))[["whole", "name", "truth", "level"]].to_spark("o_orderkey")


AGGS = ("count", "sum", "mean", "min", "max", "std", "var", "median", "nunique")


@query("""SELECT l_returnflag, count(l_quantity) AS count, sum(l_quantity) AS sum, round(avg(l_quantity), 6) AS mean, min(l_quantity) AS min, max(l_quantity) AS max,
 round(stddev_samp(l_quantity), 6) AS std, round(var_samp(l_quantity), 6) AS var, median(l_quantity) AS median, count(DISTINCT l_quantity) AS nunique FROM lineitem GROUP BY 1""")
def group_stats(spark, sf):
    out = t(spark, sf, "lineitem").groupby("l_returnflag")["l_quantity"].agg(list(AGGS))
    for c in ("mean", "std", "var"):
        out[c] = out[c].round(6)
    return out.to_spark("l_returnflag")


@query("SELECT event_type, arg_min(value, event_id) AS first, arg_max(value, event_id) AS last, arg_max(event_id, value) AS at_max, arg_min(event_id, value) AS at_min FROM (SELECT event_id, event_type, value + event_id * 1e-7 AS value FROM events) GROUP BY 1")
def group_first_last(spark, sf):
    e = events(spark, sf)
    e["value"] = e["value"] + e.index.to_series() * 1e-7
    g = e.groupby("event_type")["value"]
    edges = e.groupby("event_type").agg(first=("value", "first"), last=("value", "last"))
    with tb.option_context("compute.ops_on_diff_frames", True):
        return edges.assign(at_max=g.idxmax(), at_min=g.idxmin()).to_spark("event_type")


@query("SELECT o_orderstatus, bool_or(o_totalprice > 400000) AS some, bool_and(o_totalprice > 1000) AS every, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1")
def group_any_all_size(spark, sf):
    o = orders(spark, sf)
    o = o.assign(big=o["o_totalprice"] > 400000, ok=o["o_totalprice"] > 1000)
    return o.groupby("o_orderstatus").agg(some=("big", "any"), every=("ok", "all"), n=("ok", "size")).to_spark("o_orderstatus")


@query("""SELECT event_type, count(v) AS count, round(avg(v), 5) AS mean, round(stddev_samp(v), 5) AS std, min(v) AS low, round(quantile_cont(v, 0.25), 5) AS q1, round(quantile_cont(v, 0.5), 5) AS q2,
 round(quantile_cont(v, 0.75), 5) AS q3, max(v) AS high FROM (%s) GROUP BY 1""" % HOLES)
def group_describe(spark, sf):
    out = holes(events(spark, sf))[["event_type", "v"]].groupby("event_type").describe()
    names = ["count", "mean", "std", "low", "q1", "q2", "q3", "high"]
    out.columns = names
    for c in ("mean", "std", "q1", "q2", "q3"):
        out[c] = out[c].round(5)
    out["count"] = out["count"].astype("int")
    return out.to_spark("event_type")


@query("SELECT k, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM (SELECT CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS k, value FROM events) GROUP BY 1")
def group_keep_missing_keys(spark, sf):
    e = events(spark, sf)
    e["k"] = e["event_type"].mask(e.index.to_series() % 3 == 0, None)
    out = e.groupby("k", dropna=False).agg(n=("value", "size"), total=("value", "sum"))
    out["total"] = out["total"].round(4)
    return out.to_spark("k")


@query("SELECT CAST(count(v) AS DOUBLE) AS count, round(avg(v), 5) AS mean, round(stddev_samp(v), 5) AS std, min(v) AS low, round(quantile_cont(v, 0.25), 5) AS q1, round(median(v), 5) AS q2, round(quantile_cont(v, 0.75), 5) AS q3, max(v) AS high FROM (%s)" % HOLES)
def describe(spark, sf):
    out = holes(events(spark, sf))[["v"]].describe().T
    out.columns = ["count", "mean", "std", "low", "q1", "q2", "q3", "high"]
    for c in ("mean", "std", "q1", "q2", "q3"):
        out[c] = out[c].round(5)
    return out.to_spark()


def _stats(spark, sf, names):
    v = holes(events(spark, sf))["v"]
    return v._frame.df.agg(*[tb_reduce(n, v).alias(n) for n in names])


def tb_reduce(name, s):
    from .operators.aggregates import reduce

    c = reduce(name, s.col, s.kind)
    return c if name in ("count", "nunique", "min", "max") else F.round(c, 5)


@query("SELECT round(sum(v), 5) AS sum, round(avg(v), 5) AS mean, round(var_samp(v), 5) AS var, round(stddev_samp(v), 5) AS std, round(stddev_samp(v) / sqrt(count(v)), 5) AS sem, round(median(v), 5) AS median, min(v) AS min, max(v) AS max, count(v) AS count, count(DISTINCT v) AS nunique FROM (%s)" % HOLES)
def whole_stats(spark, sf):
    return _stats(spark, sf, ["sum", "mean", "var", "std", "sem", "median", "min", "max", "count", "nunique"])


@query("""SELECT round(avg(power(v - m, 3)) / power(avg(power(v - m, 2)), 1.5), 5) AS skew, round(avg(power(v - m, 4)) / power(avg(power(v - m, 2)), 2) - 3, 5) AS kurt
 FROM (%s), (SELECT avg(v) AS m FROM (%s)) WHERE v IS NOT NULL""" % (HOLES, HOLES))
def skew_kurt(spark, sf):
    return _stats(spark, sf, ["skew", "kurt"])


@query("SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS count FROM orders GROUP BY 1")
def value_counts(spark, sf):
    return orders(spark, sf)["o_orderstatus"].value_counts().to_frame("count").to_spark("o_orderstatus")


@query("SELECT event_type, user_id, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def group_value_counts(spark, sf):
    return events(spark, sf).groupby("event_type")["user_id"].value_counts().to_frame("n").to_spark(["event_type", "user_id"])


@query("SELECT p_size FROM (SELECT p_size, count(*) AS n FROM part GROUP BY 1) WHERE n = (SELECT max(n) FROM (SELECT count(*) AS n FROM part GROUP BY p_size))")
def mode(spark, sf):
    return t(spark, sf, "part")["p_size"].mode().to_spark()


@query("SELECT DISTINCT p_brand FROM part")
def unique(spark, sf):
    return t(spark, sf, "part")["p_brand"].unique().to_spark()


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem")
def corr_pearson(spark, sf):
    x = t(spark, sf, "lineitem")
    return x.df.agg(F.round(F.corr(x["l_quantity"].col, x["l_extendedprice"].col), 6).alias("r"))


@query("SELECT round(avg(abs(value - m)), 6) AS mad FROM events, (SELECT avg(value) AS m FROM events)")
def mad(spark, sf):
    return tb.from_pandas(events(spark, sf)[["value"]].mad().to_pandas().round(6).to_frame("mad")).to_spark()


@query("SELECT approx_n > 0 AS positive FROM (SELECT count(DISTINCT user_id) AS approx_n FROM events)")
def approx_nunique(spark, sf):
    e = events(spark, sf)
    return e.df.agg((F.approx_count_distinct(e["user_id"].col) > 0).alias("positive"))


# ---- joins -------------------------------------------------------------------------------------------
def _merge(how):
    def f(spark, sf):
        a = t(spark, sf, "customer")[["c_custkey", "c_nationkey", "c_acctbal"]]
        b = t(spark, sf, "nation")
        b = b[b["n_nationkey"] % 2 == 0].rename(columns={"n_nationkey": "c_nationkey"})
        b["c_acctbal"] = b["n_regionkey"] * 1.0
        a = a[a["c_nationkey"] < 20]
        return a.merge(b, how, on="c_nationkey", suffixes=("_a", "_b")).to_spark()

    return f


for _how, _join in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("outer", "FULL JOIN")):
    query(
        f"""SELECT c_custkey, c_nationkey, a.c_acctbal AS c_acctbal_a, n_name, n_regionkey, b.c_acctbal AS c_acctbal_b
 FROM (SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_nationkey < 20) a {_join}
 (SELECT n_nationkey AS c_nationkey, n_name, n_regionkey, n_regionkey * 1.0::DOUBLE AS c_acctbal FROM nation WHERE n_nationkey % 2 = 0) b USING (c_nationkey)""",
        f"merge_{_how}",
    )(_merge(_how))


@query("SELECT c_custkey, c_nationkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def join_on_index(spark, sf):
    n = t(spark, sf, "nation", "n_nationkey")[["n_name"]]
    return t(spark, sf, "customer")[["c_custkey", "c_nationkey"]].join(n, on="c_nationkey").to_spark()


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN -1.0 ELSE o_totalprice END AS o_totalprice FROM orders")
def update(spark, sf):
    o = orders(spark, sf)[["o_totalprice"]]
    other = orders(spark, sf)
    other = other[other.index.to_series() % 3 == 0].assign(o_totalprice=-1.0)[["o_totalprice"]]
    with tb.option_context("compute.ops_on_diff_frames", True):
        o.update(other)
    return o.to_spark("o_orderkey")


@query("SELECT coalesce(a.k, b.k) AS k, coalesce(a.x, b.x) AS x FROM (SELECT event_id AS k, CASE WHEN event_id % 2 = 0 THEN value END AS x FROM events WHERE event_id % 3 <> 0) a FULL JOIN (SELECT event_id AS k, -1.0::DOUBLE AS x FROM events WHERE event_id % 5 = 0) b ON a.k = b.k")
def combine_first(spark, sf):
    e = events(spark, sf)
    a = e.assign(x=e["value"].where(e.index.to_series() % 2 == 0), k=e.index.to_series())
    b = e.assign(x=-1.0, k=e.index.to_series())
    a, b = a[a["k"] % 3 != 0][["x"]], b[b["k"] % 5 == 0][["x"]]
    with tb.option_context("compute.ops_on_diff_frames", True):
        return a.combine_first(b).to_spark("k")


@query("SELECT coalesce(a.k, b.k) AS k, a.x + b.x AS s FROM (SELECT o_orderkey AS k, o_totalprice AS x FROM orders WHERE o_orderkey % 2 = 0) a FULL JOIN (SELECT o_orderkey AS k, o_totalprice AS x FROM orders WHERE o_orderkey % 3 = 0) b ON a.k = b.k")
def align_operands(spark, sf):
    o = orders(spark, sf)
    k = o.index.to_series()
    a, b = o[k % 2 == 0]["o_totalprice"], orders(spark, sf)
    b = b[b.index.to_series() % 3 == 0]["o_totalprice"]
    with tb.option_context("compute.ops_on_diff_frames", True):
        return (a + b).to_frame("s").to_spark("k")


@query("SELECT w AS k, CASE WHEN n_nationkey IS NULL THEN '-1' ELSE n_name END AS n_name, coalesce(n_regionkey, -1) AS n_regionkey FROM (SELECT unnest([3, 1, 99, 7]) AS w) LEFT JOIN nation ON w = n_nationkey")
def reindex(spark, sf):
    n = t(spark, sf, "nation", "n_nationkey")
    out = n.reindex(index=[3, 1, 99, 7], fill_value=-1)
    return out.to_spark("k").select(F.col("k").cast("int"), F.col("n_name").cast("string"), F.col("n_regionkey").cast("int"))


# ---- set operations, duplicates ----------------------------------------------------------------------
@query("SELECT c_custkey AS k, c_nationkey AS nation, c_acctbal AS acctbal, c_mktsegment FROM customer UNION ALL SELECT s_suppkey, s_nationkey, s_acctbal, NULL FROM supplier")
def concat_rows(spark, sf):
    c = t(spark, sf, "customer")[["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"]].rename(columns={"c_custkey": "k", "c_nationkey": "nation", "c_acctbal": "acctbal"})
    s = t(spark, sf, "supplier")[["s_suppkey", "s_nationkey", "s_acctbal"]].rename(columns={"s_suppkey": "k", "s_nationkey": "nation", "s_acctbal": "acctbal"})
    return tb.concat([c, s]).to_spark()


@query("SELECT c_nationkey AS nation FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def concat_rows_inner(spark, sf):
    c = t(spark, sf, "customer").rename(columns={"c_nationkey": "nation"})
    s = t(spark, sf, "supplier").rename(columns={"s_nationkey": "nation"})
    return tb.concat([c, s], join="inner").to_spark()


@query("SELECT n_nationkey AS k, n_name, s.n FROM nation LEFT JOIN (SELECT s_nationkey AS k2, CAST(count(*) AS BIGINT) AS n FROM supplier GROUP BY 1) s ON n_nationkey = k2")
def concat_columns(spark, sf):
    n = t(spark, sf, "nation", "n_nationkey")[["n_name"]]
    c = t(spark, sf, "supplier").groupby("s_nationkey").size().to_frame("n")
    return tb.concat([n, c], axis=1).to_spark("k")


for _kind, _op in (("intersection", "INTERSECT"), ("difference", "EXCEPT")):

    @query(f"SELECT c_nationkey AS k FROM customer WHERE c_nationkey < 15 {_op} SELECT s_nationkey FROM supplier WHERE s_nationkey > 5", f"index_{_kind}")
    def _f(spark, sf, kind=_kind):
        a = t(spark, sf, "customer", "c_nationkey")
        b = t(spark, sf, "supplier", "s_nationkey")
        a, b = a[a.index.to_series() < 15].index, b[b.index.to_series() > 5].index
        return getattr(a, kind)(b).to_frame(name="k").to_spark()


@query("(SELECT k FROM (SELECT c_nationkey AS k FROM customer WHERE c_nationkey < 15) EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey > 5) UNION ALL (SELECT s_nationkey AS k FROM supplier WHERE s_nationkey > 5 EXCEPT SELECT c_nationkey FROM customer WHERE c_nationkey < 15)")
def index_symmetric_difference(spark, sf):
    a, b = t(spark, sf, "customer", "c_nationkey"), t(spark, sf, "supplier", "s_nationkey")
    a, b = a[a.index.to_series() < 15].index, b[b.index.to_series() > 5].index
    return a.symmetric_difference(b).to_frame(name="k").to_spark()


@query("SELECT k FROM (SELECT k, greatest(coalesce(a.n, 0), coalesce(b.n, 0)) AS n FROM (SELECT p_size AS k, count(*) AS n FROM part GROUP BY 1) a FULL JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) b USING (k)), LATERAL (SELECT unnest(range(n)))")
def index_union(spark, sf):
    return t(spark, sf, "part", "p_size").index.union(t(spark, sf, "customer", "c_nationkey").index).to_frame(name="k").to_spark()


for _keep, _test in (("first", "row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1"), ("last", "row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1"), (False, "count(*) OVER (PARTITION BY user_id, event_type) = 1")):

    @query(f"SELECT event_id, user_id, event_type FROM events QUALIFY {_test}", f"drop_duplicates_{_keep or 'none'}")
    def _f(spark, sf, keep=_keep):
        return events(spark, sf)[["user_id", "event_type"]].drop_duplicates(keep=keep).to_spark("event_id")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) > 1 AS dup FROM events")
def duplicated(spark, sf):
    return events(spark, sf).duplicated("user_id").to_frame("dup").to_spark("event_id")


# ---- windows -----------------------------------------------------------------------------------------
@query(f"""SELECT event_id, lag(value) OVER w AS prev, lead(value, 2) OVER w AS next2, round(value - lag(value) OVER w, 6) AS diff, round((value - lag(value) OVER w) / lag(value) OVER w, 6) AS pct
 FROM (SELECT event_id, value * {SCALE}::DOUBLE + 1 AS value FROM events) WINDOW w AS (ORDER BY event_id)""")
def shift_diff_pct(spark, sf):
    e = events(spark, sf)
    v = (e["value"] * SCALE + 1).rename("value")
    out = v.shift(1).to_frame("prev")
    with tb.option_context("compute.ops_on_diff_frames", True):
        return out.assign(next2=v.shift(-2), diff=v.diff().round(6), pct=v.pct_change().round(6)).to_spark("event_id")


@query("SELECT event_id, lag(value, 1) OVER w AS prev, round(value - lag(value) OVER w, 6) AS diff FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def group_shift_diff(spark, sf):
    g = events(spark, sf).groupby("user_id")["value"]
    with tb.option_context("compute.ops_on_diff_frames", True):
        return g.shift(1).to_frame("prev").assign(diff=g.diff().round(6)).to_spark("event_id")


def _cum(name):
    def f(spark, sf):
        s = getattr(holes(events(spark, sf))["v"], name)()
        return s.round(4).to_frame("x").to_spark("event_id")

    return f


for _name, _fun in (("cumsum", "sum"), ("cummin", "min"), ("cummax", "max")):
    query(f"SELECT event_id, CASE WHEN v IS NULL THEN NULL ELSE round({_fun}(v) OVER (ORDER BY event_id), 4) END AS x FROM ({HOLES})", _name)(_cum(_name))


@query("SELECT event_id, round(product(1 + value / 1e7) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING), 6) AS x FROM events")
def cumprod(spark, sf):
    e = events(spark, sf)
    return (1 + e["value"] / 1e7).cumprod().round(6).to_frame("x").to_spark("event_id")


@query(f"SELECT event_id, CASE WHEN v IS NULL THEN NULL ELSE round(sum(v) OVER (PARTITION BY user_id ORDER BY event_id), 4) END AS total, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM ({HOLES})")
def group_cumsum_cumcount(spark, sf):
    g = holes(events(spark, sf)).groupby("user_id")
    with tb.option_context("compute.ops_on_diff_frames", True):
        return g["v"].cumsum().round(4).to_frame("total").assign(n=g.cumcount()).to_spark("event_id")


RANKS = {"average": "rank() OVER w + (count(*) OVER (PARTITION BY c_nationkey) - 1) / 2.0", "min": "rank() OVER w", "max": "rank() OVER w + count(*) OVER (PARTITION BY c_nationkey) - 1", "dense": "dense_rank() OVER w", "first": "row_number() OVER (ORDER BY c_nationkey, c_custkey)"}
for _name, _sql in RANKS.items():

    @query(f"SELECT c_custkey, CAST({_sql} AS DOUBLE) AS r FROM customer WINDOW w AS (ORDER BY c_nationkey)", f"rank_{_name}")
    def _f(spark, sf, method=_name):
        return t(spark, sf, "customer", "c_custkey", "c_custkey")["c_nationkey"].rank(method).to_frame("r").to_spark("c_custkey")


@query("SELECT c_custkey, CAST(rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey DESC) + (count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) - 1) / 2.0 AS DOUBLE) AS r FROM customer")
def group_rank(spark, sf):
    c = t(spark, sf, "customer", "c_custkey", "c_custkey")
    return c.groupby("c_mktsegment")["c_nationkey"].rank(ascending=False).to_frame("r").to_spark("c_custkey")


WINDOW_SQL = {"count": "count(v)", "sum": "sum(v)", "min": "min(v)", "max": "max(v)", "mean": "avg(v)", "std": "stddev_samp(v)", "var": "var_samp(v)"}
DIGITS = {"sum": 4, "var": 4}
for _name, _sql in WINDOW_SQL.items():
    _d = DIGITS.get(_name, 7)
    _gate = "" if _name == "count" else "CASE WHEN count(v) OVER w >= 2 THEN "

    @query(f"SELECT event_id, {_gate}round(CAST({_sql} OVER w AS DOUBLE), {_d}) {'END' if _gate else ''} AS x FROM ({HOLES}) WINDOW w AS (ORDER BY event_id ROWS 4 PRECEDING)", f"rolling_{_name}")
    def _f(spark, sf, name=_name):
        r = holes(events(spark, sf))["v"].rolling(5, 2)
        return getattr(r, name)().round(DIGITS.get(name, 7)).to_frame("x").to_spark("event_id")

    @query(f"SELECT event_id, {_gate}round(CAST({_sql} OVER w AS DOUBLE), {_d}) {'END' if _gate else ''} AS x FROM ({HOLES}) WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS 2 PRECEDING)", f"group_rolling_{_name}")
    def _g(spark, sf, name=_name):
        r = holes(events(spark, sf)).groupby("user_id")["v"].rolling(3, 2)
        return getattr(r, name)().round(DIGITS.get(name, 7)).to_frame("x").to_spark("event_id")

    _few = "count(*)" if _name == "count" else "count(v)"

    @query(f"SELECT event_id, CASE WHEN {_few} OVER w >= 3 THEN round(CAST({_sql} OVER w AS DOUBLE), {_d}) END AS x FROM ({HOLES}) WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING)", f"expanding_{_name}")
    def _h(spark, sf, name=_name):
        r = holes(events(spark, sf))["v"].expanding(3)
        return getattr(r, name)().round(DIGITS.get(name, 7)).to_frame("x").to_spark("event_id")


@query(f"SELECT event_id, round(avg(v) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING), 7) AS x FROM ({HOLES})")
def group_expanding_mean(spark, sf):
    return holes(events(spark, sf)).groupby("event_type")["v"].expanding(1).mean().round(7).to_frame("x").to_spark("event_id")


# ---- missing values ----------------------------------------------------------------------------------
@query(f"SELECT event_id, last_value(v IGNORE NULLS) OVER (ORDER BY event_id) AS f, first_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b, last_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS 1 PRECEDING) AS f1 FROM ({HOLES})")
def ffill_bfill(spark, sf):
    v = holes(events(spark, sf))["v"]
    with tb.option_context("compute.ops_on_diff_frames", True):
        return v.ffill().to_frame("f").assign(b=v.bfill(), f1=v.ffill(limit=1)).to_spark("event_id")


@query(f"SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS f FROM ({HOLES})")
def group_ffill(spark, sf):
    return holes(events(spark, sf)).groupby("user_id")["v"].ffill().to_frame("f").to_spark("event_id")


@query(f"SELECT event_id, coalesce(v, -1) AS filled, CASE WHEN v < 50 THEN 50 WHEN v > 100 THEN 100 ELSE v END AS clipped, CASE event_type WHEN 'view' THEN 'seen' WHEN 'error' THEN 'bad' ELSE event_type END AS kind, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 END AS code FROM ({HOLES})")
def fillna_clip_replace_map(spark, sf):
    e = holes(events(spark, sf))
    e = e.assign(filled=e["v"].fillna(-1.0), clipped=e["v"].clip(50.0, 100.0), kind=e["event_type"].replace({"view": "seen", "error": "bad"}), code=e["event_type"].map({"view": 1, "click": 2}))
    return e[["filled", "clipped", "kind", "code"]].to_spark("event_id")


@query(f"SELECT event_id, v FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN value END AS u FROM ({HOLES})) WHERE (v IS NOT NULL)::INT + (u IS NOT NULL)::INT >= 1")
def dropna_thresh(spark, sf):
    e = holes(events(spark, sf))
    e["u"] = e["value"].where(e.index.to_series() % 2 == 0)
    return e[["v", "u"]].dropna(thresh=1)[["v"]].to_spark("event_id")


# ---- sort, top, rows ---------------------------------------------------------------------------------
@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def nlargest(spark, sf):
    return orders(spark, sf).nlargest(10, "o_totalprice")[["o_totalprice"]].to_spark("o_orderkey")


@query("SELECT o_orderkey, o_orderdate::VARCHAR AS d FROM orders ORDER BY o_orderpriority, o_totalprice DESC LIMIT 20")
def sort_values_head(spark, sf):
    o = orders(spark, sf).sort_values(["o_orderpriority", "o_totalprice"], ascending=[True, False]).head(20)
    o["d"] = o["o_orderdate"].dt.strftime("%Y-%m-%d %H:%M:%S")
    return o[["d"]].to_spark("o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 7")
def tail(spark, sf):
    return orders(spark, sf).tail(7)[["o_totalprice"]].to_spark("o_orderkey")


@query("SELECT event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 3")
def group_head(spark, sf):
    return events(spark, sf).groupby("event_type").head(3)[["event_type", "value"]].to_spark("event_id")


@query("SELECT event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) <= 4")
def group_nlargest(spark, sf):
    return events(spark, sf).groupby("event_type")["value"].nlargest(4).to_frame("value").to_spark(["event_type", "event_id"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 10 AND 40")
def loc_slice(spark, sf):
    return orders(spark, sf).loc[10:40][["o_totalprice"]].to_spark("o_orderkey")


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders) WHERE p >= 5 AND p < 50 AND (p - 5) % 4 = 0")
def iloc_slice(spark, sf):
    return orders(spark, sf).iloc[5:50:4][["o_custkey"]].to_spark("o_orderkey")


@query("SELECT event_id, value FROM events WHERE ts::TIME BETWEEN TIME '08:00:00' AND TIME '09:30:00'")
def between_time(spark, sf):
    e = t(spark, sf, "events").set_index("ts")
    return e.between_time("08:00:00", "09:30:00")[["event_id", "value"]].to_spark()


@query("SELECT event_id FROM events WHERE ts < (SELECT min(ts) FROM events) + INTERVAL 2 DAY")
def first_offset(spark, sf):
    return t(spark, sf, "events").set_index("ts").first("2D")[["event_id"]].to_spark()


@query("SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS BIGINT) AS p FROM customer")
def default_index_sequence(spark, sf):
    c = t(spark, sf, "customer", None, "c_custkey").sort_values("c_acctbal")
    with tb.option_context("compute.default_index_type", "distributed-sequence"):
        return c[["c_custkey"]].reset_index(drop=True).to_spark("p")


# ---- reshaping ---------------------------------------------------------------------------------------
@query("SELECT p_partkey, 'p_size' AS variable, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
def melt(spark, sf):
    p = t(spark, sf, "part").astype({"p_size": "float"})
    return p.melt("p_partkey", ["p_size", "p_retailprice"]).to_spark()


@query("SELECT l_returnflag, round(avg(l_quantity) FILTER (l_linestatus = 'F'), 5) AS F, round(avg(l_quantity) FILTER (l_linestatus = 'O'), 5) AS O FROM lineitem GROUP BY 1")
def pivot_table(spark, sf):
    out = t(spark, sf, "lineitem").pivot_table("l_quantity", "l_returnflag", "l_linestatus", "mean")
    return out.round(5).to_spark("l_returnflag")


@query("SELECT n_nationkey AS k, 'a' AS label, CAST(n_regionkey AS DOUBLE) AS v FROM nation UNION ALL SELECT n_nationkey, 'b', n_nationkey * 1.0 FROM nation WHERE n_nationkey % 2 = 0")
def stack(spark, sf):
    n = t(spark, sf, "nation", "n_nationkey")
    k = n.index.to_series()
    n = n.assign(a=n["n_regionkey"].astype("float"), b=(k * 1.0).where(k % 2 == 0))[["a", "b"]]
    return n.stack().to_frame("v").to_spark(["k", "label"])


@query("SELECT user_id, CAST(count(*) FILTER (event_type = 'click') AS BIGINT) AS click, CAST(count(*) FILTER (event_type = 'view') AS BIGINT) AS view FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def unstack(spark, sf):
    e = events(spark, sf)
    out = e[e["event_type"].isin(["click", "view"])].groupby(["user_id", "event_type"]).size().unstack()
    return out.fillna(0).to_spark("user_id")


@query("SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings")
def explode(spark, sf):
    e = t(spark, sf, "embeddings", "vec_id")[["embedding"]].explode("embedding").rename(columns={"embedding": "x"})
    return e.astype({"x": "double"}).to_spark("vec_id")


@query("SELECT o_orderkey, (o_orderstatus = 'F')::INT AS s_F, (o_orderstatus = 'O')::INT AS s_O, (o_orderstatus = 'P')::INT AS s_P FROM orders")
def get_dummies(spark, sf):
    o = orders(spark, sf)[["o_orderstatus"]]
    return tb.get_dummies(o, prefix="s", dtype="int").to_spark("o_orderkey")


@query("SELECT r_name AS label, CAST(r_regionkey AS BIGINT) AS n FROM region")
def transpose_small(spark, sf):
    r = t(spark, sf, "region", "r_name")[["r_regionkey"]].astype("int")
    return r.T.T.rename(columns={"r_regionkey": "n"}).to_spark("label")


# ---- functions in batches, SQL, plots ----------------------------------------------------------------
@query("SELECT event_id, value * 2 AS twice, length(event_type) AS n FROM events")
def map_in_pandas(spark, sf):
    return t(spark, sf, "events")[["event_id", "event_type", "value"]].map_in_pandas(lambda p: p.assign(twice=p["value"] * 2, n=p["event_type"].str.len())[["event_id", "twice", "n"]], "event_id long, twice double, n long").to_spark()


@query("SELECT event_type, round(max(value) - min(value), 6) AS spread FROM events GROUP BY 1")
def group_apply(spark, sf):
    import pandas as pd

    g = events(spark, sf).groupby("event_type")["value"]
    return g.apply(lambda s: pd.DataFrame({"spread": [round(s.max() - s.min(), 6)]}), schema="spread double").to_spark("event_type")


@query("SELECT event_id, round(value - avg(value) OVER (PARTITION BY event_type), 5) AS centred FROM events")
def group_transform(spark, sf):
    g = events(spark, sf).groupby("event_type")["value"]
    return g.transform(lambda s: s - s.mean(), schema="value double").round(5).to_frame("centred").to_spark("event_id")


@query("SELECT event_id, user_id FROM events QUALIFY sum(value) OVER (PARTITION BY user_id) > 5000")
def group_filter(spark, sf):
    e = events(spark, sf).assign(u=lambda f: f["user_id"])
    return e.groupby("u").filter(lambda p: p["value"].sum() > 5000)[["user_id"]].to_spark("event_id")


@query("SELECT event_id, CAST(length(event_type) AS BIGINT) * 10 AS n FROM events")
def series_apply(spark, sf):
    def tens(x) -> int:
        return len(x) * 10

    return events(spark, sf)["event_type"].apply(tens).to_frame("n").to_spark("event_id")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE') AND n_nationkey < 20")
def sql_parameters(spark, sf):
    n, r = t(spark, sf, "nation"), t(spark, sf, "region")
    return tb.sql("SELECT n_name, r_name FROM {n} JOIN {r} ON n_regionkey = r_regionkey WHERE r_name IN {names} AND n_nationkey < {most}", n=n, r=r, names=["ASIA", "EUROPE"], most=20).to_spark()


@query("SELECT CAST(least(floor((value - lo) / ((hi - lo) / 8)), 7) AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events) GROUP BY 1")
def hist_bins(spark, sf):
    e = events(spark, sf)
    low, high = e.df.agg(F.min("value"), F.max("value")).first()
    return e.assign(bin=tb.Series(e, S.bucket_of(e["value"].col, low, high, 8), "bin")).groupby("bin").size().to_frame("n").to_spark("bin")


@query("SELECT round(quantile_cont(value, 0.25), 5) AS q1, round(median(value), 5) AS med, round(quantile_cont(value, 0.75), 5) AS q3 FROM events")
def box_stats(spark, sf):
    e = events(spark, sf)
    q = e["value"].quantile([0.25, 0.5, 0.75]).to_pandas().round(5).tolist()
    return spark.createDataFrame([tuple(q)], "q1 double, med double, q3 double")


@query("SELECT user_id, max_by(value, event_id) AS v FROM events WHERE event_id <= 500 GROUP BY 1")
def group_asof(spark, sf):
    e = events(spark, sf)
    return e[e.index.to_series() <= 500].groupby("user_id").agg(v=("value", "last")).to_spark("user_id")


@query("SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS code FROM part")
def factorize(spark, sf):
    codes, _ = t(spark, sf, "part", "p_partkey", "p_partkey")["p_brand"].factorize()
    return codes.to_frame("code").to_spark("p_partkey")


@query("SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'PROMO' THEN 1 ELSE -1 END AS code FROM part")
def categorical_codes(spark, sf):
    import pandas as pd

    p = t(spark, sf, "part", "p_partkey")
    return p["p_type"].astype(pd.CategoricalDtype(["ECONOMY", "PROMO"])).cat.codes.to_frame("code").to_spark("p_partkey")


@query()
def sample(spark, sf):
    return events(spark, sf).sample(frac=0.1, random_state=3).to_spark("event_id")


@query("SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY 1")
def write_and_read_back(spark, sf):
    """A Parquet sink partitioned by a column, and its source, in the shared folder."""
    from .plans.ordered import shared_path

    path = shared_path(spark)
    t(spark, sf, "customer").to_parquet(path, partition_cols="c_mktsegment")
    return tb.read_parquet(path).groupby("c_mktsegment").size().to_frame("n").to_spark("c_mktsegment")


# ---- scalar functions, one query for each -------------------------------------------------------------
STRINGS = {
    "lower": (lambda s: s.str.lower(), "lower(x)"),
    "upper": (lambda s: s.str.upper(), "upper(x)"),
    "capitalize": (lambda s: s.str.capitalize(), "upper(x[1]) || lower(x[2:])"),
    "title": (lambda s: s.str.title(), "array_to_string(list_transform(string_split(x, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"),
    "swapcase": (lambda s: s.str.swapcase(), "upper(x)"),
    "startswith": (lambda s: s.str.startswith("large"), "starts_with(x, 'large')"),
    "endswith": (lambda s: s.str.endswith("bolt"), "ends_with(x, 'bolt')"),
    "strip": (lambda s: s.str.strip("colt"), "trim(x, 'colt')"),
    "lstrip": (lambda s: s.str.lstrip("scl"), "ltrim(x, 'scl')"),
    "rstrip": (lambda s: s.str.rstrip("tegd"), "rtrim(x, 'tegd')"),
    "get": (lambda s: s.str.get(2), "x[3]"),
    "len": (lambda s: s.str.len(), "length(x)"),
    "isalpha": (lambda s: s.str.isalpha(), "regexp_full_match(x, '[A-Za-z]+')"),
    "isdigit": (lambda s: s.str.isdigit(), "regexp_full_match(x, '[0-9]+')"),
    "isalnum": (lambda s: s.str.isalnum(), "regexp_full_match(x, '[A-Za-z0-9]+')"),
    "isspace": (lambda s: s.str.isspace(), "regexp_full_match(x, '\\s+')"),
    "islower": (lambda s: s.str.islower(), "x = lower(x)"),
    "isupper": (lambda s: s.str.isupper(), "false"),
    "istitle": (lambda s: s.str.title().str.istitle(), "true"),
    "center": (lambda s: s.str.center(20, "*"), "repeat('*', (20 - length(x)) // 2) || x || repeat('*', 20 - length(x) - (20 - length(x)) // 2)"),
    "ljust": (lambda s: s.str.ljust(20, "."), "rpad(x, 20, '.')"),
    "rjust": (lambda s: s.str.rjust(20, "."), "lpad(x, 20, '.')"),
    "pad": (lambda s: s.str.pad(18), "lpad(x, 18, ' ')"),
    "zfill": (lambda s: s.str.zfill(16), "lpad(x, 16, '0')"),
    "contains": (lambda s: s.str.contains("[bc]ol"), "regexp_matches(x, '[bc]ol')"),
    "match": (lambda s: s.str.match("[a-l]"), "regexp_matches(x, '^[a-l]')"),
    "count": (lambda s: s.str.count("l"), "length(x) - length(replace(x, 'l', ''))"),
    "find": (lambda s: s.str.find("l"), "instr(x, 'l') - 1"),
    "rfind": (lambda s: s.str.rfind("l"), "CASE WHEN instr(x, 'l') = 0 THEN -1 ELSE length(x) - instr(reverse(x), 'l') END"),
    "findall": (lambda s: s.str.findall("[aeiou]").str.join("-"), "array_to_string(regexp_extract_all(x, '[aeiou]'), '-')"),
    "repeat": (lambda s: s.str.repeat(2), "repeat(x, 2)"),
    "replace": (lambda s: s.str.replace("[aeiou]", "_"), "regexp_replace(x, '[aeiou]', '_', 'g')"),
    "slice": (lambda s: s.str.slice(1, 4), "x[2:4]"),
    "slice_replace": (lambda s: s.str.slice_replace(1, 3, "##"), "x[1:1] || '##' || x[4:]"),
    "split": (lambda s: s.str.split(" ").str.join("|"), "replace(x, ' ', '|')"),
    "rsplit": (lambda s: s.str.rsplit(" ", 1).str.join("|"), "replace(x, ' ', '|')"),
    "partition": (lambda s: s.str.partition(" ").str.join("|"), "split_part(x, ' ', 1) || '| |' || split_part(x, ' ', 2)"),
    "rpartition": (lambda s: s.str.rpartition(" ").str.join("|"), "split_part(x, ' ', 1) || '| |' || split_part(x, ' ', 2)"),
    "translate": (lambda s: s.str.translate({"a": "4", "e": "3"}), "translate(x, 'ae', '43')"),
    "wrap": (lambda s: s.str.wrap(6), "replace(x, ' ', chr(10))"),
}
for _name, (_fun, _sql) in STRINGS.items():

    @query(f"SELECT p_partkey, {_sql} AS y FROM (SELECT p_partkey, p_name AS x FROM part)", f"str_{_name}")
    def _f(spark, sf, fun=_fun):
        return fun(t(spark, sf, "part", "p_partkey")["p_name"]).to_frame("y").to_spark("p_partkey")


DATES = {
    "year": "year(x)", "month": "month(x)", "day": "day(x)", "hour": "hour(x)", "minute": "minute(x)", "second": "second(x)", "microsecond": "microsecond(x) % 1000000", "week": "week(x)", "dayofweek": "isodow(x) - 1",
    "weekday": "isodow(x) - 1", "dayofyear": "dayofyear(x)", "quarter": "quarter(x)", "is_month_start": "day(x) = 1", "is_month_end": "x::DATE = last_day(x)", "is_quarter_start": "x::DATE = date_trunc('quarter', x)::DATE",
    "is_quarter_end": "x::DATE = last_day(x) AND month(x) % 3 = 0", "is_year_start": "dayofyear(x) = 1", "is_year_end": "month(x) = 12 AND day(x) = 31", "is_leap_year": "dayofyear(make_date(year(x), 12, 31)) = 366", "days_in_month": "day(last_day(x))", "date": "x::DATE",
}
DATE_CALLS = {
    "day_name": (lambda s: s.dt.day_name(), "dayname(x)"), "month_name": (lambda s: s.dt.month_name(), "monthname(x)"), "strftime": (lambda s: s.dt.strftime("%Y/%m/%d %H:%M"), "strftime(x, '%Y/%m/%d %H:%M')"),
    "normalize": (lambda s: s.dt.normalize().dt.strftime("%Y-%m-%d %H"), "strftime(date_trunc('day', x), '%Y-%m-%d %H')"), "floor": (lambda s: s.dt.floor("15min").dt.strftime("%d %H:%M:%S"), "strftime(time_bucket(INTERVAL 15 MINUTE, x), '%d %H:%M:%S')"),
    "ceil": (lambda s: s.dt.ceil("H").dt.strftime("%d %H:%M:%S"), "strftime(CASE WHEN x = date_trunc('hour', x) THEN x ELSE date_trunc('hour', x) + INTERVAL 1 HOUR END, '%d %H:%M:%S')"),
    "round": (lambda s: s.dt.round("H").dt.strftime("%d %H:%M:%S"), "strftime(date_trunc('hour', x + INTERVAL 30 MINUTE), '%d %H:%M:%S')"),
}
for _name, _sql in DATES.items():

    @query(f"SELECT event_id, {_sql} AS y FROM (SELECT event_id, ts + INTERVAL (event_id * 7) HOUR AS x FROM events)", f"dt_{_name}")
    def _f(spark, sf, name=_name):
        e = events(spark, sf)
        shifted = tb.Series(e, F.timestamp_micros(F.unix_micros(e["ts"].col.cast("timestamp")) + e.index._cols[0] * 7 * 3_600_000_000).cast("timestamp_ntz"), "x")
        return getattr(shifted.dt, name).to_frame("y").to_spark("event_id")


for _name, (_fun, _sql) in DATE_CALLS.items():

    @query(f"SELECT event_id, {_sql} AS y FROM (SELECT event_id, ts AS x FROM events)", f"dt_{_name}")
    def _f(spark, sf, fun=_fun):
        return fun(events(spark, sf)["ts"]).to_frame("y").to_spark("event_id")


UNARY = {
    "abs": "abs(x)", "arccos": "acos(x / 1000)", "arccosh": "acosh(1 + x)", "arcsin": "asin(x / 1000)", "arcsinh": "asinh(x)", "arctan": "atan(x)", "arctanh": "atanh(x / 1000)", "cbrt": "cbrt(x)", "ceil": "ceil(x)", "cos": "cos(x)", "cosh": "cosh(x / 1000)",
    "deg2rad": "radians(x)", "degrees": "degrees(x)", "exp": "exp(x / 1000)", "exp2": "power(2, x / 1000)", "expm1": "exp(x / 1000) - 1", "fabs": "abs(x)", "floor": "floor(x)", "isfinite": "true", "isinf": "false", "isnan": "false", "log": "ln(1 + x)", "log10": "log10(1 + x)",
    "log1p": "ln(1 + x)", "log2": "log2(1 + x)", "negative": "-x", "positive": "x", "rad2deg": "degrees(x)", "radians": "radians(x)", "reciprocal": "1 / (1 + x)", "rint": "round_even(x, 0)", "sign": "CAST(sign(x) AS DOUBLE)", "sin": "sin(x)", "sinh": "sinh(x / 1000)", "sqrt": "sqrt(x)", "square": "x * x",
    "tan": "tan(x / 1000)", "tanh": "tanh(x / 1000)", "trunc": "trunc(x)",
}
SMALL = ("arccos", "arcsin", "arctanh", "cosh", "exp", "exp2", "expm1", "sinh", "tan", "tanh")
PLUS = ("arccosh", "log", "log10", "log2", "reciprocal")
for _name, _sql in UNARY.items():
    _bool = _name in ("isfinite", "isinf", "isnan")

    @query(f"SELECT event_id, {_sql if _bool else f'round(CAST({_sql} AS DOUBLE), 6)'} AS y FROM (SELECT event_id, value AS x FROM events)", f"ufunc_{_name}")
    def _f(spark, sf, name=_name, boolean=_bool):
        x = events(spark, sf)["value"]
        x = x / 1000 if name in SMALL else x + 1 if name in PLUS else x
        y = getattr(np, name)(x)
        return (y if boolean else y.astype("float").round(6)).to_frame("y").to_spark("event_id")


BINARY = {
    "arctan2": "atan2(a, b)", "copysign": "a", "floor_divide": "floor(a / b)", "fmax": "greatest(a, b)", "fmin": "least(a, b)", "fmod": "a - b * trunc(a / b)", "hypot": "sqrt(a * a + b * b)", "maximum": "greatest(a, b)", "minimum": "least(a, b)",
    "power": "power(a, 2)", "float_power": "power(a, 2)", "true_divide": "a / b", "logaddexp": "greatest(a, b) + ln(1 + exp(-abs(a - b)))", "heaviside": "CASE WHEN a < 0 THEN 0 WHEN a > 0 THEN 1 ELSE b END",
}
for _name, _sql in BINARY.items():

    @query(f"SELECT event_id, round(CAST({_sql} AS DOUBLE), 5) AS y FROM (SELECT event_id, value * {SCALE}::DOUBLE AS a, CAST(user_id AS DOUBLE) + 1 AS b FROM events)", f"ufunc_{_name}")
    def _f(spark, sf, name=_name):
        e = events(spark, sf)
        a, b = e["value"] * SCALE, e["user_id"].astype("float") + 1
        y = getattr(np, name)(a, 2 if name in ("power", "float_power") else b)
        return y.astype("float").round(5).to_frame("y").to_spark("event_id")


for _name, _sql in {"bitwise_and": "a & b", "bitwise_or": "a | b", "bitwise_xor": "xor(a, b)", "gcd": "gcd(a, b)", "lcm": "lcm(a, b)", "left_shift": "a << 2", "right_shift": "a >> 2"}.items():

    @query(f"SELECT event_id, CAST({_sql} AS BIGINT) AS y FROM (SELECT event_id, event_id + 1 AS a, user_id + 1 AS b FROM events)", f"ufunc_{_name}")
    def _f(spark, sf, name=_name):
        e = events(spark, sf)
        a, b = e.index.to_series() + 1, e["user_id"] + 1
        return getattr(np, name)(a, 2 if "shift" in name else b).astype("int").to_frame("y").to_spark("event_id")

from . import interface_queries as _interface_queries  # noqa: E402, F401  registers its queries too
