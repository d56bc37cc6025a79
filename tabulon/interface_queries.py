"""Queries over the rest of the interface: named operators, index and category methods, sources and sinks, plot data.

Single values are returned as rows (name, value) with the value as text.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from . import api as tb
from . import plot
from .plans.ordered import shared_path
from .queries import events, holes, orders, query, t


def facts(spark, **values):
    shown = {k: str(v).lower() if isinstance(v, (bool, np.bool_)) else str(v) for k, v in values.items()}
    return spark.createDataFrame(list(shown.items()), "name string, value string")


def fact_sql(source: str, **values) -> str:
    """(name, value) rows of aggregates over one source."""
    return " UNION ALL ".join(f"SELECT DISTINCT '{k}' AS name, CAST({v} AS VARCHAR) AS value FROM {source}" for k, v in values.items())


def rounded_text(x: float | None, digits: int) -> str | None:
    """The text that SQL gives for round(x, digits): half away from zero, no exponent below 1e16."""
    scale = 10.0**digits
    if x is None or not math.isfinite(x * scale):
        return None if x is None else str(x)
    whole = math.floor(abs(x) * scale)
    return str(math.copysign((whole + (abs(x) * scale - whole >= 0.5)) / scale, x))


# ---- named arithmetic and comparisons ------------------------------------------------------------------
SMALL = "(SELECT o_orderkey, (o_custkey % 9 + 1)::DOUBLE AS b FROM orders)"


def small(spark, sf):
    o = orders(spark, sf)
    return o.assign(b=(o["o_custkey"] % 9 + 1).astype("float"))[["b"]]


NAMED = {
    "add": (3, "b + 3"), "radd": (3, "3 + b"), "sub": (3, "b - 3"), "rsub": (3, "3 - b"), "mul": (3, "b * 3"), "rmul": (3, "3 * b"), "div": (4, "b / 4"), "rdiv": (4, "4 / b"), "truediv": (8, "b / 8"), "rtruediv": (8, "8 / b"),
    "floordiv": (3, "floor(b / 3)"), "rfloordiv": (30, "floor(30 / b)"), "mod": (3, "b % 3"), "rmod": (30, "30 % b"), "pow": (2, "power(b, 2)"), "rpow": (2, "power(2, b)"), "multiply": (5, "b * 5"), "subtract": (5, "b - 5"), "divide": (2, "b / 2"),
}
COMPARED = {"eq": "b = 3", "ne": "b <> 3", "lt": "b < 3", "le": "b <= 3", "gt": "b > 3", "ge": "b >= 3"}
_NAMED_SQL = "SELECT o_orderkey, " + ", ".join(f"CAST({s} AS DOUBLE) AS y_{n}" for n, (_, s) in NAMED.items()) + ", " + ", ".join(f"{s} AS y_{n}" for n, s in COMPARED.items()) + f" FROM {SMALL}"


@query(_NAMED_SQL)
def frame_named_operators(spark, sf):
    f = small(spark, sf)
    made = [f.add(3), f.radd(3), f.sub(3), f.rsub(3), f.mul(3), f.rmul(3), f.div(4), f.rdiv(4), f.truediv(8), f.rtruediv(8), f.floordiv(3), f.rfloordiv(30), f.mod(3), f.rmod(30), f.pow(2), f.rpow(2), f.multiply(5), f.subtract(5), f.divide(2)]
    made += [f.eq(3), f.ne(3), f.lt(3), f.le(3), f.gt(3), f.ge(3)]
    return f.assign(**{f"y_{n}": x["b"] for n, x in zip([*NAMED, *COMPARED], made)}).drop(columns=["b"]).to_spark("o_orderkey")


@query(_NAMED_SQL)
def series_named_operators(spark, sf):
    f = small(spark, sf)
    b = f["b"]
    made = [b.add(3), b.radd(3), b.sub(3), b.rsub(3), b.mul(3), b.rmul(3), b.div(4), b.rdiv(4), b.truediv(8), b.rtruediv(8), b.floordiv(3), b.rfloordiv(30), b.mod(3), b.rmod(30), b.pow(2), b.rpow(2), b.multiply(5), b.subtract(5), b.divide(2)]
    made += [b.eq(3), b.ne(3), b.lt(3), b.le(3), b.gt(3), b.ge(3)]
    return f.assign(**{f"y_{n}": x for n, x in zip([*NAMED, *COMPARED], made)}).drop(columns=["b"]).to_spark("o_orderkey")


_DUNDER_SQL = f"""SELECT o_orderkey, b + 3 AS a1, 3 + b AS a2, b - 3 AS a3, 3 - b AS a4, b * 3 AS a5, 3 * b AS a6, b / 4 AS a7, 4 / b AS a8, floor(b / 3) AS a9, floor(30 / b) AS a10, b % 3 AS a11, 30 % b AS a12,
 power(b, 2) AS a13, power(2, b) AS a14, abs(b) AS a15, -b AS a16, b = 3 AS c1, b <> 3 AS c2, b < 3 AS c3, b <= 3 AS c4, b > 3 AS c5, b >= 3 AS c6 FROM {SMALL}"""


def _dunders(x):
    made = [x + 3, 3 + x, x - 3, 3 - x, x * 3, 3 * x, x / 4, 4 / x, x // 3, 30 // x, x % 3, 30 % x, x**2, 2**x, abs(x), -x]
    return dict(zip([f"a{i + 1}" for i in range(16)], made)) | {"c1": x == 3, "c2": x != 3, "c3": x < 3, "c4": x <= 3, "c5": x > 3, "c6": x >= 3}


@query(_DUNDER_SQL)
def frame_operators(spark, sf):
    f = small(spark, sf)
    return f.assign(**{k: v["b"] for k, v in _dunders(f).items()}).drop(columns=["b"]).to_spark("o_orderkey")


@query(_DUNDER_SQL)
def series_operators(spark, sf):
    f = small(spark, sf)
    return f.assign(**_dunders(f["b"])).drop(columns=["b"]).to_spark("o_orderkey")


@query("SELECT o_orderkey, floor(k / 7) AS q, k % 7 AS r, floor(1000 / k) AS rq, 1000 % k AS rr, NOT (k > 500) AS inv, k > 10 AND k < 900 AS both_, k < 10 OR k > 900 AS either FROM (SELECT o_orderkey, (o_custkey + 1)::DOUBLE AS k FROM orders)")
def series_divmod_logic(spark, sf):
    o = orders(spark, sf)
    k = (o["o_custkey"] + 1).astype("float")
    (q, r), (rq, rr) = k.divmod(7), k.rdivmod(1000)
    return o.assign(q=q, r=r, rq=rq, rr=rr, inv=~(k > 500), both_=(k > 10) & (k < 900), either=(k < 10) | (k > 900))[["q", "r", "rq", "rr", "inv", "both_", "either"]].to_spark("o_orderkey")


@query("SELECT event_id, coalesce(a, 0) + coalesce(b, 0) AS s, coalesce(a, 1) * coalesce(b, 1) AS m FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN value END AS a, CASE WHEN event_id % 3 <> 0 THEN value END AS b FROM events) WHERE a IS NOT NULL OR b IS NOT NULL")
def fill_value_operands(spark, sf):
    e = events(spark, sf)
    k = e.index.to_series()
    e = e.assign(a=e["value"].where(k % 2 == 0), b=e["value"].where(k % 3 != 0)).dropna(how="all", subset=["a", "b"])
    return e.assign(s=e["a"].add(e["b"], fill_value=0.0), m=e["a"].mul(e["b"], fill_value=1.0))[["s", "m"]].to_spark("event_id")


@query("SELECT c_custkey, -(c_custkey + 0) AS neg FROM (SELECT abs(c_custkey - 100) AS c_custkey FROM customer)")
def index_arithmetic(spark, sf):
    i = abs(t(spark, sf, "customer", "c_custkey").index - 100)
    return i.to_frame(name="c_custkey").assign(neg=lambda f: -f["c_custkey"]).to_spark()


@query("SELECT event_id, CASE WHEN v IS NULL THEN NULL ELSE (v + w) END AS total FROM (SELECT event_id, value AS v, user_id * 2.0 AS w FROM events)")
def frame_dot(spark, sf):
    e = events(spark, sf)
    f = e.assign(v=e["value"], w=e["user_id"] * 1.0)[["v", "w"]]
    return f.assign(total=f.dot(pd.Series({"v": 1.0, "w": 2.0})))[["total"]].to_spark("event_id")


@query(fact_sql("events", dot="round(sum(value * user_id), 4)", matmul="round(sum(value * value), 4)"))
def series_dot(spark, sf):
    e = events(spark, sf)
    v, u = e["value"], e["user_id"].astype("float")
    rows = [("dot", rounded_text(v.dot(u), 4)), ("matmul", rounded_text(v @ v, 4))]
    return spark.createDataFrame(rows, "name string, value string")


@query("SELECT c_custkey, upper(c_name) AS c_name, c_nationkey + 1 AS n FROM customer")
def frame_applymap_pipe(spark, sf):
    c = t(spark, sf, "customer", "c_custkey")

    def grown(x: int) -> int:
        return x + 1

    f = c[["c_nationkey"]].astype("int").applymap(grown).pipe(lambda x: x.rename(columns={"c_nationkey": "n"}))
    with tb.option_context("compute.ops_on_diff_frames", True):
        return c.assign(c_name=c["c_name"].str.upper())[["c_name"]].join(f).to_spark("c_custkey")


# ---- reducers across columns, with missing values kept -------------------------------------------------
ACROSS = "(SELECT event_id, v, value * 2 AS w, user_id * 1.0 AS u FROM (SELECT *, CASE WHEN event_id % 7 < 3 THEN NULL ELSE value END AS v FROM events))"


def wide(spark, sf):
    e = events(spark, sf)
    return e.assign(v=e["value"].mask(e.index.to_series() % 7 < 3), w=e["value"] * 2, u=e["user_id"] * 1.0)[["v", "w", "u"]]


@query(f"""SELECT event_id, round(list_sum([v, w, u]), 6) AS s, round(list_avg([v, w, u]), 6) AS mean, list_min([v, w, u]) AS low, list_max([v, w, u]) AS high, CAST(list_count([v, w, u]) AS BIGINT) AS n,
 round(list_median([v, w, u]), 6) AS med, round(list_var_samp([v, w, u]), 4) AS var, round(list_stddev_samp([v, w, u]), 6) AS sd, round(list_stddev_samp([v, w, u]) / sqrt(list_count([v, w, u])), 6) AS se,
 CASE WHEN v IS NOT NULL THEN round(v + w + u, 6) END AS strict, CASE WHEN list_count([v, w, u]) >= 3 THEN round(v + w + u, 6) END AS enough FROM {ACROSS}""")
def mean_axis1(spark, sf):
    f = wide(spark, sf)
    r = {"s": f.sum(axis=1), "mean": f.mean(axis=1), "low": f.min(axis=1), "high": f.max(axis=1), "n": f.count(axis=1), "med": f.median(axis=1), "var": f.var(axis=1), "sd": f.std(axis=1), "se": f.sem(axis=1)}
    r |= {"strict": f.sum(axis=1, skipna=False), "enough": f.sum(axis=1, min_count=3)}
    digits = {"var": 4, "low": None, "high": None, "n": None}
    return f.assign(**{k: x if digits.get(k, 6) is None else x.round(digits.get(k, 6)) for k, x in r.items()}).drop(columns=["v", "w", "u"]).to_spark("event_id")


@query(fact_sql("(SELECT CASE WHEN event_id % 7 < 3 THEN NULL ELSE value END AS v, user_id FROM events)", sum_v="NULL", max_v="NULL", sum_u="sum(user_id)", min_u="min(user_id)", few="NULL", kurt="NULL"))
def sum_skipna(spark, sf):
    e = events(spark, sf)
    v, u = e["value"].mask(e.index.to_series() % 7 < 3), e["user_id"]
    made = {"sum_v": v.sum(skipna=False), "max_v": v.max(skipna=False), "sum_u": u.sum(skipna=False), "min_u": u.min(skipna=False), "few": v.sum(min_count=10**12), "kurt": v.kurtosis(skipna=False)}
    return spark.createDataFrame([(k, None if x is None else str(x)) for k, x in made.items()], "name string, value string")


@query("SELECT event_id, " + ", ".join(f"min(value * {k + 1}) OVER w AS c{k}" for k in range(12)) + " FROM events WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def expanding_many_columns(spark, sf):
    e = events(spark, sf)
    f = e.assign(**{f"c{k}": e["value"] * (k + 1) for k in range(12)})[[f"c{k}" for k in range(12)]]
    return f.expanding(1).min().to_spark("event_id")


@query("SELECT event_id, dense_rank() OVER (ORDER BY value) - 1 AS code FROM events")
def factorize_many(spark, sf):
    e = events(spark, sf)
    with tb.option_context("compute.max_rows", 10_000_000):
        codes, _ = e["value"].factorize()
    return codes.to_frame("code").to_spark("event_id")


@query(fact_sql("(SELECT p_size, p_retailprice FROM part WHERE p_partkey < 12)", prod="CAST(product(p_size % 3 + 1) AS BIGINT)", product="CAST(product(p_size % 3 + 1) AS BIGINT)", argmax="arg_max(p, p_retailprice)").replace("arg_max(p, p_retailprice) AS VARCHAR) AS value FROM (SELECT p_size, p_retailprice FROM part WHERE p_partkey < 12)", "(SELECT count(*) FROM part WHERE p_partkey < (SELECT arg_max(p_partkey, p_retailprice + p_partkey * 1e-9) FROM part)) AS VARCHAR) AS value"))
def products_and_positions(spark, sf):
    p = t(spark, sf, "part", "p_partkey", "p_partkey")
    few = p[p.index.to_series() < 12]["p_size"] % 3 + 1
    return facts(spark, prod=few.prod(), product=few.product(), argmax=(p["p_retailprice"] + p.index.to_series() * 1e-9).argmax())


@query("SELECT 'c_acctbal' AS column_, round(sum(c_acctbal), 2) AS total, min(c_acctbal) AS low FROM customer UNION ALL SELECT 'c_nationkey', sum(c_nationkey), min(c_nationkey) FROM customer")
def aggregate_frame(spark, sf):
    got = t(spark, sf, "customer")[["c_acctbal", "c_nationkey"]].aggregate(["sum", "min"]).T
    got.columns = ["total", "low"]
    return got.assign(total=got["total"].round(2)).to_spark("column_")


@query("SELECT event_type, round(sum(value), 4) AS total, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def group_named_aggregates(spark, sf):
    g = events(spark, sf).groupby("event_type")
    out = g.aggregate(total=tb.NamedAgg("value", "sum"), n=tb.NamedAgg(column="value", aggfunc="size"))
    return out.assign(total=out["total"].round(4)).to_spark("event_type")


@query("SELECT event_id, value FROM events WHERE event_type = 'click'")
def group_get_group(spark, sf):
    return events(spark, sf).groupby("event_type").get_group("click")[["value"]].to_spark("event_id")


@query("SELECT event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) <= 4")
def group_nsmallest(spark, sf):
    return events(spark, sf).groupby("event_type")["value"].nsmallest(4).to_frame("value").to_spark(["event_type", "event_id"])


# ---- rows, labels, indexers ----------------------------------------------------------------------------
@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice, p_partkey LIMIT 9")
def nsmallest(spark, sf):
    return t(spark, sf, "part", "p_partkey", "p_partkey").nsmallest(9, "p_retailprice")[["p_retailprice"]].to_spark("p_partkey")


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice, p_partkey LIMIT 9")
def series_nsmallest(spark, sf):
    return t(spark, sf, "part", "p_partkey", "p_partkey")["p_retailprice"].nsmallest(9).to_frame().to_spark("p_partkey")


@query("SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_custkey DESC) - 1 AS BIGINT) AS p FROM customer")
def sort_index_descending(spark, sf):
    c = t(spark, sf, "customer", "c_custkey", "c_custkey")
    c = c.assign(k=c.index.to_series())[["k"]].sort_index(ascending=False)
    with tb.option_context("compute.default_index_type", "distributed-sequence"):
        return c.reset_index(drop=True).to_spark("p").withColumnRenamed("k", "c_custkey")


@query("SELECT CAST(row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS BIGINT) AS at, CAST(c_custkey - (SELECT min(c_custkey) FROM customer) AS BIGINT) AS came FROM customer")
def argsort(spark, sf):
    c = t(spark, sf, "customer", "c_custkey", "c_custkey")
    return c["c_acctbal"].argsort().to_frame("came").to_spark("at")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey BETWEEN 3 AND 9")
def truncate(spark, sf):
    return t(spark, sf, "nation", "n_nationkey").truncate(3, 9).to_spark("n_nationkey")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def xs_level(spark, sf):
    return t(spark, sf, "nation", ["n_regionkey", "n_nationkey"]).xs(2).to_spark("n_nationkey")


@query("SELECT event_id FROM events WHERE strftime(ts, '%H:%M:%S') = '10:00:00'")
def at_time(spark, sf):
    e = t(spark, sf, "events")
    e["ts"] = e["ts"].dt.floor("s")  # at_time means the exact time; the SQL any fraction of that second
    return e.set_index("ts").at_time("10:00:00")[["event_id"]].to_spark()


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'x' ELSE n_name END AS n_name, CASE WHEN n_nationkey = 0 THEN 99 ELSE n_regionkey END AS n_regionkey FROM nation")
def assign_by_label_and_position(spark, sf):
    n = t(spark, sf, "nation", "n_nationkey", "n_nationkey")
    n.loc[n["n_regionkey"] == 1, "n_name"] = "x"
    n.iloc[0, 1] = 99
    return n.to_spark("n_nationkey")


@query("SELECT n_nationkey, n_name FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS p FROM nation) WHERE p IN (2, 5, 7)")
def take(spark, sf):
    return t(spark, sf, "nation", "n_nationkey", "n_nationkey").take([2, 5, 7])[["n_name"]].to_spark("n_nationkey")


@query(fact_sql("nation", at="max(n_name) FILTER (n_nationkey = 7)", iat="max(n_name) FILTER (n_nationkey = 3)", item="max(n_regionkey) FILTER (n_nationkey = 4)", first_valid="min(n_nationkey)", last_valid="max(n_nationkey)"))
def single_cells(spark, sf):
    n = t(spark, sf, "nation", "n_nationkey", "n_nationkey")
    one = n[n.index.to_series() == 4]["n_regionkey"]
    return facts(spark, at=n.at[7, "n_name"], iat=n.iat[3, 0], item=one.item(), first_valid=n.first_valid_index(), last_valid=n.last_valid_index())


@query("SELECT n_nationkey, n_regionkey AS pre_n_regionkey_s, 1 AS added, upper(n_name) AS popped FROM nation")
def labels_and_columns(spark, sf):
    n = t(spark, sf, "nation", "n_nationkey")
    n.insert(1, "added", 1)
    name = n.pop("n_name")
    out = n[["n_regionkey"]].add_prefix("pre_").add_suffix("_s")
    made = n.assign(**{"pre_n_regionkey_s": n["n_regionkey"]}).select_dtypes("number")
    assert list(made.columns) == ["added", "n_regionkey", "pre_n_regionkey_s"] and list(out.columns) == ["pre_n_regionkey_s"]
    made = made.drop(columns=["n_regionkey"]).rename_axis("n_nationkey")
    with tb.option_context("compute.ops_on_diff_frames", True):
        return made.assign(popped=name.str.upper()).to_spark("n_nationkey")


@query(fact_sql("customer", rows="count(*)", columns="5", size="count(*) * 5", ndim="2", empty="false", ndim1="1", len_="count(*)", unique="count(DISTINCT c_custkey) = count(*)", hasnans="false", dtype="'int64'", squeezed="min(c_custkey)"))
def frame_properties(spark, sf):
    c = t(spark, sf, "customer")
    k = c["c_custkey"]
    (rows, columns), low = c.shape, c[["c_custkey"]].squeeze().min()
    assert list(c) == list(c.columns) == [s for s, _ in c.items()] and len(c.dtypes) == 5 and c.copy().equals(c.swapaxes(0, 0)) and len(c.axes) == 2 and k.axes[0].nlevels == 1
    return facts(spark, rows=rows, columns=columns, size=c.size, ndim=c.ndim, empty=c.empty, ndim1=k.ndim, len_=len(k), unique=k.is_unique, hasnans=k.hasnans, dtype=k.dtype, squeezed=low)


@query("SELECT event_id, v IS NULL AS a, v IS NULL AS b, v IS NOT NULL AS c, v IS NOT NULL AS d FROM (SELECT event_id, CASE WHEN event_id % 7 < 3 THEN NULL ELSE value END AS v FROM events)")
def missing_tests(spark, sf):
    e = holes(events(spark, sf))
    v = e["v"]
    return e.assign(a=v.isnull(), b=tb.isnull(v), c=v.notnull(), d=tb.notna(v))[["a", "b", "c", "d"]].to_spark("event_id")


@query("SELECT n_nationkey, n_name IS NULL AS n_name, n_regionkey IS NOT NULL AS n_regionkey FROM nation")
def frame_missing_tests(spark, sf):
    n = t(spark, sf, "nation", "n_nationkey")
    return n.isnull().assign(n_regionkey=n.notnull()["n_regionkey"]).to_spark("n_nationkey")


@query("SELECT k, x, other FROM (SELECT c_custkey AS k, c_acctbal AS x FROM customer WHERE c_custkey % 2 = 0) a FULL JOIN (SELECT s_suppkey AS k, s_acctbal AS other FROM supplier) b USING (k)")
def align_frames(spark, sf):
    c = t(spark, sf, "customer", "c_custkey")
    a = c[c.index.to_series() % 2 == 0].rename(columns={"c_acctbal": "x"})[["x"]]
    b = t(spark, sf, "supplier", "s_suppkey").rename(columns={"s_acctbal": "other"})[["other"]]
    with tb.option_context("compute.ops_on_diff_frames", True):
        left, right = a.align(b, axis=0)
        return left.assign(other=right["other"]).to_spark("k")


@query("SELECT o_orderkey, o_totalprice AS self, round(o_totalprice, 0) AS other FROM orders WHERE o_totalprice <> round(o_totalprice, 0)")
def compare_series(spark, sf):
    p = orders(spark, sf)["o_totalprice"]
    return p.compare(p.round(0)).to_spark("o_orderkey")


@query("SELECT n_nationkey, n_name, CASE WHEN n_nationkey < 10 THEN n_regionkey END AS n_regionkey FROM nation")
def reindex_like(spark, sf):
    n = t(spark, sf, "nation", "n_nationkey", "n_nationkey")
    few = n[n.index.to_series() < 10]
    out = few[["n_regionkey"]].reindex_like(n[["n_regionkey"]])
    with tb.option_context("compute.ops_on_diff_frames", True):
        return n[["n_name"]].join(out).to_spark("n_nationkey").select("n_nationkey", "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def broadcast_and_hints(spark, sf):
    c, n = t(spark, sf, "customer")[["c_custkey", "c_nationkey"]], t(spark, sf, "nation").rename(columns={"n_nationkey": "c_nationkey"})[["c_nationkey", "n_name"]]
    out = c.hint("merge").merge(tb.broadcast(n), on="c_nationkey")  # 25 nations
    return out[["c_custkey", "n_name"]].spark.hint("rebalance").to_spark()


@query("SELECT c_nationkey AS k, c_acctbal AS x FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier")
def append_frames(spark, sf):
    c = t(spark, sf, "customer")[["c_nationkey", "c_acctbal"]].rename(columns={"c_nationkey": "k", "c_acctbal": "x"})
    return c.append(t(spark, sf, "supplier")[["s_nationkey", "s_acctbal"]].rename(columns={"s_nationkey": "k", "s_acctbal": "x"}), ignore_index=True).to_spark()


@query("SELECT l_returnflag AS k, CAST(sum(l_quantity) FILTER (l_linestatus = 'F') AS DOUBLE) AS F, CAST(sum(l_quantity) FILTER (l_linestatus = 'O') AS DOUBLE) AS O FROM lineitem GROUP BY 1")
def pivot(spark, sf):
    x = t(spark, sf, "lineitem").groupby(["l_returnflag", "l_linestatus"], as_index=False).agg({"l_quantity": "sum"})
    return x.pivot(index="l_returnflag", columns="l_linestatus", values="l_quantity").to_spark("k")


# ---- indexes and categories ----------------------------------------------------------------------------
@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier WHERE s_nationkey NOT IN (1, 2)")
def index_append_drop(spark, sf):
    a, b = t(spark, sf, "customer", "c_nationkey").index, t(spark, sf, "supplier", "s_nationkey").index
    return a.append(b.drop([1, 2])).to_frame(name="k").to_spark()


@query("SELECT n_nationkey AS k FROM nation WHERE n_nationkey <> 0 UNION ALL SELECT 77")
def index_insert_delete(spark, sf):
    i = t(spark, sf, "nation", "n_nationkey", "n_nationkey").index
    return i.delete(0).insert(3, 77).to_frame(name="k").to_spark().select(F.col("k").cast("int").alias("k"))


@query(fact_sql("nation", integer="true", numeric="true", floating="false", boolean="false", object="false", categorical="false", interval="false", holds="true", dates="false", inferred="'integer'", compatible="true", nlevels="1", shape="count(*)", unique="true", duplicates="false", low="min(n_nationkey)", high="max(n_nationkey)", name="'key'", asi8="sum(n_nationkey)", increasing="true", decreasing="false", monotonic="true", argmax="count(*) - 1", argmin="0", same="true", identical="true"))
def index_properties(spark, sf):
    n = t(spark, sf, "nation", "n_nationkey", "n_nationkey")
    i = n.index.set_names("key")
    same = i.copy()
    return facts(
        spark, integer=i.is_integer(), numeric=i.is_numeric(), floating=i.is_floating(), boolean=i.is_boolean(), object=i.is_object(), categorical=i.is_categorical(), interval=i.is_interval(), holds=i.holds_integer(), dates=i.is_all_dates,
        inferred=i.inferred_type, compatible=i.is_type_compatible("integer"), nlevels=i.nlevels, shape=i.shape[0], unique=i.is_unique, duplicates=i.has_duplicates, low=i.min(), high=i.max(), name=i.name, asi8=i.asi8.sum(),
        increasing=i.is_monotonic_increasing, decreasing=i.is_monotonic_decreasing, monotonic=i.is_monotonic, argmax=i.argmax(), argmin=i.argmin(), same=i.equals(same.transpose()), identical=i.identical(same),
    )


@query("SELECT n_regionkey AS region, CAST(count(*) AS BIGINT) AS n FROM nation GROUP BY 1")
def index_levels(spark, sf):
    n = t(spark, sf, "nation", ["n_regionkey", "n_nationkey"])
    swapped = n.swaplevel(0, 1).index.swaplevel(0, 1)
    level = swapped.get_level_values("n_regionkey")
    assert n.droplevel("n_nationkey").index.names == ["n_regionkey"] == swapped.droplevel("n_nationkey").names and n.index.levshape[1] == len(n)
    return level.value_counts().to_frame("n").to_spark("region")


@query("SELECT a AS k, b AS label, CAST(a * 10 AS BIGINT) AS v FROM (SELECT unnest([1, 1, 2, 2]) AS a, unnest(['x', 'y', 'x', 'y']) AS b)")
def index_constructors(spark, sf):
    made = [
        tb.Index.from_tuples([(1, "x"), (1, "y"), (2, "x"), (2, "y")], names=["k", "label"]),
        tb.Index.from_arrays([[1, 1, 2, 2], ["x", "y", "x", "y"]], names=["k", "label"]),
        tb.Index.from_product([[1, 2], ["x", "y"]], names=["k", "label"]),
        tb.Index.from_frame(tb.Frame({"k": [1, 1, 2, 2], "label": ["x", "y", "x", "y"]})),
    ]
    assert all(i.equals(made[0]) for i in made)
    f = made[2].to_frame()
    return f.assign(v=f["k"] * 10).to_spark().select(F.col("k").cast("int").alias("k"), "label", "v")


@query("SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 0 WHEN 'economy' THEN 1 ELSE -1 END AS a, CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'PROMO' THEN 0 ELSE -1 END AS b FROM (SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 'economy' ELSE p_type END AS p_type FROM part WHERE false UNION ALL SELECT p_partkey, p_type FROM part) p".replace("WHEN 'economy'", "WHEN 'ECONOMY'"))
def categories(spark, sf):
    p = t(spark, sf, "part", "p_partkey")
    c = p["p_type"].astype(pd.CategoricalDtype(["ECONOMY", "PROMO"])).cat
    a = c.rename_categories({"ECONOMY": "economy"}).cat.reorder_categories(["PROMO", "economy"])
    b = c.add_categories("NONE").cat.set_categories(["PROMO", "ECONOMY", "NONE"]).cat.remove_unused_categories().cat.as_ordered()
    assert b.cat.ordered and not b.cat.as_unordered().cat.ordered and list(b.cat.categories) == ["PROMO", "ECONOMY"] and list(c.remove_categories("PROMO").cat.categories) == ["ECONOMY"]
    return p.assign(a=a.cat.codes, b=b.cat.codes)[["a", "b"]].to_spark("p_partkey")


@query("SELECT CASE n_name WHEN 'B' THEN 1 ELSE 0 END AS code, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN n_regionkey = 1 THEN 'B' ELSE 'A' END AS n_name FROM nation) GROUP BY 1")
def categorical_index(spark, sf):
    n = t(spark, sf, "nation", "n_nationkey")
    s = n["n_name"].where(n["n_regionkey"] == 1, "A").where(n["n_regionkey"] != 1, "B")
    i = tb.CategoricalIndex(s, categories=["A", "B"])
    assert list(i.categories) == ["A", "B"] and not i.ordered and i.is_categorical()
    return i.codes.value_counts().to_frame("n").to_spark("code").select(F.col("code").cast("int").alias("code"), "n")


@query("SELECT event_id, week(ts) AS a, isodow(ts) - 1 AS b, dayofyear(ts) AS c, day(last_day(ts)) AS d FROM events")
def datetime_index(spark, sf):
    e = events(spark, sf)
    i = tb.DatetimeIndex(e["ts"])
    made = {"a": i.weekofyear, "b": i.day_of_week, "c": i.day_of_year, "d": i.daysinmonth}
    return e.assign(**{k: tb.Series(e, x.spark_column, k) for k, x in made.items()})[["a", "b", "c", "d"]].to_spark("event_id")


@query("SELECT k AS event_id, month(x) AS m, day(x) AS d, strftime(x, '%Y-%m-%d %H') AS s FROM (SELECT event_id AS k, TIMESTAMP '1970-01-01' + to_seconds(event_id * 3600) AS x FROM events)")
def to_datetime_units(spark, sf):
    e = events(spark, sf)
    x = tb.to_datetime(e.index.to_series() * 3600, unit="s")
    y = tb.to_datetime(x.dt.strftime("%Y-%m-%d %H:%M:%S"), format="yyyy-MM-dd HH:mm:ss")
    return e.assign(m=y.dt.month, d=y.dt.day, s=y.dt.strftime("%Y-%m-%d %H"))[["m", "d", "s"]].to_spark("event_id")


@query("SELECT CAST(i AS BIGINT) AS i, strftime(DATE '2024-01-30' + CAST(i AS INTEGER), '%Y-%m-%d') AS d FROM range(40) r(i)")
def date_range(spark, sf):
    days = tb.date_range("2024-01-30", periods=40, freq="D").to_series("d").dt.strftime("%Y-%m-%d").to_list()
    ids = tb.range(40).index.to_frame(name="i")
    assert len(ids) == 40
    return spark.createDataFrame(list(enumerate(days)), "i long, d string")


# ---- functions ---------------------------------------------------------------------------------------
@query("SELECT event_id, abs(x - 50) AS a, NOT (x > 50) AS b, x > 50 AND x < 80 AS c, x > 50 OR x < 10 AS d, xor(CAST(x > 50 AS INT), CAST(x < 80 AS INT)) = 1 AS e, x - 50 < 0 AS f, x * 8 AS g FROM (SELECT event_id, value AS x FROM events)")
def more_ufuncs(spark, sf):
    e = events(spark, sf)
    x = e["value"]
    hi, lo = x > 50, x < 80
    made = {"a": np.absolute(x - 50), "b": np.logical_not(hi), "c": np.logical_and(hi, lo), "d": np.logical_or(hi, x < 10), "e": np.logical_xor(hi, lo), "f": np.signbit(x - 50), "g": np.ldexp(x, 3)}
    return e.assign(**made)[list(made)].to_spark("event_id")


@query("SELECT event_id, ~event_id AS a, ~user_id AS b, round(greatest(v, w) + log2(1 + power(2, -abs(v - w))), 6) AS c, v - trunc(v) AS d FROM (SELECT event_id, user_id, value / 50 AS v, user_id / 10.0::DOUBLE AS w FROM events)")
def bit_ufuncs(spark, sf):
    e = events(spark, sf)
    v, w = e["value"] / 50, e["user_id"] / 10.0
    made = {"a": np.invert(e.index.to_series()), "b": np.bitwise_not(e["user_id"]), "c": np.logaddexp2(v, w).round(6), "d": v - np.trunc(v)}
    return e.assign(**made)[list(made)].to_spark("event_id")


@query("SELECT p_partkey, regexp_full_match(x, '[0-9]+') AS a, regexp_full_match(x, '[0-9]+') AS b, strlen(x) AS c FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name ELSE CAST(p_size AS VARCHAR) END AS x FROM part)")
def str_digits_and_bytes(spark, sf):
    p = t(spark, sf, "part", "p_partkey")
    x = p["p_name"].where(p["p_size"] % 2 == 0, p["p_size"].astype(str))
    return p.assign(a=x.str.isnumeric(), b=x.str.isdecimal(), c=x.str.len())[["a", "b", "c"]].to_spark("p_partkey")


@query("SELECT event_id, value * 2 AS twice FROM events")
def batches_by_accessor(spark, sf):
    def doubled(p: pd.DataFrame) -> pd.DataFrame:
        return p.assign(twice=p["value"] * 2)[["event_id", "twice"]]

    e = t(spark, sf, "events")[["event_id", "value"]]
    out = e.batch.apply_batch(doubled, "event_id long, twice double")
    assert out.apply_batch(lambda p: p.head(0), "event_id long, twice double").empty
    return out.to_spark()


@query("SELECT event_id, value - 1 AS value FROM events")
def transform_batches(spark, sf):
    e = events(spark, sf)[["value"]]
    return e.transform_batch(lambda p: p - 1, "value double").to_spark("event_id")


@query("SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS BIGINT) AS row_id FROM customer")
def attach_ids(spark, sf):
    c = t(spark, sf, "customer", "c_custkey", "c_custkey")
    return c.batch.attach_id_column("distributed-sequence", "row_id")[["row_id"]].to_spark("c_custkey")


# ---- sources, sinks, execution ------------------------------------------------------------------------
NATION_SQL = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


def _nation(f):
    return f.to_spark("n_nationkey").select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))


@query(NATION_SQL)
def csv_round_trip(spark, sf):
    path = shared_path(spark)
    t(spark, sf, "nation").to_csv(path, num_files=2)
    return _nation(tb.read_csv(path, index_col="n_nationkey"))


@query(NATION_SQL)
def json_round_trip(spark, sf):
    path = shared_path(spark)
    t(spark, sf, "nation").to_json(path)
    return _nation(tb.read_json(path, index_col="n_nationkey"))


@query(NATION_SQL)
def orc_round_trip(spark, sf):
    path = shared_path(spark)
    t(spark, sf, "nation", "n_nationkey").to_orc(path, index_col="n_nationkey")
    return _nation(tb.read_orc(path, index_col="n_nationkey"))


@query(NATION_SQL)
def spark_io_round_trip(spark, sf):
    path = shared_path(spark)
    t(spark, sf, "nation").to_spark_io(path, "parquet")
    return _nation(tb.read_spark_io(path, "parquet", index_col="n_nationkey"))


@query(NATION_SQL)
def table_round_trip(spark, sf):
    name = "nation_" + shared_path(spark).rsplit("-", 1)[1]
    t(spark, sf, "nation").to_table(name, format="parquet")
    return _nation(tb.read_table(name, index_col="n_nationkey"))


@query(NATION_SQL)
def local_forms(spark, sf):
    """Small tables through pandas, records, dicts and tuples, and back."""
    n = t(spark, sf, "nation", "n_nationkey", "n_nationkey")
    assert n.toPandas().equals(n.to_pandas()) and n.to_numpy().shape == n.values.shape and len(n.to_dict()) == 2 and len(n.to_records()) == len(n) and n.index.to_list() == n.index.toPandas().tolist() == list(n.index.to_numpy())
    assert [k for k, _ in n.iterrows()] == [r[0] for r in n.itertuples()] == list(n["n_name"].to_dict()) and "n_name" in n.to_string() and "n_name" in n.to_html() and "n_name" in repr(n) and [x for _, x in n["n_name"].items()] == n["n_name"].to_list()
    return _nation(tb.Frame.from_records(n.reset_index().toPandas().to_dict("records")).set_index("n_nationkey"))


@query("SELECT r_regionkey AS k, r_name AS label FROM region")
def from_dict(spark, sf):
    r = t(spark, sf, "region", "r_regionkey", "r_regionkey")
    out = tb.Frame.from_dict({"k": r.index.to_list(), "label": r["r_name"].to_list()})
    return out.to_spark().select(F.col("k").cast("int").alias("k"), "label")


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events WHERE value > 50 GROUP BY 1")
def cached_and_cut(spark, sf):
    e = events(spark, sf)
    with e[e["value"] > 50].cache() as c:
        assert c.storage_level.useMemory and "value" in c.spark_schema().names and c.spark.schema() == c.spark_schema()
        out = c.spark.repartition(3).spark.coalesce(2).spark.checkpoint().spark.local_checkpoint().groupby("event_type").size().to_frame("n").to_spark("event_type")
        out.count()
    return out


@query("SELECT event_id, value FROM events ORDER BY event_id LIMIT 3")
def options_context(spark, sf):
    before = tb.get_option("display.max_rows")
    tb.set_option("display.max_rows", 3)
    n = tb.get_option("display.max_rows")
    tb.reset_option("display.max_rows")
    assert tb.get_option("display.max_rows") == before and "compute.max_rows" in tb.show_options()
    return events(spark, sf).head(n)[["value"]].to_spark("event_id")


@query("SELECT p_partkey, p_size * 2 AS size2 FROM part")
def registered_accessor(spark, sf):
    @tb.register_dataframe_accessor("doubler")
    class Doubler:
        def __init__(self, frame):
            self.frame = frame

        def size(self):
            return self.frame.assign(size2=self.frame["p_size"] * 2)[["size2"]]

    return t(spark, sf, "part", "p_partkey").doubler.size().to_spark("p_partkey")


@query("""WITH b AS (SELECT min(event_id) AS lo, max(event_id) AS hi FROM events),
 m AS (SELECT DISTINCT unnest([lo, (3 * lo + hi) // 4, (lo + hi) // 2, (lo + 3 * hi) // 4, hi]) AS mark FROM b)
 SELECT CAST(mark AS BIGINT) AS mark, max_by(value, event_id) AS value FROM m JOIN events ON event_id <= mark WHERE value IS NOT NULL GROUP BY mark""")
def series_asof(spark, sf):
    """The last value at or before marks that span all ids."""
    e = events(spark, sf)
    lo, hi = e.index.min(), e.index.max()
    marks = sorted({lo, (3 * lo + hi) // 4, (lo + hi) // 2, (lo + 3 * hi) // 4, hi})
    found = e["value"].asof(marks).to_pandas()
    return spark.createDataFrame([(int(k), float(v)) for k, v in found.items()], "mark long, value double")


# ---- data of plots -------------------------------------------------------------------------------------
@query("SELECT CAST(b AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n FROM (SELECT least(floor((value - lo) / ((hi - lo) / 10)), 9) AS b FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events)) GROUP BY 1")
def plot_histogram(spark, sf):
    _, counts = plot.histogram(events(spark, sf)[["value"]], 10)
    return spark.createDataFrame([(k, int(n)) for k, n in enumerate(counts["value"]) if n], "bin long, n long")


@query("""WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, median(value) AS med, quantile_cont(value, 0.75) AS q3, avg(value) AS mean FROM events),
 s AS (SELECT q1, med, q3, mean, min(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS lo, max(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS hi FROM events, q GROUP BY ALL)
 SELECT round(q1, 6) AS q1, round(med, 6) AS med, round(q3, 6) AS q3, round(mean, 6) AS mean, lo AS whislo, hi AS whishi FROM s""")
def plot_box(spark, sf):
    b = plot.box(events(spark, sf), "value")
    return spark.createDataFrame([(round(b["q1"], 6), round(b["med"], 6), round(b["q3"], 6), round(b["mean"], 6), b["whislo"], b["whishi"])], "q1 double, med double, q3 double, mean double, whislo double, whishi double")


@query("""SELECT CAST(i AS INTEGER) AS i, round(sum(exp(-0.5 * power((value - p) / h, 2))) / (n * h * sqrt(2 * pi())), 9) AS d FROM events, (SELECT count(*) AS n, 0.5 * stddev_samp(value) AS h FROM events), (SELECT unnest([0, 1, 2]) AS i, unnest([10.0, 50.0, 90.0]) AS p) GROUP BY i, n, h""")
def plot_density(spark, sf):
    _, d = plot.kde(events(spark, sf), "value", bw_method=0.5, ind=[10.0, 50.0, 90.0])
    return spark.createDataFrame([(i, round(float(x), 9)) for i, x in enumerate(d)], "i int, d double")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1000")
def plot_top_rows(spark, sf):
    rows = plot.top_n(orders(spark, sf)[["o_totalprice"]])
    return spark.createDataFrame([(int(k), float(v)) for k, v in rows["o_totalprice"].items()], "o_orderkey long, o_totalprice double")
