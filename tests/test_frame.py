"""The table interface against pandas on small data with nulls, ties, duplicates and odd types."""

import numpy as np
import pandas as pd
import pytest

import tabulon.api as tb
from tabulon.frame import Unsupported
from tabulon.plans import ordered


@pytest.fixture(scope="module")
def pdf():
    return pd.DataFrame(
        {"a": [1, 2, 3, 4, 5, 6, 7, 8, 9], "b": [4.0, np.nan, 6.0, 3.0, 2.0, 1.0, np.nan, 0.0, 0.0], "c": list("xyxyzxzzx"), "d": ["One two", None, "x", "", " pad ", "ÉCLAIR", "12", "a-b", "Z"]},
        index=pd.Index([0, 1, 3, 5, 6, 8, 9, 9, 9], name="k"),
    )


@pytest.fixture(scope="module")
def f(spark, pdf):
    return tb.from_pandas(pdf)


def same(got, want, **kw):
    got = got.to_pandas() if hasattr(got, "to_pandas") else got
    if isinstance(want, pd.DataFrame):
        got = got.where(pd.notna(got), np.nan) if len(got) else got
        pd.testing.assert_frame_equal(got, want.where(pd.notna(want), np.nan), check_dtype=False, check_names=False, check_index_type=False, check_column_type=False, **kw)
    elif isinstance(want, pd.Series):
        pd.testing.assert_series_equal(got.where(pd.notna(got), np.nan), want.where(pd.notna(want), np.nan), check_dtype=False, check_names=False, check_index_type=False, **kw)
    else:
        assert got == want or pd.isna(got) and pd.isna(want) or abs(got - want) < 1e-9


CASES = {
    "select": lambda x: x[["b", "a"]],
    "filter": lambda x: x[x["a"] > 3],
    "isin": lambda x: x[x["c"].isin(["x", "z"])],
    "head": lambda x: x.head(3),
    "head_negative": lambda x: x.head(-2),
    "tail": lambda x: x.tail(4),
    "iloc": lambda x: x.iloc[2:7],
    "iloc_step": lambda x: x.iloc[1:8:3],
    "iloc_list": lambda x: x.iloc[[0, 4]],
    "iloc_cols": lambda x: x.iloc[1:4, [0, 2]],
    "loc_slice": lambda x: x.loc[3:8],
    "loc_cols": lambda x: x.loc[3:8, ["a", "c"]],
    "truncate": lambda x: x.loc[:8].truncate(1, 6),
    "assign": lambda x: x.assign(e=x["a"] * 2, g=lambda y: y["a"] + 1),
    "rename": lambda x: x.rename(columns={"a": "A"}),
    "prefix": lambda x: x.add_prefix("p_"),
    "suffix": lambda x: x.add_suffix("_s"),
    "drop": lambda x: x.drop(columns=["a"]),
    "like": lambda x: x.filter(items=["a", "c"]),
    "regex": lambda x: x.filter(regex="^[ab]"),
    "sort": lambda x: x.sort_values(["c", "a"], ascending=[True, False]),
    "sort_missing_first": lambda x: x.sort_values("b", na_position="first", kind="stable") if isinstance(x, pd.DataFrame) else x.sort_values("b", na_position="first"),
    "sort_index": lambda x: x[["a"]].sort_index(ascending=False, kind="stable"),
    "nlargest": lambda x: x.nlargest(3, "a"),
    "nsmallest": lambda x: x.nsmallest(3, "b"),
    "isna": lambda x: x.isna(),
    "fillna": lambda x: x[["b"]].fillna(9.5),
    "fillna_dict": lambda x: x.fillna({"b": 1.5, "d": "none"}),
    "dropna": lambda x: x.dropna(),
    "dropna_all": lambda x: x[["b", "d"]].dropna(how="all"),
    "replace": lambda x: x.replace({"c": {"x": "w"}}),
    "clip": lambda x: x[["a", "b"]].clip(2, 5),
    "round": lambda x: (x[["b"]] / 3).round(2),
    "where": lambda x: x[["a"]].where(x[["a"]] > 4, 0),
    "duplicates": lambda x: x[["c"]].drop_duplicates(),
    "duplicates_last": lambda x: x[["c"]].drop_duplicates(keep="last"),
    "duplicated": lambda x: x.duplicated("c"),
    "add": lambda x: x[["a", "b"]] + 1,
    "radd": lambda x: 1 + x["a"],
    "rsub": lambda x: 10 - x["a"],
    "frames": lambda x: x[["a", "b"]] * x[["a", "b"]],
    "truediv": lambda x: x["a"] / x["b"],
    "mod": lambda x: (x["a"] - 5) % 3,
    "pow": lambda x: x["a"] ** 2,
    "neg": lambda x: -x["a"],
    "compare": lambda x: x["b"] < 3,
    "logic": lambda x: (x["a"] > 2) & ~(x["b"] > 3),
    "between": lambda x: x["a"].between(2, 5),
    "cumsum": lambda x: x["b"].cumsum(),
    "cummax": lambda x: x[["a", "b"]].cummax(),
    "cumprod": lambda x: x["a"].cumprod(),
    "shift": lambda x: x["b"].shift(2),
    "shift_back": lambda x: x["a"].shift(-1),
    "shift_fill": lambda x: x["a"].shift(1, fill_value=0),
    "diff": lambda x: x["b"].diff(),
    "pct_change": lambda x: x["a"].pct_change(),
    "ffill": lambda x: x["b"].ffill(),
    "bfill": lambda x: x["b"].bfill(),
    "ffill_limit": lambda x: x["b"].ffill(limit=1),
    "rolling": lambda x: x["b"].rolling(3, 2).mean(),
    "rolling_frame": lambda x: x[["a", "b"]].rolling(2).sum(),
    "expanding": lambda x: x["b"].expanding(2).std(),
    "expanding_sum": lambda x: x[["a", "b"]].expanding(1).sum(),
    "rank": lambda x: x["b"].rank(),
    "rank_first": lambda x: x["b"].rank(method="first"),
    "rank_desc": lambda x: x["b"].rank(method="min", ascending=False),
    "group_sum": lambda x: x.groupby("c")[["a", "b"]].sum(),
    "group_mean": lambda x: x.groupby("c")["b"].mean(),
    "group_agg": lambda x: x.groupby("c").agg({"a": "sum", "b": "max"}),
    "group_size": lambda x: x.groupby("c").size(),
    "group_first": lambda x: x.groupby("c")[["a", "b"]].first(),
    "group_last": lambda x: x.groupby("c")[["a", "b"]].last(),
    "group_nunique": lambda x: x.groupby("c")["b"].nunique(),
    "group_no_index": lambda x: x.groupby("c", as_index=False)["a"].sum() if isinstance(x, pd.DataFrame) else x.groupby("c", as_index=False)[["a"]].sum(),
    "group_cumsum": lambda x: x.groupby("c")["a"].cumsum(),
    "group_shift": lambda x: x.groupby("c")["a"].shift(),
    "group_rank": lambda x: x.groupby("c")["b"].rank(),
    "group_cumcount": lambda x: x.groupby("c").cumcount(),
    "group_ffill": lambda x: x.groupby("c")["b"].ffill(),
    "group_head": lambda x: x.groupby("c").head(1),
    "group_tail": lambda x: x.groupby("c").tail(1),
    "get_group": lambda x: x.groupby("c").get_group("x"),
    "set_index": lambda x: x.set_index("c"),
    "append_index": lambda x: x.set_index("c", append=True),
    "swaplevel": lambda x: x.set_index("c", append=True).swaplevel(),
    "droplevel": lambda x: x.set_index("c", append=True).droplevel(0),
    "xs": lambda x: x.set_index("c").xs("x"),
    "explode": lambda x: x["a"].head(3),
    "map": lambda x: x["c"].map({"x": 1.0, "y": 2.0}),
    "str_upper": lambda x: x["d"].str.upper(),
    "str_title": lambda x: x["d"].str.title(),
    "str_swapcase": lambda x: x["d"].str.swapcase(),
    "str_center": lambda x: x["d"].str.center(9, "*"),
    "str_center_even": lambda x: x["d"].str.center(8, "*"),
    "str_zfill": lambda x: x["d"].str.zfill(5),
    "str_slice": lambda x: x["d"].str.slice(-3, None),
    "str_slice_step": lambda x: x["d"].str.slice(None, None, -1),
    "str_len": lambda x: x["d"].str.len(),
    "str_find": lambda x: x["d"].str.find("w"),
    "str_rfind": lambda x: x["d"].str.rfind("o"),
    "str_replace": lambda x: x["d"].str.replace("[aeiou]", "_", regex=True),
    "str_normalize": lambda x: x["d"].str.normalize("NFD"),
    "str_isalpha": lambda x: x["c"].str.isalpha(),
    "dummies": lambda x: (pd if isinstance(x, pd.DataFrame) else tb).get_dummies(x[["c"]], dtype="int" if not isinstance(x, pd.DataFrame) else int),
    "ufunc": lambda x: np.sqrt(x["a"]),
    "ufunc_two": lambda x: np.hypot(x["a"], 3),
    "astype": lambda x: x["a"].astype(str),
    "describe": lambda x: x[["a", "b"]].describe(),
    "quantile": lambda x: x[["a", "b"]].quantile([0.25, 0.5]),
    "corr": lambda x: x[["a", "b"]].corr(),
    "sum": lambda x: x[["a", "b"]].sum(),
    "mean": lambda x: x[["a", "b"]].mean(),
    "std0": lambda x: x[["a", "b"]].std(ddof=0),
    "median": lambda x: x[["a", "b"]].median(),
    "nunique": lambda x: x.nunique(),
    "count": lambda x: x.count(),
    "agg": lambda x: x[["a", "b"]].agg(["min", "max"]),
    "all": lambda x: x[["a"]].all(),
    "transpose": lambda x: x.loc[:8][["a", "b"]].T,
    "pivot_table": lambda x: x.assign(e=x["a"] % 2).pivot_table("b", "c", "e", "mean"),
    "mode": lambda x: x["c"].mode(),
    "scalar_sum": lambda x: x["a"].sum(),
    "scalar_var": lambda x: x["b"].var(),
    "scalar_prod": lambda x: x["a"].prod(),
    "scalar_idxmax": lambda x: x["b"].idxmax(),
    "scalar_argmax": lambda x: x["b"].argmax(),
    "scalar_corr": lambda x: x["a"].corr(x["b"]),
    "monotonic": lambda x: x["a"].is_monotonic_increasing,
    "not_monotonic": lambda x: x["b"].is_monotonic_decreasing,
    "index_max": lambda x: x.index.max(),
    "index_unique": lambda x: x.index.is_unique,
    "first_valid": lambda x: x["b"].first_valid_index(),
    "repeat": lambda x: x["a"].repeat(2),
    "at": lambda x: x.at[3, "a"],
    "iat": lambda x: x.iat[2, 0],
}


@pytest.mark.parametrize("name", CASES)
def test_like_pandas(f, pdf, name):
    want = CASES[name](pdf)
    if name == "mode":
        want = want.reset_index(drop=True)
        assert CASES[name](f).to_pandas().tolist() == want.tolist()
        return
    got = CASES[name](f)
    if isinstance(want, (pd.DataFrame, pd.Series)) and name in ("group_no_index",):
        got = got.to_pandas().reset_index(drop=True)
    same(got, want, **({"atol": 1e-9} if name in ("expanding", "corr") else {}))


def test_small_blocks_give_the_same_windows(f, pdf, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK", 2)
    for name in ("cumsum", "cummax", "cumprod", "shift", "shift_back", "diff", "ffill", "bfill", "ffill_limit", "rolling", "expanding", "expanding_sum", "rank", "rank_first", "monotonic"):
        same(CASES[name](f), CASES[name](pdf), **({"atol": 1e-9} if name == "expanding" else {}))


def test_order_survives_many_partitions(spark):
    pdf = pd.DataFrame({"x": range(100)}, index=pd.Index(range(100), name="k"))
    f = tb.wrap(spark.createDataFrame(pdf.reset_index()).repartition(7), "k", "k")
    same(f["x"].cumsum(), pdf["x"].cumsum())
    same(f.iloc[10:14], pdf.iloc[10:14])


def test_setting(f, pdf):
    g, p = f.copy(), pdf.copy()
    g["e"] = g["a"] + 1
    p["e"] = p["a"] + 1
    g.insert(1, "first", g["a"])
    p.insert(1, "first", p["a"])
    g.loc[g["a"] > 6, "e"] = 0
    p.loc[p["a"] > 6, "e"] = 0
    same(g, p)
    same(g.pop("first"), p.pop("first"))
    same(g, p)


def test_merge_against_pandas(spark):
    a = pd.DataFrame({"k": [1, 2, 2, 3], "v": [1.0, 2.0, 3.0, 4.0]})
    b = pd.DataFrame({"k": [2, 3, 3, 5], "v": [10.0, 20.0, 30.0, 40.0]})
    for how in ("inner", "left", "right", "outer"):
        got = tb.from_pandas(a).merge(tb.from_pandas(b), how, on="k", suffixes=("_l", "_r")).to_pandas()
        want = a.merge(b, how, on="k", suffixes=("_l", "_r"))
        key = ["k", "v_l", "v_r"]
        same(got.sort_values(key).reset_index(drop=True), want.sort_values(key).reset_index(drop=True))


def test_other_tables_need_the_option(f, pdf):
    g = tb.from_pandas(pdf.loc[:8][["a"]])
    h = tb.from_pandas(pdf.loc[3:6][["a"]])
    with pytest.raises(ValueError):
        g["a"] + h["a"]
    with tb.option_context("compute.ops_on_diff_frames", True):
        same((g["a"] + h["a"]).sort_index(), pdf.loc[:8]["a"] + pdf.loc[3:6]["a"])


def test_options():
    with pytest.raises(tb.OptionError):
        tb.get_option("no.such")
    with pytest.raises(ValueError):
        tb.set_option("compute.default_index_type", "other")
    with tb.option_context("display.max_rows", 7):
        assert tb.options.display.max_rows == 7
    assert tb.get_option("display.max_rows") == 1000
    assert "compute.max_rows" in tb.show_options()


@pytest.mark.parametrize("kind", ["sequence", "distributed", "distributed-sequence"])
def test_default_index(spark, kind):
    with tb.option_context("compute.default_index_type", kind):
        ids = tb.wrap(spark.range(1000)).index.to_pandas()
    assert ids.is_unique and (kind == "distributed" or sorted(ids) == list(range(1000)))


def test_unsupported_names_raise(f):
    for name in ("resample", "interpolate", "ewm"):
        with pytest.raises(Unsupported):
            getattr(f, name)
    with pytest.raises(Unsupported):
        f["a"].autocorr
    with pytest.raises(Unsupported):
        f.groupby("c").ohlc
    with pytest.raises(AttributeError):
        f.no_such_thing


def test_sources_and_sinks(spark, f, tmp_path):
    for kind in ("parquet", "orc", "json", "csv"):
        path = str(tmp_path / kind)
        getattr(f[["a", "c"]], f"to_{kind}")(path, index_col="k")
        back = getattr(tb, f"read_{kind}")(path, index_col="k")
        assert sorted(map(str, back.to_spark("k").select("k", "a", "c").collect())) == sorted(map(str, f[["a", "c"]].to_spark("k").collect()))
    f[["a"]].to_table("kept_rows", index_col="k")
    assert len(tb.read_table("kept_rows")) == 9
    spark.sql("DROP TABLE kept_rows")
    assert f[["a"]].to_csv().startswith("a\n1\n") and '"a":1' in f[["a"]].to_json()
    assert tb.read_csv(str(tmp_path / "csv"), usecols=["a"], nrows=2).shape == (2, 1)
    with pytest.raises(ValueError):
        tb.read_orc(str(tmp_path / "orc"), columns=["nope"])
    assert tb.range(5).shape == (5, 1) and len(tb.date_range("2024-01-01", periods=4, freq="6h")) == 4


def test_batches_and_groups(f, pdf):
    same(f.transform_batch(lambda p: p[["a"]] * 2, "a long"), pdf[["a"]] * 2)
    same(f["a"].transform_batch(lambda s: s + 1), pdf["a"] + 1)
    same(f[["a", "b"]].apply(lambda r: r["a"] + 1, axis=1), pdf[["a", "b"]].apply(lambda r: r["a"] + 1, axis=1))
    got = f.groupby("c")["a"].transform(lambda s: s - s.mean())
    same(got.sort_index(), pdf.groupby("c")["a"].transform(lambda s: s - s.mean()).sort_index(), check_freq=False)
    kept = f.groupby("c").filter(lambda p: p["a"].sum() > 12)
    assert sorted(kept["a"].to_list()) == sorted(pdf.groupby("c").filter(lambda p: p["a"].sum() > 12)["a"])


def test_plots_and_categories(f, pdf):
    from tabulon import plot

    edges, counts = plot.histogram(f[["a"]], 4)
    assert counts["a"].tolist() == np.histogram(pdf["a"], 4)[0].tolist() and np.allclose(edges, np.histogram(pdf["a"], 4)[1])
    box = plot.box(f, "a")
    assert (box["q1"], box["med"], box["q3"]) == tuple(pdf["a"].quantile([0.25, 0.5, 0.75])) and box["whishi"] == 9
    points, density = plot.kde(f, "a", 0.3, [1.0, 5.0])
    h = 0.3 * pdf["a"].std()
    want = [np.exp(-0.5 * ((x - pdf["a"]) / h) ** 2).sum() / (9 * h * np.sqrt(2 * np.pi)) for x in points]
    assert np.allclose(density, want)
    cat = f["c"].astype("category").cat
    assert list(cat.categories) == ["x", "y", "z"] and cat.codes.to_list() == pdf["c"].astype("category").cat.codes.tolist()
    codes, values = f["c"].factorize()
    assert codes.to_list() == pd.factorize(pdf["c"], sort=True)[0].tolist() and list(values) == ["x", "y", "z"]


def test_streams_are_refused(spark):
    with pytest.raises(ValueError):
        tb.wrap(spark.readStream.format("rate").load())


def test_accessors_and_sql(f):
    @tb.register_dataframe_accessor("shape_of")
    class ShapeOf:
        def __init__(self, frame):
            self.frame = frame

        def columns(self):
            return len(self.frame._labels)

    assert f.shape_of.columns() == 4
    assert tb.sql("SELECT sum(a) AS s FROM {x} WHERE c IN {keep} AND a > {low}", x=f, keep=["x"], low=1).to_spark().first().s == 18


def test_small_helpers(f, pdf):
    same(tb.Frame.from_dict({"x": [1, 2]}), pd.DataFrame({"x": [1, 2]}))
    same(tb.Frame.from_records([(1, "a")], columns=["x", "y"]), pd.DataFrame({"x": [1], "y": ["a"]}))
    assert tb.Frame({"x": [True]}).bool() and f.get_dtype_counts()["int64"] == 1
    same(np.exp(f[["a"]]), np.exp(pdf[["a"]]))
    same(np.maximum(f[["a"]], f[["a"]]), pdf[["a"]])
    same(np.modf(f["b"] / 4), pd.Series(np.modf(pdf["b"] / 4)[0]))
    assert f.index.take([0, 2]).to_list() == [0, 3]
    ids = f.batch.attach_id_column("distributed-sequence", "id")
    assert ids["id"].to_list() == list(range(9)) and ids.index.to_list() == pdf.index.tolist()
    same(f.spark.local_checkpoint()[["a"]], pdf[["a"]])
    same(f.spark.analyzed[["a"]], pdf[["a"]])
    with pytest.raises(ImportError):
        tb.load_model("no such model")


def test_factorize_never_cuts_its_values(spark):
    s = tb.wrap(spark.range(1200), "id", "id").index.to_series()
    with pytest.raises(ValueError):
        s.factorize()
