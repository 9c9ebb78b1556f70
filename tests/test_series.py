import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from barline.functions.columns import full_window, pct_rank_avg
from barline.functions.ewm import block_rows, ewm
from barline.operators import features, labels, quantiles, ranking, series
from barline.operators.asof import asof_backward


def frame(df, *keys):
    keys = list(keys) or ["symbol", "trade_date"]
    return df.toPandas().sort_values(keys).reset_index(drop=True)


def test_price_features_follow_pandas(bars):
    got = frame(features.price_features(bars))
    src = frame(bars)
    by = src.groupby("symbol")["adj_close"]
    want = pd.DataFrame({"ret_5": by.pct_change(5)})
    want["ma20_gap"] = src["adj_close"] / by.transform(lambda s: s.rolling(20).mean()) - 1
    delta = by.diff()
    gain = delta.clip(lower=0).groupby(src["symbol"]).transform(lambda s: s.ewm(alpha=1 / 14, adjust=False).mean())
    loss = (-delta.clip(upper=0)).groupby(src["symbol"]).transform(lambda s: s.ewm(alpha=1 / 14, adjust=False).mean())
    want["rsi_14"] = 100 - 100 / (1 + gain / loss.replace(0, np.nan))
    fast, slow = (by.transform(lambda s, n=n: s.ewm(span=n, adjust=False).mean()) for n in (12, 26))
    want["macd_dif"] = fast - slow
    want["macd_dea"] = (fast - slow).groupby(src["symbol"]).transform(lambda s: s.ewm(span=9, adjust=False).mean())
    want["volatility_20"] = by.pct_change().groupby(src["symbol"]).transform(lambda s: s.rolling(20).std())
    for c in want:
        np.testing.assert_allclose(got[c].astype(float), want[c], rtol=1e-7, atol=1e-9, equal_nan=True, err_msg=c)


def test_ewm_crosses_blocks_and_skips_unknown(spark):
    n = 400
    x = np.sin(np.arange(n)) + 3
    pdf = pd.DataFrame({"symbol": "a", "trade_date": pd.bdate_range("2020-01-01", periods=n).date, "x": x})
    assert block_rows([0.5]) < n
    got = frame(ewm(spark.createDataFrame(pdf), {"y": ("x", 0.5)}))["y"]
    np.testing.assert_allclose(got, pd.Series(x).ewm(alpha=0.5, adjust=False).mean(), rtol=1e-10)
    pdf.loc[[0, 1, 10, 11], "x"] = None
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    got = frame(ewm(df, {"y": ("x", 0.5)}))["y"].astype(float)
    want = pd.Series(pdf["x"]).ewm(alpha=0.5, adjust=False, ignore_na=True).mean()
    np.testing.assert_allclose(got, want, rtol=1e-10, equal_nan=True)


def test_rank_with_ties_and_unknown(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.integers(0, 4, 300), "v": rng.integers(-6, 6, 300).astype(float), "id": range(300)})
    pdf.loc[rng.integers(0, 300, 40), "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    want = pdf.groupby("g")["v"].rank(pct=True)
    for out in (df.withColumn("r", pct_rank_avg("v", "g")), ranking.pct_rank_large(df, "v", ["g"], "r")):
        got = frame(out, "id")["r"].astype(float)
        np.testing.assert_allclose(got, want, rtol=1e-12, equal_nan=True)


def test_full_window_needs_all_values(spark):
    rows = [("a", i, v) for i, v in enumerate([1.0, None, 3.0, 4.0, 5.0])]
    df = spark.createDataFrame(rows, "symbol string, trade_date int, v double")
    got = [r["m"] for r in df.withColumn("m", full_window(F.avg, "v", 3)).orderBy("trade_date").collect()]
    assert got == [None, None, None, None, 4.0]


def test_flat_series_has_no_strength(spark):
    pdf = pd.DataFrame({"symbol": "a", "trade_date": pd.bdate_range("2020-01-01", periods=30).date})
    for c in ("open", "high", "low", "close", "adj_close"):
        pdf[c] = 5.0
    pdf["volume"] = 0.0
    df = spark.createDataFrame(pdf)
    out = frame(features.price_features(df))
    assert out["rsi_6"].isna().all() and out["boll_pos"].isna().all()
    vol = frame(df.withColumns(series.volume_ratio_columns()))
    assert vol["vol_ratio_5"].isna().all() and (vol["shrink_volume_flag"] == 0).all()


def test_drawdown_against_paths(bars):
    got = frame(labels.forward_drawdowns(bars))
    src = frame(bars)
    for _, g in src.groupby("symbol"):
        o, c = g["open"].to_numpy(), g["close"].to_numpy()
        for k in (3, 10, 40):
            for i in list(range(min(len(g), 60))) + [len(g) - k - 1, len(g) - k]:
                if i < 0 or i >= len(g):
                    continue
                have = got.loc[g.index[i], f"label_maxdd_{k}"]
                if i + k >= len(g):
                    assert pd.isna(have)
                    continue
                path = np.r_[o[i + 1], c[i + 1: i + k + 1]]
                assert abs(have - (path / np.maximum.accumulate(path) - 1).min()) < 1e-12


def test_label_table_keeps_only_complete_rows(bars):
    index = bars.where("symbol = '000000.SZ'").selectExpr("'000300.SH' index_code", "trade_date", "open", "close")
    out = frame(labels.label_table(bars, index))
    per_symbol = out.groupby("symbol").size().to_dict()
    assert per_symbol == {"000000.SZ": 1660, "000001.SZ": 160, "000002.SZ": 90, "000003.SZ": 5}


def test_asof_carries_unknown_metrics(spark):
    left = spark.createDataFrame([("a", d) for d in ("2020-01-01", "2020-01-10", "2020-01-20", "2020-02-01")], "symbol string, trade_date string")
    right = spark.createDataFrame(
        [("a", "2020-01-10", "2019-12-01", 1.0, 5.0), ("a", "2020-01-10", "2019-12-31", 2.0, 6.0), ("a", "2020-01-20", "2020-01-01", None, 7.0)],
        "symbol string, asof_date string, report_date string, roe double, m double")
    left = left.withColumn("trade_date", F.to_date("trade_date"))
    right = right.withColumns({c: F.to_date(c) for c in ("asof_date", "report_date")})
    rows = asof_backward(left, right, ["roe", "m"]).orderBy("trade_date").collect()
    assert [(r["roe"], r["m"]) for r in rows] == [(None, None), (2.0, 6.0), (None, 7.0), (None, 7.0)]


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 2000), "x": rng.normal(0, 100, 2000), "y": rng.integers(-3, 3, 2000).astype(float)})
    got = quantiles.exact_quantiles(spark.createDataFrame(pdf), ["x", "y"], (0.005, 0.25, 0.5, 0.995), ["g"]).toPandas()
    for _, r in got.iterrows():
        v = pdf.loc[pdf.g == r["g"], r["column"]]
        np.testing.assert_allclose([r[f"q{i}"] for i in range(4)], v.quantile([0.005, 0.25, 0.5, 0.995]), rtol=1e-12)


def test_no_look_ahead(bars):
    """Changing later rows must not change earlier features."""
    cut = F.lit("2015-06-01").cast("date")
    changed = bars.withColumns({c: F.when(F.col("trade_date") > cut, F.col(c) * 3).otherwise(F.col(c)) for c in ("close", "adj_close", "high", "low", "open")})
    a, b = (frame(features.price_features(x).where(F.col("trade_date") <= cut)) for x in (bars, changed))
    pd.testing.assert_frame_equal(a, b)


def test_tail_and_sequence(bars):
    assert series.tail_per_symbol(bars, 5).groupBy("symbol").count().agg(F.max("count")).first()[0] == 5
    seq = series.sequence_window(bars, ["open", "close"], 10, drop_incomplete=False)
    assert seq.where(F.size("x_seq") != 10).count() == 0
    short = seq.where("symbol = '000005.SZ'").first()["x_seq"]
    assert short[:9] == [[0.0, 0.0]] * 9


def test_block_moments_equal_sliding_ones(spark):
    rng = np.random.default_rng(3)
    frames = []
    for i, size in enumerate((40, 9, 5, 3)):
        x, y = rng.normal(0, 1, size), rng.normal(0, 1, size)
        if i == 0:
            x[7], y[20], x[30:38], x[12] = np.nan, np.nan, 2.7, 1e9
            y[22:30] = 0.1
        frames.append(pd.DataFrame({"symbol": f"s{i}", "trade_date": pd.bdate_range("2020-01-01", periods=size).date, "x": x, "y": y}))
    pdf = pd.concat(frames, ignore_index=True)
    df = spark.createDataFrame(pdf).withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("x", "y")})
    out = series.rolling_moments(df, 5, {"mean": "x"}, {"dev": "x"}, {"beta": ("x", "y")})
    got = out.orderBy("symbol", "trade_date").toPandas()
    mean = pd.concat([g["x"].rolling(5).apply(np.mean, raw=True) for _, g in pdf.groupby("symbol")])
    dev = pd.concat([g["x"].rolling(5).apply(lambda v: np.std(v, ddof=1), raw=True) for _, g in pdf.groupby("symbol")])
    np.testing.assert_allclose(got["mean"].astype(float), mean, rtol=1e-12)
    np.testing.assert_allclose(got["dev"].astype(float), dev, rtol=1e-9, atol=1e-15)
    assert (got["dev"] == 0).any()
    for k in range(len(pdf)):
        part = pdf[(pdf["symbol"] == pdf["symbol"][k]) & (pdf.index <= k)].tail(5)
        full = len(part) == 5 and part[["x", "y"]].notna().all().all() and part["y"].nunique() > 1
        value = got["beta"][k]
        assert full == (value is not None and not np.isnan(value))
        if full:
            np.testing.assert_allclose(value, np.cov(part["x"], part["y"])[0, 1] / np.var(part["y"], ddof=1), rtol=1e-9, atol=1e-12)
