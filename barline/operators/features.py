"""Composite feature frames: price, volume, relative, fundamental and market."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.columns import by_date, change, div, flag, packed, pct_rank_avg, series_key, unpacked
from barline.operators import series
from barline.operators.asof import asof_backward
from barline.sources.schemas import BENCHMARK_INDEX, GROWTH_INDEX

PRICE_OUT = (
    "ret_1 ret_3 ret_5 ret_10 ret_20 ret_60 ma5_gap ma10_gap ma20_gap ma60_gap rsi_6 rsi_14 "
    "macd_dif macd_dea macd_hist atr_14 boll_pos volatility_5 volatility_20"
).split()
VOLUME_OUT = (
    "vol_ratio_5 vol_ratio_20 turnover_rank_industry amount_rank_market shrink_volume_flag surge_volume_flag"
).split()
RELATIVE_OUT = (
    "ret5_vs_hs300 ret10_vs_hs300 ret20_vs_industry stock_rank_in_industry industry_rank_5d industry_rank_20d"
).split()
FUNDAMENTAL_OUT = "roe revenue_yoy profit_yoy industry_roe_percentile".split()
MARKET_OUT = (
    "up_limit_count down_limit_count broken_limit_rate consecutive_limit_height market_turnover hs300_ret_1 "
    "cyb_ret_1 market_volatility_5 sector_hotness_top1 sector_hotness_top3_mean risk_on_flag risk_off_flag"
).split()


def with_price_features(bars: DataFrame) -> DataFrame:
    """All price columns next to the bars, on one shuffle by symbol.  The recursive means pass many windows and read one price."""
    work = series.atr(bars.withColumns(series.return_columns()))
    work = work.withColumns({
        **series.gap_columns(), **series.volatility_columns(), "boll_pos": series.bollinger_column(),
    })
    before = work.columns
    rest = [c for c in before if c not in (*series_key(), "trade_date", "adj_close")]
    work = series.oscillators(packed(work, rest, "__rest"))
    added = [c for c in work.columns if c not in before and c != "__rest"]
    return unpacked(work, "__rest").select(*before, *added)


def price_features(bars: DataFrame) -> DataFrame:
    return with_price_features(bars).select("symbol", "trade_date", *PRICE_OUT)


def with_industry(df: DataFrame, securities: DataFrame) -> DataFrame:
    return df.join(securities.select("symbol", "industry"), "symbol", "left")


def volume_features(bars: DataFrame, securities: DataFrame) -> DataFrame:
    work = with_industry(bars, securities).withColumns(series.volume_ratio_columns())
    work = work.withColumns({
        "turnover_rank_industry": pct_rank_avg("turnover_rate", "trade_date", "industry"),
        "amount_rank_market": pct_rank_avg("amount", "trade_date"),
    })
    return work.select("symbol", "trade_date", *VOLUME_OUT)


def index_returns(index_bars: DataFrame, rows=(5, 10), code: str = BENCHMARK_INDEX, prefix: str = "hs300") -> DataFrame:
    """Index changes over index rows, whatever dates the stocks trade on."""
    w = Window.partitionBy("index_code").orderBy("trade_date")
    return index_bars.where(F.col("index_code") == code).select(
        "trade_date", *[change("close", n, w).alias(f"{prefix}_ret_{n}") for n in rows]
    )


def industry_daily_mean(df: DataFrame) -> DataFrame:
    """Mean 5- and 20-row return per date and industry; NULL industry left out."""
    return df.where(F.col("industry").isNotNull()).groupBy("trade_date", "industry").agg(
        F.avg("ret_5").alias("industry_ret_5"), F.avg("ret_20").alias("industry_ret_20")
    )


def industry_rank(daily: DataFrame) -> DataFrame:
    return daily.withColumns({
        "industry_rank_5d": pct_rank_avg("industry_ret_5", "trade_date"),
        "industry_rank_20d": pct_rank_avg("industry_ret_20", "trade_date"),
    })


def relative_features(bars: DataFrame, index_bars: DataFrame, securities: DataFrame) -> DataFrame:
    work = with_industry(bars, securities).withColumns(series.return_columns((5, 10, 20)))
    return add_relative(work, index_bars).select("symbol", "trade_date", *RELATIVE_OUT)


def add_relative(work: DataFrame, index_bars: DataFrame) -> DataFrame:
    """Needs ``industry`` and the 5, 10 and 20 row returns."""
    ranks = industry_rank(industry_daily_mean(work)).drop("industry_ret_5")
    out = work.join(by_date(index_returns(index_bars)), "trade_date", "left")
    out = out.withColumns({
        "ret5_vs_hs300": F.col("ret_5") - F.col("hs300_ret_5"),
        "ret10_vs_hs300": F.col("ret_10") - F.col("hs300_ret_10"),
        "stock_rank_in_industry": pct_rank_avg("pct_chg", "trade_date", "industry"),
    })
    out = out.join(ranks, ["trade_date", "industry"], "left")
    return out.withColumn("ret20_vs_industry", F.col("ret_20") - F.col("industry_ret_20")).drop(
        "industry_ret_20", "hs300_ret_5", "hs300_ret_10"
    )


def fundamental_features(bars: DataFrame, financials: DataFrame, securities: DataFrame) -> DataFrame:
    """Latest snapshot known on each date, and its return-on-equity rank in the industry."""
    metrics = ["roe", "revenue_yoy", "profit_yoy"]
    work = asof_backward(bars.select("symbol", "trade_date"), financials, metrics)
    work = with_industry(work, securities)
    return work.withColumn("industry_roe_percentile", pct_rank_avg("roe", "trade_date", "industry")).select(
        "symbol", "trade_date", *FUNDAMENTAL_OUT
    )


def market_breadth(bars: DataFrame) -> DataFrame:
    """Limit counts, touches and turnover per date: one partial aggregation."""
    touched = div(F.col("high"), F.col("pre_close")) - 1 >= 0.095
    return bars.groupBy("trade_date").agg(
        F.count_if(F.col("pct_chg") >= 9.5).alias("up_limit_count"),
        F.count_if(F.col("pct_chg") <= -9.5).alias("down_limit_count"),
        F.sum("amount").alias("market_turnover"),
        F.count_if(touched).alias("up_touch_count"),
    )


def broken_limit_rate():
    missed = F.greatest(F.col("up_touch_count") - F.col("up_limit_count"), F.lit(0)).cast("double")
    return F.coalesce(div(missed, F.col("up_touch_count")), F.lit(0.0))


def sector_hotness(sector_daily: DataFrame) -> DataFrame:
    """Best and mean of the three best sector moves per date; three rows per date survive the shuffle."""
    w = Window.partitionBy("trade_date").orderBy(F.col("pct_chg").desc(), "sector_id")
    top = (
        sector_daily.where(F.col("pct_chg").isNotNull())
        .withColumn("rn", F.row_number().over(w))
        .where(F.col("rn") <= 3)
    )
    best = top.groupBy("trade_date").agg(
        F.max("pct_chg").alias("sector_hotness_top1"), F.avg("pct_chg").alias("sector_hotness_top3_mean")
    )
    dates = sector_daily.select("trade_date").distinct()
    return dates.join(best, "trade_date", "left").na.fill(0.0)


def calendar_window(n: int):
    """Rolling over already aggregated dates: one row per trading date, so one task is enough."""
    return Window.partitionBy(F.lit(0)).orderBy("trade_date").rowsBetween(-(n - 1), 0)


def index_returns_on_bar_dates(dates: DataFrame, index_bars: DataFrame) -> DataFrame:
    """One-row index changes over the dates stocks traded on (a date without index breaks the pair)."""
    closes = index_bars.groupBy("trade_date").agg(
        F.max(F.when(F.col("index_code") == BENCHMARK_INDEX, F.col("close"))).alias("hs300_close"),
        F.max(F.when(F.col("index_code") == GROWTH_INDEX, F.col("close"))).alias("cyb_close"),
    )
    w = Window.partitionBy(F.lit(0)).orderBy("trade_date")
    return dates.join(closes, "trade_date", "left").withColumns({
        "hs300_ret_1": change("hs300_close", 1, w), "cyb_ret_1": change("cyb_close", 1, w),
    })


def market_features(bars: DataFrame, index_bars: DataFrame, sector_daily: DataFrame | None) -> DataFrame:
    """Twelve columns per trading date."""
    w5 = calendar_window(5)
    work = market_breadth(bars).withColumn("broken_limit_rate", broken_limit_rate())
    work = index_returns_on_bar_dates(work, index_bars).withColumns({
        "consecutive_limit_height": F.when(F.count("up_limit_count").over(w5) == 5, F.max("up_limit_count").over(w5)),
    })
    work = work.withColumn(
        "market_volatility_5", F.when(F.count("hs300_ret_1").over(w5) == 5, F.stddev_samp("hs300_ret_1").over(w5))
    )
    if sector_daily is None:
        work = work.withColumns({c: F.lit(0.0) for c in ("sector_hotness_top1", "sector_hotness_top3_mean")})
    else:
        work = work.join(sector_hotness(sector_daily), "trade_date", "left")
    breadth = F.col("up_limit_count") - F.col("down_limit_count")
    top1 = F.coalesce(F.col("sector_hotness_top1"), F.lit(0.0))
    top3 = F.coalesce(F.col("sector_hotness_top3_mean"), F.lit(0.0))
    work = work.withColumns({
        "risk_on_flag": flag((F.col("hs300_ret_1") > 0) & ((breadth > 0) | (top1 > 0) | (top3 > 0))),
        "risk_off_flag": flag((F.col("hs300_ret_1") < 0) & ((breadth < 0) | (top1 < 0) | (top3 < 0))),
    })
    return work.select("trade_date", *MARKET_OUT)
