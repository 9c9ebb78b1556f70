"""Declared schemas, natural keys and model column groups."""

from __future__ import annotations

from pyspark.sql import types as T

_STR, _DBL, _DATE, _BOOL, _INT, _TIME = T.StringType(), T.DoubleType(), T.DateType(), T.BooleanType(), T.IntegerType(), T.TimestampNTZType()
_STRINGS, _DOUBLES, _INTS, _MAP = T.ArrayType(_STR), T.ArrayType(_DBL), T.ArrayType(_INT), T.MapType(_STR, _STR)


def _table(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns])


# Table layouts and natural keys.
SCHEMAS: dict[str, T.StructType] = {
    "securities": _table(
        ("symbol", _STR), ("name", _STR), ("exchange", _STR), ("board", _STR), ("industry", _STR), ("list_date", _DATE), ("delist_date", _DATE),
        ("is_st", _BOOL), ("status", _STR),
    ),
    "trade_calendar": _table(
        ("trade_date", _DATE), ("is_open", _BOOL), ("exchange", _STR),
    ),
    "daily_bars": _table(
        ("symbol", _STR), ("trade_date", _DATE), ("open", _DBL), ("high", _DBL), ("low", _DBL), ("close", _DBL), ("pre_close", _DBL), ("volume", _DBL),
        ("amount", _DBL), ("turnover_rate", _DBL), ("amplitude", _DBL), ("pct_chg", _DBL), ("adj_factor", _DBL), ("adj_close", _DBL),
        ("is_suspended", _BOOL), ("source", _STR),
    ),
    "index_bars": _table(
        ("index_code", _STR), ("trade_date", _DATE), ("open", _DBL), ("high", _DBL), ("low", _DBL), ("close", _DBL), ("volume", _DBL),
        ("amount", _DBL), ("source", _STR),
    ),
    "sector_daily": _table(
        ("sector_id", _STR), ("sector_name", _STR), ("trade_date", _DATE), ("close", _DBL), ("pct_chg", _DBL), ("amount", _DBL), ("turnover", _DBL),
        ("up_limit_count", _INT), ("source", _STR),
    ),
    "capital_flow_daily": _table(
        ("symbol", _STR), ("trade_date", _DATE), ("main_net_inflow", _DBL), ("super_large_net_inflow", _DBL), ("large_net_inflow", _DBL),
        ("medium_net_inflow", _DBL), ("small_net_inflow", _DBL), ("main_inflow_ratio", _DBL), ("source", _STR),
    ),
    "financial_snapshot": _table(
        ("symbol", _STR), ("report_date", _DATE), ("asof_date", _DATE), ("pe_ttm", _DBL), ("pb", _DBL), ("ps_ttm", _DBL), ("roe", _DBL),
        ("revenue_yoy", _DBL), ("profit_yoy", _DBL), ("gross_margin", _DBL), ("debt_ratio", _DBL), ("industry_percentile", _DBL), ("source", _STR),
    ),
    "news": _table(
        ("news_id", _STR), ("publish_time", _TIME), ("source", _STR), ("title", _STR), ("summary", _STR), ("content", _STR), ("url", _STR),
        ("mentioned_symbols", _STRINGS), ("importance_score_raw", _DBL), ("normalized_flag", _BOOL),
    ),
    "event_features_daily": _table(
        ("trade_date", _DATE), ("event_embedding", _DOUBLES),
    ),
    "company_profiles": _table(
        ("symbol", _STR), ("asof_date", _DATE), ("industry_name", _STR), ("board", _STR), ("market_cap_log", _DBL), ("volatility_120", _DBL),
        ("beta_120", _DBL), ("turnover_mean_120", _DBL), ("amount_mean_120", _DBL), ("ret_20", _DBL), ("ret_60", _DBL), ("roe", _DBL),
        ("revenue_yoy", _DBL), ("profit_yoy", _DBL), ("debt_ratio", _DBL), ("gross_margin", _DBL), ("profile_version", _STR),
    ),
    "company_similarity": _table(
        ("symbol", _STR), ("neighbor_symbol", _STR), ("sim_score", _DBL), ("sim_rank", _INT), ("similarity_version", _STR), ("asof_date", _DATE),
    ),
    "bad_records": _table(
        ("domain", _STR), ("business_key", _STR), ("payload", _STR), ("error_message", _STR),
    ),
}

KEYS: dict[str, tuple[str, ...]] = {
    "securities": ("symbol",),
    "trade_calendar": ("trade_date", "exchange"),
    "daily_bars": ("symbol", "trade_date"),
    "index_bars": ("index_code", "trade_date"),
    "sector_daily": ("sector_id", "trade_date"),
    "capital_flow_daily": ("symbol", "trade_date"),
    "financial_snapshot": ("symbol", "report_date", "asof_date"),
    "news": ("news_id",),
    "event_features_daily": ("trade_date",),
    "company_profiles": ("symbol", "asof_date"),
    "company_similarity": ("symbol", "neighbor_symbol", "similarity_version"),
}

# Model column groups, in model order.
SEQUENCE_COLUMNS = [
    "open", "high", "low", "close", "adj_close", "volume", "amount", "turnover_rate", "pct_chg", "ret_1", "ret_3", "ret_5", "ret_10", "ret_20",
    "ma5_gap", "ma10_gap", "ma20_gap", "ma60_gap", "rsi_6", "rsi_14", "macd_dif", "macd_dea", "macd_hist", "atr_14", "boll_pos", "volatility_5",
    "volatility_20", "vol_ratio_5", "vol_ratio_20", "intraday_range", "candle_body", "upper_shadow", "lower_shadow", "gap_open_to_prev_close",
    "close_to_prev_close", "high_to_prev_close", "low_to_prev_close", "amount_log1p", "volume_log1p", "turnover_rate_delta", "ret_spread_5_20",
    "volatility_ratio_5_20",
]
TABULAR_COLUMNS = [
    "list_days", "turnover_rank_industry", "amount_rank_market", "ret5_vs_hs300", "ret10_vs_hs300", "ret20_vs_industry", "stock_rank_in_industry",
    "industry_rank_5d", "industry_rank_20d", "roe", "revenue_yoy", "profit_yoy", "industry_roe_percentile",
]
MARKET_COLUMNS = [
    "up_limit_count", "down_limit_count", "broken_limit_rate", "consecutive_limit_height", "market_turnover", "hs300_ret_1", "cyb_ret_1",
    "market_volatility_5", "sector_hotness_top1", "sector_hotness_top3_mean", "risk_on_flag", "risk_off_flag", "limit_count_spread",
    "limit_count_ratio", "sector_hotness_spread", "market_regime_score",
]
PROFILE_COLUMNS = [
    "market_cap_log", "volatility_120", "beta_120", "turnover_mean_120", "amount_mean_120", "ret_20", "ret_60", "roe", "revenue_yoy", "profit_yoy",
    "debt_ratio", "gross_margin",
]
ID_COLUMNS = ["symbol_id", "industry_id", "board_id"]
RANK_COLUMNS = ["turnover_rank_industry", "amount_rank_market", "stock_rank_in_industry", "industry_rank_5d", "industry_rank_20d", "industry_roe_percentile"]
FLAG_COLUMNS = ["shrink_volume_flag", "surge_volume_flag", "risk_on_flag", "risk_off_flag"]
BOUNDED_COLUMNS = ["boll_pos", "broken_limit_rate", *RANK_COLUMNS]
ZERO_COLUMNS = [*MARKET_COLUMNS, "ret5_vs_hs300", "ret10_vs_hs300", "ret20_vs_industry", *FLAG_COLUMNS[:2]]
EVENT_DIM = 256
HORIZONS = (3, 5, 10, 20, 40)
BIGLOSS_HORIZONS = (5, 20)
BENCHMARK_INDEX = "000300.SH"
GROWTH_INDEX = "399006.SZ"
