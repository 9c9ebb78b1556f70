"""Composite feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.catalog.ranks import ASOF_ROE, IND, avg_rank
from barline.catalog.registry import query
from barline.catalog.series import (
    BARDATE_RETURNS,
    BENCH_R1,
    BETA,
    BOLL,
    BREADTH,
    GAPS_SQL,
    MACD_CTES,
    MACD_ROWS_SQL,
    MAXDD,
    PATHS,
    RETURNS_SQL,
    RSI_CTES,
    RSI_ROWS_SQL,
    TR_CTE,
    VOL_SQL,
    W,
    W5,
    full,
    ret,
)
from barline.functions import vectors
from barline.operators import features, finalize, labels, profiles, series, similarity
from barline.sources.schemas import HORIZONS, PROFILE_COLUMNS

PRICE = (
    f"{RSI_CTES}, rsi AS ({RSI_ROWS_SQL}), {MACD_CTES}, macd AS ({MACD_ROWS_SQL}), {TR_CTE}, "
    f"p AS (SELECT *, {ret(1)} AS r1 FROM tr), "
    f"win AS (SELECT symbol, trade_date, {RETURNS_SQL}, {GAPS_SQL}, {BOLL} AS boll_pos, "
    f"{full('avg', 'tr', 14)} AS atr_14, {full('stddev_samp', 'r1', 5)} AS volatility_5, "
    f"{full('stddev_samp', 'r1', 20)} AS volatility_20 FROM p) "
    "SELECT win.*, rsi_6, rsi_14, macd_dif, macd_dea, macd_hist FROM win LEFT JOIN rsi USING (symbol, trade_date) "
    "LEFT JOIN macd USING (symbol, trade_date)"
)
COARSE = {"macd_dif": "~3", "macd_dea": "~3", "macd_hist": "~3", "atr_14": "~3", "rsi_6": "~4", "rsi_14": "~4"}
PRICE_SPEC = " ".join(c + COARSE.get(c, "~") for c in features.PRICE_OUT)


@query(f"symbol trade_date {PRICE_SPEC}", PRICE, "bars")
def price_features(t):
    return features.price_features(t.bars)


VOLUME = (
    f"{IND}, v AS ({VOL_SQL}), k AS (SELECT symbol, trade_date, {avg_rank('turnover_rate', 'trade_date, industry')} "
    f"AS turnover_rank_industry, {avg_rank('amount', 'trade_date')} AS amount_rank_market FROM b) "
    "SELECT * FROM v JOIN k USING (symbol, trade_date)"
)


@query("symbol trade_date " + " ".join(f"{c}~" for c in features.VOLUME_OUT), VOLUME, "bars securities")
def volume_features(t):
    return features.volume_features(t.bars, t.securities)


INDEX_RET = (
    "SELECT trade_date, close / nullif(lag(close, 5) OVER (ORDER BY trade_date), 0) - 1 AS hs300_ret_5, "
    "close / nullif(lag(close, 10) OVER (ORDER BY trade_date), 0) - 1 AS hs300_ret_10 "
    "FROM index_bars WHERE index_code = '000300.SH'"
)
RELATIVE = (
    f"{IND}, r AS (SELECT *, {ret(5)} AS ret_5, {ret(10)} AS ret_10, {ret(20)} AS ret_20, "
    f"{avg_rank('pct_chg', 'trade_date, industry')} AS stock_rank_in_industry FROM b), ix AS ({INDEX_RET}), "
    "m AS (SELECT trade_date, industry, avg(ret_5) AS m5, avg(ret_20) AS m20 FROM r WHERE industry IS NOT NULL GROUP BY 1, 2), "
    f"k AS (SELECT trade_date, industry, m20, {avg_rank('m5', 'trade_date')} AS industry_rank_5d, "
    f"{avg_rank('m20', 'trade_date')} AS industry_rank_20d FROM m) "
    "SELECT r.symbol, r.trade_date, ret_5 - hs300_ret_5 AS ret5_vs_hs300, ret_10 - hs300_ret_10 AS ret10_vs_hs300, "
    "ret_20 - m20 AS ret20_vs_industry, stock_rank_in_industry, industry_rank_5d, industry_rank_20d "
    "FROM r LEFT JOIN ix USING (trade_date) LEFT JOIN k USING (trade_date, industry)"
)


@query("symbol trade_date " + " ".join(f"{c}~" for c in features.RELATIVE_OUT), RELATIVE, "bars securities index_bars")
def relative_features(t):
    t = t.stored()
    return features.relative_features(t.bars, t.index_bars, t.securities)


FUNDAMENTAL = (
    f"{ASOF_ROE}, c AS (SELECT a.*, industry FROM a LEFT JOIN securities USING (symbol)) SELECT symbol, trade_date, roe, "
    f"revenue_yoy, profit_yoy, {avg_rank('roe', 'trade_date, industry')} AS industry_roe_percentile FROM c"
)


@query("symbol trade_date roe~ revenue_yoy~ profit_yoy~ industry_roe_percentile~", FUNDAMENTAL, "bars financials securities")
def fundamental_features(t):
    return features.fundamental_features(t.bars, t.financials, t.securities)


HOT = (
    "SELECT trade_date, coalesce(max(CASE WHEN rn = 1 THEN pct_chg END), 0) AS sector_hotness_top1, "
    "coalesce(avg(CASE WHEN rn <= 3 THEN pct_chg END), 0) AS sector_hotness_top3_mean FROM ("
    "SELECT trade_date, pct_chg, row_number() OVER (PARTITION BY trade_date ORDER BY pct_chg DESC NULLS LAST, sector_id) "
    "AS rn FROM sector_daily) GROUP BY trade_date"
)
MARKET = f"""
    b0 AS ({BREADTH}), hot AS ({HOT}), ir AS ({BARDATE_RETURNS}),
    j AS (SELECT b0.*, ir.hs300_ret_1, ir.cyb_ret_1, hot.sector_hotness_top1, hot.sector_hotness_top3_mean,
        coalesce(greatest(up_touch_count - up_limit_count, 0) / CAST(nullif(up_touch_count, 0) AS DOUBLE), 0) AS broken_limit_rate,
        CASE WHEN count(up_limit_count) OVER {W5} = 5 THEN max(up_limit_count) OVER {W5} END AS consecutive_limit_height,
        CASE WHEN count(hs300_ret_1) OVER {W5} = 5 THEN stddev_samp(hs300_ret_1) OVER {W5} END AS market_volatility_5
        FROM b0 LEFT JOIN ir USING (trade_date) LEFT JOIN hot USING (trade_date))
    SELECT *, CASE WHEN hs300_ret_1 > 0 AND (up_limit_count > down_limit_count OR coalesce(sector_hotness_top1, 0) > 0
                OR coalesce(sector_hotness_top3_mean, 0) > 0) THEN 1.0 ELSE 0.0 END AS risk_on_flag,
           CASE WHEN hs300_ret_1 < 0 AND (up_limit_count < down_limit_count OR coalesce(sector_hotness_top1, 0) < 0
                OR coalesce(sector_hotness_top3_mean, 0) < 0) THEN 1.0 ELSE 0.0 END AS risk_off_flag FROM j"""
MARKET_SPEC = " ".join(c + ("~2" if c == "market_turnover" else "~") for c in features.MARKET_OUT)


@query(f"trade_date {MARKET_SPEC}", MARKET, "bars index_bars sector_daily")
def market_features(t):
    t = t.stored()
    return features.market_features(t.bars, t.index_bars, t.sector_daily)


REGIME = (
    f"m AS (WITH {MARKET}) SELECT trade_date, up_limit_count - down_limit_count AS limit_count_spread, "
    "(up_limit_count - down_limit_count) / (up_limit_count + down_limit_count + 1.0) AS limit_count_ratio, "
    "sector_hotness_top1 - sector_hotness_top3_mean AS sector_hotness_spread, risk_on_flag - risk_off_flag AS market_regime_score FROM m"
)


@query("trade_date limit_count_spread~ limit_count_ratio~ sector_hotness_spread~ market_regime_score~", REGIME,
       "bars index_bars sector_daily")
def market_regime_features(t):
    t = t.stored()
    return features.market_features(t.bars, t.index_bars, t.sector_daily).withColumns(series.regime_columns())


CAP = (
    "ln(1 + greatest(coalesce(amount / nullif(turnover_rate / 100, 0), close * volume), 0))"
)


@query("symbol trade_date market_cap_log~", f"SELECT symbol, trade_date, {CAP} AS market_cap_log FROM bars", "bars")
def market_cap_estimate(t):
    return t.bars.withColumn("market_cap_log", profiles.market_cap_estimate())


PROFILES = f"""
    r AS (SELECT *, {ret(1)} AS ret_1, {ret(20)} AS ret_20, {ret(60)} AS ret_60, {CAP} AS market_cap_log FROM bars),
    {BENCH_R1}, q AS (SELECT * FROM r LEFT JOIN bench USING (trade_date)),
    rolled AS (SELECT symbol, trade_date, market_cap_log, {full('stddev_samp', 'ret_1', 120)} AS volatility_120,
        {BETA} AS beta_120, {full('avg', 'turnover_rate', 120)} AS turnover_mean_120,
        {full('avg', 'amount', 120)} AS amount_mean_120, ret_20, ret_60 FROM q),
    snap AS (SELECT * FROM financials
        QUALIFY row_number() OVER (PARTITION BY symbol, asof_date ORDER BY report_date DESC) = 1)
    SELECT x.symbol, x.trade_date AS asof_date, s.industry AS industry_name, s.board, x.* EXCLUDE (symbol, trade_date),
           f.roe, f.revenue_yoy, f.profit_yoy, f.debt_ratio, f.gross_margin, 'cp1' AS profile_version
    FROM rolled x ASOF LEFT JOIN snap f ON x.symbol = f.symbol AND x.trade_date >= f.asof_date
    LEFT JOIN securities s ON s.symbol = x.symbol"""
PROFILE_SPEC = " ".join(c + ("~5" if c == "amount_mean_120" else "~") for c in PROFILE_COLUMNS)
PROFILE_USES = "bars index_bars financials securities"


def profile_frame(t):
    t = t.stored()
    return profiles.company_profiles(t.bars, t.index_bars, t.financials, t.securities)


@query(f"symbol asof_date industry_name board {PROFILE_SPEC} profile_version", PROFILES, PROFILE_USES)
def company_profiles(t):
    return profile_frame(t)


@query("usable",
       f"p AS (WITH {PROFILES}) SELECT (" + " + ".join(f"count({c})" for c in PROFILE_COLUMNS) + ") > 0 AND ("
       + " + ".join(f"coalesce(sum(abs({c})), 0)" for c in profiles.CORE) + ") <> 0 AS usable FROM p", PROFILE_USES)
def profiles_usable(t):
    return profiles.profiles_usable(profile_frame(t))


def standardised(columns) -> str:
    return ", ".join(
        f"(v_{c} - avg(v_{c}) OVER ()) / CASE WHEN coalesce(stddev_pop(v_{c}) OVER (), 0) = 0 THEN 1 "
        f"ELSE stddev_pop(v_{c}) OVER () END" for c in columns
    )


SIM_COLUMNS = [*similarity.FUNDAMENTALS, *similarity.BEHAVIOUR, "market_cap_log"]
SIMILARITY = f"""
    prof AS (WITH {PROFILES}), last AS (SELECT * FROM prof QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY asof_date DESC) = 1),
    filled AS (SELECT symbol, asof_date, coalesce(industry_name, '') AS industry, coalesce(board, '') AS board,
        {', '.join(f'coalesce({c}, median({c}) OVER (), 0) AS v_{c}' for c in SIM_COLUMNS)} FROM last),
    z AS (SELECT symbol, asof_date, industry, board, v_market_cap_log AS cap, [{standardised(similarity.FUNDAMENTALS)}] AS f,
        [{standardised(similarity.BEHAVIOUR)}] AS b FROM filled),
    scored AS (SELECT x.symbol, y.symbol AS neighbor_symbol, greatest(x.asof_date, y.asof_date) AS asof_date,
        0.4 * CASE WHEN x.industry = y.industry AND x.industry <> '' THEN 1.0 WHEN x.board = y.board AND x.board <> '' THEN 0.25
              ELSE 0 END + 0.2 * exp(-abs(x.cap - y.cap))
        + 0.2 * list_inner_product(x.f, y.f) / nullif(sqrt(list_inner_product(x.f, x.f)) * sqrt(list_inner_product(y.f, y.f)), 0)
        + 0.2 * list_inner_product(x.b, y.b) / nullif(sqrt(list_inner_product(x.b, x.b)) * sqrt(list_inner_product(y.b, y.b)), 0)
        AS sim_score FROM z x JOIN z y ON x.symbol <> y.symbol),
    sim AS (SELECT symbol, neighbor_symbol, sim_score, asof_date, 'cs1' AS similarity_version,
        CAST(row_number() OVER (PARTITION BY symbol ORDER BY round(sim_score, 12) DESC, neighbor_symbol) AS INTEGER) AS sim_rank
        FROM scored WHERE sim_score > 0 QUALIFY sim_rank <= 10)"""


@query("symbol neighbor_symbol sim_score~ sim_rank similarity_version asof_date", f"{SIMILARITY} SELECT * FROM sim", PROFILE_USES)
def company_similarity(t):
    return similarity.company_similarity(profile_frame(t))


@query("symbol neighbor_symbol sim_rank",
       f"{SIMILARITY} SELECT symbol, neighbor_symbol, sim_rank FROM sim WHERE sim_rank <= 3", PROFILE_USES)
def similarity_topk(t):
    return similarity.company_similarity(profile_frame(t), k=3, smallest=16)


IDS = "ids AS (SELECT symbol, CAST(row_number() OVER (ORDER BY symbol) AS INTEGER) AS symbol_id FROM securities)"


@query("symbol neighbor_symbol_ids[s] neighbor_scores[]",
       f"{SIMILARITY}, {IDS}, j AS (SELECT sim.*, coalesce(ids.symbol_id, 0) AS nid FROM sim LEFT JOIN ids "
       "ON ids.symbol = sim.neighbor_symbol) SELECT symbol, list(nid ORDER BY sim_rank) AS neighbor_symbol_ids, "
       "list(sim_score ORDER BY sim_rank) AS neighbor_scores FROM j GROUP BY symbol", PROFILE_USES)
def neighbor_lists(t):
    from barline.operators.ranking import entity_ids

    return similarity.neighbor_lists(similarity.company_similarity(profile_frame(t)), entity_ids(t.securities))


LABELS = f"""
    {PATHS}, dd AS (SELECT symbol, trade_date, {MAXDD} FROM paths),
    fr AS (SELECT symbol, trade_date, {', '.join(f"lead(close, {k}) OVER {W} / nullif(lead(open) OVER {W}, 0) - 1 AS label_ret_{k}" for k in HORIZONS)} FROM bars),
    bn AS (SELECT trade_date, {', '.join(f"lead(close, {k}) OVER (ORDER BY trade_date) / nullif(lead(open) OVER (ORDER BY trade_date), 0) - 1 AS br_{k}" for k in HORIZONS)}
        FROM index_bars WHERE index_code = '000300.SH')
    SELECT fr.*, dd.* EXCLUDE (symbol, trade_date),
        {', '.join(f"CASE WHEN label_ret_{k} > 0 THEN 1 ELSE 0 END AS label_win_{k}, label_ret_{k} - br_{k} AS label_alpha_{k}" for k in HORIZONS)},
        {', '.join(f"CASE WHEN label_maxdd_{k} <= -0.05 THEN 1 ELSE 0 END AS label_bigloss_{k}" for k in (5, 20))}
    FROM fr JOIN dd USING (symbol, trade_date) LEFT JOIN bn USING (trade_date)
    WHERE {' AND '.join(f'label_maxdd_{k} IS NOT NULL' for k in HORIZONS)}"""
LABEL_SPEC = " ".join(f"label_ret_{k}~ label_win_{k} label_alpha_{k}~ label_maxdd_{k}~" for k in HORIZONS)


@query(f"symbol trade_date {LABEL_SPEC} label_bigloss_5 label_bigloss_20", LABELS, "bars index_bars")
def label_table(t):
    return labels.label_table(t.bars, t.index_bars)


@query("vec_id vec[]",
       "SELECT vec_id, list_transform(range(0, 24), lambda i: list_avg(embedding[i * 2 + least(i, 16) + 1 : "
       "i * 2 + least(i, 16) + 2 + CASE WHEN i < 16 THEN 1 ELSE 0 END])) AS vec FROM embeddings", "")
def vector_project(t):
    vec = F.transform("embedding", lambda x: x.cast("double"))
    return t.raw("embeddings").select("vec_id", vectors.project(vec, 24).alias("vec"))


@query("vec_id total~ items",
       "SELECT vec_id, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS total, 256 AS items FROM embeddings", "")
def event_vector_normalize(t):
    text = F.to_json(F.transform("embedding", lambda x: x.cast("double")))
    df = finalize.event_vector_normalize(t.raw("embeddings").select("vec_id", text.alias("event_embedding")))
    return df.select(
        "vec_id", F.aggregate("event_embedding", F.lit(0.0), lambda s, x: s + x).alias("total"),
        F.size("event_embedding").alias("items"),
    )
