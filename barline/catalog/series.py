"""Per-symbol window queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.catalog.registry import query
from barline.functions.ewm import ewm as ewm_means
from barline.operators import features, labels, series
from barline.sources.schemas import HORIZONS

W = "(PARTITION BY symbol ORDER BY trade_date)"


def win(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(agg: str, col: str, n: int) -> str:
    """SQL twin of a full window."""
    return f"CASE WHEN count({col}) OVER {win(n)} = {n} THEN {agg}({col}) OVER {win(n)} END"


def ret(n: int, col: str = "adj_close") -> str:
    return f"({col} / nullif(lag({col}, {n}) OVER {W}, 0) - 1)"


RETURNS_SQL = ", ".join(f"{ret(n)} AS ret_{n}" for n in series.RETURN_ROWS)
GAPS_SQL = ", ".join(f"adj_close / nullif({full('avg', 'adj_close', n)}, 0) - 1 AS ma{n}_gap" for n in series.GAP_ROWS)


@query("symbol trade_date ret_1~ ret_3~ ret_5~ ret_10~ ret_20~ ret_60~",
       f"SELECT symbol, trade_date, {RETURNS_SQL} FROM bars", "bars")
def returns(t):
    return t.bars.withColumns(series.return_columns())


@query("symbol trade_date ma5_gap~ ma10_gap~ ma20_gap~ ma60_gap~",
       f"SELECT symbol, trade_date, {GAPS_SQL} FROM bars", "bars")
def ma_gaps(t):
    return t.bars.withColumns(series.gap_columns())


def recursive_mean(name: str, source: str, col: str, alpha: str) -> str:
    """Recursive CTEs ``name`` giving (symbol, rn, y) from ``source`` (symbol, rn, col)."""
    return (
        f"{name} AS (SELECT symbol, rn, {col} AS y FROM {source} WHERE rn = 1 "
        f"UNION ALL SELECT s.symbol, s.rn, (1 - {alpha}) * p.y + {alpha} * s.{col} "
        f"FROM {name} p JOIN {source} s ON s.symbol = p.symbol AND s.rn = p.rn + 1)"
    )


NUMBERED = f"numbered AS (SELECT symbol, trade_date, adj_close, row_number() OVER {W} AS rn FROM bars)"
MOVES = (
    f"moves AS (SELECT symbol, trade_date, greatest(m, 0) AS up, greatest(-m, 0) AS down, rn - 1 AS rn FROM ("
    f"SELECT symbol, trade_date, adj_close - lag(adj_close) OVER {W} AS m, row_number() OVER {W} AS rn FROM bars) "
    f"WHERE m IS NOT NULL)"
)
RSI_CTES = ", ".join([MOVES] + [
    recursive_mean(f"{side}{n}", "moves", side, f"(1.0 / {n})") for n in (6, 14) for side in ("up", "down")
])
RSI_ROWS_SQL = (
    "SELECT m.symbol, m.trade_date, 100 - 100 / (1 + u6.y / nullif(d6.y, 0)) AS rsi_6, "
    "100 - 100 / (1 + u14.y / nullif(d14.y, 0)) AS rsi_14 FROM moves m "
    "JOIN up6 u6 ON u6.symbol = m.symbol AND u6.rn = m.rn JOIN down6 d6 ON d6.symbol = m.symbol AND d6.rn = m.rn "
    "JOIN up14 u14 ON u14.symbol = m.symbol AND u14.rn = m.rn JOIN down14 d14 ON d14.symbol = m.symbol AND d14.rn = m.rn"
)
MACD_CTES = ", ".join([
    NUMBERED,
    recursive_mean("fast", "numbered", "adj_close", "(2.0 / 13)"),
    recursive_mean("slow", "numbered", "adj_close", "(2.0 / 27)"),
    "dif AS (SELECT n.symbol, n.trade_date, n.rn, f.y - s.y AS d FROM numbered n "
    "JOIN fast f ON f.symbol = n.symbol AND f.rn = n.rn JOIN slow s ON s.symbol = n.symbol AND s.rn = n.rn)",
    recursive_mean("dea", "dif", "d", "0.2"),
])
MACD_ROWS_SQL = (
    "SELECT i.symbol, i.trade_date, i.d AS macd_dif, e.y AS macd_dea, (i.d - e.y) * 2 AS macd_hist "
    "FROM dif i JOIN dea e ON e.symbol = i.symbol AND e.rn = i.rn"
)


@query("symbol trade_date rsi_6~4 rsi_14~4",
       f"{RSI_CTES}, r AS ({RSI_ROWS_SQL}) SELECT b.symbol, b.trade_date, r.rsi_6, r.rsi_14 "
       "FROM bars b LEFT JOIN r ON r.symbol = b.symbol AND r.trade_date = b.trade_date", "bars")
def rsi(t):
    return series.oscillators(t.bars, macd=False)


@query("symbol trade_date macd_dif~3 macd_dea~3 macd_hist~3", f"{MACD_CTES} {MACD_ROWS_SQL}", "bars")
def macd(t):
    return series.oscillators(t.bars, rsi_rows=())


@query("symbol trade_date ewm_close~3",
       f"{NUMBERED}, {recursive_mean('m', 'numbered', 'adj_close', '0.1')} "
       "SELECT n.symbol, n.trade_date, m.y AS ewm_close FROM numbered n JOIN m ON m.symbol = n.symbol AND m.rn = n.rn",
       "bars")
def ewm(t):
    return ewm_means(t.bars, {"ewm_close": ("adj_close", 0.1)})


TR_CTE = (
    f"tr AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM "
    f"(SELECT *, lag(close) OVER {W} AS pc FROM bars))"
)


@query("symbol trade_date atr_14~3", f"{TR_CTE} SELECT symbol, trade_date, {full('avg', 'tr', 14)} AS atr_14 FROM tr",
       "bars")
def atr_14(t):
    return series.atr(t.bars)


BOLL = (
    f"(adj_close - ({full('avg', 'adj_close', 20)} - 2 * {full('stddev_samp', 'adj_close', 20)})) "
    f"/ nullif(4 * {full('stddev_samp', 'adj_close', 20)}, 0)"
)


@query("symbol trade_date boll_pos~", f"SELECT symbol, trade_date, {BOLL} AS boll_pos FROM bars", "bars")
def bollinger_pos(t):
    return t.bars.withColumn("boll_pos", series.bollinger_column())


R1 = f"r AS (SELECT *, {ret(1)} AS ret_1 FROM bars)"


@query("symbol trade_date volatility_5~ volatility_20~ volatility_120~",
       f"{R1} SELECT symbol, trade_date, " + ", ".join(
           f"{full('stddev_samp', 'ret_1', n)} AS volatility_{n}" for n in (5, 20, 120)) + " FROM r", "bars")
def volatility(t):
    df = t.bars.withColumns(series.return_columns((1,)))
    return df.withColumns(series.volatility_columns(rows=(5, 20, 120)))


VOL_SQL = (
    f"SELECT symbol, trade_date, vol_ratio_5, vol_ratio_20, CASE WHEN vol_ratio_5 < 0.7 THEN 1.0 ELSE 0.0 END AS "
    f"shrink_volume_flag, CASE WHEN vol_ratio_5 > 1.8 THEN 1.0 ELSE 0.0 END AS surge_volume_flag FROM ("
    f"SELECT *, volume / nullif({full('avg', 'volume', 5)}, 0) AS vol_ratio_5, "
    f"volume / nullif({full('avg', 'volume', 20)}, 0) AS vol_ratio_20 FROM bars)"
)


@query("symbol trade_date vol_ratio_5~ vol_ratio_20~ shrink_volume_flag~ surge_volume_flag~", VOL_SQL, "bars")
def volume_ratios(t):
    return t.bars.withColumns(series.volume_ratio_columns())


@query("symbol trade_date turnover_mean_120~ amount_mean_120~5",
       f"SELECT symbol, trade_date, {full('avg', 'turnover_rate', 120)} AS turnover_mean_120, "
       f"{full('avg', 'amount', 120)} AS amount_mean_120 FROM bars", "bars")
def rolling_means_120(t):
    return t.bars.withColumns(series.rolling_mean_columns(("turnover_rate", "amount")))


BENCH_R1 = (
    "bench AS (SELECT trade_date, close / nullif(lag(close) OVER (ORDER BY trade_date), 0) - 1 AS bench_ret_1 "
    "FROM index_bars WHERE index_code = '000300.SH')"
)
BETA = (
    f"CASE WHEN count(CASE WHEN ret_1 IS NOT NULL AND bench_ret_1 IS NOT NULL THEN 1 END) OVER {win(120)} = 120 "
    f"THEN covar_samp(ret_1, bench_ret_1) OVER {win(120)} END / nullif({full('var_samp', 'bench_ret_1', 120)}, 0)"
)


@query("symbol trade_date beta_120~",
       f"{R1}, {BENCH_R1} SELECT symbol, trade_date, {BETA} AS beta_120 FROM r LEFT JOIN bench USING (trade_date)",
       "bars index_bars")
def rolling_beta_120(t):
    bench = features.index_returns(t.index_bars, (1,), prefix="bench")
    df = t.bars.withColumns(series.return_columns((1,))).join(bench, "trade_date", "left")
    return df.withColumn("beta_120", series.beta_column("ret_1", "bench_ret_1"))


BREADTH = (
    "SELECT trade_date, count(CASE WHEN pct_chg >= 9.5 THEN 1 END) AS up_limit_count, "
    "count(CASE WHEN pct_chg <= -9.5 THEN 1 END) AS down_limit_count, sum(amount) AS market_turnover, "
    "count(CASE WHEN high / nullif(pre_close, 0) - 1 >= 0.095 THEN 1 END) AS up_touch_count FROM bars GROUP BY trade_date"
)
BARDATE_RETURNS = (
    "SELECT trade_date, hs300_close / nullif(lag(hs300_close) OVER (ORDER BY trade_date), 0) - 1 AS hs300_ret_1, "
    "cyb_close / nullif(lag(cyb_close) OVER (ORDER BY trade_date), 0) - 1 AS cyb_ret_1 FROM ("
    "SELECT d.trade_date, h.close AS hs300_close, c.close AS cyb_close FROM (SELECT DISTINCT trade_date FROM bars) d "
    "LEFT JOIN index_bars h ON h.trade_date = d.trade_date AND h.index_code = '000300.SH' "
    "LEFT JOIN index_bars c ON c.trade_date = d.trade_date AND c.index_code = '399006.SZ')"
)
W5 = "(ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"


@query("trade_date consecutive_limit_height~ market_volatility_5~",
       f"b AS ({BREADTH}), i AS ({BARDATE_RETURNS}) SELECT trade_date, "
       f"CASE WHEN count(up_limit_count) OVER {W5} = 5 THEN max(up_limit_count) OVER {W5} END AS consecutive_limit_height, "
       f"CASE WHEN count(hs300_ret_1) OVER {W5} = 5 THEN stddev_samp(hs300_ret_1) OVER {W5} END AS market_volatility_5 "
       "FROM b JOIN i USING (trade_date)", "bars index_bars")
def market_rolling(t):
    return features.market_features(t.bars, t.index_bars, None)


@query("trade_date hs300_ret_1~ cyb_ret_1~", BARDATE_RETURNS, "bars index_bars")
def index_returns_on_bar_dates(t):
    return features.index_returns_on_bar_dates(t.bars.select("trade_date").distinct(), t.index_bars)


FILL_BACK = "(PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@query("symbol trade_date roe~ profit_yoy",
       "gap AS (SELECT symbol, trade_date, CASE WHEN volume > 60 THEN pct_chg END AS roe, "
       "CASE WHEN volume < 40 THEN close END AS profit_yoy FROM bars) SELECT symbol, trade_date, " + ", ".join(
           f"coalesce(last_value({c} IGNORE NULLS) OVER {W}, first_value({c} IGNORE NULLS) OVER {FILL_BACK}) AS {c}"
           for c in ("roe", "profit_yoy")) + " FROM gap", "bars")
def ffill_bfill(t):
    gaps = t.bars.select(
        "symbol", "trade_date", F.when(F.col("volume") > 60, F.col("pct_chg")).alias("roe"),
        F.when(F.col("volume") < 40, F.col("close")).alias("profit_yoy"),
    )
    return gaps.withColumns(series.fill_columns(("roe", "profit_yoy")))


CANDLE_SQL = f"""
    SELECT symbol, trade_date, (high - low) / nullif(close, 0) AS intraday_range,
           (close - open) / nullif(open, 0) AS candle_body, (high - greatest(open, close)) / nullif(open, 0) AS upper_shadow,
           (least(open, close) - low) / nullif(open, 0) AS lower_shadow,
           (open - pc) / nullif(pc, 0) AS gap_open_to_prev_close, (close - pc) / nullif(pc, 0) AS close_to_prev_close,
           (high - pc) / nullif(pc, 0) AS high_to_prev_close, (low - pc) / nullif(pc, 0) AS low_to_prev_close,
           ln(1 + greatest(amount, 0)) AS amount_log1p, ln(1 + greatest(volume, 0)) AS volume_log1p,
           turnover_rate - lag(turnover_rate) OVER {W} AS turnover_rate_delta, ret_5 - ret_20 AS ret_spread_5_20,
           {full('stddev_samp', 'ret_1', 5)} / nullif({full('stddev_samp', 'ret_1', 20)}, 0) AS volatility_ratio_5_20
    FROM (SELECT *, lag(close) OVER {W} AS pc, {ret(1)} AS ret_1, {ret(5)} AS ret_5, {ret(20)} AS ret_20 FROM bars)"""
CANDLE_COLUMNS = (
    "intraday_range~ candle_body~ upper_shadow~ lower_shadow~ gap_open_to_prev_close~ close_to_prev_close~ "
    "high_to_prev_close~ low_to_prev_close~ amount_log1p~ volume_log1p~ turnover_rate_delta~ ret_spread_5_20~ "
    "volatility_ratio_5_20~"
)


@query(f"symbol trade_date {CANDLE_COLUMNS}", CANDLE_SQL, "bars")
def candle_features(t):
    df = t.bars.withColumns(series.return_columns((1, 5, 20)))
    return df.withColumns(series.volatility_columns()).withColumns(series.candle_columns())


FORWARD = ", ".join(
    f"lead(close, {k}) OVER {W} / nullif(lead(open) OVER {W}, 0) - 1 AS label_ret_{k}" for k in HORIZONS)
WINS = ", ".join(f"CASE WHEN label_ret_{k} > 0 THEN 1 ELSE 0 END AS label_win_{k}" for k in HORIZONS)


@query("symbol trade_date " + " ".join(f"label_ret_{k}~ label_win_{k}" for k in HORIZONS),
       f"SELECT *, {WINS} FROM (SELECT symbol, trade_date, {FORWARD} FROM bars)", "bars")
def forward_returns(t):
    df = t.bars.withColumns({f"label_ret_{k}": labels.forward_return(k) for k in HORIZONS})
    return df.withColumns({f"label_win_{k}": labels.win(F.col(f"label_ret_{k}")) for k in HORIZONS})


def drawdown_sql(k: int) -> str:
    """Depth on one path, from first principles: every point against the best point up to it."""
    return (
        f"CASE WHEN len(path) >= {k + 1} AND path[1] IS NOT NULL THEN list_min(list_transform(range(1, {k + 2}), "
        f"lambda i: path[i] / list_max(path[1:i]) - 1)) END AS label_maxdd_{k}"
    )


PATHS = (
    f"paths AS (SELECT symbol, trade_date, list_concat([lead(open) OVER {W}], list(close) OVER "
    "(PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 1 FOLLOWING AND 40 FOLLOWING)) AS path FROM bars)"
)
MAXDD = ", ".join(drawdown_sql(k) for k in HORIZONS)


@query("symbol trade_date " + " ".join(f"label_maxdd_{k}~" for k in HORIZONS),
       f"{PATHS} SELECT symbol, trade_date, {MAXDD} FROM paths", "bars")
def forward_max_drawdown(t):
    return labels.forward_drawdowns(t.bars)


@query("symbol trade_date label_bigloss_5 label_bigloss_20",
       f"{PATHS} SELECT symbol, trade_date, CASE WHEN label_maxdd_5 <= -0.05 THEN 1 ELSE 0 END AS label_bigloss_5, "
       "CASE WHEN label_maxdd_20 <= -0.05 THEN 1 ELSE 0 END AS label_bigloss_20 "
       f"FROM (SELECT symbol, trade_date, {MAXDD} FROM paths)", "bars")
def big_loss_flag(t):
    df = labels.forward_drawdowns(t.bars, (5, 20))
    return df.withColumns({f"label_bigloss_{k}": labels.bigloss(f"label_maxdd_{k}") for k in (5, 20)})


SEQ = ("open", "close", "volume", "pct_chg")


@query("symbol trade_date flat[]",
       "w AS (SELECT symbol, trade_date, list([" + ", ".join(f"coalesce({c}, 0.0)" for c in SEQ) + "]) OVER "
       "(PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS x FROM bars) "
       "SELECT symbol, trade_date, flatten(x) AS flat FROM w WHERE len(x) = 20", "bars")
def sequence_window(t):
    return series.sequence_window(t.bars, SEQ, 20).withColumn("flat", F.flatten("x_seq"))


@query("symbol trade_date flat[]",
       "w AS (SELECT symbol, trade_date, list([" + ", ".join(f"coalesce({c}, 0.0)" for c in SEQ) + "]) OVER "
       "(PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS x FROM bars) "
       "SELECT symbol, trade_date, list_concat(list_transform(range(0, (6 - len(x)) * 4), lambda i: 0.0), flatten(x)) "
       "AS flat FROM w", "bars")
def sequence_window_padded(t):
    return series.sequence_window(t.bars, SEQ, 6, drop_incomplete=False).withColumn("flat", F.flatten("x_seq"))


@query("symbol trade_date close~",
       "SELECT symbol, trade_date, close FROM bars WHERE trade_date <= DATE '1998-06-30' QUALIFY row_number() OVER "
       "(PARTITION BY symbol ORDER BY trade_date DESC) <= 20", "bars")
def tail_per_symbol(t):
    return series.tail_per_symbol(t.bars, 20, F.lit("1998-06-30").cast("date"))
