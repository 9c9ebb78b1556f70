"""Cross-section rank queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.catalog.registry import query
from barline.functions.columns import pct_rank_avg as rank_column
from barline.operators import features, labels, ranking, series


def avg_rank(col: str, part: str) -> str:
    """SQL twin of the average percent rank."""
    known = " AND ".join(f"{p.strip()} IS NOT NULL" for p in part.split(","))
    return (
        f"CASE WHEN {col} IS NOT NULL AND {known} THEN (rank() OVER (PARTITION BY {part} ORDER BY {col} NULLS LAST) "
        f"+ (count({col}) OVER (PARTITION BY {part}, {col}) - 1) / 2.0) / count({col}) OVER (PARTITION BY {part}) END"
    )


IND = "b AS (SELECT bars.*, industry FROM bars LEFT JOIN securities USING (symbol))"
R = "(adj_close / nullif(lag(adj_close, {n}) OVER (PARTITION BY symbol ORDER BY trade_date), 0) - 1)"


@query("symbol trade_date volume_rank~",
       f"SELECT symbol, trade_date, {avg_rank('volume', 'trade_date')} AS volume_rank FROM bars", "bars")
def pct_rank_avg(t):
    return ranking.pct_rank_large(t.bars, "volume", ["trade_date"], "volume_rank")


@query("symbol trade_date volume_rank~",
       f"SELECT symbol, trade_date, {avg_rank('volume', 'trade_date')} AS volume_rank FROM bars", "bars")
def pct_rank_large_groups(t):
    return ranking.pct_rank_large(t.bars, "volume", ["trade_date"], "volume_rank", parts=50)


@query("symbol trade_date turnover_rank_industry~",
       f"{IND} SELECT symbol, trade_date, {avg_rank('turnover_rate', 'trade_date, industry')} AS turnover_rank_industry FROM b",
       "bars securities")
def turnover_rank_industry(t):
    df = features.with_industry(t.bars, t.securities)
    return df.withColumn("turnover_rank_industry", rank_column("turnover_rate", "trade_date", "industry"))


@query("symbol trade_date amount_rank_market~",
       f"SELECT symbol, trade_date, {avg_rank('amount', 'trade_date')} AS amount_rank_market FROM bars", "bars")
def amount_rank_market(t):
    return ranking.pct_rank_large(t.bars, "amount", ["trade_date"], "amount_rank_market")


@query("symbol trade_date stock_rank_in_industry~",
       f"{IND} SELECT symbol, trade_date, {avg_rank('pct_chg', 'trade_date, industry')} AS stock_rank_in_industry FROM b",
       "bars securities")
def stock_rank_in_industry(t):
    df = features.with_industry(t.bars, t.securities)
    return df.withColumn("stock_rank_in_industry", rank_column("pct_chg", "trade_date", "industry"))


MEANS = (
    f"{IND}, r AS (SELECT *, {R.format(n=5)} AS ret_5, {R.format(n=20)} AS ret_20 FROM b), "
    "m AS (SELECT trade_date, industry, avg(ret_5) AS industry_ret_5, avg(ret_20) AS industry_ret_20 FROM r "
    "WHERE industry IS NOT NULL GROUP BY 1, 2)"
)


@query("trade_date industry industry_rank_5d~ industry_rank_20d~",
       f"{MEANS} SELECT trade_date, industry, {avg_rank('industry_ret_5', 'trade_date')} AS industry_rank_5d, "
       f"{avg_rank('industry_ret_20', 'trade_date')} AS industry_rank_20d FROM m", "bars securities")
def industry_rank(t):
    df = features.with_industry(t.bars, t.securities).withColumns(series.return_columns((5, 20)))
    return features.industry_rank(features.industry_daily_mean(df))


@query("symbol trade_date industry_rank_5d~ industry_rank_20d~",
       f"{MEANS}, k AS (SELECT trade_date, industry, {avg_rank('industry_ret_5', 'trade_date')} AS industry_rank_5d, "
       f"{avg_rank('industry_ret_20', 'trade_date')} AS industry_rank_20d FROM m) "
       "SELECT symbol, trade_date, industry_rank_5d, industry_rank_20d FROM b LEFT JOIN k USING (trade_date, industry)",
       "bars securities")
def industry_rank_per_row(t):
    df = features.with_industry(t.bars, t.securities).withColumns(series.return_columns((5, 20)))
    return ranking.with_industry_ranks(df)


ASOF_ROE = (
    "a AS (SELECT b.symbol, b.trade_date, f.roe, f.revenue_yoy, f.profit_yoy FROM bars b ASOF LEFT JOIN ("
    "SELECT * FROM financials QUALIFY row_number() OVER (PARTITION BY symbol, asof_date ORDER BY report_date DESC) = 1"
    ") f ON b.symbol = f.symbol AND b.trade_date >= f.asof_date)"
)


@query("symbol trade_date industry_roe_percentile~",
       f"{ASOF_ROE}, c AS (SELECT a.*, industry FROM a LEFT JOIN securities USING (symbol)) "
       f"SELECT symbol, trade_date, {avg_rank('roe', 'trade_date, industry')} AS industry_roe_percentile FROM c",
       "bars financials securities")
def industry_roe_percentile(t):
    return features.fundamental_features(t.bars, t.financials, t.securities)


@query("symbol trade_date label_rank_score~",
       "x AS (SELECT symbol, trade_date, lead(close, 5) OVER (PARTITION BY symbol ORDER BY trade_date) / "
       "nullif(lead(open) OVER (PARTITION BY symbol ORDER BY trade_date), 0) - 1 AS r FROM bars), "
       "n AS (SELECT trade_date, lead(close, 5) OVER (ORDER BY trade_date) / nullif(lead(open) OVER (ORDER BY trade_date), 0) "
       "- 1 AS r FROM index_bars WHERE index_code = '000300.SH'), y AS (SELECT x.symbol, x.trade_date, x.r - n.r AS alpha "
       f"FROM x LEFT JOIN n USING (trade_date)) SELECT symbol, trade_date, {avg_rank('alpha', 'trade_date')} "
       "AS label_rank_score FROM y", "bars index_bars")
def label_rank_score(t):
    bench = labels.benchmark_returns(t.index_bars, (5,))
    df = t.bars.withColumn("ret", labels.forward_return(5)).join(bench, "trade_date", "left")
    df = df.withColumn("alpha", F.col("ret") - F.col("bench_ret_5"))
    return df.withColumn("label_rank_score", rank_column("alpha", "trade_date"))


@query("symbol symbol_id industry_id board_id",
       "i AS (SELECT v, row_number() OVER (ORDER BY v) AS id FROM (SELECT DISTINCT trim(industry) AS v FROM securities) WHERE v <> ''), "
       "b AS (SELECT v, row_number() OVER (ORDER BY v) AS id FROM (SELECT DISTINCT trim(board) AS v FROM securities) WHERE v <> '') "
       "SELECT symbol, CAST(row_number() OVER (ORDER BY symbol) AS INTEGER) AS symbol_id, "
       "CAST(coalesce(i.id, 0) AS INTEGER) AS industry_id, CAST(coalesce(b.id, 0) AS INTEGER) AS board_id "
       "FROM securities LEFT JOIN i ON i.v = industry LEFT JOIN b ON b.v = board", "securities")
def entity_ids(t):
    return ranking.entity_ids(t.securities)


@query("trade_date date_index",
       "SELECT trade_date, CAST(row_number() OVER (ORDER BY trade_date) - 1 AS INTEGER) AS date_index FROM calendar", "calendar")
def date_index(t):
    return ranking.date_index(t.bars)
