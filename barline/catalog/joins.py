"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.catalog.aggregates import INDUSTRY_PCT, industry_rows
from barline.catalog.features import PROFILES, PROFILE_USES, profile_frame
from barline.catalog.ranks import ASOF_ROE
from barline.catalog.registry import query
from barline.catalog.series import BENCH_R1
from barline.operators import aggregates, asof, calendar, features, joins, labels, series
from barline.operators import ranking


@query("symbol trade_date industry_sw board name",
       "SELECT symbol, trade_date, industry AS industry_sw, board, name FROM bars LEFT JOIN securities USING (symbol)", "bars securities")
def join_security_dim(t):
    dim = t.securities.select("symbol", "name", F.col("industry").alias("industry_sw"), "board")
    return t.bars.select("symbol", "trade_date").join(dim, "symbol", "left")


@query("symbol trade_date roe~ revenue_yoy~ profit_yoy~", f"{ASOF_ROE} SELECT * FROM a", "bars financials")
def asof_backward_fundamentals(t):
    return asof.asof_backward(t.bars.select("symbol", "trade_date"), t.financials, ["roe", "revenue_yoy", "profit_yoy"])


@query("symbol trade_date ret5_vs_hs300~ ret10_vs_hs300~", """
    i AS (SELECT trade_date, close / nullif(lag(close, 5) OVER (ORDER BY trade_date), 0) - 1 AS r5,
        close / nullif(lag(close, 10) OVER (ORDER BY trade_date), 0) - 1 AS r10 FROM index_bars WHERE index_code = '000300.SH'),
    s AS (SELECT symbol, trade_date, adj_close / nullif(lag(adj_close, 5) OVER w, 0) - 1 AS s5,
        adj_close / nullif(lag(adj_close, 10) OVER w, 0) - 1 AS s10 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY trade_date))
    SELECT symbol, trade_date, s5 - r5 AS ret5_vs_hs300, s10 - r10 AS ret10_vs_hs300 FROM s LEFT JOIN i USING (trade_date)""", "bars index_bars")
def join_index_relative(t):
    df = t.bars.withColumns(series.return_columns((5, 10))).join(features.index_returns(t.index_bars), "trade_date", "left")
    return df.withColumns({
        "ret5_vs_hs300": F.col("ret_5") - F.col("hs300_ret_5"), "ret10_vs_hs300": F.col("ret_10") - F.col("hs300_ret_10")})


@query("symbol trade_date bench_ret_3~ bench_ret_40~", """
    n AS (SELECT trade_date, lead(close, 3) OVER w / nullif(lead(open) OVER w, 0) - 1 AS bench_ret_3,
        lead(close, 40) OVER w / nullif(lead(open) OVER w, 0) - 1 AS bench_ret_40 FROM index_bars WHERE index_code = '000300.SH'
        WINDOW w AS (ORDER BY trade_date))
    SELECT symbol, trade_date, bench_ret_3, bench_ret_40 FROM bars LEFT JOIN n USING (trade_date)""", "bars index_bars")
def join_benchmark_returns(t):
    return t.bars.select("symbol", "trade_date").join(labels.benchmark_returns(t.index_bars, (3, 40)), "trade_date", "left")


@query("symbol trade_date bench_ret_1~",
       f"{BENCH_R1} SELECT symbol, trade_date, bench_ret_1 FROM bars LEFT JOIN bench USING (trade_date)", "bars index_bars")
def join_benchmark_daily(t):
    return t.bars.select("symbol", "trade_date").join(features.index_returns(t.index_bars, (1,), prefix="bench"), "trade_date", "left")


@query("symbol trade_date close",
       "SELECT symbol, trade_date, close FROM bars WHERE symbol IN (SELECT symbol FROM bars WHERE trade_date = (SELECT max(trade_date) FROM bars))",
       "bars")
def semi_join_symbols(t):
    last = t.bars.agg(F.max("trade_date").alias("d")).scalar()
    return joins.semi_join_symbols(t.bars.select("symbol", "trade_date", "close"), t.bars.where(F.col("trade_date") == last))


@query("symbol first_day expected_days", """
    e AS (SELECT symbol, greatest(DATE '1993-06-01', coalesce(list_date, DATE '1993-06-01')) AS first_day FROM securities),
    d AS (SELECT e.*, (SELECT count(*) FROM calendar WHERE trade_date >= first_day AND trade_date <= DATE '1995-12-31') AS expected_days FROM e),
    c AS (SELECT symbol, count(*) AS n FROM bars WHERE trade_date BETWEEN DATE '1993-06-01' AND DATE '1995-12-31' GROUP BY 1)
    SELECT d.symbol, first_day, CAST(expected_days AS INTEGER) AS expected_days FROM d LEFT JOIN c USING (symbol)
    WHERE NOT (expected_days > 0 AND coalesce(n, 0) >= expected_days * 1)""", "bars securities calendar")
def anti_join_completed(t):
    counts = aggregates.symbol_trade_counts(t.bars, "1993-06-01", "1995-12-31")
    return joins.incomplete_symbols(t.securities, counts, t.calendar, "1993-06-01", "1995-12-31")


@query("symbol neighbor_symbol symbol_id", """
    i AS (SELECT symbol, CAST(row_number() OVER (ORDER BY symbol) AS INTEGER) AS symbol_id FROM securities WHERE NOT is_st),
    n AS (SELECT symbol, lag(symbol) OVER (ORDER BY symbol) AS neighbor_symbol FROM securities)
    SELECT n.symbol, neighbor_symbol, coalesce(i.symbol_id, 0) AS symbol_id FROM n LEFT JOIN i ON i.symbol = neighbor_symbol""", "securities")
def join_neighbor_ids(t):
    code = F.substring("symbol", 1, 6).cast("int")
    edges = t.securities.select("symbol", F.when(code > 0, t.code(code - 1)).alias("neighbor_symbol"))
    ids = ranking.dense_ids(t.securities.where(~F.col("is_st")), "symbol", "symbol_id").withColumnRenamed("symbol", "neighbor_symbol")
    return edges.join(ids, "neighbor_symbol", "left").withColumn("symbol_id", F.coalesce("symbol_id", F.lit(0)))


@query("symbol trade_date name signal_score~ avg_amount_5~2", """
    SELECT b.symbol, b.trade_date, s.name, CASE WHEN s.industry IS NOT DISTINCT FROM s.industry AND b.volume > 20 THEN b.pct_chg END AS signal_score,
        b.amount AS avg_amount_5 FROM bars b JOIN (SELECT symbol, CASE WHEN is_st THEN NULL ELSE name END AS name, industry FROM securities) s
        ON s.symbol = b.symbol""", "bars securities")
def join_predictions(t):
    names = t.securities.select(
        "symbol", F.when(~F.col("is_st"), F.col("name")).alias("name"), F.col("industry").alias("industry_sw"), "board")
    raw = t.bars.select("symbol", "trade_date", "volume", "amount", "pct_chg").join(names, "symbol")
    keys = ["symbol", "trade_date", "name", "industry_sw", "board"]
    predicted = raw.where(F.col("volume") > 20).select(*keys, F.col("pct_chg").alias("signal_score"))
    aux = raw.select(*keys, F.col("amount").alias("avg_amount_5"))
    return joins.join_predictions(raw.select(*keys), predicted, aux)


@query("symbol", "SELECT DISTINCT symbol FROM bars JOIN securities USING (symbol) WHERE status = 'active' AND trade_date = DATE '1997-06-02'",
       "bars securities")
def join_active_bars(t):
    return joins.active_on_date(t.bars, t.securities, "1997-06-02")


SYMBOL_NEWS = """
    n AS (SELECT CAST(event_id AS VARCHAR) AS item_id, 'news' AS kind, CAST(ts AS TIMESTAMP) AS publish_time, event_type AS title,
        lpad(CAST(user_id AS VARCHAR), 6, '0') || '.SZ' AS m FROM events WHERE event_type <> 'click'),
    q AS (SELECT DISTINCT lpad(CAST(user_id AS VARCHAR), 6, '0') || '.SZ' AS symbol, CAST(ts AS DATE) AS trade_date FROM events
        WHERE event_type IN ('click', 'error')),
    own AS (SELECT q.*, kind, item_id, publish_time, title FROM q JOIN n ON m = symbol AND publish_time >= trade_date + INTERVAL '23:59:59' - INTERVAL 7 DAY
        AND publish_time <= trade_date + INTERVAL '23:59:59'),
    fb AS (SELECT q.*, kind, item_id, publish_time, title FROM (SELECT * FROM q ANTI JOIN own USING (symbol, trade_date)) q
        JOIN (SELECT *, CAST(publish_time AS DATE) AS pd FROM n WHERE CAST(publish_time AS TIME) <= TIME '23:59:59' QUALIFY row_number() OVER (PARTITION BY CAST(publish_time AS DATE)
            ORDER BY publish_time DESC, item_id) <= 8) n ON pd = trade_date),
    note AS (SELECT q.*, 'announcement' AS kind, CAST(event_id AS VARCHAR) AS item_id, CAST(ts AS TIMESTAMP) AS publish_time, props AS title
        FROM q JOIN events e ON lpad(CAST(user_id AS VARCHAR), 6, '0') || '.SZ' = symbol AND event_type = 'click'
        AND ts >= trade_date + INTERVAL '23:59:59' - INTERVAL 7 DAY AND ts <= trade_date + INTERVAL '23:59:59'),
    u AS (SELECT * FROM own UNION ALL SELECT * FROM fb UNION ALL SELECT * FROM note),
    places AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY symbol, trade_date ORDER BY kind = 'announcement', publish_time DESC, kind, item_id) <= 8)
    SELECT *, CAST(row_number() OVER (PARTITION BY symbol, trade_date ORDER BY publish_time DESC, kind, item_id) AS INTEGER) AS item_rank FROM places"""


@query("symbol trade_date kind item_id publish_time title item_rank", SYMBOL_NEWS)
def interval_join_symbol_news(t):
    ev = t.raw("events").select(
        F.col("event_id").cast("string").alias("news_id"), F.col("ts").cast("timestamp_ntz").alias("publish_time"),
        F.col("event_type").alias("title"), "event_type", "props", F.array(t.code(F.col("user_id"))).alias("mentioned_symbols"),
    )
    asked = ev.where(F.col("event_type").isin("click", "error")).select(
        F.get("mentioned_symbols", F.lit(0)).alias("symbol"), F.to_date("publish_time").alias("trade_date"))
    notices = ev.where(F.col("event_type") == "click").withColumnRenamed("news_id", "announcement_id").withColumn("title", F.col("props"))
    return joins.symbol_news(asked, ev.where(F.col("event_type") != "click"), notices)


@query("symbol left_last_date right_first_date", """
    l AS (SELECT symbol, max(trade_date) AS left_last_date FROM bars WHERE trade_date < DATE '1997-01-01' GROUP BY 1),
    r AS (SELECT symbol, min(trade_date) AS right_first_date FROM bars WHERE trade_date >= DATE '1997-01-01' GROUP BY 1)
    SELECT * FROM l JOIN r USING (symbol)""", "bars")
def boundary_join_symbols(t):
    cut = F.lit("1997-01-01").cast("date")
    return joins.boundary_join(t.bars.where(F.col("trade_date") < cut), t.bars.where(F.col("trade_date") >= cut))


@query("symbol trade_date train_symbol_samples train_industry_pctile~ major_index_ret_1~ down_limit_ratio~", f"""
    p AS (WITH {INDUSTRY_PCT}), c AS (SELECT symbol, count(*) AS train_symbol_samples FROM bars WHERE volume > 45 GROUP BY 1),
    lim AS (SELECT trade_date, count(CASE WHEN pct_chg <= -9.5 THEN 1 END) AS down FROM bars GROUP BY 1),
    ix AS (SELECT trade_date, max(CASE WHEN index_code = '000300.SH' THEN open / close - 1 END) AS h,
        max(CASE WHEN index_code <> '000300.SH' THEN open / close - 1 END) AS y FROM index_bars GROUP BY 1)
    SELECT b.symbol, b.trade_date, coalesce(c.train_symbol_samples, 0) AS train_symbol_samples,
        coalesce(p.train_industry_pctile, 1) AS train_industry_pctile, least(coalesce(h, 0), coalesce(y, 0)) AS major_index_ret_1,
        down / (SELECT count(*) FROM securities)::DOUBLE AS down_limit_ratio
    FROM bars b JOIN securities s USING (symbol) LEFT JOIN c USING (symbol)
    LEFT JOIN (SELECT * FROM p WHERE samples % 2 = 0) p ON p.industry_sw = s.industry LEFT JOIN lim USING (trade_date) LEFT JOIN ix USING (trade_date)""",
    "bars securities index_bars")
def join_training_coverage(t):
    counts = t.bars.where(F.col("volume") > 45).groupBy("symbol").agg(F.count("*").alias("train_symbol_samples"))
    pct = aggregates.industry_sample_percentile(industry_rows(t)).where(F.col("samples") % 2 == 0).drop("samples")
    move = F.col("open") / F.col("close") - 1
    is_main = F.col("index_code") == "000300.SH"
    index = t.index_bars.groupBy("trade_date").agg(
        F.max(F.when(is_main, move)).alias("hs300_ret_1"), F.max(F.when(~is_main, move)).alias("cyb_ret_1"))
    limits = features.market_breadth(t.bars).select("trade_date", "down_limit_count", "up_limit_count")
    df = industry_rows(t).join(index, "trade_date", "left").join(limits, "trade_date", "left")
    df = df.withColumn("market_symbol_count", t.securities.agg(F.count("*").alias("n")).scalar())
    return joins.limit_ratios(joins.training_coverage(df, counts, pct))


@query("symbol trade_date has_bar has_index has_sector has_event has_profile has_financial has_news complete", f"""
    pr AS (WITH {PROFILES}), q AS (SELECT s.symbol, c.trade_date FROM securities s JOIN (SELECT DISTINCT symbol, trade_date FROM financials_d) c USING (symbol)),
    f AS (SELECT q.*, EXISTS (SELECT 1 FROM bars b WHERE b.symbol = q.symbol AND b.trade_date = q.trade_date) AS has_bar,
        EXISTS (SELECT 1 FROM index_bars b WHERE b.trade_date = q.trade_date) AS has_index,
        EXISTS (SELECT 1 FROM sector_daily b WHERE b.trade_date = q.trade_date AND b.pct_chg > 0) AS has_sector,
        EXISTS (SELECT 1 FROM calendar b WHERE b.trade_date = q.trade_date AND month(b.trade_date) <> 3) AS has_event,
        EXISTS (SELECT 1 FROM pr WHERE pr.symbol = q.symbol AND pr.asof_date = q.trade_date AND beta_120 IS NOT NULL) AS has_profile,
        EXISTS (SELECT 1 FROM financials b WHERE b.symbol = q.symbol AND b.asof_date <= q.trade_date) AS has_financial,
        EXISTS (SELECT 1 FROM calendar b WHERE b.trade_date = q.trade_date AND month(b.trade_date) <> 4) AS has_news FROM q)
    SELECT *, has_bar AND has_index AND has_sector AND has_event AND has_profile AND has_financial AND has_news AS complete FROM f""".replace(
        "financials_d", "(SELECT symbol, CAST(date_trunc('week', asof_date) AS DATE) AS trade_date FROM financials)"), PROFILE_USES + " sector_daily calendar")
def presence_check(t):
    asked = t.financials.select("symbol", F.trunc("asof_date", "week").alias("trade_date"))
    asked = asked.join(t.securities.select("symbol"), "symbol")
    good = profile_frame(t).where(F.col("beta_120").isNotNull())
    cal = t.calendar
    return joins.presence_check(
        asked, t.bars, t.index_bars, t.sector_daily.where(F.col("pct_chg") > 0), cal.where(F.month("trade_date") != 3), good,
        t.financials, cal.where(F.month("trade_date") != 4))


@query("day is_open at_or_before before", """
    s AS (SELECT CAST(unnest(generate_series(min(trade_date), max(trade_date), INTERVAL 1 DAY)) AS DATE) AS day FROM calendar)
    SELECT day, EXISTS (SELECT 1 FROM calendar WHERE trade_date = day) AS is_open,
        (SELECT count(*) FROM calendar WHERE trade_date <= day) AS at_or_before, (SELECT count(*) FROM calendar WHERE trade_date < day) AS before FROM s""",
    "calendar")
def calendar_day_map(t):
    return calendar.day_map(t.calendar)
