"""Row-level cleaning, symbol and calendar queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.catalog.registry import query
from barline.catalog.sources import EXCHANGE, RAW_CODES, raw_codes
from barline.functions import symbols
from barline.operators import calendar, rows
from barline.sources.sample_tables import SampleTables


@query("seq symbol", f"{RAW_CODES} SELECT seq, code || '.' || {EXCHANGE} AS symbol FROM c UNION ALL "
       "SELECT -c_custkey - 1, CASE WHEN c_custkey % 3 = 0 THEN lpad(CAST(c_custkey AS VARCHAR), 6, '0') || '.BJ' END FROM customer")
def normalize_symbol(t):
    k = F.col("c_custkey")
    odd = F.when(k % 3 == 0, F.concat(F.lit(" "), F.lpad(k.cast("string"), 6, "0"), F.lit(".bj "))).when(
        k % 3 == 1, F.concat(F.lit("12"), F.lit("-ab"))).otherwise(F.lit(""))
    more = t.raw("customer").select((-k - 1).alias("seq"), odd.alias("symbol"))
    df = raw_codes(t).select("seq", "symbol").unionByName(more)
    return df.withColumn("symbol", symbols.normalize_symbol(F.col("symbol")))


@query("symbol code prefixed numeric", f"""
    {RAW_CODES}, d AS (SELECT DISTINCT code, {EXCHANGE} AS x FROM c)
    SELECT code || '.' || x AS symbol, code, lower(x) || code AS prefixed, CASE WHEN x = 'SH' THEN '1.' ELSE '0.' END || code AS numeric FROM d""")
def symbol_codes(t):
    s = F.col("symbol")
    df = raw_codes(t).select(symbols.normalize_symbol(s).alias("symbol")).distinct()
    return df.select("symbol", symbols.code(s).alias("code"), symbols.market_prefixed(s).alias("prefixed"), symbols.numeric_id(s).alias("numeric"))


def broken_bars(lineitem):
    """Line items as bars with planted faults; copies share symbol and date."""
    k = F.col("l_orderkey") % 11
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return lineitem.select(
        F.struct("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice").alias("seq"),
        SampleTables.code(F.col("l_suppkey")).alias("symbol"), F.to_date("l_shipdate").alias("trade_date"),
        F.when(k != 1, price).alias("open"), F.when(k == 2, price / 2).otherwise(price * 1.5).alias("high"),
        F.when(k == 3, price * 2).otherwise(price / 2).alias("low"), price.alias("close"),
        F.when(k == 4, -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("volume"),
        F.when(k != 5, F.col("l_extendedprice")).alias("amount"),
    )


BROKEN = """
    raw AS (SELECT l_orderkey % 11 AS k, l_extendedprice / l_quantity AS p, lpad(CAST(l_suppkey AS VARCHAR), 6, '0') || '.SZ' AS symbol,
        CAST(l_shipdate AS DATE) AS trade_date, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice FROM lineitem),
    bar AS (SELECT *, CASE WHEN k <> 1 THEN p END AS open, CASE WHEN k = 2 THEN p / 2 ELSE p * 1.5 END AS high,
        CASE WHEN k = 3 THEN p * 2 ELSE p / 2 END AS low, p AS close, CASE WHEN k = 4 THEN -l_quantity ELSE l_quantity END AS volume,
        CASE WHEN k <> 5 THEN l_extendedprice END AS amount FROM raw),
    chk AS (SELECT *, list_filter([
            CASE WHEN high < greatest(coalesce(open, 0), close) THEN 'high_lt_open_or_close' END,
            CASE WHEN low > least(coalesce(open, 0), close) THEN 'low_gt_open_or_close' END,
            CASE WHEN high < low THEN 'high_lt_low' END,
            CASE WHEN least(coalesce(open, 0), high, low, close, volume, coalesce(amount, 0)) < 0 THEN 'negative_value' END],
            lambda x: x IS NOT NULL) AS errors, open IS NULL OR amount IS NULL AS missing FROM bar),
    num AS (SELECT *, len(errors) = 0 AND NOT missing AS clean, row_number() OVER (PARTITION BY symbol, trade_date,
        (len(errors) = 0 AND NOT missing) ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS rn FROM chk)"""


@query("symbol trade_date order_key line part errors[s] is_valid is_repeat", f"""
    {BROKEN} SELECT symbol, trade_date, l_orderkey AS order_key, l_linenumber AS line, l_partkey AS part, errors,
        clean AND rn = 1 AS is_valid, clean AND rn > 1 AS is_repeat FROM num""")
def validate_bars(t):
    out = rows.checked_bars(broken_bars(t.raw("lineitem")))
    return out.withColumns({"order_key": F.col("seq.l_orderkey"), "line": F.col("seq.l_linenumber"), "part": F.col("seq.l_partkey")})


@query("symbol trade_date pct_chg~ turnover_rate~ main_net_inflow~2", """
    q AS (SELECT quantile_cont(amount - 100000, 0.01) AS lo, quantile_cont(amount - 100000, 0.99) AS hi FROM bars)
    SELECT symbol, trade_date, CASE WHEN pct_chg IS NOT NULL THEN greatest(-25, least(25, pct_chg)) END AS pct_chg,
        greatest(0, least(100, turnover_rate * 30 - 50)) AS turnover_rate, greatest(lo, least(hi, amount - 100000)) AS main_net_inflow
    FROM bars, q""", "bars")
def clip_market_extremes(t):
    return rows.clip_market_extremes(t.bars.select(
        "symbol", "trade_date", "pct_chg", (F.col("turnover_rate") * 30 - 50).alias("turnover_rate"),
        (F.col("amount") - 100000).alias("main_net_inflow")))


@query("symbol position", """
    SELECT lpad(CAST(user_id AS VARCHAR), 6, '0') || '.SZ' AS symbol, min(event_id) AS position FROM events GROUP BY 1""")
def distinct_ordered_symbols(t):
    df = t.raw("events").select(F.lpad(F.col("user_id").cast("string"), 6, "0").alias("symbol"), "event_id")
    return rows.distinct_ordered_symbols(df, "event_id")


@query("news_id trade_date", """
    SELECT news_id, coalesce(CASE WHEN hour(publish_time) < 15 THEN (SELECT c.trade_date FROM news_calendar c
            WHERE c.trade_date = CAST(publish_time AS DATE)) END,
        (SELECT min(c.trade_date) FROM news_calendar c WHERE c.trade_date > CAST(publish_time AS DATE)),
        (SELECT max(c.trade_date) FROM news_calendar c)) AS trade_date FROM news""", "news news_calendar")
def asof_forward_publication_date(t):
    return calendar.publication_to_trade_date(t.news, "publish_time", t.news_calendar)


@query("event_id day next_1 next_3 prev_1 prev_2", """
    d AS (SELECT event_id, CAST(ts AS DATE) AS day FROM events), dd AS (SELECT DISTINCT day FROM d),
    l AS (SELECT list(trade_date ORDER BY trade_date) AS c FROM news_calendar),
    r AS (SELECT day, list_filter(c, lambda x: x > day) AS up, list_filter(c, lambda x: x < day) AS down FROM dd, l)
    SELECT event_id, day, up[1] AS next_1, up[3] AS next_3, down[-1] AS prev_1, down[-2] AS prev_2 FROM d JOIN r USING (day)""",
    "news_calendar")
def calendar_offset(t):
    df = t.raw("events").select("event_id", F.to_date("ts").alias("day"))
    for n, name in ((1, "next_1"), (3, "next_3"), (-1, "prev_1"), (-2, "prev_2")):
        df = calendar.offset_dates(df, "day", t.news_calendar, n, name)
    return df


@query("trade_date", "SELECT trade_date FROM calendar WHERE trade_date BETWEEN DATE '1996-01-03' AND DATE '1998-05-04'", "calendar")
def calendar_range(t):
    return calendar.in_calendar_range(t.calendar, "1996-01-03", "1998-05-04")


@query("event_id analysis_date", """
    r AS (SELECT event_id, CAST(ts AS DATE) AS today, CASE WHEN event_id % 7 = 0 THEN CAST(ts AS DATE) - 100 END AS asked FROM events),
    cal AS (SELECT CAST(d AS DATE) AS trade_date, isodow(d) < 6 AND day(d) <> 10 AS is_open FROM (SELECT unnest(generate_series(
        (SELECT min(CAST(ts AS DATE)) FROM events), (SELECT max(CAST(ts AS DATE)) FROM events) - 5, INTERVAL 1 DAY)) AS d)),
    days AS (SELECT DISTINCT today FROM r),
    back AS (SELECT today, today - 1 AS a, (SELECT is_open FROM cal WHERE trade_date = today - 1) AS state FROM days),
    res AS (SELECT today, CASE WHEN state THEN a
        WHEN NOT state THEN coalesce((SELECT max(trade_date) FROM cal WHERE is_open AND trade_date <= a - 1),
            a - 1 - CAST(greatest(isodow(a - 1) - 5, 0) AS INTEGER))
        WHEN isodow(a) > 5 THEN coalesce((SELECT max(trade_date) FROM cal WHERE is_open AND trade_date <= a), a - CAST(isodow(a) - 5 AS INTEGER))
        ELSE a END AS d FROM back)
    SELECT event_id, coalesce(asked, d) AS analysis_date FROM r JOIN res USING (today)""")
def resolve_analysis_date(t):
    ev = t.raw("events")
    asked = F.when(F.col("event_id") % 7 == 0, F.date_sub(F.to_date("ts"), 100))
    requests = ev.select("event_id", F.to_date("ts").alias("today"), asked.alias("asked"))
    span = ev.agg(F.min(F.to_date("ts")).alias("a"), F.date_sub(F.max(F.to_date("ts")), 5).alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("trade_date"))
    state = days.withColumn("is_open", (F.weekday("trade_date") < 5) & (F.day("trade_date") != 10))
    return calendar.resolve_analysis_date(requests, state)
