"""Scan, vendor-layout and writer queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.catalog.registry import query
from barline.functions.columns import by_symbol
from barline.operators import series as series_ops
from barline.sources import news, scans, schemas, vendors, writers

BAR_SPEC = "symbol trade_date open high low close pre_close volume amount~4 turnover_rate~ amplitude~ pct_chg~ source"


@query("symbol trade_date close", """
    SELECT symbol, trade_date, close FROM bars WHERE trade_date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'
    AND symbol IN ('000003.SZ', '000007.SZ', '000009.SZ')""", "bars")
def scan_table(t):
    return scans.scan_table(t.bars, "1996-01-01", "1998-12-31", ["000003.SZ", "000007.SZ", "000009.SZ"])


@query("symbol", "SELECT DISTINCT symbol FROM securities WHERE status = 'active'", "securities")
def scan_active_securities(t):
    return scans.active_securities(t.securities)


@query("trade_date", "SELECT trade_date FROM calendar WHERE month(trade_date) <> 2", "calendar")
def scan_calendar(t):
    return scans.trading_calendar(t.calendar.withColumn("is_open", F.month("trade_date") != 2))


@query("trade_date", """
    SELECT CAST(d AS DATE) AS trade_date FROM (SELECT unnest(generate_series((SELECT min(trade_date) FROM calendar), (SELECT max(trade_date) FROM calendar), INTERVAL 1 DAY)) AS d)
    WHERE isodow(d) < 6""", "calendar")
def scan_calendar_fallback(t):
    """No date of the calendar is open, so its weekdays stand in."""
    return scans.trading_calendar(t.calendar.withColumn("is_open", F.lit(False)), None, None)


@query("symbol trade_date close~ volume", """
    SELECT symbol, trade_date, CASE WHEN strftime(trade_date, '%Y-%m') = '1996-03' THEN close * 2 ELSE close END AS close, volume FROM bars
    WHERE trade_date BETWEEN DATE '1996-02-10' AND DATE '1996-04-20'""", "bars")
def stored_table_range(t):
    """Bars written typed by month, one month rebuilt, and a range read back."""
    folder = writers.work_folder(t.spark, "stored")
    schema = schemas.SCHEMAS["daily_bars"]
    bars = writers.typed(t.bars.select(*[c for c in schema.names if c in t.bars.columns]), schema)
    writers.write_table(bars, folder, "daily_bars", "overwrite")
    march = bars.withColumn("trade_month", F.date_format("trade_date", "yyyy-MM")).where("trade_month = '1996-03'")
    writers.rebuild_range(march.withColumn("close", F.col("close") * 2), folder)
    return scans.read_range(t.spark, folder, "daily_bars", "1996-02-10", "1996-04-20", ["symbol", "trade_date", "close", "volume"])


@query("symbol trade_date pct_chg~ volume", "SELECT symbol, trade_date, pct_chg, volume FROM bars", "bars")
def scan_projected_parquet(t):
    """Bars stored with all their columns, read back by the known ones."""
    folder = writers.work_folder(t.spark, "wide")
    t.bars.write.parquet(folder)
    return scans.projected(t.spark.read.parquet(folder), [schemas.KEYS["daily_bars"], schemas.SEQUENCE_COLUMNS, schemas.TABULAR_COLUMNS])


@query("kind symbol trade_date", """
    SELECT 'raw' AS kind, symbol, trade_date FROM bars WHERE trade_date = (SELECT max(trade_date) FROM bars)
    UNION ALL SELECT 'packaged', symbol, trade_date FROM bars""", "bars")
def scan_dispatch_by_schema(t):
    zero = F.array(F.lit(0.0))
    packed = t.bars.withColumns({c: zero for c in scans.PACKAGED})
    parts = []
    for source in (t.bars, packed):
        kind, rows = scans.inference_rows(source)
        parts.append(rows.select(F.lit(kind).alias("kind"), "symbol", "trade_date"))
    return parts[0].unionByName(parts[1])


def vendor_text(t):
    """The bars as a vendor would send them: everything text."""
    return t.bars.select("symbol", *[F.col(c).cast("string").alias(c) for c in (
        "trade_date", "open", "high", "low", "close", "volume", "amount", "turnover_rate", "amplitude", "pct_chg")])


LAYOUTS = """
    SELECT symbol, trade_date, open, high, low, close, pre_close, volume, amount, turnover_rate, amplitude, pct_chg, 'labelled' AS source FROM bars
    UNION ALL SELECT symbol, trade_date, open, high, low, close, pre_close, volume, amount, turnover_rate, amplitude, pct_chg, 'share' FROM bars
    UNION ALL SELECT symbol, trade_date, open, high, low, close, pre_close, volume * 100, volume * 100 * close, NULL, amplitude, pct_chg, 'lots' FROM bars"""


@query(BAR_SPEC, LAYOUTS, "bars")
def normalize_vendor_bars(t):
    text = vendor_text(t).drop("amplitude", "pct_chg")
    back = {v: k for k, v in vendors.LABELLED.items()}
    labelled = vendors.bars_labelled(text.withColumnsRenamed(back))
    share = text.withColumn("turnover", (F.col("turnover_rate").cast("double") / 100).cast("string")).drop("turnover_rate")
    share = vendors.bars_turnover_share(share.withColumnRenamed("trade_date", "date"))
    lots = text.drop("amount", "turnover_rate").withColumnsRenamed({"trade_date": "date", "volume": "amount"})
    return labelled.unionByName(share).unionByName(vendors.bars_lots(lots))


@query("symbol trade_date open close high low volume amount turnover_rate~", """
    SELECT symbol, CAST(trade_date AS VARCHAR) AS trade_date, open, close, high, low, volume * 100 AS volume, amount, turnover_rate
    FROM bars WHERE volume > 10""", "bars")
def parse_kline_csv_strings(t):
    order = ("trade_date", "open", "close", "high", "low", "volume", "amount", "amplitude", "pct_chg")
    parts = [F.coalesce(F.col(c), F.lit("")) for c in order]
    whole = F.concat_ws(",", *parts, F.lit("0"), F.col("turnover_rate"))
    short = F.concat_ws(",", *parts[:6])
    text = vendor_text(t)
    df = text.select("symbol", F.when(F.col("volume").cast("double") > 10, whole).otherwise(short).alias("kline"))
    out = vendors.parse_kline(df)
    return out.withColumns({c: F.col(c).try_cast("double") for c in ("open", "close", "high", "low", "amount", "turnover_rate")})


@query(BAR_SPEC, """
    SELECT symbol, trade_date, open, high, low, close, pre_close, volume * 100 AS volume, amount, turnover_rate, amplitude, pct_chg, 'kline' AS source FROM bars""", "bars")
def normalize_kline_bars(t):
    """Comma-joined vendor lines to declared bars; lines with too few parts are left out."""
    order = ("trade_date", "open", "close", "high", "low", "volume", "amount", "amplitude", "pct_chg")
    text = vendor_text(t)
    whole = F.concat_ws(",", *[F.coalesce(F.col(c), F.lit("")) for c in order], F.lit("0"), F.col("turnover_rate"))
    lines = text.select("symbol", whole.alias("kline"))
    broken = text.select("symbol", F.concat_ws(",", "trade_date", "open").alias("kline"))
    return vendors.bars_kline(lines.unionByName(broken))


SOURCES = """
    n AS (SELECT *, CAST(substr(symbol, 1, 6) AS INTEGER) AS k FROM bars),
    u AS (SELECT symbol, trade_date, close, 0 AS prio, 'first' AS source FROM n WHERE k % 3 = 0 AND volume > 80
        UNION ALL SELECT symbol, trade_date, close, 1, 'second' FROM n WHERE k % 3 <> 2
        UNION ALL SELECT symbol, trade_date, close, 2, 'third' FROM n)
    SELECT symbol, trade_date, close, source FROM u QUALIFY prio = min(prio) OVER (PARTITION BY symbol)"""


@query("symbol trade_date close source", SOURCES, "bars")
def source_priority_fallback(t):
    k = F.substring("symbol", 1, 6).cast("int")
    rows = t.bars.select("symbol", "trade_date", "close", "volume")
    first = rows.where((k % 3 == 0) & (F.col("volume") > 80)).withColumn("source", F.lit("first"))
    second = rows.where(k % 3 != 2).withColumn("source", F.lit("second"))
    return vendors.first_source([first, second, rows.withColumn("source", F.lit("third"))])


@query("index_code trade_date open~ close~ volume~ amount~2 source", """
    w AS (SELECT * FROM index_bars WHERE index_code = '000300.SH')
    SELECT index_code, trade_date, open, close, volume, amount, 'labelled' AS source FROM w
    UNION ALL SELECT index_code, trade_date, open, close, volume, amount, 'plain' FROM w WHERE trade_date >= DATE '1996-06-01'
    UNION ALL SELECT index_code, trade_date, open, close, volume, NULL, 'lots' FROM w WHERE trade_date >= DATE '1996-06-01'""",
    "index_bars")
def normalize_index_bars(t):
    code = schemas.BENCHMARK_INDEX
    base = t.index_bars.where(F.col("index_code") == code).drop("index_code")
    back = {v: k for k, v in vendors.LABELLED.items() if v in base.columns}
    plain = base.withColumnRenamed("trade_date", "date")
    lots = base.drop("amount").withColumnsRenamed({"trade_date": "date", "volume": "amount"})
    out = vendors.index_bars(base.withColumnsRenamed(back), "labelled", code)
    out = out.unionByName(vendors.index_bars(plain, "plain", code, "1996-06-01"))
    return out.unionByName(vendors.index_bars(lots, "lots", code, "1996-06-01"))


@query("sector_id sector_name trade_date close~ pct_chg~ amount~2 source",
       "SELECT sector_id, sector_name, trade_date, close, pct_chg, amount, 'sector_index' AS source FROM sector_daily", "sector_daily")
def normalize_sector_daily(t):
    back = {v: k for k, v in vendors.SECTOR.items()}
    return vendors.sector_daily(t.sector_daily.select("sector_id", "sector_name", "trade_date", "close", "amount").withColumnsRenamed(back))


@query("symbol report_date asof_date roe~ revenue_yoy~ profit_yoy~ gross_margin~ debt_ratio~", """
    r AS (SELECT lpad(CAST(CAST(floor(o_custkey / 15) AS BIGINT) AS VARCHAR), 6, '0') || '.SZ' AS symbol,
        CAST(o_orderdate AS DATE) - 30 AS report_date, o_orderkey,
        CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderdate AS DATE) - 30 ELSE CAST(o_orderdate AS DATE) END AS asof_date,
        CAST(o_orderkey % 41 AS DOUBLE) AS roe, CAST(o_orderkey % 97 AS DOUBLE) AS revenue_yoy,
        CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 131 AS DOUBLE) END AS profit_yoy,
        CAST(o_orderkey % 53 AS DOUBLE) AS gross_margin, CAST(o_orderkey % 89 AS DOUBLE) AS debt_ratio FROM orders)
    SELECT * EXCLUDE (o_orderkey) FROM r WHERE asof_date >= DATE '1996-01-01' - 450 AND asof_date <= DATE '1998-12-31'
    QUALIFY row_number() OVER (PARTITION BY symbol, report_date, asof_date ORDER BY o_orderkey) = 1""")
def normalize_financials(t):
    key = F.col("o_orderkey")
    raw = t.raw("orders").select(
        t.code(F.floor(F.col("o_custkey") / 15)).alias("symbol"), key.alias("seq"),
        F.date_sub(F.to_date("o_orderdate"), 30).cast("string").alias("REPORT_DATE"),
        F.when(key % 4 == 0, F.lit("--")).otherwise(F.to_date("o_orderdate").cast("string")).alias("NOTICE_DATE"),
        (key % 41).cast("string").alias("ROEJQ"), (key % 97).cast("string").alias("TOTALOPERATEREVETZ"),
        F.when(key % 7 == 0, F.lit("-")).otherwise((key % 131).cast("string")).alias("PARENTNETPROFITTZ"),
        (key % 53).cast("string").alias("XSMLL"), (key % 89).cast("string").alias("ZCFZL"),
    )
    return vendors.financials(raw, "1996-01-01", "1998-12-31")


@query("symbol trade_date main_net_inflow~ main_inflow_ratio~ small_net_inflow~", """
    SELECT symbol, trade_date, CAST(floor(amount) AS DOUBLE) AS main_net_inflow, CAST(floor(volume) AS DOUBLE) AS main_inflow_ratio,
        NULL AS small_net_inflow FROM bars WHERE trade_date >= DATE '1996-01-01'""", "bars")
def normalize_capital_flow(t):
    raw = t.bars.select(
        F.col("symbol"), F.date_format("trade_date", "yyyyMMdd").alias("日期_日期"),
        F.format_number(F.floor("amount"), 0).alias("资金净流入_资金净流入"),
        F.concat(F.floor("volume").cast("string"), F.lit("%")).alias("大单(主力)_净占比"), F.lit("--").alias("小单_净额"),
    )
    return vendors.capital_flow(raw, "1996-01-01")


@query("announcement_id publish_time title category content mentioned_symbols[s]", """
    SELECT md5(lpad(CAST(user_id AS VARCHAR), 6, '0') || '|' || event_type || '|' || strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S'))
        AS announcement_id, CAST(ts AS TIMESTAMP) AS publish_time, event_type AS title, event_type AS category, props AS content,
        [lpad(CAST(user_id AS VARCHAR), 6, '0') || '.SZ'] AS mentioned_symbols
    FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-21'""")
def normalize_announcements(t):
    return vendors.announcements(vendor_notices(t), "2024-01-05", "2024-01-20")


def vendor_notices(t):
    back = {v: k for k, v in vendors.NOTICE.items()}
    return t.raw("events").select(
        t.code(F.col("user_id")).alias("symbol"), F.col("ts").cast("timestamp_ntz").alias(back["publish_time"]),
        F.col("event_type").alias(back["title"]), F.col("props").alias(back["url"]), F.col("event_type").alias(back["category"]),
    )


@query("trade_date exchange is_open",
       "SELECT trade_date, 'CN' AS exchange, true AS is_open FROM calendar WHERE trade_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'",
       "calendar")
def normalize_calendar(t):
    return vendors.calendar(t.calendar.select(F.col("trade_date").cast("string").alias("day")), "1996-01-01", "1999-12-31")


RAW_CODES = """
    c AS (SELECT c_custkey AS seq, CASE c_custkey % 4 WHEN 0 THEN '6' WHEN 1 THEN '3' WHEN 2 THEN '0' ELSE '8' END
        || CASE c_custkey % 4 WHEN 3 THEN '30' WHEN 1 THEN '00' ELSE '0' || CAST(c_custkey % 2 AS VARCHAR) END
        || right('000' || CAST(c_custkey // 3 % 1000 AS VARCHAR), 3) AS code, c_name AS name, c_mktsegment AS industry FROM customer)"""
EXCHANGE = "CASE WHEN left(code, 3) IN ('830') THEN 'BJ' WHEN left(code, 3) IN ('600', '601') THEN 'SH' ELSE 'SZ' END"


@query("symbol name exchange board industry is_st status", f"""
    {RAW_CODES}, d AS (SELECT *, {EXCHANGE} AS exchange FROM c)
    SELECT code || '.' || exchange AS symbol, name, exchange, CASE WHEN left(code, 3) = '300' THEN 'ChiNext'
        WHEN left(code, 3) IN ('000', '001') THEN 'MainBoard' WHEN left(code, 1) = '8' THEN 'BSE' ELSE 'MainBoard' END AS board,
        industry, upper(name) LIKE '%ST%' AS is_st, 'active' AS status
    FROM d QUALIFY row_number() OVER (PARTITION BY code ORDER BY seq) = 1""")
def normalize_securities(t):
    return vendors.securities(raw_codes(t))


def raw_codes(t):
    k = F.col("c_custkey")
    lead = F.when(k % 4 == 0, "6").when(k % 4 == 1, "3").when(k % 4 == 2, "0").otherwise("8")
    mid = F.when(k % 4 == 3, "30").when(k % 4 == 1, "00").otherwise(F.concat(F.lit("0"), (k % 2).cast("string")))
    tail = F.lpad((F.floor(k / 3) % 1000).cast("string"), 3, "0")
    return t.raw("customer").select(
        k.alias("seq"), F.concat(F.lit(" "), lead, mid, F.lit("-"), tail).alias("symbol"), F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("industry"),
    )


@query("symbol name industry board list_date status is_st", """
    e AS (SELECT symbol, coalesce(CASE WHEN is_st THEN NULL ELSE name END, 'spot ' || name) AS name0, industry, board, list_date, name, is_st
        FROM securities)
    SELECT symbol, CASE WHEN board = 'ASIA' THEN 'detail ' || name ELSE name0 END AS name,
        CASE WHEN board = 'ASIA' THEN 'D' WHEN board = 'AFRICA' THEN 'Unknown' ELSE industry END AS industry, board,
        list_date, 'active' AS status, false AS is_st FROM e""", "securities")
def enrich_securities(t):
    s = t.securities
    fresh = s.select("symbol", *[F.lit(None).cast(k).alias(c) for c, k in (
        ("name", "string"), ("exchange", "string"), ("board", "string"), ("industry", "string"), ("list_date", "date"),
        ("is_st", "boolean"), ("status", "string"))])
    old = s.select(
        "symbol", F.when(~F.col("is_st"), F.col("name")).alias("name"), "board",
        F.when(F.col("board") != "AFRICA", F.col("industry")).alias("industry"), "list_date",
    )
    spot = s.select("symbol", F.concat(F.lit("spot "), "name").alias("name"))
    detail = s.where(F.col("board") == "ASIA").select("symbol", F.concat(F.lit("detail "), "name").alias("name"), F.lit("D").alias("industry"))
    return vendors.enrich_securities(fresh, old, spot, detail)


ECONOMIC = """
    eco AS (SELECT CAST(ts AS DATE) AS trade_date, event_id AS item_id,
        CASE user_id % 4 WHEN 0 THEN '中国' WHEN 1 THEN '美国' WHEN 2 THEN '香港' END AS region, event_type AS event,
        CASE WHEN event_id % 5 = 0 THEN NULL ELSE strftime(ts, '%H:%M') END AS time, props AS actual,
        CAST(floor(value) AS BIGINT) % 3 AS importance FROM events)"""
CALENDAR_ITEMS = """
    SELECT trade_date, item_id, '{cat}' AS category, 'daily_{cat}' AS source,
        '[{mark}][' || coalesce(region, '{region}') || '] ' || event AS title,
        '地区: ' || coalesce(region, '{region}') || '; 公布: ' || coalesce(actual, 'None') || '; 预期: None; 前值: None; 重要性: '
            || coalesce(CAST(importance AS VARCHAR), '0') AS summary,
        trade_date + CAST(coalesce(time, '{clock}') || ':00' AS TIME) AS publish_time,
        CAST(coalesce(importance, 0) AS DOUBLE) AS importance_score_raw, coalesce(time, '{clock}') AS order_time FROM eco {where}"""
POOL = (
    ECONOMIC + ", pool AS (" + CALENDAR_ITEMS.format(cat="financial", mark="金融热点", region="全球", clock="08:00", where="")
    + """ UNION ALL SELECT trade_date, item_id, 'domestic', 'daily_domestic', '[国内热点] ' || title, props,
        trade_date + INTERVAL 19 HOUR + INTERVAL 1 MINUTE * least(place, 50), greatest(0.0, 10.0 - place),
        right('000000' || CAST(least(place, 51) AS VARCHAR), 6)
        FROM (SELECT CAST(ts AS DATE) AS trade_date, event_id AS item_id, event_type || ' ' || props AS title, props,
              row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY event_id) AS place FROM events) UNION ALL """
    + CALENDAR_ITEMS.format(cat="international", mark="国际热点", region="海外", clock="09:00",
                            where="WHERE NOT regexp_matches(coalesce(region, ''), '中国|香港|澳门|台湾')") + ")"
)


def news_pool(t):
    ev = t.raw("events")
    k = F.col("user_id") % 4
    eco = ev.select(
        F.to_date("ts").alias("trade_date"), F.col("event_id").alias("item_id"),
        F.when(k == 0, "中国").when(k == 1, "美国").when(k == 2, "香港").alias("region"), F.col("event_type").alias("event"),
        F.when(F.col("event_id") % 5 != 0, F.date_format("ts", "HH:mm")).alias("time"), F.col("props").alias("actual"),
        F.lit(None).cast("string").alias("forecast"), F.lit(None).cast("string").alias("previous"),
        (F.floor("value") % 3).alias("importance"),
    )
    evening = ev.select(
        F.to_date("ts").alias("trade_date"), F.col("event_id").alias("item_id"),
        F.concat_ws(" ", "event_type", "props").alias("title"), F.col("props").alias("content"),
    )
    return news.candidates(eco, evening)


@query("trade_date item_id category source title summary publish_time importance_score_raw", f"{POOL} SELECT * FROM pool")
def market_news_candidates(t):
    return news_pool(t)


@query("trade_date category slot source title news_id publish_time summary importance_score_raw is_placeholder", f"""
    {POOL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY trade_date, category ORDER BY CASE WHEN category = 'domestic' THEN 0
        ELSE importance_score_raw END DESC, order_time, item_id) AS slot FROM pool),
    grid AS (SELECT trade_date, category, slot, row_number() OVER (PARTITION BY trade_date ORDER BY o, slot) AS idx FROM news_calendar,
        (SELECT 'financial' AS category, unnest(range(1, 6)) AS slot, 1 AS o UNION ALL SELECT 'domestic', unnest(range(1, 4)), 2
         UNION ALL SELECT 'international', unnest(range(1, 3)), 3)),
    j AS (SELECT g.*, r.item_id IS NULL AS ph, r.title AS rt, r.summary AS rs, r.publish_time AS rp, r.importance_score_raw AS ri
        FROM grid g LEFT JOIN ranked r ON r.trade_date = g.trade_date AND r.category = g.category AND r.slot = g.slot),
    f AS (SELECT *, 'daily_' || category AS source, CASE WHEN ph THEN '[' || category || '] ' || CAST(trade_date AS VARCHAR)
        || ' 暂无足量热点，使用占位事件补齐' ELSE rt END AS title FROM j)
    SELECT trade_date, category, CAST(slot AS INTEGER) AS slot, source, title,
        md5(CAST(trade_date AS VARCHAR) || '|' || source || '|' || category || '|' || CAST(idx AS VARCHAR) || '|' || title) AS news_id,
        CASE WHEN ph THEN trade_date + INTERVAL 12 HOUR + INTERVAL 1 MINUTE * slot ELSE rp END AS publish_time,
        CASE WHEN ph THEN CAST(trade_date AS VARCHAR) || ' ' || category || ' category placeholder event' ELSE rs END AS summary,
        CASE WHEN ph THEN 0 ELSE ri END AS importance_score_raw, ph AS is_placeholder FROM f""", "news_calendar")
def news_topk_with_padding(t):
    return news.daily_pick(t.news_calendar, news_pool(t))


@query("domain business_key error_message", """
    SELECT 'daily_bars' AS domain, symbol AS business_key, 'bar validation failed' AS error_message FROM bars WHERE pct_chg IS NULL""", "bars")
def quarantine_bad_records(t):
    return writers.bad_records(t.bars.where(F.col("pct_chg").isNull()), "daily_bars", "bar validation failed")


UPSERT = """
    old AS (SELECT symbol, trade_date, close, volume, DATE '2020-01-01' AS created_at FROM bars WHERE volume > 30),
    new AS (SELECT symbol, trade_date, close * 2 AS close, DATE '2021-01-01' AS created_at FROM bars WHERE volume < 60)
    SELECT coalesce(o.symbol, n.symbol) AS symbol, coalesce(o.trade_date, n.trade_date) AS trade_date,
        CASE WHEN n.symbol IS NOT NULL THEN n.close ELSE o.close END AS close, o.volume,
        coalesce(o.created_at, n.created_at) AS created_at
    FROM old o FULL JOIN new n ON o.symbol = n.symbol AND o.trade_date = n.trade_date"""


@query("symbol trade_date close volume created_at", UPSERT, "bars")
def upsert(t):
    rows = t.bars.select("symbol", "trade_date", "close", "volume")
    old = rows.where(F.col("volume") > 30).withColumn("created_at", F.lit("2020-01-01").cast("date"))
    new = rows.where(F.col("volume") < 60).select(
        "symbol", "trade_date", (F.col("close") * 2).alias("close"), F.lit("2021-01-01").cast("date").alias("created_at")
    )
    return writers.upsert(old, new, ["symbol", "trade_date"])


@query("symbol trade_date", "SELECT symbol, trade_date FROM bars WHERE NOT (trade_date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' AND is_suspended)", "bars")
def delete_range(t):
    return writers.outside_range(t.bars, "trade_date", "1996-01-01", "1997-12-31", F.col("is_suspended"))


@query("symbol trade_date close", """
    SELECT symbol, trade_date, CASE WHEN trade_date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' THEN close + 1 ELSE close END AS close
    FROM bars WHERE NOT (trade_date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' AND volume <= 20)""", "bars")
def rebuild_range(t):
    rows = t.bars.select("symbol", "trade_date", "close")
    fresh = t.bars.where(F.col("volume") > 20).select("symbol", "trade_date", (F.col("close") + 1).alias("close"))
    once = writers.replace_range(rows, fresh, "1996-01-01", "1996-12-31")
    return writers.replace_range(once, fresh, "1996-01-01", "1996-12-31")


@query("event_id publish_time ratio~ tags", """
    SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') AS publish_time,
        CASE WHEN user_id % 3 = 0 THEN NULL ELSE value END AS ratio, '["' || event_type || '"]' AS tags FROM events""")
def json_normalize(t):
    ratio = F.when(F.col("user_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return writers.json_safe(t.raw("events").select(
        "event_id", F.col("ts").alias("publish_time"), ratio.alias("ratio"), F.array("event_type").alias("tags")))


@query("symbol trade_date close is_suspended source", """
    SELECT symbol, trade_date, CASE WHEN volume > 20 THEN close END AS close, is_suspended, '["a"]' AS source FROM bars""", "bars")
def typed_export(t):
    rows = t.bars.select(
        "symbol", F.col("trade_date").cast("string").alias("trade_date"),
        F.when(F.col("volume") > 20, F.col("close").cast("string")).otherwise(F.lit("n/a")).alias("close"),
        F.col("is_suspended").cast("string").alias("is_suspended"), F.array(F.lit("a")).alias("source"),
    )
    return writers.typed(rows, schemas.SCHEMAS["daily_bars"])


@query("trade_date symbol signal_score~ place", """
    SELECT trade_date, symbol, coalesce(pct_chg, 0) AS signal_score, row_number() OVER (PARTITION BY trade_date
        ORDER BY coalesce(pct_chg, 0) DESC, symbol) AS place FROM bars""", "bars")
def write_predictions(t):
    """Written as Parquet, CSV and metadata, then read back in file order."""
    from pyspark.sql import Window

    folder = writers.work_folder(t.spark, "predictions")
    rows = t.bars.withColumn("signal_score", F.coalesce("pct_chg", F.lit(0.0))).select("symbol", "trade_date", "signal_score")
    writers.write_predictions(rows, folder, {"model": "signal"})
    back = t.spark.read.parquet(f"{folder}/predictions")
    w = Window.partitionBy("trade_date").orderBy(F.col("signal_score").desc(), "symbol")
    return back.withColumn("place", F.row_number().over(w))


@query("symbol trade_date close", "SELECT symbol, trade_date, close FROM bars WHERE trade_date = (SELECT max(trade_date) FROM bars)", "bars")
def write_latest_and_archive(t):
    folder = writers.work_folder(t.spark, "latest")
    latest = t.bars.agg(F.max("trade_date").alias("d")).scalar()
    rows = t.bars.where(F.col("trade_date") == latest).select("symbol", "trade_date", "close")
    writers.write_latest_and_archive(rows, folder, "20300101")
    return t.spark.read.parquet(f"{folder}/latest")


@query("symbol trade_date bars_needed", """
    n AS (SELECT symbol, trade_date, row_number() OVER (PARTITION BY symbol ORDER BY trade_date) AS rn,
        count(*) OVER (PARTITION BY symbol) AS total FROM bars)
    SELECT symbol, trade_date, row_number() OVER (PARTITION BY symbol ORDER BY trade_date) AS bars_needed
    FROM n WHERE rn > total - 3 - 140""", "bars")
def trailing_rows_for_rebuild(t):
    from barline.plans.samples import returns_to_refresh

    touched = series_ops.tail_per_symbol(t.bars, 3).select("symbol", "trade_date")
    need = returns_to_refresh(t.bars, touched)
    return need.withColumn("bars_needed", F.row_number().over(by_symbol()))
