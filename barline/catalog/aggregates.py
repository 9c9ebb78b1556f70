"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.catalog.features import HOT
from barline.catalog.ranks import MEANS
from barline.catalog.registry import query
from barline.catalog.series import BREADTH
from barline.operators import aggregates as agg
from barline.operators import features, labels, series


@query("trade_date up_limit_count down_limit_count market_turnover~2 up_touch_count", BREADTH, "bars")
def market_breadth(t):
    return features.market_breadth(t.bars)


@query("trade_date broken_limit_rate~",
       f"b AS ({BREADTH}) SELECT trade_date, coalesce(greatest(up_touch_count - up_limit_count, 0) / "
       "CAST(nullif(up_touch_count, 0) AS DOUBLE), 0) AS broken_limit_rate FROM b", "bars")
def broken_limit_rate(t):
    return features.market_breadth(t.bars).withColumn("broken_limit_rate", features.broken_limit_rate())


@query("trade_date industry industry_ret_5~ industry_ret_20~", f"{MEANS} SELECT * FROM m", "bars securities")
def industry_daily_mean(t):
    df = features.with_industry(t.bars, t.securities).withColumns(series.return_columns((5, 20)))
    return features.industry_daily_mean(df)


@query("trade_date sector_hotness_top1~ sector_hotness_top3_mean~5", HOT, "sector_daily")
def sector_hotness(t):
    return features.sector_hotness(t.sector_daily)


@query("trade_date symbol_count", """
    c AS (SELECT trade_date, count(DISTINCT symbol) AS symbol_count FROM bars JOIN securities USING (symbol)
        WHERE status = 'active' AND trade_date <= DATE '1998-06-20' AND trade_date >= DATE '1998-06-20' - 14 GROUP BY 1)
    SELECT trade_date, symbol_count FROM c WHERE symbol_count >= greatest(1, floor((SELECT max(symbol_count) FROM c) * 0.95))
    ORDER BY trade_date DESC LIMIT 1""", "bars securities")
def market_coverage(t):
    return agg.market_coverage(t.bars, t.securities, "1998-06-20")


@query("symbol bar_count", """
    SELECT symbol, count(*) AS bar_count FROM bars WHERE trade_date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' GROUP BY 1""", "bars")
def symbol_trade_counts(t):
    return agg.symbol_trade_counts(t.bars, "1996-01-01", "1998-12-31")


@query("latest_date latest_rows security_count", """
    SELECT max(trade_date) AS latest_date, (SELECT count(*) FROM bars WHERE trade_date = (SELECT max(trade_date) FROM bars)) AS latest_rows,
        (SELECT count(*) FROM securities) AS security_count FROM bars""", "bars securities")
def latest_and_counts(t):
    return agg.latest_and_counts(t.bars, t.securities)


INDUSTRY_PCT = """
    c AS (SELECT coalesce(industry, 'Unknown') AS industry_sw, count(*) AS samples FROM bars LEFT JOIN securities USING (symbol) GROUP BY 1)
    SELECT a.industry_sw, a.samples, (SELECT count(*) FROM c b WHERE b.samples <= a.samples) / (SELECT count(*) FROM c)::DOUBLE
        AS train_industry_pctile FROM c a"""


def industry_rows(t):
    return features.with_industry(t.bars, t.securities).withColumnRenamed("industry", "industry_sw")


@query("industry_sw samples train_industry_pctile~", INDUSTRY_PCT, "bars securities")
def industry_sample_percentile(t):
    return agg.industry_sample_percentile(industry_rows(t))


SPLIT = (
    "CASE WHEN trade_date BETWEEN DATE '1995-01-01' AND DATE '1997-12-31' THEN 'train' "
    "WHEN trade_date BETWEEN DATE '1998-06-01' AND DATE '1999-03-31' THEN 'valid' "
    "WHEN trade_date BETWEEN DATE '1999-09-01' AND DATE '2000-12-31' THEN 'test' END"
)


@query("split rows unique_symbols unique_dates min_trade_date max_trade_date estimated_samples", f"""
    s AS (SELECT {SPLIT} AS split, symbol, trade_date FROM bars),
    p AS (SELECT split, symbol, count(*) AS n FROM s GROUP BY 1, 2)
    SELECT s.split, count(*) AS rows, count(DISTINCT symbol) AS unique_symbols, count(DISTINCT trade_date) AS unique_dates,
        min(trade_date) AS min_trade_date, max(trade_date) AS max_trade_date,
        (SELECT CAST(sum(greatest(0, n - 19)) AS BIGINT) FROM p WHERE p.split = s.split) AS estimated_samples
    FROM s WHERE s.split IS NOT NULL GROUP BY s.split""", "bars")
def split_stats(t):
    from barline.operators.splits import assign_split

    return agg.split_stats(assign_split(t.bars, windows()), 20)


def windows():
    from barline.operators.splits import split_config

    return split_config(config())


def config():
    return {
        "project": {"seq_length": 20, "split_method": "time_purged", "split": {
            "train_start": "1995-01-01", "train_end": "1997-12-31", "valid_start": "1998-06-01", "valid_end": "1999-03-31",
            "test_start": "1999-09-01", "test_end": "2000-12-31"}},
        "labels": {"holding_periods": [3, 5, 10, 20, 40]},
    }


NUMBERS = ("open", "high", "low", "close", "volume", "amount", "turnover_rate", "pre_close", "pct_chg", "amplitude", "adj_close")
AUDIT = ("symbol", "trade_date", *NUMBERS, "is_suspended")


def union_of(template: str, columns) -> str:
    return " UNION ALL ".join(template.replace("{c}", c) for c in columns)


@query("column missing_share~", union_of("SELECT '{c}' AS \"column\", avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS missing_share FROM bars", AUDIT), "bars")
def profile_missing_shares(t):
    return agg.missing_shares(t.bars, t.bars.columns)


@query("kind column value~",
       "SELECT 'repeated' AS kind, 'key' AS \"column\", CAST(count(*) - count(DISTINCT (symbol, trade_date)) AS DOUBLE) AS value FROM bars UNION ALL SELECT 'constant', 'data_version', 1 UNION ALL "
       + union_of("SELECT 'constant', '{c}', 1 FROM bars HAVING count(DISTINCT {c}) <= 1", AUDIT) + " UNION ALL "
       + union_of("SELECT 'mean', '{c}', avg({c}) FROM bars UNION ALL SELECT 'std', '{c}', stddev_samp({c}) FROM bars", NUMBERS), "bars")
def profile_quality_audit(t):
    df = t.bars.withColumn("data_version", F.lit("v1"))
    numbers = [f.name for f in t.bars.schema.fields if f.dataType.simpleString() == "double"]
    repeated = agg.repeated_keys(df, ("symbol", "trade_date")).select(
        F.lit("repeated").alias("kind"), F.lit("key").alias("column"), F.col("repeated").cast("double").alias("value"))
    constant = agg.near_constant(df, df.columns).select(F.lit("constant").alias("kind"), "column", F.lit(1.0).alias("value"))
    stats = agg.label_stats(df, numbers)
    out = repeated.unionByName(constant)
    for k in ("mean", "std"):
        out = out.unionByName(stats.select(F.lit(k).alias("kind"), "column", F.col(k).alias("value")))
    return out


@query("pos mean~ std~", """
    SELECT CAST(pos AS INTEGER) AS pos, avg(x) AS mean, greatest(stddev_pop(x), 0.001) AS std FROM (
        SELECT unnest(range(0, len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY 1""")
def vector_column_stats(t):
    vec = F.transform("embedding", lambda x: x.cast("double"))
    return agg.vector_column_stats(t.raw("embeddings").select(vec.alias("v")), "v")


@query("label vector[]", """
    m AS (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(range(0, len(embedding))) AS pos,
        CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY 1, 2)
    SELECT label, list(m / n ORDER BY pos) AS vector FROM m JOIN (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY 1) USING (label)
    GROUP BY label""")
def daily_vector_pool(t):
    vec = F.transform("embedding", lambda x: x.cast("double"))
    return agg.daily_vector_pool(t.raw("embeddings").select("label", vec.alias("v")), "v", "label")


def wins(t):
    df = t.bars.withColumn("ret", labels.forward_return(5)).where(F.col("ret").isNotNull())
    return df.withColumn("win", labels.win(F.col("ret")))


WINS = (
    "w AS (SELECT trade_date, CASE WHEN r > 0 THEN 1 ELSE 0 END AS win FROM (SELECT trade_date, lead(close, 5) OVER "
    "(PARTITION BY symbol ORDER BY trade_date) / nullif(lead(open) OVER (PARTITION BY symbol ORDER BY trade_date), 0) - 1 AS r "
    "FROM bars) WHERE r IS NOT NULL)"
)


@query("trade_date win_rate~", f"{WINS} SELECT trade_date, avg(win) AS win_rate FROM w GROUP BY 1", "bars")
def win_rate_by_date(t):
    return wins(t).groupBy("trade_date").agg(F.avg("win").alias("win_rate"))


@query("weight~",
       f"{WINS} SELECT greatest(0.5, least(3, (1 - p) / p)) AS weight FROM (SELECT greatest(0.05, least(0.95, avg(win))) AS p FROM w)", "bars")
def class_pos_weight(t):
    return wins(t).agg(agg.pos_weight(F.col("win")).alias("weight"))


@query("market_regime n is_mode", """
    c AS (SELECT CASE WHEN pct_chg > 5 THEN 'risk_on' WHEN pct_chg < -5 THEN 'risk_off' ELSE 'neutral' END AS market_regime,
        count(*) AS n FROM bars GROUP BY 1)
    SELECT market_regime, n, market_regime = (SELECT market_regime FROM c ORDER BY n DESC, market_regime DESC LIMIT 1) AS is_mode FROM c""",
    "bars")
def regime_counts(t):
    regime = F.when(F.col("pct_chg") > 5, "risk_on").when(F.col("pct_chg") < -5, "risk_off").otherwise("neutral")
    return agg.regime_counts(t.bars.withColumn("market_regime", regime))
