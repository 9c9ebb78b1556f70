"""Market-shaped tables derived from the star-schema test data.

Suppliers play listed companies, weekly trading of a supplier plays a daily bar,
orders play financial reports, events play news.  Sums run over whole cents so
that the base prices do not depend on the order of addition.
"""

from __future__ import annotations

import math
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline.functions.columns import by_symbol, change, div
from barline.sources.schemas import BENCHMARK_INDEX, GROWTH_INDEX
from barline.sources.writers import saved

GROWTH_REGION = "AMERICA"


class SampleTables:
    """Lazily built frames over one data folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @staticmethod
    def code(key) -> F.Column:
        return F.concat(F.lpad(key.cast("string"), 6, "0"), F.lit(".SZ"))

    @cached_property
    def bars(self) -> DataFrame:
        lines = self.raw("lineitem")
        return weekly_bars(lines, series_tasks(self.spark, lines.count()))

    @cached_property
    def loose_bars(self) -> DataFrame:
        """The bars for uses that do not go by symbol, as they are stored or without a shuffle of their own."""
        return self.bars if self.__dict__.get("kept") else weekly_bars(self.raw("lineitem"))

    def stored(self) -> "SampleTables":
        """The same tables over bars and securities written once, as a warehouse has them.

        For compositions that read the bars many times; without it every reader
        would build them again from the line items.
        """
        if self.__dict__.get("kept"):
            return self
        out = SampleTables(self.spark, self.path)
        out.__dict__.update(bars=saved(self.bars, "bars"), securities=saved(self.securities, "securities"), kept=True)
        return out

    def stream(self, name: str) -> DataFrame:
        """The table as a file stream."""
        schema = self.raw(name).schema
        return self.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(self.path)

    @cached_property
    def securities(self) -> DataFrame:
        sup, nat, reg = self.raw("supplier"), self.raw("nation"), self.raw("region")
        listed = F.when(F.col("s_suppkey") % 2 == 1, F.date_add(F.lit("1992-01-01").cast("date"), F.col("s_suppkey").cast("int")))
        return (
            sup.join(nat, sup.s_nationkey == nat.n_nationkey)
            .join(reg, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                self.code(F.col("s_suppkey")).alias("symbol"),
                F.col("s_name").alias("name"),
                F.lit("SZ").alias("exchange"),
                F.col("r_name").alias("board"),
                F.col("n_name").alias("industry"),
                listed.alias("list_date"),
                (F.col("s_acctbal") < 0).alias("is_st"),
                F.lit("active").alias("status"),
            )
        )

    @cached_property
    def calendar(self) -> DataFrame:
        return self.raw("lineitem").select(F.trunc("l_shipdate", "week").alias("trade_date")).distinct()

    @cached_property
    def index_bars(self) -> DataFrame:
        growth = self.securities.where(F.col("board") == GROWTH_REGION).select("symbol")
        whole = _index(self.loose_bars, BENCHMARK_INDEX)
        return whole.unionByName(_index(self.loose_bars.join(growth, "symbol", "left_semi"), GROWTH_INDEX))

    @cached_property
    def sector_daily(self) -> DataFrame:
        per_day = (
            self.loose_bars.join(self.securities.select("symbol", "industry"), "symbol")
            .groupBy(F.col("industry").alias("sector_id"), "trade_date")
            .agg(F.avg("close").alias("close"), F.sum("amount").alias("amount"))
        )
        w = Window.partitionBy("sector_id").orderBy("trade_date")
        return per_day.select(
            "sector_id", F.col("sector_id").alias("sector_name"), "trade_date", "close",
            (change("close", 1, w) * 100).alias("pct_chg"), F.round("amount", 2).alias("amount"),
        )

    @cached_property
    def financials(self) -> DataFrame:
        key = F.col("o_orderkey")
        asof = F.to_date("o_orderdate")
        rows = self.raw("orders").select(
            self.code(F.floor(F.col("o_custkey") / 15)).alias("symbol"),
            F.date_sub(asof, (F.lit(30) + key % 2).cast("int")).alias("report_date"),
            asof.alias("asof_date"),
            F.struct(
                key.alias("order_key"),
                (F.col("o_totalprice") / 10000.0 - 25.0).alias("roe"),
                (key % 97 - 40).cast("double").alias("revenue_yoy"),
                F.when(key % 7 != 0, (key % 131 - 60).cast("double")).alias("profit_yoy"),
                ((key % 53).cast("double") + 0.5).alias("gross_margin"),
                ((key % 89).cast("double")).alias("debt_ratio"),
            ).alias("m"),
        )
        best = rows.groupBy("symbol", "report_date", "asof_date").agg(F.max("m").alias("m"))
        return best.select("symbol", "report_date", "asof_date", "m.*").drop("order_key")

    @cached_property
    def news(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_id").cast("string").alias("news_id"),
            F.col("ts").cast("timestamp_ntz").alias("publish_time"),
            F.concat(F.lit("daily_"), "event_type").alias("source"),
            F.concat_ws(" ", "event_type", "props").alias("title"),
            F.lit(None).cast("string").alias("summary"),
            F.col("props").alias("content"),
            F.array(self.code(F.col("user_id"))).alias("mentioned_symbols"),
            F.col("value").alias("importance_score_raw"),
        )

    @cached_property
    def news_calendar(self) -> DataFrame:
        """Weekdays spanned by the news."""
        span = self.raw("events").agg(F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("b"))
        days = span.select(F.explode(F.sequence("a", "b")).alias("trade_date"))
        return days.where(F.weekday("trade_date") < 5)


ROWS_PER_TASK = 100_000


def series_tasks(spark: SparkSession, rows: int) -> int:
    """Tasks for windows by symbol over ``rows`` line items: they grow with the table, so a task's memory does not."""
    return max(spark.sparkContext.defaultParallelism, math.ceil(rows / ROWS_PER_TASK))


def weekly_bars(lineitem: DataFrame, tasks: int | None = None) -> DataFrame:
    """Line items of a supplier and week as one bar; with ``tasks`` the series are dealt out to that many."""
    li = lineitem.select(
        SampleTables.code(F.col("l_suppkey")).alias("symbol"),
        "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount",
    )
    # a week holds few items of a supplier: they are narrower than their partial sums, and one shuffle serves weeks and series
    li = li.repartition(tasks, "symbol") if tasks else li
    li = li.select(
        "symbol",
        F.trunc("l_shipdate", "week").alias("trade_date"),
        div(F.col("l_extendedprice"), F.col("l_quantity")).alias("price"),
        F.struct(
            "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"
        ).alias("seq"),
        F.col("l_quantity").alias("qty"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
        F.round(F.col("l_discount") * 100).cast("long").alias("disc"),
    )
    bars = li.groupBy("symbol", "trade_date").agg(
        F.min_by("price", "seq").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"),
        F.sum("qty").alias("volume"),
        (F.sum("cents") / F.lit(100.0)).alias("amount"),
        (F.sum("disc") / F.count("*")).alias("turnover_rate"),
    )
    bars = bars.withColumn("pre_close", F.lag("close").over(by_symbol()))
    pct = (div(F.col("close"), F.col("pre_close")) - 1) * 100
    return bars.select(
        "symbol", "trade_date", "open", "high", "low", "close", "pre_close", "volume", "amount", "turnover_rate",
        (div(F.col("high") - F.col("low"), F.col("pre_close")) * 100).alias("amplitude"),
        pct.alias("pct_chg"),
        F.col("close").alias("adj_close"),
        (F.col("volume") <= 2).alias("is_suspended"),
    )


def _index(bars: DataFrame, code: str) -> DataFrame:
    return bars.groupBy("trade_date").agg(
        *[F.avg(c).alias(c) for c in ("open", "high", "low", "close")],
        F.sum("volume").alias("volume"),
        F.round(F.sum("amount"), 2).alias("amount"),
    ).select(F.lit(code).alias("index_code"), "*")


# The same tables for the oracle.
_CODE = "lpad(CAST({0} AS VARCHAR), 6, '0') || '.SZ'"
SQL_TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "bars": ((), f"""
        SELECT *, (high - low) / nullif(pre_close, 0) * 100 AS amplitude,
               (close / nullif(pre_close, 0) - 1) * 100 AS pct_chg, close AS adj_close, volume <= 2 AS is_suspended
        FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) AS pre_close FROM (
            SELECT {_CODE.format('l_suppkey')} AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS trade_date,
                   first(l_extendedprice / l_quantity ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey,
                         l_quantity, l_extendedprice) AS open,
                   max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
                   last(l_extendedprice / l_quantity ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey,
                        l_quantity, l_extendedprice) AS close,
                   sum(l_quantity) AS volume,
                   CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS amount,
                   CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / count(*) AS turnover_rate
            FROM lineitem GROUP BY 1, 2))"""),
    "securities": ((), f"""
        SELECT {_CODE.format('s_suppkey')} AS symbol, s_name AS name, 'SZ' AS exchange, r_name AS board,
               n_name AS industry,
               CASE WHEN s_suppkey % 2 = 1 THEN DATE '1992-01-01' + CAST(s_suppkey AS INTEGER) END AS list_date,
               s_acctbal < 0 AS is_st, 'active' AS status
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""),
    "calendar": ((), """
        SELECT DISTINCT CAST(date_trunc('week', l_shipdate) AS DATE) AS trade_date FROM lineitem"""),
    "index_bars": (("bars", "securities"), f"""
        SELECT '{BENCHMARK_INDEX}' AS index_code, trade_date, avg(open) AS open, avg(high) AS high,
               avg(low) AS low, avg(close) AS close, sum(volume) AS volume,
               round(sum(amount), 2) AS amount
        FROM bars GROUP BY trade_date
        UNION ALL
        SELECT '{GROWTH_INDEX}', trade_date, avg(open), avg(high), avg(low),
               avg(close), sum(volume), round(sum(amount), 2)
        FROM bars WHERE symbol IN (SELECT symbol FROM securities WHERE board = '{GROWTH_REGION}')
        GROUP BY trade_date"""),
    "sector_daily": (("bars", "securities"), """
        SELECT sector_id, sector_id AS sector_name, trade_date, close,
               (close / nullif(lag(close) OVER (PARTITION BY sector_id ORDER BY trade_date), 0) - 1) * 100 AS pct_chg,
               amount
        FROM (SELECT industry AS sector_id, trade_date, avg(close) AS close, round(sum(amount), 2) AS amount
              FROM bars JOIN securities USING (symbol) GROUP BY 1, 2)"""),
    "financials": ((), f"""
        SELECT symbol, CAST(report_date AS DATE) AS report_date, asof_date, roe, revenue_yoy, profit_yoy, gross_margin, debt_ratio
        FROM (SELECT {_CODE.format('CAST(floor(o_custkey / 15) AS BIGINT)')} AS symbol,
                     CAST(o_orderdate AS DATE) - CAST(30 + o_orderkey % 2 AS INTEGER) AS report_date,
                     CAST(o_orderdate AS DATE) AS asof_date, o_orderkey, o_totalprice / 10000.0 - 25.0 AS roe,
                     CAST(o_orderkey % 97 - 40 AS DOUBLE) AS revenue_yoy,
                     CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 131 - 60 AS DOUBLE) END AS profit_yoy,
                     CAST(o_orderkey % 53 AS DOUBLE) + 0.5 AS gross_margin,
                     CAST(o_orderkey % 89 AS DOUBLE) AS debt_ratio
              FROM orders)
        QUALIFY row_number() OVER (PARTITION BY symbol, report_date, asof_date ORDER BY o_orderkey DESC) = 1"""),
    "news": ((), f"""
        SELECT CAST(event_id AS VARCHAR) AS news_id, CAST(ts AS TIMESTAMP) AS publish_time,
               'daily_' || event_type AS source, concat_ws(' ', event_type, props) AS title,
               CAST(NULL AS VARCHAR) AS summary, props AS content,
               [{_CODE.format('user_id')}] AS mentioned_symbols, value AS importance_score_raw
        FROM events"""),
    "news_calendar": ((), """
        SELECT trade_date FROM (
            SELECT CAST(unnest(generate_series(min(CAST(ts AS DATE)), max(CAST(ts AS DATE)), INTERVAL 1 DAY)) AS DATE)
                   AS trade_date FROM events)
        WHERE isodow(trade_date) < 6"""),
}


def with_tables(body: str, names: tuple[str, ...]) -> str:
    """``body`` prefixed by the CTEs it uses; ``body`` may open with CTEs of its own."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for dep in SQL_TABLES[name][0]:
            add(dep)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    ctes = [f"{n} AS ({SQL_TABLES[n][1]})" for n in ordered]
    text = body.strip()
    if text[:6].upper() == "SELECT":
        return f"WITH RECURSIVE {', '.join(ctes)} {text}" if ctes else text
    return f"WITH RECURSIVE {', '.join([*ctes, text])}"
