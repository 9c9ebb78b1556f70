"""Streaming queries: run to the end of the input, then read as tables."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from barline.catalog.registry import query
from barline.catalog.rows import BROKEN, broken_bars
from barline.catalog.series import GAPS_SQL, RETURNS_SQL
from barline.catalog.text import rules, sql_rules
from barline.operators import series
from barline.sources import writers
from barline.sources.sample_tables import weekly_bars
from barline.streaming import jobs


FILES = 4
ROWS_PER_FILE = 250_000
#: The parts of a table as they arrive: in order, or late ones last and one of them twice.
ARRIVAL, MIXED, TWICE = (0, 1, 2, 3), (2, 0, 3, 1), (2, 0, 3, 1, 2)


def finish(started):
    started.awaitTermination()


def in_files(t, name: str, order: Column, turns: tuple[int, ...]):
    """The whole table as a stream, a part a batch: cut at quantiles of ``order``, a part for each number of ``turns``.

    A part has as many files as its rows need, so that no task writes or reads a part that grows with the table.
    """
    rows, folder = t.raw(name), writers.work_folder(t.spark, "files")
    files = max(1, math.ceil(rows.count() / (FILES * ROWS_PER_FILE)))
    cuts = rows.agg(F.percentile_approx(order, [i / FILES for i in range(1, FILES)], 100)).first()[0] or []
    part = sum((F.when(order > c, 1).otherwise(0) for c in cuts), F.lit(0))
    for turn in turns:
        rows.where(part == turn).repartition(files).write.mode("append").parquet(folder)
    return t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)


@query("symbol trade_date close volume", f"{BROKEN} SELECT symbol, trade_date, close, volume FROM num WHERE clean AND rn = 1")
def stream_bars_quarantine(t):
    folder = writers.work_folder(t.spark, "intake")
    finish(jobs.bars_intake(in_files(t, "lineitem", F.col("l_orderkey"), ARRIVAL), folder, broken_bars))
    return jobs.current_bars(t.spark, folder)


@query("business_key error_message n", f"""
    {BROKEN} SELECT symbol AS business_key, array_to_string(list_concat(errors, list_filter([CASE WHEN open IS NULL THEN 'missing_open' END,
        CASE WHEN amount IS NULL THEN 'missing_amount' END, CASE WHEN clean THEN 'repeated_key' END], lambda x: x IS NOT NULL)), ',') AS error_message, count(*) AS n
    FROM num WHERE NOT (clean AND rn = 1) GROUP BY 1, 2""")
def stream_bad_records(t):
    from barline.streaming.tables import all_batches

    folder = writers.work_folder(t.spark, "intake")
    finish(jobs.bars_intake(in_files(t, "lineitem", F.col("l_orderkey"), ARRIVAL), folder, broken_bars))
    return all_batches(t.spark, f"{folder}/bad_records").groupBy("business_key", "error_message").agg(F.count("*").alias("n"))


def news_stream(t, turns: tuple[int, ...]):
    return in_files(t, "events", F.col("ts").cast("timestamp").cast("long"), turns).select(
        F.col("event_id").cast("string").alias("news_id"), F.col("ts").cast("timestamp").alias("publish_time"), F.col("event_type").alias("title"),
        F.col("props").alias("content"))


@query("news_id title", "SELECT CAST(event_id AS VARCHAR) AS news_id, event_type AS title FROM events")
def stream_dedupe_news(t):
    folder = writers.work_folder(t.spark, "news")
    twice = news_stream(t, TWICE).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    finish(jobs.dedupe_news(twice, folder))
    return jobs.current_news(t.spark, folder)


@query("day trade_date event_direction events", f"""
    e AS (SELECT CAST(ts AS DATE) AS day, coalesce(CASE WHEN hour(ts) < 15 THEN (SELECT c.trade_date FROM news_calendar c WHERE c.trade_date = CAST(ts AS DATE)) END,
        (SELECT min(c.trade_date) FROM news_calendar c WHERE c.trade_date > CAST(ts AS DATE)), (SELECT max(c.trade_date) FROM news_calendar c)) AS trade_date,
        {sql_rules("(event_type || ' ' || props)")} FROM events)
    SELECT day, trade_date, CASE WHEN way = 'none' THEN 'neutral' ELSE way END AS event_direction, count(*) AS events FROM e GROUP BY 1, 2, 3""", "news_calendar")
def stream_event_counts(t):
    folder = writers.work_folder(t.spark, "counts")
    finish(jobs.event_counts(news_stream(t, MIXED), t.news_calendar, folder, rules))
    return jobs.current_counts(t.spark, folder).withColumn("day", F.to_date("day"))


@query("symbol trade_date ret_1~ ret_20~ ma60_gap~", f"SELECT symbol, trade_date, {RETURNS_SQL}, {GAPS_SQL} FROM bars", "bars")
def stream_refresh_trailing(t):
    folder = writers.work_folder(t.spark, "refresh")

    def rebuild(bars):
        return bars.select("symbol", "trade_date", "adj_close").withColumns({**series.return_columns(), **series.gap_columns()})

    finish(jobs.refresh_trailing(t.stream("lineitem"), folder, rebuild, weekly_bars))
    return jobs.current_features(t.spark, folder)
