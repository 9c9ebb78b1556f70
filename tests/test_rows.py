import datetime as dt

import pytest
from pyspark.sql import functions as F

from barline.functions import symbols, vectors
from barline.operators import calendar, events, rows
from barline.sources import vendors, writers


def test_symbols(spark):
    cases = {" 600000 ": "600000.SH", "sz000001": "000001.SZ", "430047": "430047.BJ", "000001.sh": "000001.SH", "12": None, "": None, "300750.XX": "300750.SZ"}
    df = spark.createDataFrame([(k,) for k in cases], "s string").withColumn("n", symbols.normalize_symbol(F.col("s")))
    assert {r["s"]: r["n"] for r in df.collect()} == cases


def test_validation_and_repeats(spark):
    day = dt.date(2024, 1, 2)
    good = (10.0, 12.0, 9.0, 11.0, 5.0, 50.0)
    table = [
        (1, "000001", day, *good), (2, "000001", day, *good),                       # the second is a repeat
        (3, "000002", day, 10.0, 8.0, 9.0, 11.0, 5.0, 50.0),                        # high below close and low
        (4, "000002", day, *good),                                                  # a valid row after a bad one is no repeat
        (5, "000003", day, 10.0, 12.0, 9.0, 11.0, -5.0, 50.0), (6, "000004", day, None, 12.0, 9.0, 11.0, 5.0, 50.0),
    ]
    df = spark.createDataFrame(table, "seq long, symbol string, trade_date date, open double, high double, low double, close double, volume double, amount double")
    valid, bad = rows.validate_bars(df)
    assert sorted(r["seq"] for r in valid.collect()) == [1, 4]
    reasons = {r["seq"]: r["reasons"] for r in bad.collect()}
    assert reasons[2] == ["repeated_key"]
    assert "high_lt_open_or_close" in reasons[3] and "high_lt_low" in reasons[3]
    assert reasons[5] == ["negative_value"] and "missing_open" in reasons[6]
    kept = writers.bad_records(bad, "daily_bars", "x").collect()
    assert {r["business_key"] for r in kept} == {"000001.SZ", "000002.SZ", "000003.SZ", "000004.SZ"}


def test_publication_date(spark):
    cal = spark.createDataFrame([(dt.date(2024, 1, d),) for d in (2, 3, 4, 5, 8)], "trade_date date")
    cases = [("2024-01-02 14:59:00", 2), ("2024-01-02 15:00:00", 3), ("2024-01-06 09:00:00", 8), ("2024-01-05 16:00:00", 8), ("2024-01-20 09:00:00", 8), ("2023-12-30 09:00:00", 2)]
    df = spark.createDataFrame([(t,) for t, _ in cases], "t string").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    got = {r["t"]: r["trade_date"].day for r in calendar.publication_to_trade_date(df, "ts", cal).collect()}
    assert got == dict(cases)


def test_upsert_keeps_first_stamp_and_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1, "x", 10), ("b", 2, "y", 10)], "k string, v int, note string, created_at int")
    new = spark.createDataFrame([("b", 5, 20), ("c", 6, 20)], "k string, v int, created_at int")
    once = writers.upsert(old, new, ["k"])
    twice = writers.upsert(once, new, ["k"])
    want = {("a", 1, "x", 10), ("b", 5, "y", 10), ("c", 6, None, 20)}
    assert {tuple(r) for r in once.collect()} == want == {tuple(r) for r in twice.collect()}


def test_event_vector(spark):
    df = spark.createDataFrame([("[1, \"x\", 2.5]",), ("[]",), ("oops",), (None,)], "j string")
    got = [r["v"] for r in df.withColumn("v", vectors.from_json_text(F.col("j"), 4)).collect()]
    assert got == [[1.0, 0.0, 2.5, 0.0], [0.0] * 4, [0.0] * 4, [0.0] * 4]


def test_vector_projection(spark):
    import numpy as np

    df = spark.createDataFrame([([float(i) for i in range(n)],) for n in (3, 5, 13)], "v array<double>")
    got = [r["p"] for r in df.withColumn("p", vectors.project(F.col("v"), 5)).collect()]
    assert got[0] == [0.0, 1.0, 2.0, 0.0, 0.0] and got[1] == [0.0, 1.0, 2.0, 3.0, 4.0]
    np.testing.assert_allclose(got[2], [part.mean() for part in np.array_split(np.arange(13.0), 5)])


def test_rules_first_match_wins(spark):
    df = spark.createDataFrame([("公司回购", "诉讼"), ("涉及诉讼", None), ("进展公告", ""), ("天气", "")], "title string, content string")
    got = [r["e"] for r in df.withColumn("e", events.rule_event(F.col("title"), F.col("content"))).collect()]
    assert [(e["event_type"], e["event_direction"]) for e in got] == [
        ("buyback", "positive"), ("lawsuit", "negative"), ("routine", "neutral"), ("general_info", "neutral")]


def test_plugged_classifier_and_encoder(spark):
    import pandas as pd

    score = events.classifier(lambda s: pd.DataFrame({"buyback": s.str.len() / 10, "lawsuit": 0.1}))
    df = spark.createDataFrame([("abcdefg",)], "t string").withColumn("m", score(F.col("t")))
    event = df.withColumn("e", events.scored_event(F.col("m"), F.create_map(F.lit("positive"), F.lit(0.3)), "len")).first()["e"]
    assert event["event_type"] == "buyback" and event["event_direction"] == "neutral" and abs(event["event_strength"] - 0.5) < 1e-9
    enc = events.encoder(lambda s: [[float(len(x)), 1.0] for x in s])
    assert spark.createDataFrame([("abc",)], "t string").select(enc(F.col("t")).alias("v")).first()["v"] == [3.0, 1.0]


def test_dedupe(spark):
    t = dt.datetime(2024, 1, 2, 9)
    table = [(1, "i1", t, "s", "A"), (2, "i1", t, "s", "B"), (3, "i2", t, "s", "A"), (4, "i3", t, "s", "C")]
    df = spark.createDataFrame(table, "seq int, news_id string, publish_time timestamp, source string, title string")
    assert sorted(r["seq"] for r in events.dedupe_news(df, "news_id", "seq").collect()) == [1, 4]


def test_source_order(spark):
    a = spark.createDataFrame([("x", 1)], "symbol string, v int")
    b = spark.createDataFrame([("x", 2), ("y", 3), ("y", 4)], "symbol string, v int")
    assert sorted(tuple(r) for r in vendors.first_source([a, b]).collect()) == [("x", 1), ("y", 3), ("y", 4)]


@pytest.mark.parametrize("day,want", [("2024-01-06", "2024-01-05"), ("2024-01-07", "2024-01-05"), ("2024-01-04", "2024-01-04")])
def test_weekday_back(spark, day, want):
    got = spark.range(1).select(calendar.weekday_back(F.lit(day).cast("date")).alias("d")).first()["d"]
    assert str(got) == want


def test_calendar_lookups_by_day(spark):
    """Days before, between, on and after the open dates, a NULL day and an empty calendar."""
    import bisect
    import datetime as dt

    from barline.operators import calendar, joins

    opened = [dt.date(2024, 1, d) for d in (2, 3, 4, 8, 9, 15)]
    cal = spark.createDataFrame([(d,) for d in opened], "trade_date date")
    asked = [dt.date(2023, 12, 1), *[dt.date(2024, 1, d) for d in range(1, 18)], dt.date(2025, 1, 1), None]
    days = spark.createDataFrame([(d,) for d in asked], "day date")
    for n in (1, 3, -1, -2):
        got = {r.day: r.out for r in calendar.offset_dates(days, "day", cal, n, "out").collect()}
        assert len(got) == len(asked)
        for d in asked:
            rank = None if d is None else (bisect.bisect_right(opened, d) + n - 1 if n > 0 else bisect.bisect_left(opened, d) + n)
            assert got[d] == (opened[rank] if rank is not None and 0 <= rank < len(opened) else None)
    plan = calendar.offset_dates(days, "day", cal, 1)._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "BroadcastHashJoin" in plan
    assert all(r.next_date is None for r in calendar.offset_dates(days, "day", cal.limit(0)).collect())
    requests = spark.createDataFrame([(d, None) for d in asked if d], "today date, asked date")
    known = spark.createDataFrame([(dt.date(2024, 1, d), dt.date(2024, 1, d) in opened) for d in range(2, 12)], "trade_date date, is_open boolean")
    got = {r.today: r.analysis_date for r in calendar.resolve_analysis_date(requests, known).collect()}
    assert got[dt.date(2024, 1, 4)] == dt.date(2024, 1, 3) and got[dt.date(2024, 1, 8)] == dt.date(2024, 1, 4)
    assert got[dt.date(2024, 1, 12)] == dt.date(2024, 1, 9) and got[dt.date(2024, 1, 15)] == dt.date(2024, 1, 9)
    assert got[dt.date(2024, 1, 17)] == dt.date(2024, 1, 16) and got[dt.date(2023, 12, 1)] == dt.date(2023, 11, 30)
    listed = spark.createDataFrame([("a", dt.date(2024, 1, 4)), ("b", None), ("c", dt.date(2025, 1, 1))], "symbol string, list_date date")
    counts = spark.createDataFrame([("a", 4), ("b", 5)], "symbol string, bar_count long")
    rows = {r.symbol: r.expected_days for r in joins.incomplete_symbols(listed, counts, cal, "2024-01-01", "2024-12-31").collect()}
    assert rows == {"b": 6, "c": 0}
