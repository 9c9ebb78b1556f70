"""Cases of the news operators that the shared samples do not hold."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barline.functions import vectors
from barline.operators import aggregates, joins, quantiles, ranking
from barline.sources import news

DAY = dt.date(2024, 1, 9)


def at(hour, minute=0, day=9):
    return dt.datetime(2024, 1, day, hour, minute)


def test_news_take_places_before_newer_notices(spark):
    requests = spark.createDataFrame([("000001.SZ", DAY)], "symbol string, trade_date date")
    kind = "{}_id string, publish_time timestamp_ntz, title string, mentioned_symbols array<string>"
    own = spark.createDataFrame([(f"n{i}", at(8, i), f"t{i}", ["000001.SZ"]) for i in range(5)], kind.format("news"))
    notices = spark.createDataFrame([(f"a{i}", at(20, i), f"t{i}", ["000001.SZ"]) for i in range(10)], kind.format("announcement"))
    got = joins.symbol_news(requests, own, notices).orderBy("item_rank").collect()
    assert [r["item_id"] for r in got] == ["a9", "a8", "a7", "n4", "n3", "n2", "n1", "n0"]
    assert [r["item_rank"] for r in got] == list(range(1, 9))


def test_blank_evening_items_keep_their_place(spark):
    evening = spark.createDataFrame([(DAY, 1, " ", None), (DAY, 2, "second", "text " * 200), (DAY, 3, None, "only text")], "trade_date date, item_id long, title string, content string")
    got = {r["item_id"]: r for r in news._broadcast_candidates(evening).collect()}
    assert set(got) == {2, 3}
    assert got[2]["publish_time"] == at(19, 2) and got[2]["importance_score_raw"] == 8.0
    assert got[2]["summary"] == ("text " * 200).strip() and got[3]["title"].endswith("only text")


def test_clock_formats(spark):
    rows = [(DAY, i, "中国", "e", t, None, None, None, 1) for i, t in enumerate(["08:30", "8:30", "08:30:00", "8:30:15", "late", None])]
    items = spark.createDataFrame(rows, "trade_date date, item_id long, region string, event string, time string, actual string, forecast string, previous string, importance int")
    got = {r["item_id"]: r["publish_time"] for r in news._calendar_candidates(items, "financial").collect()}
    assert [got[i] for i in range(6)] == [at(8, 30), at(8, 30), at(8, 30), dt.datetime(2024, 1, 9, 8, 30, 15), at(8), at(8)]


def test_long_vectors_are_averaged_not_cut(spark):
    df = spark.createDataFrame([([1.0, 3.0, 5.0, 7.0],)], "v array<double>")
    assert df.select(vectors.normalise(F.transform("v", lambda x: x.cast("string")), 2)).first()[0] == [2.0, 6.0]


def test_near_constant_counts_exactly(spark):
    df = spark.createDataFrame([(i, i % 3, None if i else 1) for i in range(50)], "a int, b int, c int")
    got = {r["column"]: r["distinct_values"] for r in aggregates.near_constant(df, ("a", "b", "c"), 3).collect()}
    assert got == {"b": 3, "c": 1}


def test_one_date_spreads_over_all_partitions(spark):
    n = 1_000_000
    df = spark.range(n).select(F.lit(1).alias("g"), (100 + F.col("id") / n).alias("x"))
    cells = ranking.in_ranges(df, ["g", "x"], 20)
    sizes = [r["count"] for r in cells.groupBy("__b").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 0.15 * n and sum(sizes) == n
    small = df.where(F.col("x") < 100.02)
    ranked = ranking.pct_rank_large(small.withColumn("k", F.col("x") * 2), "x", ["g"], "r", 7).orderBy("x").select("r").collect()
    assert all(abs(r["r"] - (i + 1) / 20000) < 1e-9 for i, r in enumerate(ranked))


def test_ids_with_one_common_prefix_spread_and_stay_lexical(spark):
    values = [f"prefix-{i:05d}" for i in range(3000)] + [" prefix-00007 ", "", None, "é", "Z"]
    df = spark.createDataFrame([(v, "b") for v in values], "symbol string, board string")
    got = {r["symbol"]: r["id"] for r in ranking.dense_ids(df, "symbol", "id").collect()}
    assert got == {v: i + 1 for i, v in enumerate(sorted({v.strip() for v in values if v and v.strip()}, key=lambda v: v.encode()))}
    both = ranking.dense_id_table(df, ["symbol", "board"], 8)
    assert both.where("column = 'board'").collect()[0]["id"] == 1 and both.count() == len(got) + 1


def test_quantiles_of_crowded_values(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    crowded = 100 + rng.random(60_000)
    columns = {"a": crowded, "b": np.where(rng.random(60_000) < 0.4, 0.0, crowded), "c": rng.normal(0, 1e-9, 60_000), "d": np.round(crowded, 2)}
    rows = [(i % 3, *[float(x) for x in xs], None) for i, xs in enumerate(zip(*columns.values()))] + [(9, 1.0, None, 2.0, None, None)]
    df = spark.createDataFrame(rows, "g int, a double, b double, c double, d double, e double")
    probs = (0.0, 0.005, 0.25, 0.5, 0.995, 1.0)
    got = {r["column"]: r for r in quantiles.exact_quantiles(df, ["a", "b", "c", "d", "e"], probs).collect()}
    assert set(got) == {"a", "b", "c", "d"}
    for name in got:
        own = [r[1 + "abcd".index(name)] for r in rows if r[1 + "abcd".index(name)] is not None]
        assert np.allclose([got[name][f"q{j}"] for j in range(6)], np.quantile(own, probs), rtol=0, atol=1e-12)
    for r in quantiles.exact_quantiles(df, ["a", "b"], (0.5, 0.01), ["g"]).collect():
        own = [x[1 if r["column"] == "a" else 2] for x in rows if x[0] == r["g"] and x[1 if r["column"] == "a" else 2] is not None]
        assert np.allclose([r["q0"], r["q1"]], np.quantile(own, (0.5, 0.01)), rtol=0, atol=1e-12)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 99, 100, 101, 2001])
def test_quantiles_of_few_values(spark, n):
    import numpy as np

    values = np.random.default_rng(n).integers(0, 3 * n, n).astype(float)
    probs = (0.005, 0.25, 1 / 3, 0.5, 0.75, 0.995)
    got = quantiles.exact_quantiles(spark.createDataFrame([(float(v),) for v in values], "v double"), ["v"], probs).first()
    assert np.allclose([got[f"q{j}"] for j in range(6)], np.quantile(values, probs), rtol=0, atol=1e-12)
