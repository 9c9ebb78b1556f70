import copy
import datetime as dt

import pytest
from pyspark.sql import functions as F

from barline.catalog.aggregates import config
from barline.operators import finalize, splits


def changed(**split):
    c = copy.deepcopy(config())
    c["project"]["split"].update(split)
    return c


def test_config_is_checked():
    assert splits.split_config(config()).gap_days == 60
    with pytest.raises(ValueError, match="distance: "):
        splits.split_config(changed(valid_start="1998-01-31"))
    with pytest.raises(ValueError, match="order: "):
        splits.split_config(changed(valid_start="1997-06-01"))
    with pytest.raises(ValueError, match="window: "):
        splits.split_config(changed(train_end="1990-01-01"))
    with pytest.raises(ValueError, match="gap: "):
        splits.split_config(changed(gap_days=30))
    random = config()
    random["project"]["split_method"] = "random"
    with pytest.warns(UserWarning), pytest.raises(ValueError, match="leak"):
        splits.split_config(random)


def rows(spark, table):
    return spark.createDataFrame([(s, dt.date.fromisoformat(d), x) for s, d, x in table], "symbol string, trade_date date, split string")


def test_leaks_are_found(spark):
    df = rows(spark, [("a", "2020-01-01", "train"), ("a", "2020-03-31", "train"), ("a", "2020-05-01", "valid"), ("b", "2020-03-31", "valid"), ("b", "2021-06-01", "test")])
    found = {(r["rule"], r["pair"]) for r in splits.leakage_violations(df, 20, 40).collect()}
    assert ("shared_date", "train/valid") in found and ("short_gap", "train->valid") in found and ("symbol_boundary", "train->valid") in found
    only = rows(spark, [("a", "2020-01-01", "train")])
    assert {r["pair"] for r in splits.leakage_violations(only, 20, 40).where("rule = 'empty'").collect()} == {"valid", "test"}


def test_bootstrap_follows_the_weights(spark):
    df = spark.range(20000).select(F.col("id").cast("string").alias("symbol"), F.lit("d").alias("trade_date"), F.when(F.col("id") % 2 == 0, 0.5).otherwise(3.0).alias("w"))
    got = {r["w"]: r["n"] for r in splits.weighted_bootstrap(df, "w").groupBy("w").agg(F.count("*").alias("n")).collect()}
    assert abs(got[0.5] / 10000 - 0.5) < 0.03 and abs(got[3.0] / 10000 - 3.0) < 0.08
    again = splits.weighted_bootstrap(df.repartition(7), "w").count()
    assert again == sum(got.values())


def test_sidecar_errors(spark):
    data = rows(spark, [("a", "2020-01-01", "x"), ("a", "2020-01-02", "x")])
    side = spark.createDataFrame([(dt.date(2020, 1, 1), [1.0])], "trade_date date, event_embedding array<double>")
    with pytest.raises(ValueError, match="does not fit"):
        splits.join_sidecar(data, side)
    assert splits.merge_sidecars(side, side).count() == 1


def test_chunks_stand_alone(spark, bars):
    """Filling and clipping with a chunk column equals running each chunk on its own."""
    df = bars.select("symbol", "trade_date", "open", "close", "pct_chg", "turnover_rate").withColumn("chunk", F.year("trade_date"))
    whole = finalize.finalize_samples(df, "chunk", stage=False)
    for year in (2015, 2017):
        part = finalize.finalize_samples(df.where(F.col("chunk") == year), stage=False)
        other = whole.where(F.col("chunk") == year)
        assert part.exceptAll(other).count() == 0 and other.exceptAll(part).count() == 0


def test_bootstrap_draws_beyond_the_written_steps(spark, monkeypatch):
    """the first steps are plain columns; the count is the same wherever they end."""
    df = spark.range(3000).select(F.col("id").cast("string").alias("symbol"), F.lit("d").alias("trade_date"), F.when(F.col("id") != 7, F.col("id") / 150.0).alias("w"))
    few = sorted(splits.weighted_bootstrap(df, "w").collect())
    monkeypatch.setattr(splits, "NEAR", 1)
    assert few == sorted(splits.weighted_bootstrap(df, "w").collect()) and max(r["copy"] for r in few) > 8


def test_weights_send_the_dates_to_the_rows(spark, bars):
    """F6 F8: positions of dates are broadcast, so rows are not shuffled by date."""
    text = splits.sample_weights(bars.selectExpr("symbol", "trade_date", "1 win"), "win")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
