import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from barline import catalog
from barline.functions.columns import by_date
from barline.operators import features, labels, profiles, series

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_price_features_shuffle_once(spark, bars):
    text = plan(features.price_features(bars))
    assert text.count("Exchange hashpartitioning(symbol") == 1 and text.count("Exchange") == 1


def test_labels_and_profile_keep_the_symbol_partitioning(spark, bars):
    index = bars.where("symbol = '000000.SZ'").selectExpr("'000300.SH' index_code", "trade_date", "open", "close")
    for df in (labels.label_table(bars, index), profiles.with_rolling_profile(bars, index)):
        text = plan(df)
        assert text.count("Exchange hashpartitioning(symbol") == 1 and "SortMergeJoin" not in text and "CartesianProduct" not in text


def test_tail_is_cut_before_the_shuffle(spark, bars):
    assert "WindowGroupLimit" in plan(series.tail_per_symbol(bars, 3))


def test_scan_prunes_and_pushes(spark):
    from barline.sources import scans

    raw = spark.read.parquet(f"{SF}/lineitem.parquet").withColumnRenamed("l_shipdate", "trade_date")
    text = plan(scans.scan_table(raw, "1996-01-01", "1996-02-01").select("trade_date", "l_quantity"))
    assert "PushedFilters: [IsNotNull(l_shipdate)" in text and "l_extendedprice" not in text


def test_date_side_is_broadcast(spark, bars):
    side = bars.groupBy("trade_date").agg(F.count("*").alias("n"))
    assert "BroadcastHashJoin" in plan(bars.join(by_date(side), "trade_date"))


def test_every_query_has_a_name_and_sql():
    queries, oracle = catalog.queries(), catalog.oracle_sql()
    assert len(queries) >= 200 and set(oracle) == set(queries)


def test_oracle_on_the_small_tables():
    """A spread of queries against DuckDB; the whole list is run by scripts/check_oracle.py."""
    root = Path(__file__).resolve().parents[1]
    names = ["macd", "validate_bars", "pct_rank_large_groups", "company_similarity", "winsorize_by_chunk", "decision_utility", "leakage_check", "news_topk_with_padding"]
    done = subprocess.run([sys.executable, str(root / "scripts/check_oracle.py"), "--dir", SF, *names], capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stdout[-3000:]


def test_stored_months_prune(spark, bars, tmp_path):
    """A date range reads the folders of its months only, and only the wanted columns."""
    from barline.sources import scans, writers

    rows = bars.select("symbol", "trade_date", "open", "close", "volume")
    writers.write_table(rows, str(tmp_path / "t"), "daily_bars", "overwrite")
    got = scans.read_range(spark, str(tmp_path / "t"), "daily_bars", "2015-02-10", "2015-03-20", ["symbol", "trade_date", "close"])
    plan = got._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(trade_month" in plan and "PushedFilters: [IsNotNull(trade_date), GreaterThanOrEqual(trade_date" in plan
    assert "volume" not in plan[plan.rindex("ReadSchema") :]
    assert len(got.inputFiles()) >= 1
    assert got.count() == rows.where("trade_date between date'2015-02-10' and date'2015-03-20'").count()


def test_projected_scan_reads_the_known_columns_only(spark, bars, tmp_path):
    from barline.sources import scans

    bars.withColumn("note", F.lit("x")).write.parquet(str(tmp_path / "wide"))
    got = scans.projected(spark.read.parquet(str(tmp_path / "wide")), [["symbol", "trade_date"], ["close", "absent"], ["close"]])
    assert got.columns == ["symbol", "trade_date", "close"] and got.count() == bars.count()
    plan = got.where("close > 5")._jdf.queryExecution().toString()
    schema = plan[plan.rindex("ReadSchema") :]
    assert "close" in schema and "note" not in schema and "volume" not in schema and "GreaterThan(close,5.0)" in plan


def test_profile_windows_do_not_slide(spark, bars):
    index = bars.where("symbol = '000000.SZ'").selectExpr("'000300.SH' index_code", "trade_date", "open", "close")
    assert "RowFrame, -119, currentrow" not in plan(profiles.with_rolling_profile(bars, index))
    assert "RowFrame, -119, currentrow" in plan(bars.withColumns(series.rolling_mean_columns(["amount"])))


def test_block_ranking_is_dealt_out(spark):
    from barline.operators import similarity

    few = spark.range(100).coalesce(1)
    assert similarity.spread(few, "id", per_task=4).rdd.getNumPartitions() == 25


def test_wide_rows_are_shuffled_once_and_carry_no_vector(spark, bars):
    from barline.plans import samples

    index = bars.where("symbol = '000000.SZ'").selectExpr("'000300.SH' index_code", "trade_date", "open", "high", "low", "close", "volume", "amount")
    names = bars.select("symbol").distinct().withColumns({c: F.lit("x") for c in ("name", "industry", "board")})
    names = names.withColumns({"list_date": F.lit(None).cast("date"), "is_st": F.lit(False)})
    facts = bars.limit(3).select("symbol", F.col("trade_date").alias("report_date"), F.col("trade_date").alias("asof_date"))
    facts = facts.withColumns({c: F.lit(1.0) for c in profiles.FINANCIAL_OUT})
    known = bars.withColumn("is_suspended", F.lit(False))
    text = plan(samples.build_all_features(known, names, index, None, facts))
    first = text[text.index("Exchange hashpartitioning") :].split("\n")[0]
    assert "REPARTITION_BY_COL" in first
    days = bars.select("trade_date").distinct().withColumn("event_embedding", F.array(F.lit(2.0)))
    narrow, vectors = samples.event_sides(days)
    assert narrow.columns == ["trade_date", "__event"] and len(vectors.first()["event_embedding"]) == 256
    out = samples.with_event_vectors(narrow.limit(1).unionByName(spark.sql("SELECT DATE '1990-01-01' trade_date, -1L __event")), vectors).collect()
    assert sorted(sum(r["event_embedding"]) for r in out) == [0.0, 2.0]


def test_tables_are_stored_once(spark):
    from barline.sources.sample_tables import SampleTables

    tables = SampleTables(spark, SF)
    tables.__dict__["bars"] = spark.range(3)
    stored = tables.stored()
    assert stored.stored() is stored


def test_series_are_dealt_out_by_the_rows(spark):
    from barline.sources import sample_tables

    lines = spark.sql(
        "SELECT id % 5 AS l_suppkey, timestamp'1995-01-02' + make_dt_interval(id) AS l_shipdate, id AS l_orderkey, 1 AS l_linenumber, id AS l_partkey, "
        "2.0D + id % 3 AS l_quantity, 10.0D + id AS l_extendedprice, 0.05D AS l_discount FROM range(200)")
    assert sample_tables.series_tasks(spark, 36_000_000) == 360
    dealt = sample_tables.weekly_bars(lines, 7)
    assert "hashpartitioning(symbol" in plan(dealt) and dealt.select("symbol", "close").rdd.getNumPartitions() == 7
    assert sorted(dealt.collect(), key=str) == sorted(sample_tables.weekly_bars(lines).collect(), key=str)


def test_predictions_shuffle_by_symbol_before_the_rank(spark, bars):
    from barline.catalog.decisions import predictions
    from barline.sources.sample_tables import SampleTables

    tables = SampleTables(spark, "none")
    index = bars.where("symbol = '000000.SZ'").selectExpr("'000300.SH' index_code", "trade_date", "open", "high", "low", "close", "volume", "amount")
    names = bars.select("symbol").distinct().withColumns({c: F.lit("x") for c in ("name", "industry", "board")})
    names = names.withColumns({"list_date": F.lit(None).cast("date"), "is_st": F.lit(False)})
    tables.__dict__.update(bars=bars.withColumn("is_suspended", F.lit(False)), securities=names, index_bars=index, kept=True)
    once = predictions(tables).select("symbol", "trade_date", "rank_score_pred", "avg_amount_5", "list_days")
    text = plan(once.select("rank_score_pred", "avg_amount_5"))
    before_rank = text[text.index("Exchange hashpartitioning(trade_date") :]
    assert "specifiedwindowframe(RowFrame, -4" in before_rank
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
    # a security listed twice gives its rows twice and changes no rank
    tables.__dict__["securities"] = names.unionByName(names.where("symbol = '000001.SZ'"))
    twice = predictions(tables).select(*once.columns)
    assert twice.count() == once.count() + 200 and sorted(twice.distinct().collect(), key=str) == sorted(once.collect(), key=str)


def test_labels_next_to_the_rows_equal_the_table(spark, bars):
    """F1 F5: labels are series columns of the rows, which saves joining wide rows with a table of labels."""
    index = bars.where("symbol = '000000.SZ'").selectExpr("'000300.SH' index_code", "trade_date", "open", "close")
    table = labels.label_table(bars, index)
    rows = bars.select("symbol", "trade_date", "open", "close", labels.complete().alias("whole"))
    beside = labels.with_labels(rows, index).where("whole")
    assert "SortMergeJoin" not in plan(beside) and plan(beside).count("Exchange hashpartitioning(symbol") == 1
    beside = beside.select(*table.columns)
    assert table.count() == beside.count() > 0 and table.exceptAll(beside).count() == 0
    unknown = bars.select(F.when(F.col("symbol") != "000000.SZ", F.col("symbol")).alias("symbol"), "trade_date", "open", "close")
    assert unknown.select("symbol", labels.complete().alias("whole")).where("symbol IS NULL AND whole").count() == 0


def test_profiles_share_the_shuffle_of_the_sweep(spark, bars):
    """F2 F3 F4: as-of values and windows of the profiles need the bars by symbol once."""
    index = bars.where("symbol = '000000.SZ'").selectExpr("'000300.SH' index_code", "trade_date", "open", "close")
    facts = bars.limit(3).select("symbol", F.col("trade_date").alias("report_date"), F.col("trade_date").alias("asof_date"))
    facts = facts.withColumns({c: F.lit(1.0) for c in profiles.FINANCIAL_OUT})
    names = bars.select("symbol").distinct().withColumns({c: F.lit("x") for c in ("industry", "board")})
    text = plan(profiles.company_profiles(bars, index, facts, names))
    upto_bars = text[: text.index("Union")]
    assert upto_bars.count("Exchange hashpartitioning(symbol") == 1


def test_weeks_and_series_share_a_shuffle(spark):
    """F1 F7: line items travel once, not as partial sums and then as bars."""
    from barline.sources import sample_tables

    lines = spark.range(9).selectExpr("id % 5 l_suppkey", "timestamp'1995-01-02' l_shipdate", "id l_orderkey", "1 l_linenumber", "id l_partkey", "2.0D l_quantity", "10.0D l_extendedprice", "0.05D l_discount")
    assert plan(sample_tables.weekly_bars(lines, 7)).count("Exchange") == 1


def test_filling_shuffles_no_wide_rows(spark, bars):
    """F7 F9: medians of a date are broadcast, and columns without gaps need none."""
    from barline.operators import quantiles

    df = bars.select("symbol", "trade_date", "close", F.when(F.col("volume") > 30, F.col("amount")).alias("amount"))
    out = quantiles.group_median_fill(df, ["close", "amount"])
    assert "Exchange hashpartitioning" not in plan(out) and "SortMergeJoin" not in plan(out)
    pdf = df.toPandas()
    want = pdf["amount"].fillna(pdf.groupby("trade_date")["amount"].transform("median")).fillna(pdf["amount"].median())
    got = out.toPandas()
    assert sorted(got["amount"].round(9)) == sorted(want.round(9)) and sorted(got["close"]) == sorted(pdf["close"])


def test_packed_columns_come_back(spark):
    from barline.functions.columns import packed, unpacked

    df = spark.sql("SELECT 1 a, CAST(NULL AS INT) b, 'x' c")
    assert unpacked(packed(df, ["b", "c"], "rest"), "rest").collect() == df.collect()
    assert packed(df, [], "rest").columns == df.columns


def test_neighbours_do_not_move_the_rows(spark, bars):
    """F2 F3 F4 F5: lists aggregated by symbol are brought to the rows, however few tasks these have."""
    from barline.plans import samples

    rows = bars.select("symbol", "trade_date").repartition(3, "symbol")
    near = bars.groupBy("symbol").agg(F.max("close").alias("top"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = samples.with_neighbors(rows, near)
        text = plan(out)
        assert "SortMergeJoin" in text and text.count("REPARTITION_BY_NUM") == 1 and text.count("Exchange hashpartitioning(symbol") == 2
        assert out.count() == bars.count() and out.where("top IS NULL").count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
