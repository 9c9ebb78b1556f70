import datetime as dt

from pyspark.sql import functions as F

from barline.operators import series
from barline.streaming import jobs, tables


def test_trailing_rebuild_over_batches_equals_batch(spark, bars, tmp_path):
    """Three files arrive one by one; the features end up as if built at once."""
    src = bars.select("symbol", "trade_date", "adj_close")
    edges = ["2015-01-01", "2015-03-01", "2015-06-01", "2030-01-01"]
    folder = str(tmp_path / "in")
    for a, b in zip(edges, edges[1:]):
        src.where(F.col("trade_date").between(F.lit(a).cast("date"), F.date_sub(F.lit(b).cast("date"), 1))).coalesce(1).write.mode("append").parquet(folder)

    def build(df):
        return df.select("symbol", "trade_date", "adj_close").withColumns({**series.return_columns((1, 20)), **series.gap_columns((60,))})

    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = str(tmp_path / "out")
    jobs.refresh_trailing(stream, out, build, lookback=140).awaitTermination()
    assert tables.all_batches(spark, f"{out}/bars").select("batch").distinct().count() == 3
    got = jobs.current_features(spark, out).select("symbol", "trade_date", *[F.round(c, 9).alias(c) for c in ("ret_1", "ret_20", "ma60_gap")])
    want = build(src).select("symbol", "trade_date", *[F.round(c, 9).alias(c) for c in ("ret_1", "ret_20", "ma60_gap")])
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_rerun_batch_changes_nothing(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    path = str(tmp_path / "t")
    tables.write_batch(df, path, 0)
    tables.write_batch(df.where("k = 'a'").withColumn("v", F.lit(9)), path, 1)
    tables.write_batch(df.where("k = 'a'").withColumn("v", F.lit(9)), path, 1)
    assert sorted(tuple(r) for r in tables.current(spark, path, ["k"]).collect()) == [("a", 9), ("b", 2)]
    tables.compact(spark, path, str(tmp_path / "u"), ["k"])
    assert tables.current(spark, str(tmp_path / "u"), ["k"]).count() == 2


def test_intake_splits_rows(spark, tmp_path):
    day = dt.date(2024, 1, 2)
    table = [(1, "000001", day, 10.0, 12.0, 9.0, 11.0, 5.0, 50.0), (2, "000002", day, 10.0, 8.0, 9.0, 11.0, 5.0, 50.0)]
    df = spark.createDataFrame(table, "seq long, symbol string, trade_date date, open double, high double, low double, close double, volume double, amount double")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    jobs.bars_intake(stream, out).awaitTermination()
    assert [r["symbol"] for r in jobs.current_bars(spark, out).collect()] == ["000001.SZ"]
    assert tables.all_batches(spark, f"{out}/bad_records").first()["business_key"] == "000002.SZ"


def test_batches_without_valid_bars(spark, tmp_path):
    day = dt.date(2024, 1, 2)
    kind = "seq long, symbol string, trade_date date, open double, high double, low double, close double, volume double, amount double"
    for seq in (1, 2):
        spark.createDataFrame([(seq, "000001", day, 10.0, 8.0, 9.0, 11.0, 5.0, 50.0)], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for files in (1, 2):
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", files).parquet(str(tmp_path / "in"))
        out = str(tmp_path / f"out{files}")
        jobs.bars_intake(stream, out).awaitTermination()
        bars = jobs.current_bars(spark, out)
        assert bars.count() == 0 and {"symbol", "trade_date", "close"} <= set(bars.columns) and jobs.MONTH not in bars.columns
        assert tables.all_batches(spark, f"{out}/bad_records").count() == 2


def test_repeats_in_later_batches_are_quarantined(spark, tmp_path):
    day = dt.date(2024, 1, 2)
    kind = "seq long, symbol string, trade_date date, open double, high double, low double, close double, volume double, amount double"
    for seq, close in ((1, 11.0), (2, 10.5), (3, 10.0)):
        row = [(seq, "000001", day, 10.0, 12.0, 9.0, close, 5.0, 50.0), (seq + 10, f"00000{seq + 1}", day, 10.0, 12.0, 9.0, close, 5.0, 50.0)]
        spark.createDataFrame(row, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    files = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.bars_intake(files, str(tmp_path / "out")).awaitTermination()
    bars = {r["symbol"]: r["close"] for r in jobs.current_bars(spark, str(tmp_path / "out")).collect()}
    assert bars == {"000001.SZ": 11.0, "000002.SZ": 11.0, "000003.SZ": 10.5, "000004.SZ": 10.0}
    bad = [tuple(r) for r in tables.all_batches(spark, str(tmp_path / "out/bad_records")).select("business_key", "error_message").collect()]
    assert bad == [("000001.SZ", "repeated_key")] * 2


def test_late_files_lose_no_news_and_no_counts(spark, tmp_path):
    """Files arrive out of order, one a batch; the last ones lie weeks behind."""
    kind = "news_id string, publish_time timestamp, title string, content string"
    for n, day in enumerate((20, 25, 3, 1)):
        rows = [(f"d{day}-{i}", dt.datetime(2024, 1, day, 10 + i), "t", "c") for i in range(3)] + [("d20-0", dt.datetime(2024, 1, day, 9), "t", "c")]
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    calendar = spark.createDataFrame([(dt.date(2024, 1, d),) for d in range(1, 32)], "trade_date date")

    def files():
        return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    jobs.dedupe_news(files(), str(tmp_path / "news")).awaitTermination()
    ids = sorted(r["news_id"] for r in jobs.current_news(spark, str(tmp_path / "news")).collect())
    assert ids == sorted(f"d{day}-{i}" for day in (20, 25, 3, 1) for i in range(3))
    jobs.event_counts(files(), calendar, str(tmp_path / "counts")).awaitTermination()
    counts = jobs.current_counts(spark, str(tmp_path / "counts")).groupBy(F.dayofmonth("trade_date")).agg(F.sum("events")).collect()
    assert {r[0]: r[1] for r in counts} == {20: 4, 25: 4, 3: 4, 1: 4}
    jobs.late_log(files(), str(tmp_path / "log"), "news").awaitTermination()
    assert tables.all_batches(spark, str(tmp_path / "log" / "bad_records")).where("error_message = 'late'").count() == 8
    # the repeated id keeps its earliest publication, not the one that came first
    kept = {r["news_id"]: r["publish_time"] for r in jobs.current_news(spark, str(tmp_path / "news")).collect()}
    assert kept["d20-0"] == dt.datetime(2024, 1, 1, 9)


def test_batches_do_not_read_the_whole_past(spark, tmp_path):
    """Fifty one-row files: the bars lookup lists its month only, and the state of news has one row per id."""
    kind = "news_id string, publish_time timestamp, title string, content string"
    start = dt.datetime(2024, 1, 1)
    for i in range(50):
        rows = [(f"n{i}", start + dt.timedelta(days=i), "t", "c"), ("again", start + dt.timedelta(days=60 - i), str(i), "c")]
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    files = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    before = spark.conf.get(jobs.STATE_STORE)
    query = jobs.dedupe_news(files, str(tmp_path / "news"))
    query.awaitTermination()
    done = [p for p in query.recentProgress if p["numInputRows"]]
    assert len(done) == 50 and all(p["numInputRows"] == 2 for p in done)
    # a batch updates the rows it touches and no others
    assert all(p["stateOperators"][0]["numRowsUpdated"] == 2 for p in done) and done[-1]["stateOperators"][0]["numRowsTotal"] == 51
    assert tables.all_batches(spark, str(tmp_path / "news/news")).count() == 100
    assert {r["news_id"]: r["title"] for r in jobs.current_news(spark, str(tmp_path / "news")).collect()}["again"] == "49"
    assert any("rocksdb" in name.lower() for name in done[-1]["stateOperators"][0]["customMetrics"])
    assert spark.conf.get(jobs.STATE_STORE) == before


def test_bars_lookup_reads_the_touched_months(spark, tmp_path):
    day = dt.date(2024, 1, 15)
    for i in range(4):
        rows = spark.createDataFrame([("000001.SZ", day + dt.timedelta(days=30 * i))], "symbol string, trade_date date")
        tables.write_batch(rows.withColumn(jobs.MONTH, F.date_format("trade_date", "yyyyMM")), str(tmp_path / "bars"), i, [jobs.MONTH])
    known = tables.earlier_batches(spark, str(tmp_path / "bars"), 4).where(F.col(jobs.MONTH).cast("string").isin(["202402"]))
    assert known.count() == 1
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and jobs.MONTH in plan[plan.index("PartitionFilters"):].split("\n")[0]


def test_compacted_table_serves_a_running_stream(spark, tmp_path):
    path, target = str(tmp_path / "t"), str(tmp_path / "u")
    for i in range(3):
        tables.write_batch(spark.createDataFrame([("a", i)], "k string, v int"), path, i)
    tables.compact(spark, path, target, ["k"])
    tables.write_batch(spark.createDataFrame([("a", 7)], "k string, v int"), target, 3)
    assert [tuple(r) for r in tables.current(spark, target, ["k"]).collect()] == [("a", 7)]


def test_parts_of_a_stream_grow_in_files_not_in_size(spark, tmp_path, monkeypatch):
    from barline.catalog import streams
    from barline.sources.sample_tables import SampleTables

    spark.range(400).repartition(8).write.parquet(str(tmp_path / "t.parquet"))
    monkeypatch.setattr(streams, "ROWS_PER_FILE", 25)
    monkeypatch.setattr(streams.writers, "work_folder", lambda *_: str(tmp_path / "files"))
    stream = streams.in_files(SampleTables(spark, str(tmp_path)), "t", F.col("id"), streams.MIXED)
    sizes = []
    query = stream.writeStream.foreachBatch(lambda rows, _: sizes.append(rows.agg(F.count("*"), F.avg("id")).first()))
    query.option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()
    assert [middle // 100 for _, middle in sizes] == list(streams.MIXED) and sum(n for n, _ in sizes) == 400
    assert len(list((tmp_path / "files").glob("*.parquet"))) == 16


def test_a_batch_is_checked_once(spark, tmp_path, monkeypatch):
    day, calls = dt.date(2024, 1, 2), []
    kind = "seq long, symbol string, trade_date date, open double, high double, low double, close double, volume double, amount double"
    for seq in (1, 2):
        spark.createDataFrame([(seq, "000001", day, 10.0, 12.0, 9.0, 11.0, 5.0, 50.0)], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    write = jobs.write_batch
    monkeypatch.setattr(jobs, "write_batch", lambda rows, path, *rest: (calls.append(rows._jdf.queryExecution().optimizedPlan().toString()), write(rows, path, *rest)))
    files = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.bars_intake(files, str(tmp_path / "out")).awaitTermination()
    assert len(calls) == 6 and not any("Aggregate" in text for text in calls)
    assert spark.read.parquet(str(tmp_path / "out/checked")).select("seq").collect() == [(2,)]
    assert tables.all_batches(spark, str(tmp_path / "out/bad_records")).count() == 1
