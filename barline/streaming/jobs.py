"""Streaming jobs: bar intake, news dedupe, event counts and trailing rebuild.

Each takes a streaming frame and a folder, and returns the started query.  The
trigger defaults to everything that is there; pass ``processing_time`` for a
standing job.

No batch reads what all batches before it wrote: bars look up the months they touch,
news and counts keep their keys in Spark's state store (RocksDB: on disk, change log
in the query's folder, rebuilt elsewhere when an executor is lost), and the late log
reads one row of the batch before.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from barline.operators.calendar import publication_to_trade_date
from barline.operators.events import rule_event
from barline.operators.rows import checked_bars, split_checked
from barline.plans.samples import returns_to_refresh
from barline.sources.writers import bad_records
from barline.streaming.tables import all_batches, current, earlier_batches, nothing_written, previous_batch, rewritten, write_batch


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _start(writer: DataStreamWriter, folder: str, processing_time: str | None) -> StreamingQuery:
    writer = writer.option("checkpointLocation", f"{folder}/progress")
    writer = writer.trigger(processingTime=processing_time) if processing_time else writer.trigger(availableNow=True)
    return writer.start()


def _start_keyed(spark: SparkSession, writer: DataStreamWriter, folder: str, processing_time: str | None) -> StreamingQuery:
    """Start with the state on disk; a query takes the setting as it is at its start, so the session's own is put back."""
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        return _start(writer, folder, processing_time)
    finally:
        spark.conf.set(STATE_STORE, before)


MONTH = "bar_month"


def bars_intake(
    stream: DataFrame, folder: str, prepare: Callable[[DataFrame], DataFrame] | None = None, order: str = "seq", processing_time: str | None = None
) -> StreamingQuery:
    """Valid bars to ``bars``, the rest to ``bad_records``.

    The first valid row of a symbol and date stays; a repeat is quarantined, in its own batch or in a later
    one, so the result does not hang on how the rows are dealt over files.
    """

    def intake(batch: DataFrame, batch_id: int) -> None:
        rows = prepare(batch) if prepare else batch
        # the batch is checked once; both parts and the lookup read the checked rows of this batch
        checked = rewritten(checked_bars(rows, order), f"{folder}/checked")
        valid, bad = split_checked(checked)
        flat = bad.withColumn("error_text", F.array_join("reasons", ","))
        valid = valid.withColumn(MONTH, F.date_format("trade_date", "yyyyMM"))
        known = earlier_batches(batch.sparkSession, f"{folder}/bars", batch_id)
        if known is not None:
            # a month is a folder, so the lookup reads the keys of this batch's months only
            months = [r[0] for r in valid.select(MONTH).distinct().collect()]
            seen = known.where(F.col(MONTH).cast("string").isin(months)).select("symbol", "trade_date")
            again = valid.join(seen, ["symbol", "trade_date"], "left_semi").withColumn("error_text", F.lit("repeated_key"))
            flat = flat.unionByName(again.drop(MONTH), allowMissingColumns=True)
            valid = valid.join(seen, ["symbol", "trade_date"], "left_anti")
        write_batch(valid.drop(order), f"{folder}/bars", batch_id, [MONTH])
        # a batch without valid bars has no part; this names the columns all the same
        write_batch(valid.drop(order).limit(0), f"{folder}/columns", 0)
        write_batch(bad_records(flat, "daily_bars", F.col("error_text")), f"{folder}/bad_records", batch_id)

    return _start(stream.writeStream.foreachBatch(intake), folder, processing_time)


def current_bars(spark, folder: str) -> DataFrame:
    try:
        return current(spark, f"{folder}/bars", ("symbol", "trade_date")).drop(MONTH)
    except AnalysisException as missing:
        if not nothing_written(missing):
            raise
        return current(spark, f"{folder}/columns", ("symbol", "trade_date")).drop(MONTH)


def _log_late(rows: DataFrame, folder: str, batch_id: int, domain: str, delay: str) -> None:
    """Rows more than ``delay`` behind the newest publication of the batches before are noted in ``bad_records``; they count all the same."""
    spark = rows.sparkSession
    known = previous_batch(spark, f"{folder}/newest", batch_id)
    newest = rows.agg(F.max("publish_time").alias("newest"))
    late = rows.limit(0)
    if known is not None:
        before = known.agg(F.max("newest").alias("__newest"))
        late = rows.crossJoin(F.broadcast(before)).where(F.col("publish_time") < F.col("__newest") - F.expr(f"INTERVAL {delay}")).drop("__newest")
        newest = newest.unionByName(known).agg(F.max("newest").alias("newest"))
    write_batch(bad_records(late, domain, "late"), f"{folder}/bad_records", batch_id)
    write_batch(newest, f"{folder}/newest", batch_id)


def late_log(stream: DataFrame, folder: str, domain: str, delay: str = "1 day", processing_time: str | None = None) -> StreamingQuery:
    """Notes late rows of any stream with ``publish_time`` in ``bad_records``, as a query of its own beside a keyed one."""

    def note(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        _log_late(batch, folder, batch_id, domain, delay)
        batch.unpersist()

    return _start(stream.writeStream.foreachBatch(note), f"{folder}/late", processing_time)


def dedupe_news(stream: DataFrame, folder: str, key: str = "news_id", processing_time: str | None = None) -> StreamingQuery:
    """The earliest publication per id to ``news``, however late it or its repeats arrive.

    The state holds one row per id.  A batch writes the rows of the ids it touches; of equal times the first row by its
    other values stays, a known time goes before an unknown one, and rows without id count as one id.  So the table does
    not hang on how the rows are dealt over files or on a batch that runs again.
    """
    rest = [c for c in stream.columns if c != key]
    order = F.struct(F.col("publish_time").isNull(), "publish_time", *[F.col(c) for c in sorted(rest) if c != "publish_time"])
    first = stream.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("r")).select(key, "r.*").select(*stream.columns)

    def keep(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, f"{folder}/news", batch_id)

    return _start_keyed(stream.sparkSession, first.writeStream.outputMode("update").foreachBatch(keep), folder, processing_time)


def current_news(spark, folder: str, key: str = "news_id") -> DataFrame:
    return current(spark, f"{folder}/news", (key,))


COUNT_KEYS = ("day", "trade_date", "event_direction")


def event_counts(
    stream: DataFrame, calendar: DataFrame, folder: str, extract: Callable[[Column, Column], Column] = rule_event, processing_time: str | None = None,
) -> StreamingQuery:
    """Events per day window, trade date and direction, kept up to date while they arrive.

    The calendar side is static.  The state holds one count per key and takes events however late they are; a batch
    writes the counts it changed, and the newest one per key is the result.
    """
    work = publication_to_trade_date(stream, "publish_time", calendar)
    work = work.withColumn("event_direction", extract(F.coalesce("title", F.lit("")), F.col("content"))["event_direction"])
    counts = work.groupBy(F.window("publish_time", "1 day").alias("w"), "trade_date", "event_direction").agg(F.count("*").alias("events"))
    counts = counts.select(F.col("w.start").alias("day"), "trade_date", "event_direction", "events")

    def keep(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, f"{folder}/counts", batch_id)

    return _start_keyed(stream.sparkSession, counts.writeStream.outputMode("update").foreachBatch(keep), folder, processing_time)


def current_counts(spark, folder: str) -> DataFrame:
    return current(spark, f"{folder}/counts", COUNT_KEYS)


def refresh_trailing(
    stream: DataFrame, folder: str, rebuild: Callable[[DataFrame], DataFrame], prepare: Callable[[DataFrame], DataFrame] | None = None,
    lookback: int = 140, keys: Sequence[str] = ("symbol", "trade_date"), processing_time: str | None = None,
) -> StreamingQuery:
    """Rebuild features from the first touched date of each symbol on, with ``lookback`` rows of history.

    Rolling features need history that a state store would have to hold per symbol;
    the bars table holds it already.
    """

    def refresh(batch: DataFrame, batch_id: int) -> None:
        fresh = prepare(batch) if prepare else batch
        write_batch(fresh, f"{folder}/bars", batch_id)
        spark = batch.sparkSession
        touched = spark.read.parquet(f"{folder}/bars/batch={batch_id}").select(*keys)
        # the history of untouched symbols is left out before rows are merged
        bars = all_batches(spark, f"{folder}/bars").where(F.col("batch") <= batch_id)
        bars = bars.join(touched.select("symbol").distinct(), "symbol", "left_semi")
        values = [c for c in bars.columns if c not in keys and c != "batch"]
        bars = bars.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col("batch").cast("long")).alias("r")).select(*keys, "r.*")
        first = touched.groupBy("symbol").agg(F.min("trade_date").alias("__first"))
        built = rebuild(returns_to_refresh(bars, touched, lookback))
        out = built.join(first, "symbol").where(F.col("trade_date") >= F.col("__first")).drop("__first")
        write_batch(out, f"{folder}/features", batch_id)

    return _start(stream.writeStream.foreachBatch(refresh), folder, processing_time)


def current_features(spark, folder: str, keys: Sequence[str] = ("symbol", "trade_date")) -> DataFrame:
    return current(spark, f"{folder}/features", keys)
