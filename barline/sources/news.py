"""Daily news candidates and the padded daily pick."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Title marks, category sizes, home regions and the placeholder texts.
TITLE_MARK = {"financial": "金融热点", "domestic": "国内热点", "international": "国际热点"}
SLOTS = {"financial": 5, "domestic": 3, "international": 2}
HOME_REGIONS = "中国|香港|澳门|台湾"
DEFAULT_REGION = {"financial": "全球", "international": "海外"}
DEFAULT_TIME = {"financial": "08:00", "international": "09:00"}
NO_NEWS = "暂无足量热点，使用占位事件补齐"
CLOCKS = ("HH:mm", "H:mm", "HH:mm:ss", "H:mm:ss")


def _calendar_candidates(items: DataFrame, category: str) -> DataFrame:
    """Economic-calendar rows (trade_date, item_id, region, event, time, actual, forecast, previous, importance)."""
    rows = items.where(F.trim(F.coalesce("event", F.lit(""))) != "")
    region = F.coalesce(F.col("region"), F.lit(""))
    if category == "international":
        rows = rows.where(~region.rlike(HOME_REGIONS))
    shown = F.trim(F.when(region == "", F.lit(DEFAULT_REGION[category])).otherwise(region))
    clock = F.coalesce("time", F.lit(DEFAULT_TIME[category]))

    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("None"))

    summary = F.concat(
        F.lit("地区: "), shown, F.lit("; 公布: "), text("actual"), F.lit("; 预期: "), text("forecast"),
        F.lit("; 前值: "), text("previous"), F.lit("; 重要性: "), F.coalesce(F.col("importance"), F.lit(0)).cast("string"),
    )
    moment = F.concat_ws(" ", F.col("trade_date").cast("string"), F.trim(clock))
    stamp = F.coalesce(*[F.try_to_timestamp(moment, F.lit(f"yyyy-MM-dd {form}")) for form in CLOCKS])
    default = F.try_to_timestamp(
        F.concat_ws(" ", F.col("trade_date").cast("string"), F.lit(DEFAULT_TIME[category])), F.lit("yyyy-MM-dd HH:mm")
    )
    return rows.select(
        "trade_date", "item_id", F.lit(category).alias("category"), F.lit(f"daily_{category}").alias("source"),
        F.concat(F.lit(f"[{TITLE_MARK[category]}]["), shown, F.lit("] "), F.trim("event")).alias("title"),
        summary.alias("summary"), summary.alias("content"),
        F.coalesce(stamp, default).cast("timestamp_ntz").alias("publish_time"),
        F.coalesce(F.col("importance"), F.lit(0)).cast("double").alias("importance_score_raw"),
        clock.alias("order_time"),
    )


def _broadcast_candidates(items: DataFrame) -> DataFrame:
    """Evening-news rows (trade_date, item_id, title, content), in item order.

    The place of an item counts all items of its date, blank ones too; blank ones are left out afterwards.
    Score and minute do not change after the 50th place, so only the first 50 of a date are
    ranked (Spark limits each group before the shuffle) and all later ones share place 51.
    """
    w = Window.partitionBy("trade_date").orderBy("item_id")
    placed = items.select("trade_date", "item_id").withColumn("place", F.row_number().over(w)).where(F.col("place") <= 50)
    rows = items.where((F.trim(F.coalesce("title", F.lit(""))) != "") | (F.trim(F.coalesce("content", F.lit(""))) != ""))
    rows = rows.join(placed, ["trade_date", "item_id"], "left").withColumn("place", F.coalesce("place", F.lit(51)))
    title, content = F.trim(F.coalesce("title", F.lit(""))), F.trim(F.coalesce("content", F.lit("")))
    minute = F.least(F.col("place"), F.lit(50))
    when = F.timestamp_seconds(F.unix_seconds(F.col("trade_date").cast("timestamp")) + 19 * 3600 + minute * 60)
    return rows.select(
        "trade_date", "item_id", F.lit("domestic").alias("category"), F.lit("daily_domestic").alias("source"),
        F.concat(F.lit(f"[{TITLE_MARK['domestic']}] "), F.when(title != "", title).otherwise(content)).alias("title"),
        content.alias("summary"), content.alias("content"),
        when.cast("timestamp_ntz").alias("publish_time"),
        F.greatest(F.lit(0.0), F.lit(10.0) - F.col("place")).alias("importance_score_raw"),
        F.lpad(F.col("place").cast("string"), 6, "0").alias("order_time"),
    )


def candidates(economic: DataFrame, evening: DataFrame) -> DataFrame:
    """All three lists under each other, with the order columns of the pick."""
    out = _calendar_candidates(economic, "financial")
    out = out.unionByName(_broadcast_candidates(evening))
    return out.unionByName(_calendar_candidates(economic, "international"))


def daily_pick(dates: DataFrame, pool: DataFrame) -> DataFrame:
    """Per date 5 financial, 3 domestic and 2 international items; missing places get a placeholder."""
    w = Window.partitionBy("trade_date", "category").orderBy(
        F.when(F.col("category") == "domestic", F.lit(0.0)).otherwise(F.col("importance_score_raw")).desc(),
        "order_time", "item_id",
    )
    most = max(SLOTS.values())
    ranked = pool.withColumn("slot", F.row_number().over(w)).where(F.col("slot") <= most)
    places, index = [], 0
    for category, size in SLOTS.items():
        for slot in range(1, size + 1):
            index += 1
            places.append(F.struct(F.lit(category).alias("category"), F.lit(slot).alias("slot"), F.lit(index).alias("index")))
    grid = dates.select("trade_date", F.explode(F.array(*places)).alias("p")).select("trade_date", "p.*")
    work = grid.join(ranked, ["trade_date", "category", "slot"], "left")
    day = F.date_format("trade_date", "yyyy-MM-dd")
    empty = F.col("item_id").isNull()
    filler_title = F.concat(F.lit("["), F.col("category"), F.lit("] "), day, F.lit(" " + NO_NEWS))
    filler = F.concat(day, F.lit(" "), F.col("category"), F.lit(" category placeholder event"))
    noon = F.timestamp_seconds(F.unix_seconds(F.col("trade_date").cast("timestamp")) + 12 * 3600 + F.least(F.col("slot"), F.lit(59)) * 60)
    source = F.concat(F.lit("daily_"), F.col("category"))
    raw_title = F.trim(F.when(empty, filler_title).otherwise(F.coalesce("title", F.lit(""))))
    title = F.when(raw_title != "", raw_title).otherwise(F.concat_ws("_", "category", F.col("index").cast("string")))
    return work.select(
        "trade_date", "category", "slot", "index", source.alias("source"), title.alias("title"),
        F.md5(F.concat_ws("|", day, source, F.col("category"), F.col("index").cast("string"), title)).alias("news_id"),
        F.when(empty, noon.cast("timestamp_ntz")).otherwise(F.col("publish_time")).alias("publish_time"),
        F.when(empty, filler).otherwise(F.coalesce("summary", F.lit(""))).alias("summary"),
        F.when(empty, filler).otherwise(F.col("content")).alias("content"),
        F.when(empty, F.lit(0.0)).otherwise(F.col("importance_score_raw")).alias("importance_score_raw"),
        empty.alias("is_placeholder"),
    )
