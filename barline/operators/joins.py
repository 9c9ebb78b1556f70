"""Joins with a shape of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.operators.calendar import day_map, mapped_day


def _day_end() -> Column:
    return F.expr("INTERVAL '23:59:59' HOUR TO SECOND")


def semi_join_symbols(df: DataFrame, wanted: DataFrame) -> DataFrame:
    return df.join(wanted.select("symbol").distinct(), "symbol", "left_semi")


def incomplete_symbols(securities: DataFrame, counts: DataFrame, calendar: DataFrame, start: str, end: str) -> DataFrame:
    """Symbols whose bars do not cover every trading day since listing (or ``start``).

    The number of days from a listing date on is read off a running count over the
    calendar: no range join of symbols and days.
    """
    low, high = F.lit(start).cast("date"), F.lit(end).cast("date")
    dates = calendar.select("trade_date").distinct().where(F.col("trade_date").between(low, high))
    total = dates.agg(F.count("*")).scalar()
    side = day_map(dates, 1).select(F.col("day").alias("__day"), "before")
    first = F.greatest(low, F.coalesce("list_date", low))
    due = securities.select("symbol", first.alias("first_day"))
    # a calendar day table has a few hundred rows per year
    due = due.withColumn("__day", mapped_day(F.col("first_day"), dates)).join(F.broadcast(side), "__day", "left")
    due = due.withColumn("expected_days", F.coalesce(total - F.col("before"), F.lit(0)).cast("int")).drop("__day", "before")
    done = due.join(counts, "symbol", "left").where(
        (F.col("expected_days") > 0) & (F.coalesce("bar_count", F.lit(0)) >= F.col("expected_days"))
    )
    return due.join(done.select("symbol"), "symbol", "left_anti")


def active_on_date(bars: DataFrame, securities: DataFrame, date: str) -> DataFrame:
    day = bars.where(F.col("trade_date") == F.lit(date).cast("date")).select("symbol").distinct()
    return day.join(securities.where(F.col("status") == "active").select("symbol"), "symbol")


def join_predictions(raw: DataFrame, predicted: DataFrame, aux: DataFrame | None = None) -> DataFrame:
    """Left joins on symbol, date and the (possibly unknown) names.

    Symbol and date are plain equalities, so the join hashes on them; the names are
    compared null-safely on top.
    """
    out = _named_join(raw, predicted)
    return out if aux is None else _named_join(out, aux)


def _named_join(left: DataFrame, right: DataFrame) -> DataFrame:
    names = ["name", "industry_sw", "board"]
    keys = ["symbol", "trade_date", *names]
    other = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = (F.col("symbol") == F.col("__symbol")) & (F.col("trade_date") == F.col("__trade_date"))
    for n in names:
        cond = cond & F.col(n).eqNullSafe(F.col(f"__{n}"))
    return left.join(other, cond, "left").drop(*[f"__{k}" for k in keys])


def symbol_news(requests: DataFrame, news: DataFrame, notices: DataFrame | None = None, days: int = 7, limit: int = 8) -> DataFrame:
    """Up to ``limit`` items per request (symbol, trade_date), the newest first.

    News of the last ``days`` days that mention the symbol, else the news of the
    day, take the places first; notices that mention it fill those left.  The range is turned into an equi-join on
    (symbol, day); per-day news are cut to ``limit`` before they meet the requests.
    """
    end = F.col("trade_date").cast("timestamp_ntz") + _day_end()
    asked = requests.select("symbol", "trade_date").distinct().withColumn("__end", end)
    asked = asked.withColumn("__start", F.col("__end") - F.expr(f"INTERVAL {days} DAYS"))
    spread = asked.withColumn("day", F.explode(F.sequence(F.date_sub("trade_date", days), F.col("trade_date"))))
    newest = [F.col("publish_time").desc(), F.col("kind"), F.col("item_id")]

    def mentions(df: DataFrame, kind: str, key: str) -> DataFrame:
        rows = df.select(
            F.explode(F.array_distinct("mentioned_symbols")).alias("symbol"), F.lit(kind).alias("kind"),
            F.col(key).alias("item_id"), "publish_time", "title", F.to_date("publish_time").alias("day"),
        ).withColumn("symbol", F.upper("symbol"))
        # the range ends a second before midnight, so items after that second are ranked apart;
        # of either part more than ``limit`` items of one symbol and day never survive
        late = F.col("publish_time") > F.col("day").cast("timestamp_ntz") + _day_end()
        w = Window.partitionBy("symbol", "day", "__late").orderBy(*newest)
        rows = rows.withColumn("__late", late).withColumn("__r", F.row_number().over(w))
        rows = rows.where(F.col("__r") <= limit).drop("__r", "__late")
        hit = (F.col("publish_time") >= F.col("__start")) & (F.col("publish_time") <= F.col("__end"))
        return spread.join(rows, ["symbol", "day"]).where(hit).select(
            "symbol", "trade_date", "kind", "item_id", "publish_time", "title"
        )

    own = mentions(news, "news", "news_id")
    bare = asked.join(own.select("symbol", "trade_date").distinct(), ["symbol", "trade_date"], "left_anti")
    per_day = Window.partitionBy("trade_date").orderBy(F.col("publish_time").desc(), "item_id")
    daily = news.select(
        F.to_date("publish_time").alias("trade_date"), F.lit("news").alias("kind"), F.col("news_id").alias("item_id"),
        "publish_time", "title",
    ).where(F.col("publish_time") <= end).withColumn("__r", F.row_number().over(per_day)).where(F.col("__r") <= limit).drop("__r")
    fallback = bare.select("symbol", "trade_date").join(daily, "trade_date").select(own.columns)
    items = own.unionByName(fallback)
    if notices is not None:
        items = items.unionByName(mentions(notices, "announcement", "announcement_id"))
    asked_for = Window.partitionBy("symbol", "trade_date")
    places = asked_for.orderBy(F.when(F.col("kind") == "news", 0).otherwise(1), *newest)
    chosen = items.withColumn("__place", F.row_number().over(places)).where(F.col("__place") <= limit).drop("__place")
    return chosen.withColumn("item_rank", F.row_number().over(asked_for.orderBy(*newest)))


def training_coverage(samples: DataFrame, counts: DataFrame, industries: DataFrame) -> DataFrame:
    """Sample counts per symbol (default 0), industry percentile (default 1), worst index move."""
    out = samples.join(counts, "symbol", "left").join(industries, "industry_sw", "left")
    return out.withColumns({
        "train_symbol_samples": F.coalesce("train_symbol_samples", F.lit(0)),
        "train_industry_pctile": F.coalesce("train_industry_pctile", F.lit(1.0)),
        "major_index_ret_1": F.least(F.coalesce("hs300_ret_1", F.lit(0.0)), F.coalesce("cyb_ret_1", F.lit(0.0))),
    })


def limit_ratios(df: DataFrame, universe: str = "market_symbol_count") -> DataFrame:
    n = F.col(universe)
    return df.withColumns({
        f"{side}_limit_ratio": F.when(n > 0, F.coalesce(F.col(f"{side}_limit_count"), F.lit(0)) / n) for side in ("down", "up")
    })


def presence_check(
    requests: DataFrame, bars: DataFrame, index_bars: DataFrame, sector_daily: DataFrame, events: DataFrame,
    profiles: DataFrame, financials: DataFrame, news: DataFrame,
) -> DataFrame:
    """For each (symbol, trade_date): which inputs exist, and whether all do."""
    out = requests.select("symbol", "trade_date").distinct()

    def dated(df: DataFrame, name: str, column: str = "trade_date") -> DataFrame:
        return df.select(F.col(column).alias("trade_date")).distinct().withColumn(name, F.lit(True))

    def keyed(df: DataFrame, name: str, column: str = "trade_date") -> DataFrame:
        return df.select("symbol", F.col(column).alias("trade_date")).distinct().withColumn(name, F.lit(True))

    out = out.join(keyed(bars, "has_bar"), ["symbol", "trade_date"], "left")
    out = out.join(keyed(profiles, "has_profile", "asof_date"), ["symbol", "trade_date"], "left")
    for df, name in ((index_bars, "has_index"), (sector_daily, "has_sector"), (events, "has_event"), (news, "has_news")):
        out = out.join(dated(df, name), "trade_date", "left")
    first = financials.groupBy("symbol").agg(F.min("asof_date").alias("__first"))
    out = out.join(first, "symbol", "left").withColumn("has_financial", F.coalesce(F.col("__first") <= F.col("trade_date"), F.lit(False)))
    flags = ["has_bar", "has_index", "has_sector", "has_event", "has_profile", "has_financial", "has_news"]
    out = out.withColumns({f: F.coalesce(F.col(f), F.lit(False)) for f in flags})
    everything = F.lit(True)
    for f in flags:
        everything = everything & F.col(f)
    return out.withColumn("complete", everything).drop("__first")


def boundary_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Shared symbols with their last date on the left and first date on the right."""
    ends = left.groupBy("symbol").agg(F.max("trade_date").alias("left_last_date"))
    starts = right.groupBy("symbol").agg(F.min("trade_date").alias("right_first_date"))
    return ends.join(starts, "symbol")
