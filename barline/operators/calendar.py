"""Trading-calendar lookups.  A calendar has one row per date, so it is small by nature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def day_map(calendar: DataFrame, margin: int = 0) -> DataFrame:
    """Each civil day of the calendar's span (``margin`` days wider) with the trading positions around it.

    ``at_or_before`` counts the open dates up to the day, ``before`` those strictly
    before it; looking up an offset is then an equi-join on the position.
    """
    dates = calendar.select("trade_date").distinct()
    span = dates.agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("b"))
    days = span.select(F.explode(F.sequence(F.date_sub("a", margin), F.date_add("b", margin))).alias("day"))
    work = days.join(dates.select(F.col("trade_date").alias("day"), F.lit(1).alias("open")), "day", "left")
    upto = Window.partitionBy(F.lit(0)).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    counted = work.withColumn("at_or_before", F.count("open").over(upto))
    return counted.select(
        "day", F.col("open").isNotNull().alias("is_open"), "at_or_before",
        (F.col("at_or_before") - F.coalesce("open", F.lit(0))).alias("before"),
    )


def positions(calendar: DataFrame) -> DataFrame:
    return calendar.select("trade_date").distinct().select("trade_date", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("trade_date")).alias("position"))


def mapped_day(day: Column, calendar: DataFrame) -> Column:
    """The day by which ``day_map(calendar, 1)`` is looked up: days beyond the span fall on its edges."""
    edges = calendar.agg(F.struct(F.date_sub(F.min("trade_date"), 1).alias("a"), F.date_add(F.max("trade_date"), 1).alias("b"))).scalar()
    return F.when(day.isNotNull(), F.greatest(F.least(day, edges["b"]), edges["a"]))


def offset_dates(df: DataFrame, column: str, calendar: DataFrame, n: int = 1, out: str | None = None) -> DataFrame:
    """n-th open date strictly after (n > 0) or before (n < 0); NULL beyond the calendar.

    One hash probe of a day table per row, however long the calendar is.
    """
    name = out or ("next_date" if n > 0 else "prev_date")
    position = F.col("at_or_before") + n if n > 0 else F.col("before") + n + 1
    spots = positions(calendar).withColumnRenamed("trade_date", name)
    side = day_map(calendar, 1).withColumn("position", position).join(spots, "position", "left")
    work = df.withColumn("__day", mapped_day(F.col(column).cast("date"), calendar)).drop(name)
    # a calendar day table has a few hundred rows per year
    return work.join(F.broadcast(side.select(F.col("day").alias("__day"), name)), "__day", "left").drop("__day")


def publication_to_trade_date(df: DataFrame, column: str, calendar: DataFrame, close_hour: int = 15, out: str = "trade_date") -> DataFrame:
    """The same day when open and before the close, else the next open day, at most the last one.

    Days are looked up in a day table (one row per civil day), so each row costs one
    hash probe however long the calendar is.
    """
    table = day_map(calendar)
    spots = positions(calendar)
    after = (
        table.withColumn("position", F.col("at_or_before") + 1)
        .join(spots.withColumnRenamed("trade_date", "next_open"), "position", "left")
        .select("day", "is_open", "next_open")
    )
    edges = calendar.agg(F.struct(F.min("trade_date").alias("a"), F.max("trade_date").alias("b")).alias("e")).scalar()
    work = df.withColumn("day", F.to_date(column)).withColumn("__edge", edges)
    # a calendar day table has a few hundred rows per year
    work = work.join(F.broadcast(after), "day", "left")
    same_day = F.coalesce("is_open", F.lit(False)) & (F.hour(column) < close_hour)
    first, last = F.col("__edge.a"), F.col("__edge.b")
    date = (
        F.when(same_day, F.col("day"))
        .when(F.col("day") < first, first)
        .when(F.col("day") >= last, last)
        .otherwise(F.coalesce("next_open", last))
    )
    return work.withColumn(out, F.when(F.col("day").isNotNull(), date)).drop("day", "is_open", "next_open", "__edge")


def in_calendar_range(calendar: DataFrame, start: str, end: str) -> DataFrame:
    return calendar.select("trade_date").distinct().where(
        F.col("trade_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    )


def weekday_back(day: Column) -> Column:
    """The day itself, or the Friday before a weekend."""
    return F.date_sub(day, F.greatest(F.weekday(day) - 4, F.lit(0)))


def resolve_analysis_date(requests: DataFrame, calendar: DataFrame) -> DataFrame:
    """``asked`` as given, else the day before ``today`` rolled back to an open date.

    The calendar (trade_date, is_open) may know the day as open or closed, or not at
    all; an unknown weekday is taken as it is.
    """
    known = calendar.groupBy("trade_date").agg(F.max("is_open").alias("state"))
    work = requests.withColumn("anchor", F.date_sub("today", 1))
    work = work.join(known.withColumnRenamed("trade_date", "anchor"), "anchor", "left")
    anchor = F.col("anchor")
    # a day known as closed goes back from the day before it
    work = work.withColumn("__look", F.when(~F.col("state"), F.date_sub(anchor, 1)).otherwise(anchor))
    opened = calendar.where("is_open")
    spots = positions(opened).select(F.col("position").alias("at_or_before"), F.col("trade_date").alias("__last"))
    side = day_map(opened, 1).join(spots, "at_or_before").select(F.col("day").alias("__day"), "__last")
    work = work.withColumn("__day", mapped_day(F.col("__look"), opened)).join(F.broadcast(side), "__day", "left")
    last_open = F.coalesce("__last", weekday_back(F.col("__look")))
    rolled = F.when(F.col("state"), anchor).when(~F.col("state") | (F.weekday(anchor) >= 5), last_open).otherwise(anchor)
    return work.withColumn("analysis_date", F.coalesce(F.col("asked"), rolled)).drop("__day", "__look", "__last", "anchor", "state")
