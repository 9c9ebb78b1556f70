"""Counts, coverage and summary statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.columns import clip


def market_coverage(
    bars: DataFrame, securities: DataFrame, target: str | Column, days: int = 14, share: float = 0.95
) -> DataFrame:
    """One row: the newest date of the ``days`` before ``target`` (or on it) with enough active symbols."""
    want = F.lit(target).cast("date") if isinstance(target, str) else target
    recent = bars.where((F.col("trade_date") <= want) & (F.col("trade_date") >= F.date_sub(want, days)))
    active = securities.where(F.col("status") == "active").select("symbol")
    # the natural key holds one row per symbol and date, so distinct pairs are cheap
    counts = recent.select("symbol", "trade_date").join(active, "symbol", "left_semi").groupBy("trade_date").agg(
        F.countDistinct("symbol").alias("symbol_count")
    )
    # at most days+1 rows from here on
    best = F.max("symbol_count").over(Window.partitionBy(F.lit(0)))
    floor = F.greatest(F.lit(1), F.floor(best * share))
    return counts.withColumn("floor", floor).where(F.col("symbol_count") >= F.col("floor")).agg(
        F.max("trade_date").alias("trade_date"), F.max_by("symbol_count", "trade_date").alias("symbol_count")
    )


def coverage_floor(total: Column, share: float = 0.90) -> Column:
    return F.greatest(F.lit(1), F.floor(total * F.lit(share))).cast("long")


def symbol_trade_counts(bars: DataFrame, start: str, end: str) -> DataFrame:
    rows = bars.where(F.col("trade_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return rows.groupBy("symbol").agg(F.count("*").alias("bar_count"))


def latest_and_counts(bars: DataFrame, securities: DataFrame) -> DataFrame:
    """Last date, its row count and the number of securities, each from one pass."""
    last = bars.groupBy("trade_date").agg(F.count("*").alias("n")).agg(
        F.max("trade_date").alias("latest_date"), F.max_by("n", "trade_date").alias("latest_rows")
    )
    return last.withColumn("security_count", securities.agg(F.count("*")).scalar())


def industry_sample_percentile(samples: DataFrame) -> DataFrame:
    """Share of industries with at most as many samples."""
    counts = samples.groupBy(F.coalesce("industry_sw", F.lit("Unknown")).alias("industry_sw")).agg(F.count("*").alias("samples"))
    w = Window.partitionBy(F.lit(0)).orderBy("samples")
    return counts.withColumn("train_industry_pctile", F.cume_dist().over(w))


def split_stats(df: DataFrame, length: int, by: str = "split") -> DataFrame:
    """Rows, symbols, dates, range and the number of full sequences per split.

    Per symbol first, so that neither symbols nor dates pile up in one buffer.
    """
    per_symbol = df.groupBy(by, "symbol").agg(
        F.count("*").alias("n"), F.min("trade_date").alias("a"), F.max("trade_date").alias("b")
    )
    dates = df.groupBy(by, "trade_date").agg(F.count("*").alias("n")).groupBy(by).agg(F.count("*").alias("unique_dates"))
    out = per_symbol.groupBy(by).agg(
        F.sum("n").alias("rows"), F.count("*").alias("unique_symbols"), F.min("a").alias("min_trade_date"),
        F.max("b").alias("max_trade_date"), F.sum(F.greatest(F.lit(0), F.col("n") - (length - 1))).alias("estimated_samples"),
    )
    return out.join(dates, by)


def missing_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of NULLs of every column, the largest first."""
    return _long(df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns]), columns, "missing_share").orderBy(
        F.col("missing_share").desc(), "column"
    )


def near_constant(df: DataFrame, columns: Sequence[str], most: int = 1) -> DataFrame:
    """Columns with at most ``most`` distinct values besides NULL, with their exact number.

    Values are made distinct first and counted then, so no task holds the values of a column.
    """
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x"))
    counts = cells.select("x.*").distinct().groupBy("column").agg(F.count("value").alias("distinct_values"))
    return counts.where(F.col("distinct_values") <= most)


def label_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    wide = df.agg(*[F.avg(c).alias(f"{c}__a") for c in columns], *[F.stddev_samp(c).alias(f"{c}__s") for c in columns])
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"{c}__a").alias("mean"), F.col(f"{c}__s").alias("std")) for c in columns
    ])).alias("x")
    return wide.select(cells).select("x.*")


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: how many rows are copies of an earlier key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"))


def _long(one_row: DataFrame, columns: Sequence[str], value: str) -> DataFrame:
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias(value)) for c in columns])).alias("x")
    return one_row.select(cells).select("x.*")


def vector_column_stats(df: DataFrame, column: str, floor: float = 1e-3, nested: bool = False) -> DataFrame:
    """Mean and population std per position; a matrix counts over rows and time."""
    rows = df.select(F.explode(column).alias("v")) if nested else df.select(F.col(column).alias("v"))
    cells = rows.select(F.posexplode("v").alias("pos", "x"))
    return cells.groupBy("pos").agg(F.avg("x").alias("mean"), F.greatest(F.stddev_pop("x"), F.lit(floor)).alias("std"))


def daily_vector_pool(df: DataFrame, column: str, by: str) -> DataFrame:
    """Mean vector per group, scaled to length 1.

    Averaged per position with map-side combining, so a group of any size costs
    one partial sum per position and task.  All positions count; widths come from the data.
    """
    cells = df.select(by, F.posexplode(column).alias("pos", "x"))
    means = cells.groupBy(by, "pos").agg(F.avg("x").alias("m"))
    packed = means.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("p"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    out = packed.select(by, F.col("p.m").alias("v")).withColumn("norm", norm)
    unit = F.when(F.col("norm") > 0, F.transform("v", lambda x: x / F.col("norm"))).otherwise(F.col("v"))
    return out.select(by, unit.alias("vector"))


def pos_weight(win: Column) -> Column:
    """(1-p)/p with p kept in [.05, .95] and the weight in [.5, 3]."""
    p = clip(F.avg(win), 0.05, 0.95)
    return clip((F.lit(1.0) - p) / p, 0.5, 3.0)


def regime_counts(df: DataFrame, column: str = "market_regime") -> DataFrame:
    """Rows per regime and whether it is the most common one (ties by name)."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    best = counts.agg(F.max_by(column, F.struct("n", column))).scalar()
    return counts.withColumn("is_mode", F.col(column) == best)
