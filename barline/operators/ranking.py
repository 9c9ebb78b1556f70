"""Ranks and dense ids that do not need a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.columns import div, pct_rank_avg
from barline.sources.writers import staged


def in_ranges(cells: DataFrame, columns: Sequence[str], parts: int | None = None) -> DataFrame:
    """``cells`` in the order of ``columns`` over range partitions, with the number of each row's partition as ``__b``.

    The bounds are drawn from the values themselves, so no value pattern crowds a partition; equal values share one.
    The rows are staged: the numbers hold for everything that reads them.
    """
    n = parts or int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged(cells.repartitionByRange(n, *[F.col(c) for c in columns]).withColumn("__b", F.spark_partition_id()))


def below(cells: DataFrame, keys: Sequence[str], n: str) -> DataFrame:
    """Per group and partition, how many rows lower partitions hold (``__below``) and the group in all (``__total``).

    One row for each group and partition that it touches: groups lie one behind the other, so there are at most as
    many rows as groups and partitions together.
    """
    group = Window.partitionBy(*keys)
    lower = group.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    return cells.groupBy(*keys, "__b").agg(F.sum(n).alias("__bn")).select(
        *keys, "__b", F.coalesce(F.sum("__bn").over(lower), F.lit(0)).alias("__below"), F.sum("__bn").over(group).alias("__total"),
    )


def pct_rank_large(df: DataFrame, value: str, keys: Sequence[str], out: str, parts: int | None = None) -> DataFrame:
    """Same result as :func:`pct_rank_avg` for groups of any size.

    Ties collapse in a partial aggregation.  The distinct values are sorted over range partitions; ranks are counted
    inside a partition and shifted by the count of all lower ones, so a group spreads over as many tasks as it fills.
    """
    keys = list(keys)
    known = F.col(value).isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    cells = in_ranges(df.where(known).groupBy(*keys, value).agg(F.count("*").alias("__n")), [*keys, value], parts)
    inside = Window.partitionBy(*keys, "__b").orderBy(value)
    ranks = cells.join(below(cells, keys, "__n"), [*keys, "__b"]).select(
        *keys, value,
        div(
            F.col("__below") + F.sum("__n").over(inside) - (F.col("__n") - 1) / F.lit(2.0), F.col("__total")
        ).alias(out),
    )
    return df.join(ranks, [*keys, value], "left")


def industry_mean_ranks() -> dict[str, Column]:
    """Percent rank of industry mean returns, as windows over dates.

    One row stands for each industry and date; its rank goes back to all rows of
    the industry.  Needs the 5 and 20 row returns; no join of the frame to itself.
    """
    group = Window.partitionBy("trade_date", "industry")
    known = F.col("industry").isNotNull()
    first = F.row_number().over(group.orderBy("symbol")) == 1
    return {
        "industry_ret_5": F.when(known, F.avg("ret_5").over(group)),
        "industry_ret_20": F.when(known, F.avg("ret_20").over(group)),
        "__one": first & known,
    }


def with_industry_ranks(df: DataFrame) -> DataFrame:
    group = Window.partitionBy("trade_date", "industry")
    work = df.withColumns(industry_mean_ranks())
    for n in (5, 20):
        work = work.withColumn(f"__m{n}", F.when(F.col("__one"), F.col(f"industry_ret_{n}")))
    work = work.withColumns({f"__r{n}": pct_rank_avg(f"__m{n}", "trade_date") for n in (5, 20)})
    work = work.withColumns({
        f"industry_rank_{n}d": F.when(F.col("industry").isNotNull(), F.max(f"__r{n}").over(group)) for n in (5, 20)
    })
    return work.drop("__one", "__m5", "__m20", "__r5", "__r20")


def dense_id_table(values: DataFrame, columns: Sequence[str], parts: int | None = None) -> DataFrame:
    """column, value and id: ids from 1 in lexical order for the distinct non-blank values of each column, in one pass."""
    listed = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.trim(F.col(c)).alias("value")) for c in columns])).alias("v")
    distinct = values.select(listed).select("v.column", "v.value").where(F.col("value") != "").distinct()
    cells = in_ranges(distinct.withColumn("__n", F.lit(1)), ["column", "value"], parts)
    place = F.row_number().over(Window.partitionBy("column", "__b").orderBy("value"))
    return cells.join(below(cells, ["column"], "__n"), ["column", "__b"]).select("column", "value", (F.col("__below") + place).cast("int").alias("id"))


def dense_ids(values: DataFrame, column: str, out: str) -> DataFrame:
    """Ids from 1 in lexical order for the distinct non-blank values of ``column``."""
    return dense_id_table(values, [column]).select(F.col("value").alias(column), F.col("id").alias(out))


def entity_ids(securities: DataFrame) -> DataFrame:
    """symbol_id, industry_id and board_id; blank or unknown is 0."""
    one = staged(securities.groupBy("symbol").agg(
        F.first("industry", ignorenulls=False).alias("industry"), F.first("board", ignorenulls=False).alias("board")
    ))
    names = {"symbol": "symbol_id", "industry": "industry_id", "board": "board_id"}
    ids = staged(dense_id_table(one, list(names)))
    out = one
    for column, name in names.items():
        own = ids.where(F.col("column") == column).select(F.col("value").alias(column), F.col("id").alias(name))
        out = out.join(own, column, "left")
    return out.select(
        "symbol", "industry", "board", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in names.values()]
    )


def date_index(dates: DataFrame) -> DataFrame:
    """Position of each distinct date; the list of dates is as long as the calendar."""
    w = Window.partitionBy(F.lit(0)).orderBy("trade_date")
    return dates.select("trade_date").distinct().withColumn("date_index", F.row_number().over(w) - 1)
