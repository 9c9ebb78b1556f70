"""Row validation and cleaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.functions.columns import clip
from barline.functions.symbols import normalize_symbol
from barline.operators.quantiles import attach, exact_quantiles, widen

REQUIRED = ("symbol", "trade_date", "open", "high", "low", "close", "volume", "amount")


def bar_errors() -> Column:
    """Names of the broken rules; an unknown number counts as 0."""
    o, h, low, c, v, a = (F.coalesce(F.col(x), F.lit(0.0)) for x in ("open", "high", "low", "close", "volume", "amount"))
    rules = {
        "high_lt_open_or_close": h < F.greatest(o, c),
        "low_gt_open_or_close": low > F.least(o, c),
        "high_lt_low": h < low,
        "negative_value": F.least(o, h, low, c, v, a) < 0,
    }
    return _names(rules)


def missing_fields(names: Sequence[str] = REQUIRED) -> Column:
    return _names({n: F.col(n).isNull() | (F.col(n).cast("string") == "") for n in names})


def _names(rules: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules.items()]))


def checked_bars(df: DataFrame, order: str = "seq") -> DataFrame:
    """All rows with ``errors``, ``missing``, ``is_repeat`` and ``is_valid``.

    A repeat is a later row (by ``order``, unique per row) with the key of a valid
    one.  The first valid row per key comes from a partial aggregation and meets the
    rows again on key and order, so copies of one key never gather in one task.
    """
    work = df.withColumn("symbol", normalize_symbol(F.col("symbol")))
    work = work.withColumns({"errors": bar_errors(), "missing": missing_fields()})
    clean = (F.size("errors") == 0) & (F.size("missing") == 0)
    first = work.where(clean).groupBy("symbol", "trade_date").agg(F.min(order).alias(order)).withColumn("__first", F.lit(True))
    work = work.join(first, ["symbol", "trade_date", order], "left")
    is_first = F.coalesce("__first", F.lit(False))
    return work.withColumns({"is_repeat": clean & ~is_first, "is_valid": clean & is_first}).drop("__first")


def validate_bars(df: DataFrame, order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(valid rows, bad rows with their error lists)."""
    return split_checked(checked_bars(df, order))


def split_checked(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, bad rows with their error lists) of :func:`checked_bars`."""
    extra = ["errors", "missing", "is_repeat", "is_valid"]
    valid = checked.where("is_valid").drop(*extra)
    reasons = F.concat("errors", F.transform("missing", lambda m: F.concat(F.lit("missing_"), m)),
                       F.when(F.col("is_repeat"), F.array(F.lit("repeated_key"))).otherwise(F.array().cast("array<string>")))
    bad = checked.where(~F.col("is_valid")).withColumn("reasons", reasons).drop(*extra)
    return valid, bad


def clip_market_extremes(df: DataFrame) -> DataFrame:
    """Moves to +-25, turnover to 0..100, net inflow to its own 1% and 99%."""
    out = {}
    if "pct_chg" in df.columns:
        out["pct_chg"] = clip(F.col("pct_chg").try_cast("double"), -25.0, 25.0)
    if "turnover_rate" in df.columns:
        out["turnover_rate"] = clip(F.col("turnover_rate").try_cast("double"), 0.0, 100.0)
    work = df.withColumns(out) if out else df
    if "main_net_inflow" in df.columns:
        bounds = widen(exact_quantiles(df, ["main_net_inflow"], (0.01, 0.99)), ["main_net_inflow"], ("q0", "q1"))
        low, high = (F.coalesce(F.col(f"main_net_inflow__{q}"), F.lit(0.0)) for q in ("q0", "q1"))
        work = attach(work, bounds).withColumn("main_net_inflow", clip(F.col("main_net_inflow"), low, high))
    return work.select(*df.columns)


def distinct_ordered_symbols(df: DataFrame, order: str, limit: int | None = None) -> DataFrame:
    """Readable symbols in order of first mention; ``limit`` keeps the first ones."""
    work = df.select(normalize_symbol(F.col("symbol")).alias("symbol"), F.col(order).alias("position"))
    first = work.where(F.col("symbol").isNotNull()).groupBy("symbol").agg(F.min("position").alias("position"))
    return first.orderBy("position", "symbol").limit(limit) if limit else first
