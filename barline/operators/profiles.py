"""Daily company profiles and their merge into feature rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.functions.columns import by_date, div
from barline.operators import series
from barline.operators.asof import asof_backward
from barline.operators.features import index_returns
from barline.sources.schemas import PROFILE_COLUMNS

FINANCIAL_OUT = "roe revenue_yoy profit_yoy debt_ratio gross_margin".split()
CORE = "volatility_120 beta_120 turnover_mean_120 amount_mean_120".split()


def market_cap_estimate() -> Column:
    """log1p of amount over turnover share, else close times volume, never below 0."""
    traded = div(F.col("amount"), div(F.col("turnover_rate"), F.lit(100.0)))
    cap = F.coalesce(traded, F.col("close") * F.col("volume"))
    return F.when(cap.isNotNull(), F.log1p(F.greatest(cap, F.lit(0.0))))


def with_rolling_profile(bars: DataFrame, index_bars: DataFrame, days: int = 120) -> DataFrame:
    """Adds the seven price-based profile columns; keeps the partitioning by symbol."""
    bench = index_returns(index_bars, (1,), prefix="bench")
    have = set(bars.columns)
    rets = {k: v for k, v in series.return_columns((1, 20, 60)).items() if k not in have}
    work = bars.withColumns(rets).join(by_date(bench), "trade_date", "left")
    work = series.rolling_moments(
        work, days, means={f"turnover_mean_{days}": "turnover_rate", f"amount_mean_{days}": "amount"},
        deviations={f"volatility_{days}": "ret_1"}, betas={f"beta_{days}": ("ret_1", "bench_ret_1")},
    )
    return work.withColumn("market_cap_log", market_cap_estimate()).drop("bench_ret_1")


def company_profiles(
    bars: DataFrame,
    index_bars: DataFrame,
    financials: DataFrame,
    securities: DataFrame,
    start: str | None = None,
    end: str | None = None,
    version: str = "cp1",
) -> DataFrame:
    """Twelve profile columns per symbol and date, cut to the range after the windows."""
    # the sweep first: its shuffle by symbol serves the windows as well
    base = with_rolling_profile(asof_backward(bars, financials, FINANCIAL_OUT), index_bars)
    names = securities.select("symbol", F.col("industry").alias("industry_name"), "board").dropDuplicates(["symbol"])
    base = base.join(names, "symbol", "left").withColumnRenamed("trade_date", "asof_date")
    if start:
        base = base.where(F.col("asof_date") >= F.lit(start).cast("date"))
    if end:
        base = base.where(F.col("asof_date") <= F.lit(end).cast("date"))
    return base.select(
        "symbol", "asof_date", "industry_name", "board", *PROFILE_COLUMNS, F.lit(version).alias("profile_version")
    )


def profiles_usable(profiles: DataFrame) -> DataFrame:
    """One row, one boolean: any value known, and the core columns not all zero."""
    present = [c for c in PROFILE_COLUMNS if c in profiles.columns]
    core = [c for c in CORE if c in profiles.columns]
    known = sum((F.count(c) for c in present), F.lit(0))
    weight = sum((F.coalesce(F.sum(F.abs(F.col(c))), F.lit(0.0)) for c in core), F.lit(0.0))
    ok = (known > 0) & (weight != 0.0) if core else known > 0
    return profiles.agg(ok.alias("usable"))


def merge_profiles(features: DataFrame, profiles: DataFrame) -> DataFrame:
    """Left join on symbol and date; the row's own value wins over the profile's."""
    return pick_stored_profiles(with_stored_profiles(features, profiles))


def with_stored_profiles(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """The profile of each row's symbol and date next to the row's own columns."""
    right = profiles.select(
        "symbol", F.col("asof_date").alias("trade_date"),
        *[F.col(c).alias(f"__p_{c}") for c in PROFILE_COLUMNS],
        F.col("industry_name").alias("__p_industry_sw"), F.col("board").alias("__p_board"),
        F.col("profile_version").alias("company_profile_version"),
    )
    return rows.join(right, ["symbol", "trade_date"], "left")


def pick_stored_profiles(work: DataFrame) -> DataFrame:
    """The row's own value where it has one, else the profile's."""
    own, out = set(work.columns), {}
    for c in [*PROFILE_COLUMNS, "industry_sw", "board"]:
        if c in own:
            out[c] = F.coalesce(F.col(c), F.col(f"__p_{c}"))
        elif c in PROFILE_COLUMNS:
            out[c] = F.col(f"__p_{c}")
    return work.withColumns(out).drop(*[f"__p_{c}" for c in [*PROFILE_COLUMNS, "industry_sw", "board"]])
