"""The market scan: gates, eligible rows of the effective date, decision, rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from barline.operators.aggregates import coverage_floor, market_coverage
from barline.operators.decisions import decision_simple
from barline.operators.selection import random_first_n, topn_market
from barline.plans.samples import eligible_for_prediction

# Least shares of the active universe with a bar and with a sample.
COVERED, SAMPLED = 0.90, 0.05


def effective_date(bars: DataFrame, securities: DataFrame, target: str | None = None) -> DataFrame:
    """The newest well-covered date up to ``target`` (or the last bar date), as one row."""
    return market_coverage(bars, securities, target or bars.agg(F.max("trade_date")).scalar())


def scan_pool(scored: DataFrame, date: Column) -> DataFrame:
    """Eligible rows of the date that trade."""
    rows = eligible_for_prediction(scored.where(F.col("trade_date") == date))
    return rows.where(~F.coalesce("is_suspended", F.lit(False))) if "is_suspended" in rows.columns else rows


def scan_gates(scored: DataFrame, bars: DataFrame, securities: DataFrame, target: str | None = None) -> DataFrame:
    """One row: the effective date, how many active symbols have a bar and a sample, and what is asked of both.

    ``passed`` is false when either is too few; ``reason`` names the gate.
    """
    date = effective_date(bars, securities, target).select("trade_date").scalar()
    active = securities.where(F.col("status") == "active").select("symbol").distinct()
    day = bars.where(F.col("trade_date") == date).select("symbol").distinct()
    counted = active.agg(F.count("*").alias("universe")).select(
        date.alias("trade_date"), "universe", day.join(active, "symbol", "left_semi").agg(F.count("*")).scalar().alias("covered"),
        coverage_floor(F.col("universe"), COVERED).alias("coverage_floor"),
        scan_pool(scored, date).select("symbol").agg(F.count("*")).scalar().alias("sample_size"),
        coverage_floor(F.col("universe"), SAMPLED).alias("sample_floor"),
    )
    few_bars, few_samples = F.col("covered") < F.col("coverage_floor"), F.col("sample_size") < F.col("sample_floor")
    reason = F.when(F.col("trade_date").isNull(), "no covered date").when(few_bars, "too few bars").when(few_samples, "too few samples")
    return counted.withColumn("reason", reason).withColumn("passed", F.col("reason").isNull())


def full_scan(
    scored: DataFrame, bars: DataFrame, securities: DataFrame, n: int, horizon: int = 10, target: str | None = None, mode: str = "market",
    strict: bool = False, report: Observation | None = None,
) -> DataFrame:
    """Top ``n`` of the effective date.  ``scored`` holds predictions over the whole universe,
    since ranks and breadth must not see a filtered one.

    ``strict`` makes the run fail with the gate's reason when one does not pass.  ``report`` observes the pool
    (sample_size, symbols) in the same run, without another pass.
    """
    if mode not in ("market", "quick"):
        raise ValueError("scan mode must be market or quick")
    if strict:
        # the date comes through the gates, so they are read once and before any row is ranked
        gate = scan_gates(scored, bars, securities, target)
        date = gate.select(F.when(F.col("passed"), F.col("trade_date")).otherwise(F.raise_error(F.col("reason")).cast("date"))).scalar()
    else:
        date = effective_date(bars, securities, target).select("trade_date").scalar()
    rows = scan_pool(scored, date)
    if report is not None:
        rows = rows.observe(report, F.count("*").alias("sample_size"), F.approx_count_distinct("symbol").alias("symbols"))
    return random_first_n(rows, n, horizon) if mode == "quick" else topn_market(decision_simple(rows), n, horizon)
