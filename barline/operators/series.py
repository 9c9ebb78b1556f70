"""Per-symbol series: every function returns named columns over the symbol window.

A symbol's series holds at most one row per trading date (validation drops
repeats), so a symbol window is bounded by the calendar, whatever the table size.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.columns import (
    DATE,
    SYMBOL,
    by_symbol,
    change,
    div,
    flag,
    full_window,
    series_key,
)
from barline.functions.ewm import ewm, span_alpha

RETURN_ROWS = (1, 3, 5, 10, 20, 60)
GAP_ROWS = (5, 10, 20, 60)
RSI_ROWS = (6, 14)


def return_columns(rows: Iterable[int] = RETURN_ROWS, price: str = "adj_close") -> dict[str, Column]:
    return {f"ret_{n}": change(price, n) for n in rows}


def gap_columns(rows: Iterable[int] = GAP_ROWS, price: str = "adj_close") -> dict[str, Column]:
    return {f"ma{n}_gap": div(F.col(price), full_window(F.avg, price, n)) - 1 for n in rows}


def bollinger_column(price: str = "adj_close", n: int = 20, width: float = 2.0) -> Column:
    mean, dev = full_window(F.avg, price, n), full_window(F.stddev_samp, price, n)
    return div(F.col(price) - (mean - width * dev), 2 * width * dev)


def volatility_columns(ret: str = "ret_1", rows: Iterable[int] = (5, 20)) -> dict[str, Column]:
    return {f"volatility_{n}": full_window(F.stddev_samp, ret, n) for n in rows}


def true_range() -> Column:
    prev = F.lag("close").over(by_symbol())
    return F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)
    )


def atr(df: DataFrame, n: int = 14) -> DataFrame:
    out = df.withColumn("__tr", true_range())
    return out.withColumn(f"atr_{n}", full_window(F.avg, "__tr", n)).drop("__tr")


def volume_ratio_columns() -> dict[str, Column]:
    five = div(F.col("volume"), full_window(F.avg, "volume", 5))
    return {
        "vol_ratio_5": five,
        "vol_ratio_20": div(F.col("volume"), full_window(F.avg, "volume", 20)),
        "shrink_volume_flag": flag(five < 0.7),
        "surge_volume_flag": flag(five > 1.8),
    }


def _with_moves(df: DataFrame, price: str) -> DataFrame:
    move = F.col(price) - F.lag(price).over(by_symbol())
    return df.withColumn("__move", move).withColumns({
        "__up": F.when(F.col("__move") > 0, F.col("__move")).when(F.col("__move").isNotNull(), 0.0),
        "__down": F.when(F.col("__move") < 0, -F.col("__move")).when(F.col("__move").isNotNull(), 0.0),
    })


def _rsi(n: int) -> Column:
    strength = div(F.col(f"__up_{n}"), F.col(f"__down_{n}"))
    return F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + strength)


def oscillators(
    df: DataFrame, rsi_rows: Sequence[int] = RSI_ROWS, macd: bool = True, price: str = "adj_close"
) -> DataFrame:
    """RSI and MACD; all first-level means share one pass."""
    specs = {f"__{side}_{n}": (f"__{side}", 1.0 / n) for n in rsi_rows for side in ("up", "down")}
    if macd:
        specs |= {"__fast": (price, span_alpha(12)), "__slow": (price, span_alpha(26))}
    work = ewm(_with_moves(df, price), specs, gaps={"__up": "__move", "__down": "__move"})
    work = work.withColumns({f"rsi_{n}": _rsi(n) for n in rsi_rows})
    if macd:
        work = work.withColumn("macd_dif", F.col("__fast") - F.col("__slow"))
        work = ewm(work, {"macd_dea": ("macd_dif", span_alpha(9))})
        work = work.withColumn("macd_hist", (F.col("macd_dif") - F.col("macd_dea")) * 2)
    return work.drop("__move", "__up", "__down", *specs)


def rolling_mean_columns(names: Iterable[str], n: int = 120) -> dict[str, Column]:
    return {f"{out}_mean_{n}": full_window(F.avg, src, n) for out, src in _mean_sources(names)}


def _mean_sources(names: Iterable[str]):
    for name in names:
        yield name.replace("_rate", ""), name


def beta_column(stock: str, bench: str, n: int = 120) -> Column:
    """Sample covariance over sample variance; needs ``n`` complete pairs."""
    pair = F.when(F.col(stock).isNotNull() & F.col(bench).isNotNull(), F.lit(1))
    w = by_symbol().rowsBetween(-(n - 1), 0)
    cov = F.when(F.count(pair).over(w) == n, F.covar_samp(stock, bench).over(w))
    return div(cov, full_window(F.var_samp, bench, n))


def rolling_moments(
    df: DataFrame, n: int, means: Mapping[str, str], deviations: Mapping[str, str], betas: Mapping[str, tuple[str, str]]
) -> DataFrame:
    """Means, sample deviations and betas (of a stock against a bench column) over the last ``n`` rows, NULL until all are known.

    A sliding frame adds up ``n`` rows for every row.  Here a series is cut into blocks of ``n`` rows: the last ``n`` rows
    are the end of one block and the beginning of the next, which running frames give.  Parts are merged, never
    subtracted, so a value outside the ``n`` rows leaves no trace.
    """
    key = series_key()
    pairs = list(dict.fromkeys(betas.values()))
    spread = list(dict.fromkeys([*deviations.values(), *[c for p in pairs for c in p]]))
    sources = list(dict.fromkeys([*means.values(), *spread]))

    def parts(w) -> dict[str, Column]:
        out = {}
        for c in sources:
            x = F.col(c).cast("double")
            out[f"n_{c}"] = F.count(c).over(w)
            if c in means.values():
                out[f"s_{c}"] = F.sum(x).over(w)
            if c in spread:
                out |= {f"a_{c}": F.avg(x).over(w), f"m_{c}": F.var_pop(x).over(w) * F.count(c).over(w), f"lo_{c}": F.min(x).over(w), f"hi_{c}": F.max(x).over(w)}
        for a, b in pairs:
            out[f"c_{a}_{b}"] = F.covar_pop(a, b).over(w) * F.count(a).over(w)
        return out

    work = df.withColumn("__rn", F.row_number().over(by_symbol()) - 1).withColumn("__blk", F.floor(F.col("__rn") / n))
    block = Window.partitionBy(*key, "__blk")
    ends = parts(block.orderBy(F.col("__rn").desc()).rowsBetween(Window.unboundedPreceding, 0))
    work = work.withColumn("__end", F.struct(*[v.alias(k) for k, v in ends.items()]))
    begins = parts(block.orderBy("__rn").rowsBetween(Window.unboundedPreceding, 0))
    # blocks never fall along the series, so this is the series order in the sort of the blocks
    older = F.lag("__end", n - 1).over(Window.partitionBy(*key).orderBy("__blk", "__rn"))
    work = work.withColumns({**{f"__{k}": v for k, v in begins.items()}, "__old": F.when(F.col("__rn") % n < n - 1, older)})

    def now(name: str) -> Column:
        return F.col(f"__{name}")

    def old(name: str) -> Column:
        return F.col(f"__old.{name}")

    def held(c: str) -> Column:
        return F.coalesce(old(f"n_{c}"), F.lit(0))

    def known(c: str) -> Column:
        return now(f"n_{c}") + held(c) == n

    def merged(part: str, a: str, b: str) -> Column:
        """Sum of products about the mean; what one part lacks adds nothing."""
        gap = (now(f"a_{a}") - old(f"a_{a}")) * (now(f"a_{b}") - old(f"a_{b}")) * now(f"n_{a}") * held(a) / n
        return now(part) + F.coalesce(old(part) + gap, F.lit(0.0))

    def level(c: str) -> Column:
        low, high = F.least(now(f"lo_{c}"), old(f"lo_{c}")), F.greatest(now(f"hi_{c}"), old(f"hi_{c}"))
        return (low == high) & (F.abs(low) < F.lit(float("inf")))

    def squares(c: str) -> Column:
        return F.when(level(c), 0.0).otherwise(merged(f"m_{c}", c, c))

    out = {}
    for name, c in means.items():
        out[name] = F.when(known(c), (now(f"s_{c}") + F.coalesce(old(f"s_{c}"), F.lit(0.0))) / n)
    for name, c in deviations.items():
        out[name] = F.when(known(c), F.sqrt(squares(c) / (n - 1)))
    for name, (a, b) in betas.items():
        joint = F.when(level(a), 0.0).otherwise(merged(f"c_{a}_{b}", a, b))
        out[name] = F.when(known(a) & known(b), div(joint, squares(b)))
    return work.withColumns(out).drop("__rn", "__blk", "__end", "__old", *[f"__{k}" for k in begins])


def candle_columns() -> dict[str, Column]:
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    prev = F.lag("close").over(by_symbol())
    return {
        "intraday_range": div(h - low, c),
        "candle_body": div(c - o, o),
        "upper_shadow": div(h - F.greatest(o, c), o),
        "lower_shadow": div(F.least(o, c) - low, o),
        "gap_open_to_prev_close": div(o - prev, prev),
        "close_to_prev_close": div(c - prev, prev),
        "high_to_prev_close": div(h - prev, prev),
        "low_to_prev_close": div(low - prev, prev),
        "amount_log1p": F.when(F.col("amount").isNotNull(), F.log1p(F.greatest(F.col("amount"), F.lit(0.0)))),
        "volume_log1p": F.when(F.col("volume").isNotNull(), F.log1p(F.greatest(F.col("volume"), F.lit(0.0)))),
        "turnover_rate_delta": F.col("turnover_rate") - F.lag("turnover_rate").over(by_symbol()),
        "ret_spread_5_20": F.col("ret_5") - F.col("ret_20"),
        "volatility_ratio_5_20": div(F.col("volatility_5"), F.col("volatility_20")),
    }


def regime_columns() -> dict[str, Column]:
    """Date-level contrasts; an unknown input counts as 0."""
    def z(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0.0))

    spread = z("up_limit_count") - z("down_limit_count")
    return {
        "limit_count_spread": spread,
        "limit_count_ratio": spread / (z("up_limit_count") + z("down_limit_count") + 1.0),
        "sector_hotness_spread": z("sector_hotness_top1") - z("sector_hotness_top3_mean"),
        "market_regime_score": z("risk_on_flag") - z("risk_off_flag"),
    }


def fill_columns(
    names: Iterable[str], backfill: bool = True, key: Sequence[str] = (SYMBOL,), order: str = DATE
) -> dict[str, Column]:
    """Forward, then backward fill.  ``backfill`` looks ahead and can be turned off."""
    w = Window.partitionBy(*key).orderBy(order)
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = {}
    for name in names:
        filled = F.last(name, ignorenulls=True).over(past)
        # only rows before the first known value are open here, and its value is the next one for all of them
        out[name] = F.coalesce(filled, F.first(name, ignorenulls=True).over(whole)) if backfill else filled
    return out


def tail_per_symbol(df: DataFrame, n: int, until: Column | None = None) -> DataFrame:
    """The last ``n`` rows of each symbol; Spark cuts to ``n`` before the shuffle."""
    rows = df if until is None else df.where(F.col(DATE) <= until)
    w = Window.partitionBy(SYMBOL).orderBy(F.col(DATE).desc())
    return rows.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def sequence_window(
    df: DataFrame, columns: Sequence[str], length: int, drop_incomplete: bool = True, out: str = "x_seq"
) -> DataFrame:
    """Last ``length`` rows as a matrix, oldest first, unknown values as 0.

    A series shorter than ``length`` is dropped, or filled with zero rows in front.
    """
    step = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])
    rows = F.collect_list(step).over(by_symbol().rowsBetween(-(length - 1), 0))
    got = df.withColumn(out, rows)
    if drop_incomplete:
        return got.where(F.size(out) == length)
    zero = F.array_repeat(F.lit(0.0), len(columns))
    return got.withColumn(out, F.concat(F.array_repeat(zero, F.lit(length) - F.size(out)), F.col(out)))
