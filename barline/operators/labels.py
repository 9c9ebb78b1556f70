"""Forward returns, drawdowns and loss flags; entry is the open of the next row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.columns import by_date, by_symbol, div
from barline.sources.schemas import BENCHMARK_INDEX, BIGLOSS_HORIZONS, HORIZONS


def entry_open() -> Column:
    return F.lead("open").over(by_symbol())


def forward_return(k: int) -> Column:
    return div(F.lead("close", k).over(by_symbol()), entry_open()) - 1


def win(ret: Column) -> Column:
    return F.coalesce(ret > 0, F.lit(False)).cast("int")


_STRIDE = 8


def forward_drawdowns(df: DataFrame, periods: Sequence[int] = HORIZONS) -> DataFrame:
    """``label_maxdd_k``: deepest fall below the running peak on open[+1], close[+1..+k].

    The next closes come from one window node.  The peak at each step is the larger
    of the peak at the last stride and the few closes since, so all steps are short
    generated expressions: no array per row, no deep nesting.  NULL where the series
    ends earlier or the entry is unknown; an unknown close ends the path.
    """
    far = max(periods)
    w = by_symbol()
    out = df.withColumns({
        "__peak": entry_open(), "__left": F.count("*").over(w.rowsBetween(1, far)), "__row": F.row_number().over(w),
        **{f"__c{i}": F.lead("close", i).over(w) for i in range(1, far + 1)},
    })
    gap = F.min(F.when(F.col("close").isNull(), F.col("__row"))).over(w.rowsBetween(1, far))
    out = out.withColumns({"__open": F.coalesce(gap - F.col("__row"), F.lit(far + 1)), "__known": F.col("__peak").isNotNull()})
    for first in range(1, far + 1, _STRIDE):
        block = range(first, min(first + _STRIDE, far + 1))
        depth = {
            f"__d{i}": F.when(
                F.col("__open") > i,
                F.try_divide(F.col(f"__c{i}"), F.greatest("__peak", *[f"__c{j}" for j in range(first, i + 1)])) - 1,
            )
            for i in block
        }
        # the depths read the peak before this stride; withColumns evaluates both against the old row
        out = out.withColumns({**depth, "__peak": F.greatest("__peak", *[f"__c{j}" for j in block])})
    # depth of the shorter horizon goes into the longer one
    done, deepest = 0, F.lit(0.0)
    for k in sorted(periods):
        out = out.withColumn(f"__dd{k}", F.least(deepest, *[F.col(f"__d{i}") for i in range(done + 1, k + 1)]))
        done, deepest = k, F.col(f"__dd{k}")
    labels = [
        F.when(F.col("__known") & (F.col("__left") >= k), F.col(f"__dd{k}")).alias(f"label_maxdd_{k}") for k in periods
    ]
    return out.select(*df.columns, *labels)


def bigloss(maxdd: str, threshold: float = -0.05) -> Column:
    return F.coalesce(F.col(maxdd) <= threshold, F.lit(False)).cast("int")


def benchmark_returns(index_bars: DataFrame, periods: Sequence[int], code: str = BENCHMARK_INDEX) -> DataFrame:
    # one index: as many rows as trading dates
    w = Window.partitionBy("index_code").orderBy("trade_date")
    entry = F.lead("open").over(w)
    return index_bars.where(F.col("index_code") == code).select(
        "trade_date",
        *[(div(F.lead("close", k).over(w), entry) - 1).alias(f"bench_ret_{k}") for k in periods],
    )


def complete(periods: Sequence[int] = HORIZONS) -> Column:
    """Whether a row has labels: an entry, and as many rows ahead as the longest horizon asks for."""
    ahead = F.lead(F.lit(1), max(periods)).over(by_symbol()).isNotNull()
    return entry_open().isNotNull() & ahead & F.col("symbol").isNotNull() & F.col("trade_date").isNotNull()


def alpha(k: int) -> Column:
    """Return above the benchmark's; needs the columns of :func:`benchmark_returns`."""
    return forward_return(k) - F.col(f"bench_ret_{k}")


def _outcomes(periods: Sequence[int], threshold: float) -> dict[str, Column]:
    """The label columns from forward returns, drawdowns and benchmark returns."""
    out = {}
    for k in periods:
        ret = F.col(f"label_ret_{k}")
        out |= {
            f"label_ret_{k}": ret, f"label_win_{k}": win(ret), f"label_alpha_{k}": ret - F.col(f"bench_ret_{k}"),
            f"label_maxdd_{k}": F.col(f"label_maxdd_{k}"),
        }
    return out | {f"label_bigloss_{k}": bigloss(f"label_maxdd_{k}", threshold) for k in BIGLOSS_HORIZONS if k in periods}


def with_labels(rows: DataFrame, index_bars: DataFrame, periods: Sequence[int] = HORIZONS, threshold: float = -0.05) -> DataFrame:
    """The columns of :func:`label_table` next to the rows of whole series; they hold where the row is :func:`complete`."""
    work = forward_drawdowns(rows.withColumns({f"label_ret_{k}": forward_return(k) for k in periods}), periods)
    work = work.join(by_date(benchmark_returns(index_bars, periods)), "trade_date", "left")
    return work.select(*rows.columns, *[c.alias(name) for name, c in _outcomes(periods, threshold).items()])


def label_table(
    bars: DataFrame,
    index_bars: DataFrame,
    periods: Sequence[int] = HORIZONS,
    threshold: float = -0.05,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Return, win, alpha and drawdown per horizon for rows whose every horizon is complete."""
    work = bars.select("symbol", "trade_date", "open", "close")
    work = forward_drawdowns(work.withColumns({f"label_ret_{k}": forward_return(k) for k in periods}), periods)
    # the windows look ahead, so the date range comes after them
    if start:
        work = work.where(F.col("trade_date") >= F.lit(start).cast("date"))
    if end:
        work = work.where(F.col("trade_date") <= F.lit(end).cast("date"))
    complete = F.lit(True)
    for k in periods:
        complete = complete & F.col(f"label_maxdd_{k}").isNotNull()
    work = work.where(complete)
    bench = benchmark_returns(index_bars, periods)
    work = work.join(by_date(bench), "trade_date", "left")
    return work.select("symbol", "trade_date", *[c.alias(name) for name, c in _outcomes(periods, threshold).items()])
