"""Expression helpers shared by all operators.

Missing values are NULL only.  Every division goes through ``try_divide`` so a
zero denominator gives NULL under ANSI mode.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SYMBOL = "symbol"
DATE = "trade_date"


_series: ContextVar[tuple[str, ...]] = ContextVar("series", default=(SYMBOL,))


def series_key() -> tuple[str, ...]:
    """The columns that name a series: the symbol, unless :func:`series_of` adds some."""
    return _series.get()


@contextmanager
def series_of(*more: str) -> Iterator[None]:
    """Series columns built inside belong to a symbol and ``more``; a frame hashed by symbol still serves them."""
    before = _series.set((SYMBOL, *more))
    try:
        yield
    finally:
        _series.reset(before)


def by_symbol(order: str = DATE) -> WindowSpec:
    """The one window every per-symbol series uses, so that they share a shuffle."""
    return Window.partitionBy(*series_key()).orderBy(order)


def packed(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """``columns`` as one struct: windows copy it whole instead of column by column."""
    away = set(columns)
    return df.select(*[c for c in df.columns if c not in away], F.struct(*columns).alias(name)) if columns else df


def unpacked(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[f"{c}.*" if c in names else c for c in df.columns])


def last_rows(n: int, spec: WindowSpec | None = None) -> WindowSpec:
    return (spec or by_symbol()).rowsBetween(-(n - 1), 0)


def div(num: Column, den: Column) -> Column:
    return F.try_divide(num, den)


def change(col: Column | str, n: int = 1, spec: WindowSpec | None = None) -> Column:
    """Relative change against the value ``n`` rows before."""
    c = F.col(col) if isinstance(col, str) else col
    return div(c, F.lag(c, n).over(spec or by_symbol())) - F.lit(1.0)


def full_window(agg, col: Column | str, n: int, spec: WindowSpec | None = None) -> Column:
    """``agg`` over the last ``n`` rows, NULL until ``n`` non-null values are in the frame."""
    c = F.col(col) if isinstance(col, str) else col
    w = last_rows(n, spec)
    return F.when(F.count(c).over(w) == n, agg(c).over(w))


def flag(cond: Column) -> Column:
    """Boolean to 1.0/0.0; an unknown comparison counts as false."""
    return F.when(F.coalesce(cond, F.lit(False)), F.lit(1.0)).otherwise(F.lit(0.0))


def clip(col: Column, low: float | Column, high: float | Column) -> Column:
    """Clamp, keeping NULL as NULL (``greatest``/``least`` alone would skip it)."""
    lo = low if isinstance(low, Column) else F.lit(low)
    hi = high if isinstance(high, Column) else F.lit(high)
    return F.when(col.isNotNull(), F.greatest(lo, F.least(hi, col)))


def pct_rank_avg(col: Column | str, *keys: str | Column) -> Column:
    """Average rank over the non-null count, NULL in gives NULL out.

    Ties share the mean of their ranks.  Rows whose key is NULL get NULL, as a
    grouped rank leaves them out.  Use :func:`barline.operators.ranking.pct_rank_large`
    where one group can outgrow a task.
    """
    c = F.col(col) if isinstance(col, str) else col
    part = [F.col(k) if isinstance(k, str) else k for k in keys]
    group = Window.partitionBy(*part)
    known = F.lit(True)
    for k in part:
        known = known & k.isNotNull()
    ordered = group.orderBy(c.asc_nulls_last())
    # the default frame of an ordered count reaches the last peer, so it is the rank of the
    # last of equals; both ranks and the total come from one sort
    mean_rank = (F.rank().over(ordered) + F.count(c).over(ordered)) / F.lit(2.0)
    return F.when(known & c.isNotNull(), div(mean_rank, F.count(c).over(group)))


def by_date(df: DataFrame) -> DataFrame:
    """Mark a frame with one row per trading date as the side to broadcast.

    Its size is bounded by the calendar (about 250 rows a year), not by the data, and
    the other side keeps its partitioning by symbol.
    """
    return F.broadcast(df)


def nan_to_null(col: Column) -> Column:
    """NaN and both infinities to NULL."""
    return F.when(~F.isnan(col) & (F.abs(col) != F.lit(float("inf"))), col)


def sigmoid(col: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col))


def softplus(col: Column) -> Column:
    """log(1+e^x) with the usual shortcuts outside +-30."""
    return F.when(col > 30.0, col).when(col < -30.0, F.exp(col)).otherwise(F.log1p(F.exp(col)))


def all_of(*conds: Column) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def coalesce_num(name: str, default: float = 0.0, columns: list[str] | None = None) -> Column:
    """Number or ``default``; a column absent from ``columns`` is all default."""
    if columns is not None and name not in columns:
        return F.lit(float(default))
    return F.coalesce(nan_to_null(F.col(name).cast("double")), F.lit(float(default)))
