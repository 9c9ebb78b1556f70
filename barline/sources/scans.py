"""Table scans whose filters reach the Parquet reader."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.sources.schemas import SCHEMAS

# The columns that mark packaged inference rows.
PACKAGED = ("x_seq", "x_tab", "x_event", "x_mkt", "x_company_profile")


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Declared schema, no inference; the month partition column prunes by date."""
    schema = SCHEMAS[table]
    return spark.read.schema(schema).parquet(path)


def read_range(spark: SparkSession, path: str, table: str, start: str, end: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A stored monthly table by date range: the months prune folders, the dates reach the Parquet reader."""
    rows = spark.read.schema(T.StructType([*SCHEMAS[table].fields, T.StructField("trade_month", T.StringType())])).parquet(path)
    out = scan_table(rows.where(F.col("trade_month").between(start[:7], end[:7])), start, end).drop("trade_month")
    return out if columns is None else out.select(*columns)


def scan_table(df: DataFrame, start: str | None = None, end: str | None = None, symbols: Iterable[str] | None = None) -> DataFrame:
    """Date range on trade_date, else on asof_date, and an optional symbol list.

    Rows come unordered: sort at the sink where an order is wanted.
    """
    date = next((c for c in ("trade_date", "asof_date") if c in df.columns), None)
    out = df
    if date and start:
        out = out.where(F.col(date) >= F.lit(start).cast("date"))
    if date and end:
        out = out.where(F.col(date) <= F.lit(end).cast("date"))
    wanted = list(symbols or [])
    if wanted and "symbol" in df.columns:
        out = out.where(F.col("symbol").isin(wanted))
    return out


def active_securities(df: DataFrame, active_only: bool = True) -> DataFrame:
    out = df.where(F.col("status") == "active") if active_only else df
    return out.where(F.col("symbol").isNotNull()).select("symbol").distinct()


def weekdays(days: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Weekdays from ``start`` to ``end``; an open end is the first or last date of ``days``."""
    ends = days.agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("b"))
    first, last = (F.lit(x).cast("date") if x else F.col(c) for x, c in ((start, "a"), (end, "b")))
    spread = ends.select(F.explode(F.sequence(first, last)).alias("trade_date"))
    return spread.where(F.weekday("trade_date") < 5)


def trading_calendar(df: DataFrame, first: str | None = "2023-01-01", last: str | None = "2025-12-31") -> DataFrame:
    """Open dates; when there are none, the weekdays of the default range or, with None, of the table's own dates."""
    opened = df.where(F.coalesce("is_open", F.lit(False))).select("trade_date").distinct()
    any_open = opened.agg((F.count("*") > 0).alias("any")).scalar()
    return opened.unionByName(weekdays(df, first, last).where(~any_open))


def projected(df: DataFrame, groups: Sequence[Sequence[str]]) -> DataFrame:
    """Only the known columns that exist; the reader skips all others."""
    have = set(df.columns)
    return df.select(*dict.fromkeys(c for g in groups for c in g if c in have))


def inference_rows(df: DataFrame, all_dates: bool = False) -> tuple[str, DataFrame]:
    """('packaged', rows) when the tensor columns are there, else ('raw', rows of the latest date)."""
    if set(PACKAGED) <= set(df.columns):
        return "packaged", df
    if all_dates:
        return "raw", df
    latest = df.agg(F.max("trade_date").alias("d")).scalar()
    return "raw", df.where(F.col("trade_date") == latest)
