"""Vendor layouts to the declared tables.

Each layout is a rename plus unit fixes; the common tail casts and derives.  Text
that is no number becomes NULL.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions import symbols
from barline.functions.columns import by_symbol, change, div

# Vendor column labels.
LABELLED = {
    "日期": "trade_date", "开盘": "open", "收盘": "close", "最高": "high", "最低": "low",
    "成交量": "volume", "成交额": "amount", "换手率": "turnover_rate",
}
FUND_FLOW = {
    "日期_日期": "trade_date", "资金净流入_资金净流入": "main_net_inflow", "大单(主力)_净额": "large_net_inflow",
    "大单(主力)_净占比": "main_inflow_ratio", "中单_净额": "medium_net_inflow", "小单_净额": "small_net_inflow",
}
REPORT = {
    "ROEJQ": "roe", "TOTALOPERATEREVETZ": "revenue_yoy", "PARENTNETPROFITTZ": "profit_yoy",
    "XSMLL": "gross_margin", "ZCFZL": "debt_ratio",
}
NOTICE = {"公告时间": "publish_time", "公告标题": "title", "公告链接": "url", "公告类型": "category"}
SECTOR = {"日期": "trade_date", "收盘价": "close", "成交额": "amount"}
KLINE_PARTS = 11


def renamed(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def number(name: str, columns: Sequence[str]) -> Column:
    return F.col(name).try_cast("double") if name in columns else F.lit(None).cast("double")


def in_range(column: str, start: str | None, end: str | None) -> Column:
    hit = F.lit(True)
    if start:
        hit = hit & (F.col(column) >= F.lit(start).cast("date"))
    if end:
        hit = hit & (F.col(column) <= F.lit(end).cast("date"))
    return hit


def finalise_bars(df: DataFrame, source: str) -> DataFrame:
    """Cast, derive previous close and moves per symbol, drop rows without a full price."""
    have = df.columns
    names = ("open", "high", "low", "close", "volume", "amount", "turnover_rate")
    work = df.select("symbol", F.to_date("trade_date").alias("trade_date"), *[number(c, have).alias(c) for c in names])
    work = work.withColumn("pre_close", F.lag("close").over(by_symbol()))
    work = work.withColumns({
        "pct_chg": (div(F.col("close"), F.col("pre_close")) - 1) * 100,
        "amplitude": div(F.col("high") - F.col("low"), F.col("pre_close")) * 100,
        "adj_factor": F.lit(1.0),
        "adj_close": F.col("close"),
        "is_suspended": F.lit(False),
        "source": F.lit(source),
    })
    return work.dropna(subset=["trade_date", "open", "high", "low", "close"])


@dataclass(frozen=True)
class Layout:
    """Vendor columns by declared name, and factors that bring a column to the declared unit."""

    names: Mapping[str, str]
    factors: Mapping[str, float] = field(default_factory=dict)

    def read(self, df: DataFrame) -> DataFrame:
        taken = {old: new for old, new in self.names.items() if old in df.columns and new not in df.columns}
        scaled = {new: number(new, [new]) * self.factors[new] for new in taken.values() if new in self.factors}
        return df.withColumnsRenamed(taken).withColumns(scaled)


LAYOUTS = {
    "labelled": Layout(LABELLED),
    "share": Layout({"date": "trade_date", "turnover": "turnover_rate"}, {"turnover_rate": 100.0}),
}


def bars_labelled(df: DataFrame, source: str = "labelled") -> DataFrame:
    return finalise_bars(LAYOUTS["labelled"].read(df), source)


def bars_turnover_share(df: DataFrame, source: str = "share") -> DataFrame:
    return finalise_bars(LAYOUTS["share"].read(df), source)


def bars_lots(df: DataFrame, source: str = "lots") -> DataFrame:
    """Layout whose ``amount`` is volume in lots of 100; amount is estimated by the close."""
    work = renamed(df.drop("volume"), {"date": "trade_date", "amount": "volume"})
    volume = F.col("volume").try_cast("double") * 100
    work = work.withColumns({"volume": volume, "amount": volume * F.col("close").try_cast("double")})
    return finalise_bars(work.drop("turnover_rate"), source)


def parse_kline(df: DataFrame, text: str = "kline") -> DataFrame:
    """Comma-joined bar text to fields; rows with too few parts are left out, lots become shares."""
    parts = F.split(text, ",")
    at = {"trade_date": 0, "open": 1, "close": 2, "high": 3, "low": 4, "amount": 6, "amplitude": 7, "pct_chg": 8, "turnover_rate": 10}
    rows = df.where(F.size(parts) >= KLINE_PARTS)
    picked = [F.get(parts, i).alias(name) for name, i in at.items()]
    return rows.select("symbol", *picked, (F.get(parts, 5).try_cast("double") * 100).alias("volume"))


def bars_kline(df: DataFrame, source: str = "kline") -> DataFrame:
    return finalise_bars(parse_kline(df), source)


def first_source(frames: Sequence[DataFrame], key: str = "symbol") -> DataFrame:
    """Per key all rows of the first frame, in the given order, that has any.

    The winner per key is found by a partial aggregation and joined back, so no key
    is gathered in one place.
    """
    tagged = [f.withColumn("__prio", F.lit(i)) for i, f in enumerate(frames)]
    union = tagged[0]
    for f in tagged[1:]:
        union = union.unionByName(f, allowMissingColumns=True)
    best = union.groupBy(key).agg(F.min("__prio").alias("__prio"))
    return union.join(best, [key, "__prio"], "left_semi").drop("__prio")


def index_bars(df: DataFrame, layout: str, code: str, start: str | None = None, end: str | None = None) -> DataFrame:
    names = {"labelled": LABELLED, "plain": {"date": "trade_date"}, "lots": {"date": "trade_date", "amount": "volume"}}[layout]
    if layout == "lots":
        df = df.drop("volume")
    work = renamed(df, names)
    work = work.select(
        F.lit(code).alias("index_code"), F.to_date("trade_date").alias("trade_date"),
        *[number(c, work.columns).alias(c) for c in ("open", "high", "low", "close", "volume", "amount")],
        F.lit(layout).alias("source"),
    )
    if layout != "labelled":
        work = work.where(in_range("trade_date", start, end))
    return work.dropna(subset=["trade_date", "close"])


def sector_daily(df: DataFrame) -> DataFrame:
    """Needs sector_id and sector_name next to the vendor columns."""
    work = renamed(df, SECTOR)
    work = work.select(
        "sector_id", "sector_name", F.to_date("trade_date").alias("trade_date"),
        number("close", work.columns).alias("close"), number("amount", work.columns).alias("amount"),
    )
    w = Window.partitionBy("sector_id").orderBy("trade_date")
    return work.withColumns({
        "pct_chg": change("close", 1, w) * 100, "turnover": F.lit(None).cast("double"),
        "up_limit_count": F.lit(None).cast("int"), "source": F.lit("sector_index"),
    })


def financials(df: DataFrame, start: str, end: str, lookback_days: int = 450) -> DataFrame:
    """Report rows known by notice date, else update date, else report date."""
    notice = "NOTICE_DATE" if "NOTICE_DATE" in df.columns else "UPDATE_DATE"
    work = df.withColumn("report_date", F.col("REPORT_DATE").try_cast("date"))
    work = work.withColumn("asof_date", F.coalesce(F.col(notice).try_cast("date"), F.col("report_date")))
    first = F.date_sub(F.lit(start).cast("date"), lookback_days)
    work = work.where((F.col("asof_date") >= first) & (F.col("asof_date") <= F.lit(end).cast("date")))
    work = work.dropna(subset=["report_date", "asof_date"])
    metrics = [number(src, df.columns).alias(dst) for src, dst in REPORT.items()]
    empty = [F.lit(None).cast("double").alias(c) for c in ("pe_ttm", "pb", "ps_ttm", "industry_percentile")]
    order = [F.col("seq")] if "seq" in df.columns else []
    rows = work.select("symbol", "report_date", "asof_date", *empty, *metrics, *order)
    if not order:
        return rows.dropDuplicates(["symbol", "report_date", "asof_date"])
    keep = [c for c in rows.columns if c not in ("symbol", "report_date", "asof_date", "seq")]
    best = rows.groupBy("symbol", "report_date", "asof_date").agg(F.min_by(F.struct(*keep), "seq").alias("r"))
    return best.select("symbol", "report_date", "asof_date", "r.*")


def capital_flow(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """yyyyMMdd dates, numbers with thousands commas and percent signs."""
    work = renamed(df, FUND_FLOW)
    names = ("main_net_inflow", "large_net_inflow", "medium_net_inflow", "small_net_inflow", "main_inflow_ratio")

    def cleaned(c: str) -> Column:
        if c not in work.columns:
            return F.lit(None).cast("double")
        return F.regexp_replace(F.col(c).cast("string"), "[,%]", "").try_cast("double")

    rows = work.select(
        symbols.normalize_symbol(F.col("symbol")).alias("symbol"),
        F.to_date(F.try_to_timestamp(F.col("trade_date").cast("string"), F.lit("yyyyMMdd"))).alias("trade_date"),
        *[cleaned(c).alias(c) for c in names], F.lit(None).cast("double").alias("super_large_net_inflow"),
        F.lit("funds_page").alias("source"),
    )
    return rows.where(F.col("trade_date").isNotNull() & in_range("trade_date", start, end))


def announcements(df: DataFrame, start: str, end: str) -> DataFrame:
    """Notices published in [start, end + 1 day]; the id hashes code, title and time."""
    work = renamed(df, NOTICE).withColumn("publish_time", F.col("publish_time").cast("timestamp_ntz"))
    last = F.lit(end).cast("date").cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")
    work = work.where((F.col("publish_time") >= F.lit(start).cast("date").cast("timestamp_ntz")) & (F.col("publish_time") <= last))
    symbol = symbols.normalize_symbol(F.col("symbol"))
    title = F.coalesce("title", F.lit(""))
    iso = F.date_format("publish_time", "yyyy-MM-dd'T'HH:mm:ss")
    return work.select(
        F.md5(F.concat_ws("|", symbols.code(symbol), title, iso)).alias("announcement_id"), "publish_time",
        F.lit("notices").alias("source"), title.alias("title"), "category", F.lit(None).cast("string").alias("summary"),
        F.col("url").alias("content"), F.array(symbol).alias("mentioned_symbols"),
    )


def calendar(df: DataFrame, start: str, end: str) -> DataFrame:
    rows = df.select(F.col(df.columns[0]).try_cast("date").alias("trade_date"), F.lit("CN").alias("exchange"), F.lit(True).alias("is_open"))
    return rows.where(in_range("trade_date", start, end))


def securities(df: DataFrame, order: str = "seq") -> DataFrame:
    """One row per readable symbol, the first in ``order``; defaults from code and name."""
    have = df.columns

    def given(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)

    work = df.withColumn("symbol", symbols.normalize_symbol(F.col("symbol"))).where(F.col("symbol").isNotNull())
    s = F.col("symbol")
    row = F.struct(
        given("name", "string").alias("name"),
        F.coalesce(given("exchange", "string"), symbols.exchange(s)).alias("exchange"),
        F.coalesce(given("board", "string"), symbols.board(s)).alias("board"),
        given("industry", "string").alias("industry"),
        given("list_date", "date").alias("list_date"),
        F.coalesce(given("is_st", "boolean"), symbols.looks_special_treatment(given("name", "string")), F.lit(False)).alias("is_st"),
        F.coalesce(given("status", "string"), F.lit("active")).alias("status"),
    )
    return work.groupBy("symbol").agg(F.min_by(row, order).alias("r")).select("symbol", "r.*")


def enrich_securities(fresh: DataFrame, existing: DataFrame, spot: DataFrame | None = None, detail: DataFrame | None = None) -> DataFrame:
    """Fill gaps from existing rows, then from a spot list; a detail source overrides; defaults last."""
    columns = ["name", "exchange", "board", "industry", "list_date", "is_st", "status"]

    def side(df: DataFrame, names: Sequence[str], tag: str) -> DataFrame:
        picks = [F.col(c).alias(f"{tag}_{c}") for c in names if c in df.columns]
        return df.select("symbol", *picks)

    def take(work: DataFrame, other: DataFrame, names: Sequence[str], tag: str, wins: bool) -> DataFrame:
        joined = work.join(side(other, names, tag), "symbol", "left")
        both = {}
        for c in names:
            if f"{tag}_{c}" in joined.columns:
                pair = (F.col(f"{tag}_{c}"), F.col(c))
                both[c] = F.coalesce(*pair) if wins else F.coalesce(*reversed(pair))
        return joined.withColumns(both).select(*work.columns)

    work = take(fresh, existing, columns, "old", wins=False)
    if spot is not None:
        work = take(work, spot, ["name", "industry", "list_date"], "spot", wins=False)
    if detail is not None:
        work = take(work, detail, ["name", "industry", "list_date"], "det", wins=True)
    return work.withColumns({
        "industry": F.coalesce("industry", F.lit("Unknown")), "board": F.coalesce("board", F.lit("Unknown")),
        "status": F.coalesce("status", F.lit("active")), "is_st": F.coalesce("is_st", F.lit(False)),
    })
