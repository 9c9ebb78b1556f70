"""News: dedupe, event extraction and daily event vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.functions import symbols, vectors
from barline.operators.aggregates import daily_vector_pool
from barline.operators.calendar import publication_to_trade_date
from barline.sources.schemas import EVENT_DIM

# The default keyword rules and the labels a classifier may return.
POSITIVE = {
    "earnings_up": ["预增", "扭亏", "业绩大增", "净利润增长"],
    "buyback": ["回购", "股份回购"],
    "increase_holding": ["增持", "控股股东增持"],
    "major_contract": ["中标", "签订合同", "大单"],
    "new_product": ["新产品", "新技术", "研发突破"],
    "policy_support": ["政策支持", "补贴", "扶持"],
}
NEGATIVE = {
    "reduction": ["减持", "拟减持"],
    "regulation": ["监管函", "处罚", "立案"],
    "earnings_down": ["预减", "亏损", "业绩下滑"],
    "lawsuit": ["诉讼", "仲裁"],
    "pledge_risk": ["质押", "平仓风险"],
    "black_swan": ["暴雷", "爆仓", "黑天鹅"],
}
NEUTRAL = {"routine": ["提示性公告", "进展公告", "一般合作"]}
EVENT_TYPES = [*POSITIVE, *NEGATIVE, *NEUTRAL, "general_info"]
DIRECTIONS = ["positive", "negative", "neutral"]
TYPE_FLOOR, DIRECTION_FLOOR, HYBRID_FLOOR = 0.35, 0.40, 0.35
NEWS_PER_DAY = 10

EVENT = T.StructType([
    T.StructField("event_type", T.StringType()), T.StructField("event_direction", T.StringType()),
    T.StructField("event_strength", T.DoubleType()), T.StructField("event_confidence", T.DoubleType()),
    T.StructField("event_backend", T.StringType()), T.StructField("event_model", T.StringType()),
    T.StructField("event_details", T.MapType(T.StringType(), T.StringType())),
])
Rules = Mapping[str, Sequence[str]]


def _event(kind: Column | str, direction: Column | str, strength, confidence, backend: str, model: Column, details: Column) -> Column:
    def lit(x):
        return x if isinstance(x, Column) else F.lit(x)

    return F.struct(
        lit(kind).alias("event_type"), lit(direction).alias("event_direction"), lit(strength).cast("double").alias("event_strength"),
        lit(confidence).cast("double").alias("event_confidence"), F.lit(backend).alias("event_backend"), model.alias("event_model"),
        details.cast(T.MapType(T.StringType(), T.StringType())).alias("event_details"),
    )


def rule_event(title: Column, content: Column, positive: Rules = POSITIVE, negative: Rules = NEGATIVE, neutral: Rules = NEUTRAL) -> Column:
    """First event type, in rule order, one of whose keywords is in the whole text."""
    text = F.concat(title, F.lit(" "), F.coalesce(content, F.lit("")))
    groups = (
        (positive, "positive", 1.0, 1.0, "positive"), (negative, "negative", 1.0, 1.0, "negative"), (neutral, "neutral", 0.2, 0.6, "neutral"),
    )
    model = F.lit("keyword_rules")
    chain = None
    for rules, direction, strength, confidence, group in groups:
        for kind, words in rules.items():
            hit = text.contains(words[0])
            for w in words[1:]:
                hit = hit | text.contains(w)
            found = _event(kind, direction, strength, confidence, "rule", model, F.create_map(F.lit("matched_group"), F.lit(group)))
            chain = F.when(hit, found) if chain is None else chain.when(hit, found)
    rest = _event("general_info", "neutral", 0.1, 0.2, "rule", model, F.create_map(F.lit("matched_group"), F.lit("fallback")))
    return rest if chain is None else chain.otherwise(rest)


def _best(scores: Column) -> Column:
    """Entry with the highest score; of equal ones the first."""
    entries = F.map_entries(scores)
    ranked = F.transform(entries, lambda e, i: F.struct(e["value"].alias("s"), (-i).alias("i"), e["key"].alias("k")))
    return F.array_max(ranked)


def scored_event(type_scores: Column, direction_scores: Column, model: str, backend: str = "zero_shot") -> Column:
    """Event from label->score maps, with floors below which a label is not trusted."""
    kind, way = _best(type_scores), _best(direction_scores)
    ks, ws = F.coalesce(kind["s"], F.lit(0.0)), F.coalesce(way["s"], F.lit(0.0))
    strength = F.greatest(F.lit(0.05), F.least(F.lit(1.0), 0.5 * ks + 0.5 * ws))
    details = F.create_map(F.lit("type_scores"), F.to_json(type_scores), F.lit("direction_scores"), F.to_json(direction_scores))
    return _event(
        F.when(ks >= TYPE_FLOOR, kind["k"]).otherwise("general_info"),
        F.when(ws >= DIRECTION_FLOOR, way["k"]).otherwise("neutral"),
        strength, F.least(ks, ws), backend, F.lit(model), details,
    )


def hybrid_event(primary: Column, fallback: Column, floor: float = HYBRID_FLOOR) -> Column:
    """Primary when sure and specific, else the fallback with the stronger numbers of both."""
    keep = (primary["event_confidence"] >= floor) & (primary["event_type"] != "general_info")
    candidate = F.to_json(F.struct(*[primary[c].alias(c) for c in ("event_type", "event_direction", "event_confidence", "event_model")]))
    merged = _event(
        fallback["event_type"], fallback["event_direction"],
        F.greatest(fallback["event_strength"], primary["event_strength"]),
        F.greatest(fallback["event_confidence"], primary["event_confidence"]), "hybrid",
        F.coalesce(primary["event_model"], fallback["event_model"]),
        F.map_concat(F.coalesce(fallback["event_details"], F.create_map().cast("map<string,string>")), F.create_map(F.lit("primary_candidate"), candidate)),
    )
    return F.when(keep, primary).otherwise(merged)


def classifier(score: Callable[[pd.Series], pd.DataFrame]) -> Callable[[Column], Column]:
    """Wrap a batch text scorer (one column per label) as an Arrow UDF giving label->score maps.

    The scorer gets whole texts; where a model has a length limit, it cuts for itself.
    """

    @F.pandas_udf(T.MapType(T.StringType(), T.DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            table = score(texts.fillna(""))
            yield pd.Series(table.to_dict("records"), index=texts.index, dtype=object)

    return run


EXTRACTORS: dict[str, Callable[[Column, Column], Column]] = {"rule": rule_event}


def register_extractor(name: str, build: Callable[[Column, Column], Column]) -> None:
    """Add an extractor; it returns a struct of the EVENT layout."""
    EXTRACTORS[name] = build


def dedupe_news(df: DataFrame, key: str, order: str, title: str = "title") -> DataFrame:
    """One row per content hash, then one per id, the first in ``order``; mentions normalised.

    Both passes are partial aggregations, so copies of one item meet as one row per
    task.  A row lost to its hash does not hold back rows that share its id.
    """
    columns = df.columns
    stamp = F.date_format("publish_time", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    content = F.md5(F.concat_ws("|", *[F.coalesce(c, F.lit("None")) for c in (F.col(title), F.col("source"), stamp)]))
    row = F.struct(*columns)
    once = df.withColumn("__h", content).groupBy("__h").agg(F.min_by(row, order).alias("r")).select("r.*")
    once = once.groupBy(key).agg(F.min_by(row, order).alias("r")).select("r.*")
    if "mentioned_symbols" in columns:
        names = F.transform(F.coalesce("mentioned_symbols", F.array().cast("array<string>")), symbols.normalize_symbol)
        once = once.withColumn("mentioned_symbols", F.array_compact(names))
    return once.select(*columns)


def normalize_events(
    df: DataFrame, key: str, order: str, calendar: DataFrame, extract: Callable[[Column, Column], Column] = rule_event
) -> DataFrame:
    """Dedupe, put on a trade date (a given target date wins) and extract the event columns."""
    work = publication_to_trade_date(dedupe_news(df, key, order), "publish_time", calendar)
    if "target_trade_date" in df.columns:
        work = work.withColumn("trade_date", F.coalesce(F.col("target_trade_date").try_cast("date"), F.col("trade_date")))
    work = work.withColumn("__e", extract(F.coalesce("title", F.lit("")), F.col("content")))
    return work.select(*df.columns, "trade_date", "__e.*").withColumn("normalized_flag", F.lit(True))


def daily_items(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce("source", F.lit("")).startswith("daily_"))


def daily_head(df: DataFrame, n: int = NEWS_PER_DAY) -> DataFrame:
    """First ``n`` daily items per date by source, time and id; Spark cuts before the shuffle."""
    w = Window.partitionBy("trade_date").orderBy("source", "publish_time", "news_id")
    return daily_items(df).withColumn("item", F.row_number().over(w)).where(F.col("item") <= n)


def news_text() -> Column:
    """Labelled lines of one item, blank parts kept."""
    lines = [F.concat(F.lit(f"{c}="), F.trim(F.coalesce(F.col(c), F.lit("")))) for c in ("source", "title", "summary", "content")]
    return F.trim(F.concat_ws("\n", *lines))


def with_hashed_terms(df: DataFrame, text: str, out: str, size: int = EVENT_DIM) -> DataFrame:
    """Term counts hashed to ``size`` places: the encoder used when no model is plugged in."""
    words = F.filter(F.split(F.lower(F.col(text)), r"[\s=,.:;]+"), lambda w: w != "")
    hasher = HashingTF(numFeatures=size, inputCol="__w", outputCol="__tf")
    return hasher.transform(df.withColumn("__w", words)).withColumn(out, vector_to_array("__tf")).drop("__w", "__tf")


def encoder(encode: Callable[[pd.Series], "list[list[float]]"]) -> Callable[[Column], Column]:
    """Wrap a batch text encoder as an iterator UDF: the model loads once per worker."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([list(map(float, v)) for v in encode(texts.fillna(""))], index=texts.index, dtype=object)

    return run


def daily_event_vectors(
    news: DataFrame, dates: DataFrame, encode: Callable[[Column], Column] | None = None, size: int = EVENT_DIM, head: int | None = None
) -> DataFrame:
    """Each date gets the pooled vector of its daily items, or zeros; with ``head`` only of the first so many.

    ``encode`` is a plugged-in encoder of any width; its vectors are brought to ``size``.
    """
    items = (daily_items(news) if head is None else daily_head(news, head)).withColumn("__t", news_text())
    if encode is None:
        items = with_hashed_terms(items, "__t", "__v", size)
    else:
        items = items.withColumn("__v", vectors.project(encode(F.col("__t")), size))
    pooled = daily_vector_pool(items, "__v", "trade_date")
    out = dates.select("trade_date").distinct().join(pooled, "trade_date", "left")
    return out.select("trade_date", F.coalesce("vector", F.array_repeat(F.lit(0.0), size)).alias("event_embedding"))
