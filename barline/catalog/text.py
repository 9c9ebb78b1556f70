"""News and event queries.  The keyword rules of these queries fit the words of the sample texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.catalog.registry import query
from barline.operators import events
from barline.operators.aggregates import daily_vector_pool

POSITIVE = {"earnings_up": ["ention", "thatre"], "buyback": ["reaux", "zzzz"]}
NEGATIVE = {"reduction": ["ungen", "schen"], "lawsuit": ["@", "http"]}
NEUTRAL = {"routine": ["the ", "les "]}


def rules(title, content):
    return events.rule_event(title, content, POSITIVE, NEGATIVE, NEUTRAL)


def sql_rules(text: str) -> str:
    def hit(words):
        return " OR ".join(f"contains({text}, '{w}')" for w in words)

    cases = [(hit(w), k, d) for g, d in ((POSITIVE, "positive"), (NEGATIVE, "negative"), (NEUTRAL, "neutral")) for k, w in g.items()]
    kind = " ".join(f"WHEN {h} THEN '{k}'" for h, k, _ in cases)
    way = " ".join(f"WHEN {h} THEN '{d}'" for h, _, d in cases)
    return f"CASE {kind} ELSE 'general_info' END AS event_type, CASE {way} ELSE 'none' END AS way"


def rule_columns(source: str) -> str:
    return (
        f"SELECT * EXCLUDE (way), CASE WHEN way = 'none' THEN 'neutral' ELSE way END AS event_direction, "
        "CASE way WHEN 'none' THEN 0.1 WHEN 'neutral' THEN 0.2 ELSE 1.0 END AS event_strength, "
        f"CASE way WHEN 'none' THEN 0.2 WHEN 'neutral' THEN 0.6 ELSE 1.0 END AS event_confidence FROM {source}"
    )


RULED = (
    f"r AS (SELECT doc_id, source, length(text) AS n, {sql_rules(chr(40) + 'source || chr(32) || text' + chr(41))} FROM documents), "
    f"ruled AS ({rule_columns('r')})"
)


@query("doc_id event_type event_direction event_strength~ event_confidence~", f"{RULED} SELECT * FROM ruled")
def rule_event_extract(t):
    df = t.raw("documents").withColumn("e", rules(F.col("source"), F.col("text")))
    return df.select("doc_id", "e.*")


def length_scores(t):
    """Scores that depend on the text length only, standing in for a model."""
    n = F.length("text")
    kinds = F.create_map(F.lit("buyback"), (n % 10) / 10.0, F.lit("lawsuit"), (n % 7) / 7.0, F.lit("general_info"), F.lit(0.2))
    ways = F.create_map(F.lit("positive"), (n % 5) / 5.0, F.lit("negative"), (n % 3) / 3.0, F.lit("neutral"), F.lit(0.1))
    return t.raw("documents").withColumns({"kinds": kinds, "ways": ways})


SCORED = """
    s AS (SELECT doc_id, source, text, (length(text) % 10) / 10.0 AS k1, (length(text) % 7) / 7.0 AS k2, (length(text) % 5) / 5.0 AS w1,
        (length(text) % 3) / 3.0 AS w2 FROM documents),
    b AS (SELECT *, greatest(k1, k2, 0.2) AS ks, greatest(w1, w2, 0.1) AS ws FROM s),
    scored AS (SELECT doc_id, CASE WHEN ks < 0.35 THEN 'general_info' WHEN k1 = ks THEN 'buyback' WHEN k2 = ks THEN 'lawsuit' ELSE 'general_info' END AS event_type,
        CASE WHEN ws < 0.4 THEN 'neutral' WHEN w1 = ws THEN 'positive' WHEN w2 = ws THEN 'negative' ELSE 'neutral' END AS event_direction,
        greatest(0.05, least(1, 0.5 * ks + 0.5 * ws)) AS event_strength, least(ks, ws) AS event_confidence FROM b)"""


@query("doc_id event_type event_direction event_strength~ event_confidence~", f"{SCORED} SELECT * FROM scored")
def classifier_event_extract(t):
    df = length_scores(t).withColumn("e", events.scored_event(F.col("kinds"), F.col("ways"), "length_model"))
    return df.select("doc_id", "e.*")


@query("doc_id event_type event_direction event_strength~ event_confidence~ event_backend", f"""
    {SCORED}, {RULED} SELECT p.doc_id, CASE WHEN keep THEN p.event_type ELSE r.event_type END AS event_type,
        CASE WHEN keep THEN p.event_direction ELSE r.event_direction END AS event_direction,
        CASE WHEN keep THEN p.event_strength ELSE greatest(p.event_strength, r.event_strength) END AS event_strength,
        CASE WHEN keep THEN p.event_confidence ELSE greatest(p.event_confidence, r.event_confidence) END AS event_confidence,
        CASE WHEN keep THEN 'zero_shot' ELSE 'hybrid' END AS event_backend
    FROM (SELECT *, event_confidence >= 0.35 AND event_type <> 'general_info' AS keep FROM scored) p JOIN ruled r USING (doc_id)""")
def hybrid_event_merge(t):
    df = length_scores(t).withColumns({
        "p": events.scored_event(F.col("kinds"), F.col("ways"), "length_model"), "f": rules(F.col("source"), F.col("text"))})
    return df.withColumn("e", events.hybrid_event(F.col("p"), F.col("f"))).select("doc_id", "e.*")


def doubled_news(t):
    """News with copies: same id twice, and same content under another id."""
    ev = t.raw("events")
    base = ev.select(
        F.col("event_id").cast("string").alias("news_id"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("publish_time"),
        F.concat(F.lit("daily_"), "event_type").alias("source"), F.concat_ws(" ", "event_type", (F.col("user_id") % 50).cast("string")).alias("title"),
        F.col("props").alias("content"), F.array(F.col("user_id").cast("string")).alias("mentioned_symbols"), F.col("event_id").alias("seq"),
    )
    again = base.where(F.col("seq") % 4 == 0).withColumns({
        "seq": F.col("seq") + 10_000_000, "title": F.concat(F.lit("again "), "title")})
    return base.unionByName(again)


DOUBLED = """
    base AS (SELECT CAST(event_id AS VARCHAR) AS news_id, date_trunc('day', ts) AS publish_time, 'daily_' || event_type AS source,
        event_type || ' ' || CAST(user_id % 50 AS VARCHAR) AS title, props AS content, event_id AS seq FROM events),
    allnews AS (SELECT * FROM base UNION ALL SELECT news_id, publish_time, source, 'again ' || title, content, seq + 10000000 FROM base WHERE seq % 4 = 0),
    h1 AS (SELECT * FROM allnews QUALIFY row_number() OVER (PARTITION BY title, source, publish_time ORDER BY seq) = 1),
    dedup AS (SELECT * FROM h1 QUALIFY row_number() OVER (PARTITION BY news_id ORDER BY seq) = 1)"""


@query("news_id seq title publish_time", f"{DOUBLED} SELECT * FROM dedup")
def dedupe_news(t):
    return events.dedupe_news(doubled_news(t), "news_id", "seq")


@query("news_id seq trade_date event_type event_direction event_strength~", f"""
    {DOUBLED}, d AS (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM news_calendar c WHERE c.trade_date = CAST(publish_time AS DATE)) THEN CAST(publish_time AS DATE)
        ELSE coalesce((SELECT min(c.trade_date) FROM news_calendar c WHERE c.trade_date > CAST(publish_time AS DATE)), (SELECT max(trade_date) FROM news_calendar)) END
        AS trade_date FROM dedup),
    e AS (SELECT d.*, {sql_rules("(title || ' ' || content)")} FROM d), f AS ({rule_columns('e')}) SELECT * FROM f""", "news_calendar")
def normalize_event_records(t):
    return events.normalize_events(doubled_news(t), "news_id", "seq", t.news_calendar, rules)


def dated_news(t):
    return t.news.withColumn("trade_date", F.to_date("publish_time"))


HEAD = (
    "head AS (SELECT *, CAST(publish_time AS DATE) AS trade_date, CAST(row_number() OVER (PARTITION BY CAST(publish_time AS DATE) "
    "ORDER BY source, publish_time, news_id) AS INTEGER) AS item FROM news WHERE source LIKE 'daily\\_%' ESCAPE '\\' QUALIFY item <= 10)"
)


@query("trade_date news_id item", f"{HEAD} SELECT * FROM head", "news")
def daily_head_n(t):
    return events.daily_head(dated_news(t))


@query("news_id body", """
    SELECT news_id, 'source=' || source || chr(10) || 'title=' || title || chr(10) || 'summary=' || chr(10) || 'content=' || content AS body FROM news""", "news")
def news_text_assemble(t):
    return t.news.withColumn("body", events.news_text())


@query("doc_id places total~", """
    SELECT doc_id, 256 AS places, CAST(len(list_filter(regexp_split_to_array(lower(text), '[\\s=,.:;]+'), lambda w: w <> '')) AS DOUBLE) AS total FROM documents""")
def text_embed(t):
    df = events.with_hashed_terms(t.raw("documents"), "text", "v")
    return df.select("doc_id", F.size("v").alias("places"), F.aggregate("v", F.lit(0.0), lambda s, x: s + x).alias("total"))


@query("trade_date length~ places", f"""
    SELECT trade_date, CASE WHEN EXISTS (SELECT 1 FROM news h WHERE h.source LIKE 'daily\\_%' ESCAPE '\\' AND CAST(h.publish_time AS DATE) = c.trade_date)
    THEN 1.0 ELSE 0.0 END AS length, 256 AS places FROM news_calendar c""", "news news_calendar")
def daily_event_vectors(t):
    out = events.daily_event_vectors(dated_news(t), t.news_calendar)
    norm = F.sqrt(F.aggregate("event_embedding", F.lit(0.0), lambda s, x: s + x * x))
    return out.select("trade_date", norm.alias("length"), F.size("event_embedding").alias("places"))


@query("label pooled~", """
    m AS (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(range(0, len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x
        FROM embeddings) GROUP BY 1, 2)
    SELECT label, sum(m) / sqrt(sum(m * m)) AS pooled FROM m GROUP BY 1""")
def pooled_vector_sum(t):
    vec = F.transform("embedding", lambda x: x.cast("double"))
    out = daily_vector_pool(t.raw("embeddings").select("label", vec.alias("v")), "v", "label")
    return out.select("label", F.aggregate("vector", F.lit(0.0), lambda s, x: s + x).alias("pooled"))
