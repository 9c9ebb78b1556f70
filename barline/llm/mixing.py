"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted per cell of source, language and topic.  Every cell's weight is the product of
one factor per margin; the factors are raked in turn until the weighted tokens of each margin stand
in the target shares.  Only factor tables (one row per source, language or topic) change between
steps, so every step is a join of the cell table with small tables and one grouped sum, whatever the
number of documents.  Documents are drawn by a hash of their id with the cell's probability; where
that would pass 1, ``repeat_weight`` carries the rest, so weighted tokens stay calibrated.

DataFrame and SQL functions only.

Cases: NULL and empty texts have 0 tokens; a NULL source, language or topic is the empty value, a
margin of its own; margins without a target row, or with a target of 0, get weight 0; targets of
absent values are left out and the rest scaled up; a margin without tokens keeps factor 0; repeated
rows share one fate, as it hangs on the id; other columns stay, and an added column whose name is taken gets a name
of its own (``names``); a ``topic`` column of the input is the topic; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm.stage import written

MARGINS = ("source", "lang", "topic")
WORD = r"[^\x20\x09-\x0D]+"

#: Default targets: shares proportional to tokens ** ALPHA.
ALPHA = {"source": 0.7, "lang": 0.7, "topic": 0.8}
ROUNDS = 6
#: Share of all tokens that the drawn documents are expected to hold, and steps to find the scale.
RATE = 0.5
SCALE_STEPS = 8
SEED = "mix-1"

#: documents has no topic column; the queries use registers of length in its place: upper bounds in words.
REGISTERS = (("brief", 60), ("note", 300), ("article", 1500))


def n_tokens() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def register(tokens: Column) -> Column:
    """Stand-in topic from the number of words."""
    out = F.when(tokens < REGISTERS[0][1], REGISTERS[0][0])
    for name, bound in REGISTERS[1:]:
        out = out.when(tokens < bound, name)
    return out.otherwise("long")


def keyed(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """All columns of ``docs`` plus the margins and n_tokens under names of their own."""
    out = docs.withColumn("__tokens", n_tokens())
    named = {"source": F.col("source"), "lang": F.col("lang"), "topic": register(F.col("__tokens")) if topic is None else topic}
    return out.withColumns({f"__{m}": F.coalesce(c.cast("string"), F.lit("")) for m, c in named.items()})


def cells(keyed_docs: DataFrame) -> DataFrame:
    return keyed_docs.groupBy(*[F.col(f"__{m}").alias(m) for m in MARGINS]).agg(F.sum("__tokens").alias("tokens"))


def tempered(cell_table: DataFrame, margin: str, alpha: float) -> DataFrame:
    """Target rows (value, target) proportional to tokens ** alpha."""
    return cell_table.groupBy(margin).agg(F.sum("tokens").alias("t")).select(F.col(margin).alias("value"), F.pow(F.col("t").cast("double"), F.lit(alpha)).alias("target"))


def raked(cell_table: DataFrame, targets: Mapping[str, DataFrame], rounds: int = ROUNDS) -> dict[str, DataFrame]:
    """Factor table (margin, factor) of every margin."""
    total = cell_table.agg(F.sum("tokens").cast("double")).first()[0] or 0.0
    wanted = {}
    for m in MARGINS:
        present = cell_table.select(F.col(m).alias("value")).distinct().join(targets[m], "value", "left").na.fill(0.0, ["target"])
        whole = present.agg(F.sum("target")).first()[0] or 1.0
        wanted[m] = written(present.select(F.col("value").alias(m), (F.col("target") / whole * total).alias("target")), f"target-{m}")
    factors = {m: wanted[m].select(m, F.lit(1.0).alias(f"__f_{m}")) for m in MARGINS}
    for _ in range(rounds):
        for m in MARGINS:
            weighed, product = cell_table, F.col("tokens").cast("double")
            for other in MARGINS:
                if other != m:
                    weighed, product = weighed.join(factors[other], other), product * F.col(f"__f_{other}")
            sums = weighed.groupBy(m).agg(F.sum(product).alias("now"))
            step = sums.join(wanted[m], m).select(m, F.when(F.col("now") > 0, F.col("target") / F.col("now")).otherwise(0.0).alias(f"__f_{m}"))
            factors[m] = written(step, f"factor-{m}")
    return factors


def weight() -> Column:
    out = F.col(f"__f_{MARGINS[0]}")
    for m in MARGINS[1:]:
        out = out * F.col(f"__f_{m}")
    return out


def scale(cell_table: DataFrame, factors: Mapping[str, DataFrame], rate: float = RATE) -> float:
    """The s at which documents drawn with probability min(1, s * weight) are expected to hold ``rate`` of all tokens."""
    weighed = cell_table
    for m in MARGINS:
        weighed = weighed.join(factors[m], m)
    weighed = written(weighed.select("tokens", weight().alias("w")), "weighed")
    s = rate
    for _ in range(SCALE_STEPS):
        capped = F.col("w") * F.lit(s) >= 1
        row = weighed.agg(
            F.sum("tokens").alias("all"), F.sum(F.when(capped, F.col("tokens")).otherwise(0)).alias("full"),
            F.sum(F.when(capped, 0.0).otherwise(F.col("tokens") * F.col("w"))).alias("open"),
        ).first()
        if not row["open"] or row["open"] <= 0:
            break
        s = max(0.0, rate * row["all"] - row["full"]) / row["open"] or s
    return s


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the id alone."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


ADDED = ("topic", "n_tokens", "mix_weight", "probability", "repeat_weight", "kept")


def names(docs: DataFrame) -> dict[str, str]:
    """The column that holds each added value; the input's ``topic``, where it has one, holds the topic."""
    taken, out = {c.lower() for c in docs.columns}, {}
    for name in ADDED:
        new = name
        while new.lower() in taken and name != "topic":
            new = f"mixing_{new}"
        taken.add(new.lower())
        out[name] = new
    return out


def mixed(docs: DataFrame, targets: Mapping[str, DataFrame] | None = None, topic: Column | None = None, rate: float = RATE, narrow: bool = False) -> DataFrame:
    """All columns of ``docs`` plus topic, n_tokens, mix_weight, probability, repeat_weight and kept, as ``names`` calls them.

    Without ``topic`` the input's column of that name is the topic, or else a register of length.  With ``narrow`` the text is left out and the counted rows are stored, so that it is read once.
    """
    has_topic = "topic" in {c.lower() for c in docs.columns}
    if topic is None and has_topic:
        topic = F.col("topic")
    rows = keyed(docs, topic)
    if narrow:
        rows = written(rows.drop("text"), "mixing-rows")
    table = written(cells(rows), "mixing-cells")
    factors = raked(table, targets or {m: tempered(table, m, ALPHA[m]) for m in MARGINS})
    s = scale(table, factors, rate)
    out = rows
    for m in MARGINS:
        out = out.join(factors[m].withColumnRenamed(m, f"__{m}"), f"__{m}", "left")
    out = out.withColumn("__w", F.coalesce(weight(), F.lit(0.0)))
    out = out.withColumn("__p", F.least(F.lit(1.0), F.lit(s) * F.col("__w")))
    named = names(docs)
    added = {
        "topic": F.col("topic") if has_topic else F.col("__topic"), "n_tokens": F.col("__tokens"), "mix_weight": F.col("__w"), "probability": F.col("__p"),
        "repeat_weight": F.when(F.col("__p") > 0, F.lit(s) * F.col("__w") / F.col("__p")).otherwise(0.0), "kept": uniform(F.col("doc_id")) < F.col("__p"),
    }
    own = [c for c in docs.columns if c.lower() != "topic" and not (narrow and c == "text")]
    return out.select(*[F.col(f"`{c}`") for c in own], *[c.alias(named[n]) for n, c in added.items()])


def sql() -> str:
    """The same over ``documents`` in SQL, with the rounds written out."""
    words = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
    whens = " ".join(f"WHEN n_tokens < {bound} THEN '{name}'" for name, bound in REGISTERS)
    parts = [
        f"base AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, {words} AS n_tokens FROM documents)",
        f"r AS MATERIALIZED (SELECT *, CASE {whens} ELSE 'long' END AS topic FROM base)",
        "cells AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens) AS tokens FROM r GROUP BY ALL)",
        "total AS MATERIALIZED (SELECT CAST(sum(tokens) AS DOUBLE) AS t FROM cells)",
    ]
    now = {}
    for m in MARGINS:
        parts += [
            f"want_{m} AS MATERIALIZED (SELECT {m}, pow(CAST(sum(tokens) AS DOUBLE), {ALPHA[m]}) AS p FROM cells GROUP BY {m})",
            f"to_{m} AS MATERIALIZED (SELECT {m}, p / (SELECT sum(p) FROM want_{m}) * (SELECT t FROM total) AS target FROM want_{m})",
            f"{m}_0 AS MATERIALIZED (SELECT {m}, CAST(1 AS DOUBLE) AS f FROM want_{m})",
        ]
        now[m] = f"{m}_0"
    for i in range(1, ROUNDS + 1):
        for m in MARGINS:
            a, b = (o for o in MARGINS if o != m)
            parts.append(
                f"{m}_{i} AS MATERIALIZED (SELECT {m}, CASE WHEN n > 0 THEN target / n ELSE 0 END AS f FROM (SELECT c.{m}, sum(CAST(c.tokens AS DOUBLE) * x.f * y.f) AS n FROM cells c "
                f"JOIN {now[a]} x ON x.{a} = c.{a} JOIN {now[b]} y ON y.{b} = c.{b} GROUP BY c.{m}) JOIN to_{m} USING ({m}))"
            )
            now[m] = f"{m}_{i}"
    joins = " ".join(f"JOIN {now[m]} f_{m} ON f_{m}.{m} = c.{m}" for m in MARGINS)
    product = " * ".join(f"f_{m}.f" for m in MARGINS)
    parts += [f"w AS MATERIALIZED (SELECT c.*, {product} AS w FROM cells c {joins})", f"s_0 AS MATERIALIZED (SELECT CAST({RATE} AS DOUBLE) AS s)"]
    for i in range(1, SCALE_STEPS + 1):
        s = f"(SELECT s FROM s_{i - 1})"
        parts.append(
            f"s_{i} AS MATERIALIZED (SELECT CASE WHEN o > 0 AND greatest(0, {RATE} * a - c) > 0 THEN greatest(0, {RATE} * a - c) / o ELSE {s} END AS s FROM (SELECT sum(tokens) AS a, "
            f"sum(CASE WHEN w * {s} >= 1 THEN tokens ELSE 0 END) AS c, sum(CASE WHEN w * {s} >= 1 THEN 0 ELSE tokens * w END) AS o FROM w))"
        )
    s = f"(SELECT s FROM s_{SCALE_STEPS})"
    u = f"CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':{SEED}'), 1, 8) AS BIGINT) / 4294967296.0"
    return (
        f"WITH {', '.join(parts)} SELECT doc_id, r.source, r.lang, r.topic, CAST(n_tokens AS BIGINT) AS n_tokens, round(w, 6) AS mix_weight, round(least(1.0, {s} * w), 6) AS probability, "
        f"CASE WHEN w > 0 THEN round({s} * w / least(1.0, {s} * w), 6) ELSE 0 END AS repeat_weight, {u} < least(1.0, {s} * w) AS kept "
        "FROM r JOIN w ON r.source = w.source AND r.lang = w.lang AND r.topic = w.topic"
    )
