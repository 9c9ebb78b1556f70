"""Split, leakage, fold and weight queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.catalog.aggregates import SPLIT, windows
from barline.catalog.registry import query
from barline.functions.columns import by_symbol
from barline.operators import labels, splits
from barline.sources import writers


@query("symbol trade_date split", f"SELECT * FROM (SELECT symbol, trade_date, {SPLIT} AS split FROM bars) WHERE split IS NOT NULL", "bars")
def purged_time_split(t):
    return splits.assign_split(t.bars, windows())


LEAKY = (
    "CASE WHEN trade_date <= DATE '1997-12-31' THEN 'train' WHEN trade_date BETWEEN DATE '1998-01-20' AND DATE '1999-03-31' THEN 'valid' "
    "WHEN trade_date >= DATE '1999-09-01' THEN 'test' END"
)


@query("rule pair detail", f"""
    s AS (SELECT symbol, trade_date, {LEAKY} AS split FROM bars),
    e AS (SELECT split, min(trade_date) AS f, max(trade_date) AS l FROM s WHERE split IS NOT NULL GROUP BY 1),
    g AS (SELECT a.split || '->' || b.split AS pair, CAST(b.f - a.l AS INTEGER) AS days FROM e a JOIN e b
        ON (a.split, b.split) IN (('train', 'valid'), ('valid', 'test'))),
    y AS (SELECT symbol, split, min(trade_date) AS f, max(trade_date) AS l FROM s WHERE split IS NOT NULL GROUP BY 1, 2),
    r AS (SELECT a.symbol, a.split || '->' || b.split AS pair FROM y a JOIN y b ON a.symbol = b.symbol
        AND (a.split, b.split) IN (('train', 'valid'), ('valid', 'test')) WHERE a.l + 40 >= b.f - 19)
    SELECT 'short_gap' AS rule, pair, CAST(days AS VARCHAR) AS detail FROM g WHERE days < 60 UNION ALL SELECT 'symbol_boundary', pair, symbol FROM r""", "bars")
def leakage_check(t):
    date = F.col("trade_date")

    def day(text):
        return F.lit(text).cast("date")

    name = F.when(date <= day("1997-12-31"), "train").when(date.between(day("1998-01-20"), day("1999-03-31")), "valid").when(
        date >= day("1999-09-01"), "test")
    return splits.leakage_violations(t.bars.withColumn("split", name).where(F.col("split").isNotNull()), 20, 40)


@query("rule pair detail", "SELECT 'none' AS rule, 'none' AS pair, 'none' AS detail FROM bars WHERE false", "bars")
def leakage_check_clean(t):
    config = windows()
    return splits.leakage_violations(splits.assign_split(t.bars, config), config.seq_length, config.max_horizon, config.gap_days, config)


@query("trade_date date_index fold role", """
    d AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS i, count(*) OVER () AS n FROM calendar),
    k AS (SELECT *, greatest(1, floor(n * 0.5)) AS n0, greatest(1, ceil((n - greatest(1, floor(n * 0.5))) / 3.0)) AS w FROM d),
    f AS (SELECT k.*, fold, n0 + (fold - 1) * w AS lft, least(n, n0 + fold * w) AS rgt FROM k, (SELECT unnest([1, 2, 3]) AS fold))
    SELECT trade_date, CAST(i AS INTEGER) AS date_index, CAST(fold AS INTEGER) AS fold, CASE WHEN i < lft THEN 'train' ELSE 'test' END AS role
    FROM f WHERE i < rgt AND lft < rgt""", "calendar")
def walk_forward_folds(t):
    return splits.walk_forward_folds(t.bars, 3)


def won(t):
    df = t.bars.withColumn("ret", labels.forward_return(5)).where(F.col("ret").isNotNull())
    return df.withColumn("win", labels.win(F.col("ret")))


def stored_wins(t):
    """The rows that weights are given to; dates, shares, mean and rows are read on their own."""
    return writers.saved(won(t).select("symbol", "trade_date", "ret", "win"), "won")


WEIGHTS = """
    r AS (SELECT symbol, trade_date, lead(close, 5) OVER w / nullif(lead(open) OVER w, 0) - 1 AS ret FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)),
    a AS (SELECT symbol, trade_date, CASE WHEN ret > 0 THEN 1 ELSE 0 END AS win, dense_rank() OVER (ORDER BY trade_date) - 1 AS i FROM r WHERE ret IS NOT NULL),
    c AS (SELECT win, count(*) AS n FROM a GROUP BY 1), m AS (SELECT max(i) AS mx FROM a),
    x AS (SELECT symbol, trade_date, sqrt((SELECT count(*) FROM a) / CAST(n AS DOUBLE)) * pow(0.35 + 0.65 * i / mx, 1.5) AS raw FROM a JOIN c USING (win), m)
    SELECT symbol, trade_date, greatest(raw / avg(raw) OVER (), 0.001) AS weight FROM x"""


@query("symbol trade_date weight~", WEIGHTS, "bars")
def sample_weights(t):
    return splits.sample_weights(stored_wins(t), "win")


BOOTSTRAP = f"""
    wt AS (WITH {WEIGHTS}),
    term AS (SELECT symbol, trade_date, weight, unnest(range(0, 60)) AS i FROM wt),
    upto AS (SELECT symbol, trade_date, sum(exp(i * ln(weight) - weight - lgamma(i + 1))) OVER (PARTITION BY symbol, trade_date ORDER BY i) AS c FROM term),
    drawn AS (SELECT symbol, trade_date, count(*) FILTER (c < (CAST('0x' || substr(md5('7|' || symbol || '|' || CAST(trade_date AS VARCHAR)), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0) AS k
        FROM upto GROUP BY 1, 2)
    SELECT symbol, trade_date, CAST(unnest(range(1, k + 1)) AS INTEGER) AS copy FROM drawn"""


@query("symbol trade_date copy", BOOTSTRAP, "bars")
def weighted_bootstrap(t):
    return splits.weighted_bootstrap(splits.sample_weights(stored_wins(t), "win"), "weight")


@query("symbol trade_date split", f"""
    s AS (SELECT symbol, trade_date, {SPLIT} AS split, lead(close, 20) OVER (PARTITION BY symbol ORDER BY trade_date) AS y FROM bars),
    n AS (SELECT *, row_number() OVER (PARTITION BY symbol, split ORDER BY trade_date) AS rn FROM s WHERE split IS NOT NULL)
    SELECT symbol, trade_date, split FROM n WHERE rn >= 20 AND y IS NOT NULL""", "bars")
def sequence_eligibility(t):
    df = t.bars.withColumn("y", F.lead("close", 20).over(by_symbol()))
    return splits.sequence_eligible(splits.assign_split(df, windows()), 20, ["y"])


@query("symbol trade_date", f"SELECT symbol, trade_date FROM (SELECT symbol, trade_date, {SPLIT} AS split FROM bars) WHERE split IN ('valid', 'test')", "bars")
def union_splits(t):
    rows = splits.assign_split(t.bars, windows())
    return splits.union_splits(rows.where(F.col("split") == "valid"), rows.where(F.col("split") == "test"))


@query("trade_date", "SELECT DISTINCT trade_date FROM bars WHERE trade_date BETWEEN DATE '1996-06-01' AND DATE '1996-12-31'", "bars")
def intersect_dates(t):
    left = t.bars.where(F.col("trade_date") <= F.lit("1996-12-31").cast("date"))
    return splits.intersect_dates(left, t.bars.where(F.col("trade_date") >= F.lit("1996-06-01").cast("date")))


@query("trade_date", "SELECT DISTINCT trade_date FROM bars WHERE month(trade_date) = 5", "bars")
def except_dates(t):
    return splits.except_dates(t.bars, t.calendar.where(F.month("trade_date") != 5))


def vector_rows(t):
    return t.bars.select("symbol", "trade_date", F.array("open", "close").alias("event_embedding"))


SIDE = "side AS (SELECT trade_date, [open, close] AS event_embedding FROM bars QUALIFY row_number() OVER (PARTITION BY trade_date ORDER BY symbol DESC) = 1)"


@query("trade_date event_embedding[]", f"{SIDE} SELECT * FROM side", "bars")
def event_sidecar(t):
    return splits.event_sidecar(vector_rows(t))


@query("symbol trade_date event_embedding[]", f"{SIDE} SELECT symbol, trade_date, event_embedding FROM bars JOIN side USING (trade_date)", "bars")
def event_sidecar_join_checked(t):
    return splits.join_sidecar(t.bars.select("symbol", "trade_date"), splits.event_sidecar(vector_rows(t)))


@query("trade_date problem", """
    SELECT DISTINCT trade_date, 'missing' AS problem FROM bars WHERE month(trade_date) = 5
    UNION ALL SELECT DISTINCT trade_date, 'repeated' FROM bars WHERE month(trade_date) = 6""", "bars")
def event_sidecar_problems(t):
    side = splits.event_sidecar(vector_rows(t)).where(F.month("trade_date") != 5)
    return splits.sidecar_problems(t.bars, side.unionByName(side.where(F.month("trade_date") == 6)))


@query("split symbol trade_date close", f"SELECT * FROM (SELECT {SPLIT} AS split, symbol, trade_date, close FROM bars) WHERE split IS NOT NULL", "bars")
def export_splits(t):
    folder = writers.work_folder(t.spark, "splits")
    splits.export_splits(t.bars.withColumn("event_embedding", F.array("open", "close")), folder, windows())
    return t.spark.read.parquet(f"{folder}/samples")
