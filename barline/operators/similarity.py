"""Company similarity: exact top neighbours by blocks, without listing pairs.

Score of a pair: 0.4 industry (same 1, same board 0.25) + 0.2 exp(-|size gap|)
+ 0.2 cosine of fundamentals + 0.2 cosine of behaviour.  Industry, board and size
alone bound the score from above.  Companies are packed in blocks of one industry
and board and a narrow size range.  Each block first ranks its own members, which
gives a floor for their k-th score; another block is looked at only if its bound
reaches that floor.  A block pair yields the k best per company, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions import vectors
from barline.operators.quantiles import attach
from barline.sources.writers import staged

# Compared columns and score weights.
FUNDAMENTALS = ["roe", "revenue_yoy", "profit_yoy", "gross_margin", "debt_ratio"]
BEHAVIOUR = ["volatility_120", "beta_120", "turnover_mean_120", "amount_mean_120", "ret_20", "ret_60"]
W_INDUSTRY, W_SIZE, W_FUND, W_BEHAVE = 0.40, 0.20, 0.20, 0.20
SAME_BOARD = 0.25
SMALLEST_BLOCK = 512
#: Blocks or block pairs that a task ranks; their rows are few and small, but each is hundreds of thousands of scores.
PER_TASK = 16
_EPS = 1e-9

_RESULT = "symbol string, neighbor_symbol string, sim_score double, asof_date date"


def latest_profiles(profiles: DataFrame) -> DataFrame:
    """Newest row per symbol, chosen in the map-side aggregation."""
    cols = [c for c in profiles.columns if c not in ("symbol", "asof_date")]
    best = F.max_by(F.struct(*cols), "asof_date").alias("r")
    return profiles.groupBy("symbol").agg(F.max("asof_date").alias("asof_date"), best).select("symbol", "asof_date", "r.*")


def comparison_vectors(latest: DataFrame) -> DataFrame:
    """symbol, industry, board, cap, unit vectors ``f`` and ``b``."""
    columns = [*FUNDAMENTALS, *BEHAVIOUR, "market_cap_log"]
    medians = latest.agg(*[F.coalesce(F.median(c), F.lit(0.0)).alias(f"{c}__med") for c in columns])
    filled = attach(latest, medians).withColumns({c: F.coalesce(F.col(c), F.col(f"{c}__med")) for c in columns})
    filled = filled.select("symbol", "asof_date", "industry_name", "board", *columns)
    moments = filled.agg(
        *[F.avg(c).alias(f"{c}__m") for c in columns], *[F.stddev_pop(c).alias(f"{c}__s") for c in columns]
    )
    work = attach(filled, moments)

    def z(c: str) -> Column:
        spread = F.col(f"{c}__s")
        return (F.col(c) - F.col(f"{c}__m")) / F.when(spread > 0, spread).otherwise(F.lit(1.0))

    return work.select(
        "symbol", "asof_date",
        F.coalesce(F.col("industry_name"), F.lit("")).alias("industry"),
        F.coalesce(F.col("board"), F.lit("")).alias("board"),
        F.col("market_cap_log").alias("cap"),
        vectors.unit(F.array(*[z(c) for c in FUNDAMENTALS])).alias("f"),
        vectors.unit(F.array(*[z(c) for c in BEHAVIOUR])).alias("b"),
    )


def blocks(vecs: DataFrame, smallest: int = SMALLEST_BLOCK) -> DataFrame:
    """Companies packed by industry and board, split by size and then by hash when still too many.

    The block size grows with the square root of the universe, and so does the
    number of blocks.
    """
    size = vecs.agg(F.greatest(F.lit(smallest), F.ceil(F.sqrt(F.count("*"))).cast("int"))).scalar()
    group = ["industry", "board"]
    many = vecs.groupBy(*group).agg((F.count("*") > size).alias("many"))
    cut = vecs.join(many, group).withColumn(
        "bin", F.when(F.col("many"), F.floor(F.col("cap") * 2).cast("long")).otherwise(F.lit(0).cast("long"))
    ).drop("many")
    parts = cut.groupBy(*group, "bin").agg(F.ceil(F.count("*") / size).cast("long").alias("parts"))
    cut = cut.join(parts, [*group, "bin"]).withColumn("part", F.pmod(F.xxhash64("symbol"), F.col("parts")))
    member = F.struct("symbol", "asof_date", "cap", "f", "b")
    packed = cut.groupBy(*group, "bin", "part").agg(
        F.collect_list(member).alias("m"), F.min("cap").alias("lo"), F.max("cap").alias("hi")
    )
    name = F.concat_ws("\u0001", "industry", "board", "bin", "part")
    return packed.select(
        name.alias("block"), "industry", "board", "lo", "hi", F.col("m.symbol").alias("symbols"),
        F.col("m.asof_date").alias("dates"), F.col("m.cap").alias("caps"),
        F.flatten("m.f").alias("fs"), F.flatten("m.b").alias("bs"),
    )


def _best(score: np.ndarray, names: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Per row the columns of the k best positive scores, ties by name."""
    for i, row in enumerate(score):
        keep = np.flatnonzero(row > 0)
        if len(keep) > k:
            floor = np.partition(row[keep], len(keep) - k)[len(keep) - k]
            keep = keep[row[keep] >= floor - _EPS]
        order = np.lexsort((names[keep], -np.round(row[keep], 12)))[:k]
        yield i, keep[order]


def _score(industry: float, q: dict, c: dict) -> np.ndarray:
    gap = np.abs(np.subtract.outer(q["cap"], c["cap"]))
    return W_INDUSTRY * industry + W_SIZE * np.exp(-gap) + W_FUND * (q["f"] @ c["f"].T) + W_BEHAVE * (q["b"] @ c["b"].T)


def _side(row, prefix: str) -> dict:
    names = np.asarray(row[f"{prefix}symbols"], dtype=object)
    n = len(names)
    return {
        "names": names.astype(str), "dates": np.asarray(row[f"{prefix}dates"], dtype=object),
        "cap": np.asarray(row[f"{prefix}caps"], dtype=float),
        "f": np.asarray(row[f"{prefix}fs"], dtype=float).reshape(n, -1),
        "b": np.asarray(row[f"{prefix}bs"], dtype=float).reshape(n, -1),
    }


def _ranker(k: int, own: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                q = _side(row, "q_")
                c = q if own else _side(row, "c_")
                score = _score(row["near"], q, c)
                if own:
                    np.fill_diagonal(score, -1.0)
                else:
                    score[score < row["floor"] - _EPS] = -1.0
                out = []
                for i, cols in _best(score, c["names"], k):
                    out += [
                        (q["names"][i], c["names"][j], float(score[i, j]), max(q["dates"][i], c["dates"][j])) for j in cols
                    ]
                yield pd.DataFrame(out, columns=["symbol", "neighbor_symbol", "sim_score", "asof_date"])

    return run


def spread(rows: DataFrame, *keys: str, per_task: int = PER_TASK) -> DataFrame:
    """``rows`` over as many tasks as their number asks for; by their size alone they would end up in one."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // per_task))
    return rows.repartition(tasks, *keys)


def _closeness(industry: tuple[Column, Column], board: tuple[Column, Column]) -> Column:
    same = (industry[0] == industry[1]) & (industry[0] != "")
    near = (board[0] == board[1]) & (board[0] != "")
    return F.when(same, F.lit(1.0)).when(near, F.lit(SAME_BOARD)).otherwise(F.lit(0.0))


def company_similarity(profiles: DataFrame, k: int = 10, version: str = "cs1", smallest: int = SMALLEST_BLOCK) -> DataFrame:
    """Per symbol its ``k`` best neighbours with positive score, ranked from 1."""
    # one row per company, read many times below
    latest = staged(latest_profiles(profiles))
    packed = staged(blocks(comparison_vectors(latest), smallest))
    packed = staged(spread(packed, "block"))
    side = ["symbols", "dates", "caps", "fs", "bs"]

    def renamed(prefix: str, *more: str) -> DataFrame:
        return packed.select(*[F.col(c).alias(prefix + c) for c in (*more, *side)])

    ind, brd = F.col("industry"), F.col("board")
    inner = packed.select("block", _closeness((ind, ind), (brd, brd)).alias("near"), *[F.col(c).alias("q_" + c) for c in side])
    own = staged(inner.mapInPandas(_ranker(k, own=True), _RESULT))

    # the weakest k-th score inside a block; 0 where some member has fewer than k neighbours
    kth = own.groupBy("symbol").agg(F.min("sim_score").alias("s"), F.count("*").alias("n"))
    floor = packed.select("block", F.explode("symbols").alias("symbol")).join(kth, "symbol", "left").groupBy("block").agg(
        F.min(F.when(F.col("n") >= k, F.col("s")).otherwise(F.lit(0.0))).alias("floor")
    )
    shape = packed.select("block", "industry", "board", "lo", "hi")
    # as many rows as blocks, which is about the square root of the universe
    listing = shape.agg(F.collect_list(F.struct("block", "industry", "board", "lo", "hi"))).scalar()

    def bound(c: Column) -> Column:
        gap = F.greatest(c["lo"] - F.col("hi"), F.col("lo") - c["hi"], F.lit(0.0))
        near = _closeness((ind, c["industry"]), (brd, c["board"]))
        return W_INDUSTRY * near + W_SIZE * F.exp(-gap) + F.lit(W_FUND + W_BEHAVE)

    wanted = F.filter(F.col("__all"), lambda c: (c["block"] != F.col("block")) & (bound(c) >= F.col("floor") - _EPS))
    pairs = shape.join(floor, "block").withColumn("__all", listing).select(
        F.col("block").alias("q_block"), "floor", "industry", "board", F.explode(wanted).alias("c")
    ).select(
        "q_block", F.col("c.block").alias("c_block"), "floor",
        _closeness((ind, F.col("c.industry")), (brd, F.col("c.board"))).alias("near"),
    )
    # the pairs are dealt out, and the blocks (about 200 bytes a company) go to them
    dealt = spread(staged(pairs), "q_block", "c_block")
    joined = dealt.join(F.broadcast(renamed("q_", "block")), "q_block").join(F.broadcast(renamed("c_", "block")), "c_block")
    across = joined.mapInPandas(_ranker(k, own=False), _RESULT)

    w = Window.partitionBy("symbol").orderBy(F.round("sim_score", 12).desc(), "neighbor_symbol")
    ranked = own.unionByName(across).withColumn("sim_rank", F.row_number().over(w)).where(F.col("sim_rank") <= k)
    return ranked.select(
        "symbol", "neighbor_symbol", "sim_score", "sim_rank", F.lit(version).alias("similarity_version"), "asof_date"
    )


def neighbor_lists(similarity: DataFrame, ids: DataFrame, k: int = 10) -> DataFrame:
    """Per symbol the neighbour ids and scores in rank order; an unknown neighbour has id 0."""
    keys = ids.select(F.col("symbol").alias("neighbor_symbol"), F.col("symbol_id").alias("__id"))
    rows = similarity.where(F.col("sim_rank") <= k).join(keys, "neighbor_symbol", "left")
    item = F.struct("sim_rank", F.coalesce("__id", F.lit(0)).alias("i"), F.coalesce("sim_score", F.lit(0.0)).alias("s"))
    out = rows.groupBy("symbol").agg(F.sort_array(F.collect_list(item)).alias("n"))
    return out.select("symbol", F.col("n.i").alias("neighbor_symbol_ids"), F.col("n.s").alias("neighbor_scores"))


def pad_neighbors(df: DataFrame, k: int = 10) -> DataFrame:
    """Both lists to exactly ``k`` items, filled with 0."""
    ids = F.slice(F.concat(F.coalesce("neighbor_symbol_ids", F.array().cast("array<int>")), F.array_repeat(F.lit(0), k)), 1, k)
    return df.withColumns({
        "neighbor_symbol_ids": ids, "neighbor_scores": vectors.pad_or_cut(F.col("neighbor_scores"), k),
    })
