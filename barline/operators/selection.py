"""Top-N scans and the diversified pick."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.columns import clip, coalesce_num
from barline.operators.decisions import PRIORITY, SELECTION, best_horizon, buy_cap
from barline.sources.schemas import HORIZONS
from barline.sources.writers import staged

# Scan thresholds.
RECOMMENDED = ("STRONG_BUY", "BUY", "RECOMMEND_BUY")
FLOOR = 0.50
QUICK_P, QUICK_RET = 0.55, 0.01


def _chosen(df: DataFrame, horizon: int | None, horizons: tuple[int, ...]) -> DataFrame:
    """best_horizon, best_p_win and best_ret_mu, fixed or the best of ``horizons``."""
    have = df.columns
    if horizon is not None and horizon not in HORIZONS:
        raise ValueError(f"holding_days must be one of {', '.join(map(str, HORIZONS))}")
    best = best_horizon(have, (horizon,) if horizon else horizons)
    work = df.withColumn("__b", best)
    return work.withColumns({
        "best_horizon": F.col("__b.horizon"), "best_p_win": F.col("__b.p_win"), "best_ret_mu": F.col("__b.ret_mu"),
    }).drop("__b")


def _top(df: DataFrame, keys: list[Column], n: int, out: str = "scan_rank") -> DataFrame:
    """First ``n`` rows per date; Spark keeps ``n`` per task before the shuffle."""
    w = Window.partitionBy("trade_date").orderBy(*keys, "symbol")
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= n)


def topn_market(df: DataFrame, n: int, horizon: int | None = None) -> DataFrame:
    """Recommended rows by action priority, win probability, return, signal and rank.

    Needs ``decision_action``.
    """
    have = df.columns
    work = _chosen(df, horizon, HORIZONS)
    levels = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    work = work.withColumn("action_priority", F.coalesce(levels[F.col("decision_action")], F.lit(99)))
    work = work.where(F.col("decision_action").isin(*RECOMMENDED) & (F.col("best_p_win") >= FLOOR))
    keys = [F.col("action_priority").asc(), F.col("best_p_win").desc(), F.col("best_ret_mu").desc(),
            coalesce_num("signal_score", 0.0, have).desc(), coalesce_num("rank_score_pred", 0.0, have).desc()]
    return _top(work, keys, n)


def topn_quick(df: DataFrame, n: int, horizon: int | None = None) -> DataFrame:
    """Best of the 3, 5 and 10 row horizons (or the given one), at least even odds."""
    have = df.columns
    work = _chosen(df, horizon, (3, 5, 10))
    work = work.withColumn("best_p_win", clip(F.col("best_p_win"), 0.0, 1.0)).where(
        (F.col("best_p_win") >= FLOOR) & (F.coalesce("symbol", F.lit("")) != "")
    )
    keys = [F.col("best_p_win").desc(), F.col("best_ret_mu").desc(), coalesce_num("signal_score", 0.5, have).desc(),
            coalesce_num("rank_score_pred", 0.5, have).desc()]
    return _top(work, keys, n)


def threshold_quick(df: DataFrame, n: int, horizon: int = 10) -> DataFrame:
    """Win probability of at least 0.55 and predicted return above 0.01."""
    have = df.columns
    work = _chosen(df, horizon, (horizon,)).where((F.col("best_p_win") >= QUICK_P) & (F.col("best_ret_mu") > QUICK_RET))
    keys = [F.col("best_p_win").desc(), F.col("best_ret_mu").desc(), coalesce_num("signal_score", 0.0, have).desc(),
            coalesce_num("rank_score_pred", 0.0, have).desc()]
    return _top(work, keys, n)


def random_first_n(df: DataFrame, n: int, horizon: int = 10) -> DataFrame:
    """The first ``n`` qualifying rows per date in a date-seeded random order.

    The order is a hash of symbol and date, the same on every run.
    """
    work = _chosen(df, horizon, (horizon,)).where((F.col("best_p_win") >= QUICK_P) & (F.col("best_ret_mu") > QUICK_RET))
    order = F.md5(F.concat_ws("|", "symbol", F.date_format("trade_date", "yyyyMMdd")))
    return _top(work, [order.asc()], n)


def dominant_regime(df: DataFrame) -> DataFrame:
    counts = df.groupBy("trade_date", "market_regime").agg(F.count("*").alias("n"))
    return counts.groupBy("trade_date").agg(F.min_by("market_regime", F.struct(-F.col("n"), "market_regime")).alias("regime"))


def contenders(pool: DataFrame, n: int, penalty: float) -> DataFrame:
    """Rows that can still be among ``n`` picks of their date, exactly.

    A penalty takes ``penalty`` at most, and rows of one industry and board are blocked together.  So a row with
    ``n`` rows of its date, industry and board that lead by more than that is never picked: all of them go first.
    Every task sends at most ``n`` rows a group to find the bar.
    """
    group = ["trade_date", "industry", "board"]
    ranked = pool.select(*group, "u").withColumn("rn", F.row_number().over(Window.partitionBy(*group).orderBy(F.col("u").desc())))
    bar = ranked.where(F.col("rn") <= n).where(F.col("rn") == n).select(*group, (F.col("u") - penalty).alias("__bar"))
    return pool.join(bar, group, "left").where(F.col("__bar").isNull() | F.col("u").isNull() | (F.col("u") >= F.col("__bar"))).drop("__bar")


def diversified_selection(df: DataFrame, n: int, backfill: bool = False, stage_every: int = 5) -> DataFrame:
    """Greedy pick of ``n`` per date: best utility less 0.10 x the largest similarity to those picked.

    At most a regime-dependent share of the places goes to one industry and one
    board.  The pool is read once, for the rows that can win a place (``contenders``).  Each round is one
    aggregation of these over all dates: every task finds its own best candidate against the picks so far (a
    short list per date), and only these meet.  No date is gathered in one task, and no possible pick is left out.

    Needs symbol, symbol_id, industry_sw, board, market_regime, eligible,
    selection_utility and the neighbour lists.
    """
    none = F.array().cast("array<int>")
    rows = df.select(
        "trade_date", "symbol", F.col("symbol_id").cast("int").alias("id"), F.coalesce("industry_sw", F.lit("Unknown")).alias("industry"),
        F.coalesce("board", F.lit("Unknown")).alias("board"), F.col("selection_utility").alias("u"), "eligible", "market_regime",
        F.coalesce("neighbor_symbol_ids", none).alias("near"), F.coalesce("neighbor_scores", F.array().cast("array<double>")).alias("sim"),
        *[F.col(c) for c in ("p_win_prob_5", "rank_score_pred")],
    )
    rows = staged(rows)
    regime = dominant_regime(rows)

    def cap(kind: str) -> Column:
        limits = {r: buy_cap(n, share) for r, share in SELECTION[kind].items()}
        return F.when(F.col("regime") == "risk_on", limits["risk_on"]).when(F.col("regime") == "risk_off", limits["risk_off"]).otherwise(limits["neutral"])

    pick = "array<struct<symbol:string,id:int,industry:string,board:string,adjusted:double,penalty:double>>"
    state = regime.select("trade_date", cap("industry").alias("icap"), cap("board").alias("bcap"), F.array().cast(pick).alias("picks"))
    pool = staged(contenders(rows.where("eligible"), n, SELECTION["similarity_penalty"]))
    for turn in range(1, n + 1):
        work = pool.join(state, "trade_date")
        taken = F.exists("picks", lambda p: p["symbol"] == F.col("symbol"))
        full_industry = F.size(F.filter("picks", lambda p: p["industry"] == F.col("industry"))) >= F.col("icap")
        full_board = F.size(F.filter("picks", lambda p: p["board"] == F.col("board"))) >= F.col("bcap")
        pairs = F.transform("near", lambda x, i: F.struct(x.alias("id"), F.coalesce(F.get("sim", i), F.lit(1.0)).alias("s")))
        close = F.filter(pairs, lambda x: (x["id"] > 0) & F.array_contains(F.transform("picks", lambda p: p["id"]), x["id"]))
        similar = clip(F.coalesce(F.array_max(F.transform(close, lambda x: x["s"])), F.lit(0.0)), 0.0, 1.0)
        penalty = SELECTION["similarity_penalty"] * similar
        work = work.withColumns({"blocked": taken | full_industry | full_board, "penalty": penalty})
        item = F.struct("symbol", "id", "industry", "board", (F.col("u") - F.col("penalty")).alias("adjusted"), "penalty")
        order = F.struct("blocked", (F.col("penalty") - F.col("u")).alias("a"), (-F.col("u")).alias("b"), F.col("symbol").alias("c"))
        best = work.groupBy("trade_date").agg(
            F.min_by(item, order).alias("item"), F.min("blocked").alias("none_left"), F.first("icap").alias("icap"),
            F.first("bcap").alias("bcap"), F.first("picks").alias("picks"),
        )
        state = best.select(
            "trade_date", "icap", "bcap",
            F.when(F.col("none_left"), F.col("picks")).otherwise(F.concat("picks", F.array("item")).cast(pick)).alias("picks"),
        )
        if turn % stage_every == 0 and turn < n:
            state = staged(state)
    chosen = state.select("trade_date", F.posexplode("picks").alias("pos", "p")).select(
        "trade_date", (F.col("pos") + 1).alias("pick_rank"), "p.symbol", "p.adjusted", "p.penalty", F.lit(False).alias("is_backfill")
    )
    if not backfill:
        return chosen
    chosen = staged(chosen)
    count = chosen.groupBy("trade_date").agg(F.count("*").alias("have"))
    rest = rows.join(chosen.select("trade_date", "symbol"), ["trade_date", "symbol"], "left_anti").where(F.coalesce("symbol", F.lit("")) != "")
    rest = rest.withColumns({"__p": clip(F.coalesce("p_win_prob_5", F.lit(0.0)), 0.0, 1.0), "__r": F.coalesce("rank_score_pred", F.lit(0.0))})
    w = Window.partitionBy("trade_date").orderBy(F.col("u").desc(), F.col("__p").desc(), F.col("__r").desc(), "symbol")
    rest = rest.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
    rest = rest.join(count, "trade_date", "left").withColumn("pick_rank", F.col("rn") + F.coalesce("have", F.lit(0)))
    fill = rest.where(F.col("pick_rank") <= n).select(
        "trade_date", F.col("pick_rank").cast("int"), "symbol", F.col("u").alias("adjusted"), F.lit(0.0).alias("penalty"), F.lit(True).alias("is_backfill")
    )
    return chosen.unionByName(fill)
