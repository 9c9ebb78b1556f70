"""Scoring, decision and scan queries over predictions that follow from past returns."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.catalog.ranks import avg_rank
from barline.catalog.registry import query
from barline.catalog.series import BARDATE_RETURNS, BREADTH, W5, full, ret
from barline.functions.columns import full_window, pct_rank_avg
from barline.operators import decisions as dec
from barline.operators import features, selection, series
from barline.plans import scan
from barline.plans.samples import first_day, list_days
from barline.session import long_expressions
from barline.sources.schemas import HORIZONS

SOURCE = {3: 3, 5: 5, 10: 10, 20: 20, 40: 60}
USES = "bars securities index_bars"


def predictions(t):
    """Deterministic stand-in for model output, with the market and risk columns the rules read."""
    long_expressions(t.spark)
    t = t.stored()
    df = t.bars.withColumns(series.return_columns()).withColumns(series.volatility_columns(rows=(20,)))
    # all windows by symbol come before the rank by date, so that they share a shuffle
    df = df.withColumns({"avg_amount_5": full_window(F.avg, "amount", 5) * 100, "__first": first_day()})
    p = {f"p_win_prob_{k}": 1.0 / (1.0 + F.exp(-4.0 * F.col(f"ret_{s}"))) for k, s in SOURCE.items()}
    mu = {f"ret_mu_pred_{k}": 0.05 * F.col(f"ret_{s}") for k, s in SOURCE.items()}
    dd = {f"risk_dd_pred_{k}": -0.02 * F.col("volatility_20") * (1 + k / 50.0) for k in HORIZONS}
    df = df.withColumns({
        **p, **mu, **dd, "bigloss_prob_5": F.least(F.lit(1.0), 0.1 * F.col("volatility_20")),
        "bigloss_prob_20": F.least(F.lit(1.0), 0.12 * F.col("volatility_20")),
        "rank_score_pred": pct_rank_avg("ret_5", "trade_date"),
        "feature_missing_rate": F.when(F.col("ret_60").isNull(), 0.2).otherwise(0.05),
        "signal_score": 0.1 * F.col("ret_10"),
    })
    dim = t.securities.select("symbol", "name", F.col("industry").alias("industry_sw"), "board", "list_date", "is_st")
    df = df.join(dim, "symbol", "left").withColumn("list_days", list_days(F.col("__first"))).drop("__first")
    market = features.market_features(t.bars, t.index_bars, None).withColumns(series.regime_columns())
    market = market.select("trade_date", F.col("market_volatility_5"), "limit_count_ratio", "risk_on_flag", "risk_off_flag",
                           "market_regime_score", (F.col("hs300_ret_1") / 10).alias("major_index_ret_1"))
    # the sample market moves a lot, so its volatility is scaled to the range of the rules
    df = df.join(market, "trade_date", "left").withColumn("market_volatility_5", F.col("market_volatility_5") / 10)
    return df.withColumns({"ret_5": F.col("ret_5") / 4, "pct_chg": F.col("pct_chg") / 10})


PREDS = f"""
    r0 AS (SELECT *, {', '.join(f'{ret(s)} AS ret_{s}' for s in sorted({1, *SOURCE.values()}))} FROM bars),
    r1 AS (SELECT *, {full('stddev_samp', 'ret_1', 20)} AS volatility_20 FROM r0),
    mk0 AS ({BREADTH}), mk1 AS ({BARDATE_RETURNS}),
    mk2 AS (SELECT trade_date, hs300_ret_1, up_limit_count AS u, down_limit_count AS d,
        CASE WHEN count(hs300_ret_1) OVER {W5} = 5 THEN stddev_samp(hs300_ret_1) OVER {W5} END / 10 AS market_volatility_5 FROM mk0 JOIN mk1 USING (trade_date)),
    mk AS (SELECT trade_date, market_volatility_5, (u - d) / (u + d + 1.0) AS limit_count_ratio, hs300_ret_1 / 10 AS major_index_ret_1,
        CASE WHEN hs300_ret_1 > 0 AND u > d THEN 1.0 ELSE 0 END AS risk_on_flag, CASE WHEN hs300_ret_1 < 0 AND u < d THEN 1.0 ELSE 0 END AS risk_off_flag FROM mk2),
    preds AS (SELECT r1.symbol, r1.trade_date, r1.amount, r1.is_suspended, {', '.join(f'1 / (1 + exp(-4 * ret_{s})) AS p_{k}, 0.05 * ret_{s} AS mu_{k}, 0.02 * volatility_20 * (1 + {k} / 50.0) AS dd_{k}' for k, s in SOURCE.items())},
        least(1, 0.1 * volatility_20) AS bl5, least(1, 0.12 * volatility_20) AS bl20, {avg_rank('ret_5', 'trade_date')} AS rnk,
        {full('avg', 'amount', 5)} * 100 AS avg_amount_5, CASE WHEN ret_60 IS NULL THEN 0.2 ELSE 0.05 END AS missing, 0.1 * ret_10 AS signal_score,
        s.name, s.industry AS industry_sw, s.board, s.is_st, CAST(trade_date - coalesce(s.list_date, min(trade_date) OVER (PARTITION BY symbol)) AS INTEGER) AS list_days,
        mk.*  EXCLUDE (trade_date), risk_on_flag - risk_off_flag AS market_regime_score, ret_5 / 4 AS recent, pct_chg / 10 AS day_chg
      FROM r1 LEFT JOIN securities s USING (symbol) LEFT JOIN mk USING (trade_date))"""


def safe(c: str, default: float = 0.0) -> str:
    return f"coalesce({c}, {default})"


@query("symbol trade_date p_win_prob_3~ p_win_prob_40~ p_win_pred_10 bigloss_prob_5~ rank_score_pred~ market_regime_prob~ signal_score~", f"""
    {PREDS} SELECT symbol, trade_date, 1 / (1 + exp(-mu_3)) AS p_win_prob_3, 1 / (1 + exp(-mu_40)) AS p_win_prob_40,
        CASE WHEN 1 / (1 + exp(-mu_10)) >= 0.5 THEN 1 WHEN mu_10 IS NOT NULL THEN 0 END AS p_win_pred_10, 1 / (1 + exp(-bl5)) AS bigloss_prob_5,
        1 / (1 + exp(-rnk)) AS rank_score_pred, (1 / (1 + exp(-mu_3)) + 1 / (1 + exp(-mu_5))) / 2 AS market_regime_prob, signal_score FROM preds""", USES)
def postprocess_predictions(t):
    df = predictions(t)
    raw = {f"p_win_logit_{k}": F.col(f"ret_mu_pred_{k}") for k in HORIZONS}
    raw |= {"bigloss_logit_5": F.col("bigloss_prob_5"), "rank_score_logit": F.col("rank_score_pred"), "decision_score_10": F.col("signal_score"),
            "regime_logit_3": F.col("ret_mu_pred_3"), "regime_logit_5": F.col("ret_mu_pred_5")}
    return dec.postprocess(df.select("symbol", "trade_date", *[c.alias(n) for n, c in raw.items()]))


@query("symbol trade_date a~ b~8 model_count", """
    m AS (SELECT symbol, trade_date, pct_chg AS a, close AS b FROM bars UNION ALL SELECT symbol, trade_date, pct_chg * 3, close * 2 FROM bars)
    SELECT symbol, trade_date, avg(a) AS a, avg(b) AS b, count(*) AS model_count FROM m GROUP BY 1, 2""", "bars")
def ensemble_average(t):
    one = t.bars.select("symbol", "trade_date", F.col("pct_chg").alias("a"), F.col("close").alias("b"))
    two = one.withColumns({"a": F.col("a") * 3, "b": F.col("b") * 2})
    return dec.ensemble_average(one.unionByName(two), ["a", "b"])


BEST3 = " ".join(["CASE"] + [
    "WHEN " + " AND ".join(
        f"({safe(f'p_{k}', -1)}, {safe(f'mu_{k}')}, {-k}) >= ({safe(f'p_{j}', -1)}, {safe(f'mu_{j}')}, {-j})" for j in (3, 5, 10) if j != k)
    + f" THEN {k}" for k in (3, 5, 10)] + ["END"])


@query("symbol trade_date horizon p_win~ ret_mu~", f"""
    {PREDS}, b AS (SELECT *, {BEST3} AS horizon FROM preds)
    SELECT symbol, trade_date, horizon, greatest(0, CASE horizon WHEN 3 THEN {safe('p_3', -1)} WHEN 5 THEN {safe('p_5', -1)} ELSE {safe('p_10', -1)} END) AS p_win,
        CASE horizon WHEN 3 THEN {safe('mu_3')} WHEN 5 THEN {safe('mu_5')} ELSE {safe('mu_10')} END AS ret_mu FROM b""", USES)
def best_horizon(t):
    df = predictions(t)
    return df.withColumn("b", dec.best_horizon(df.columns)).select("symbol", "trade_date", "b.*")


TOP_P = "greatest(" + ", ".join(safe(f"p_{k}") for k in HORIZONS) + ")"
SIMPLE_H = "CASE " + " ".join(f"WHEN {safe(f'p_{k}')} = {TOP_P} THEN {k}" for k in HORIZONS) + " END"


@query("symbol trade_date decision_horizon decision_p_win~ decision_action decision_priority", f"""
    {PREDS} SELECT symbol, trade_date, {SIMPLE_H} AS decision_horizon, {TOP_P} AS decision_p_win,
        CASE WHEN {TOP_P} > 0.5 THEN 'BUY' ELSE 'AVOID' END AS decision_action, CASE WHEN {TOP_P} > 0.5 THEN 2 ELSE 4 END AS decision_priority FROM preds""", USES)
def decision_simple(t):
    return dec.decision_simple(predictions(t))


COMPOSITE = (
    f"(0.22 * {safe('market_regime_score')} + 0.15 * ({safe('risk_on_flag')} - {safe('risk_off_flag')}) + 0.13 * {safe('limit_count_ratio')} "
    f"- 0.12 * tanh({safe('market_volatility_5')} / 0.04))"
)
REGIME = (
    f"CASE WHEN {safe('risk_off_flag')} >= 0.5 OR {safe('market_regime_score')} <= -0.25 OR {COMPOSITE} <= -0.18 THEN 'risk_off' "
    f"WHEN {safe('risk_on_flag')} >= 0.5 OR {safe('market_regime_score')} >= 0.25 OR {COMPOSITE} >= 0.18 THEN 'risk_on' ELSE 'neutral' END"
)


@query("symbol trade_date regime_composite~ market_regime",
       f"{PREDS} SELECT symbol, trade_date, {COMPOSITE} AS regime_composite, {REGIME} AS market_regime FROM preds", USES)
def market_regime(t):
    return dec.with_market_regime(predictions(t))


def utility_sql(k: int, w=dec.UTILITY["balanced"]) -> str:
    p, mu, dd = safe(f"p_{k}"), safe(f"mu_{k}"), safe(f"dd_{k}")
    bl = safe("bl5" if k <= 10 else "bl20")
    return (
        f"{w['ret']} * tanh({mu} / {dec.SCALES['ret'][k]}) + {w['p_win']} * ({p} - 0.5) * 2 + {w['rank']} * ({safe('rnk')} - 0.5) * 2 "
        f"+ {w['upside']} * tanh(greatest({mu}, 0) / {dec.SCALES['upside'][k]}) - {w['drawdown']} * pow({dd} / {dec.SCALES['drawdown'][k]}, 1.45) "
        f"- {w['bigloss']} * ln(1 + exp(8 * ({bl} - 0.35))) AS u{k}"
    )


UTIL = f"util AS (SELECT *, {REGIME} AS regime, {', '.join(utility_sql(k) for k in HORIZONS)} FROM preds)"


@query("symbol trade_date " + " ".join(f"utility_{k}~" for k in HORIZONS),
       f"{PREDS}, {UTIL} SELECT symbol, trade_date, {', '.join(f'u{k} AS utility_{k}' for k in HORIZONS)} FROM util", USES)
def horizon_utility(t):
    return dec.with_horizon_utility(dec.with_market_regime(predictions(t)))


def weight_list(lean: dict[int, float]) -> dict[int, float]:
    raw = {k: dec.TIME["short_mid"][k] * lean[k] for k in HORIZONS}
    return {k: raw[k] / sum(raw.values()) for k in HORIZONS}


LEANS = {"risk_on": weight_list(dec.LEANING_SHORT), "risk_off": weight_list(dec.LEANING_LONG), "neutral": weight_list({k: 1.0 for k in HORIZONS})}


def weight_sql(k: int) -> str:
    return f"CASE regime WHEN 'risk_on' THEN {LEANS['risk_on'][k]} WHEN 'risk_off' THEN {LEANS['risk_off'][k]} ELSE {LEANS['neutral'][k]} END"


@query("symbol trade_date " + " ".join(f"w_{k}~" for k in HORIZONS),
       f"{PREDS}, {UTIL} SELECT symbol, trade_date, {', '.join(f'{weight_sql(k)} AS w_{k}' for k in HORIZONS)} FROM util", USES)
def horizon_time_weights(t):
    w = dec.time_weights("short_mid", "balanced", False, 0, F.col("market_regime"))
    return dec.with_market_regime(predictions(t)).withColumns({f"w_{k}": c for k, c in w.items()})


U = ", ".join(f"u{k}" for k in HORIZONS)
PLUS = " + ".join(f"CASE WHEN u{k} > 0.03 THEN 1 ELSE 0 END" for k in HORIZONS)
MINUS = " + ".join(f"CASE WHEN u{k} < -0.03 THEN 1 ELSE 0 END" for k in HORIZONS)
CONS = (
    f"greatest(0, least(1, 0.6 * greatest({PLUS}, {MINUS}, 5 - ({PLUS}) - ({MINUS})) / 5.0 + 0.4 * (1 - least(1, list_stddev_pop([{U}]) / 0.55))))"
)
SHORT, MID, FAR = "((u3 + u5) / 2)", "((u10 + u20) / 2)", "((u20 + u40) / 2)"
UPDOWN = f"{SHORT} >= 0.18 AND {FAR} <= -0.12"
BAD = f"({safe('dd_5')} > 0.08 OR {safe('bl5')} > 0.45)"
CTYPE = (
    f"CASE WHEN {UPDOWN} THEN CASE WHEN {safe('recent')} > 0.18 THEN 'overheated' WHEN {BAD} THEN 'malignant' ELSE 'benign_mismatch' END "
    f"WHEN ({SHORT} <= -0.12 AND {FAR} >= 0.18) OR ({SHORT} <= -0.1 AND {MID} >= 0.2) THEN 'reversal' "
    f"WHEN {SHORT} >= 0.1 AND {MID} >= 0.12 THEN 'aligned_positive' END"
)
CPEN = (
    f"CASE WHEN {UPDOWN} THEN CASE WHEN {safe('recent')} > 0.18 THEN 0.45 WHEN {BAD} THEN 0.6 ELSE 0.22 END "
    f"WHEN {SHORT} <= -0.12 AND {FAR} >= 0.18 THEN 0.3 WHEN {SHORT} <= -0.1 AND {MID} >= 0.2 THEN 0.24 ELSE 0 END"
)
WEIGHTED = " + ".join(f"{weight_sql(k)} * u{k}" for k in HORIZONS)
BEST_U = f"greatest({U})"
AGG = (
    f"ag AS (SELECT *, {CONS} AS cons, {CTYPE} AS ctype, {CPEN} AS cpen, {WEIGHTED} AS wu, ({WEIGHTED}) - 0.35 * ({CPEN}) AS uf, "
    + "CASE " + " ".join(f"WHEN u{k} = {BEST_U} THEN {k}" for k in HORIZONS) + f" END AS best, {BEST_U} AS best_score FROM util)"
)


@query("symbol trade_date consistency_score~", f"{PREDS}, {UTIL} SELECT symbol, trade_date, {CONS} AS consistency_score FROM util", USES)
def utility_consistency(t):
    return dec.with_horizon_utility(predictions(t)).withColumn("consistency_score", dec.consistency())


@query("symbol trade_date conflict_type conflict_penalty~",
       f"{PREDS}, {UTIL} SELECT symbol, trade_date, {CTYPE} AS conflict_type, {CPEN} AS conflict_penalty FROM util", USES)
def utility_conflict(t):
    return dec.with_conflict(dec.with_horizon_utility(predictions(t)))


def view_sql(x: str) -> str:
    return (f"CASE WHEN {x} >= 0.35 THEN 'strong_bullish' WHEN {x} >= 0.15 THEN 'bullish' WHEN {x} > -0.1 THEN 'neutral' "
            f"WHEN {x} > -0.3 THEN 'bearish' ELSE 'strong_bearish' END")


@query("symbol trade_date weighted_utility~ u_final~ best_horizon best_horizon_score~ short_term_view mid_term_view", f"""
    {PREDS}, {UTIL}, {AGG} SELECT symbol, trade_date, wu AS weighted_utility, uf AS u_final, best AS best_horizon, best_score AS best_horizon_score,
        {view_sql(SHORT)} AS short_term_view, {view_sql('((u10 + u20 + u40) / 3)')} AS mid_term_view FROM ag""", USES)
def utility_aggregate(t):
    return dec.with_aggregate(dec.with_horizon_utility(dec.with_market_regime(predictions(t))))


@query("symbol trade_date horizon_order[s]", f"""
    {PREDS}, {UTIL}, x AS (SELECT symbol, trade_date, list_sort([{', '.join(f'(-u{k}, {k})' for k in HORIZONS)}]) AS s FROM util)
    SELECT symbol, trade_date, list_transform(s, lambda e: e[2]) AS horizon_order FROM x""", USES)
def horizon_ranking(t):
    df = dec.with_horizon_utility(dec.with_market_regime(predictions(t)))
    return df.withColumn("horizon_order", dec.horizon_ranking())


def unit_clip(x: str) -> str:
    return f"greatest(0, least(1, {x}))"


RISK = f"""rk0 AS (SELECT *, {unit_clip(f"greatest({safe('dd_5')} / 0.1, {safe('dd_10')} / 0.14)")} AS k_dd, {unit_clip(safe('bl5'))} AS k_bl,
    {unit_clip(f"{safe('market_volatility_5')} / 0.05 + CASE WHEN regime = 'risk_off' THEN 0.2 ELSE 0 END")} AS k_mk,
    {unit_clip("CASE WHEN coalesce(avg_amount_5, 0) > 0 THEN (20000000 - avg_amount_5) / 20000000 ELSE 0.35 END")} AS k_lq, {unit_clip('0.5 * missing / 0.35')} AS k_dq,
    {unit_clip(f"greatest({safe('recent')} / 0.25, {safe('day_chg')} / 100 / 0.095)")} AS k_oh FROM ag),
    rk1 AS (SELECT *, {unit_clip('0.25 * k_dd + 0.24 * k_bl + 0.16 * k_mk + 0.12 * k_lq + 0.13 * k_dq + 0.1 * k_oh')} AS rs FROM rk0),
    rk AS (SELECT *, CASE WHEN rs < 0.25 THEN 'low' WHEN rs < 0.5 THEN 'medium' WHEN rs < 0.75 THEN 'high' ELSE 'severe' END AS lvl FROM rk1)"""
CHAIN = f"{PREDS}, {UTIL}, {AGG}, {RISK}"


def staged_scores(t):
    return dec.with_risk_score(dec.with_aggregate(dec.with_horizon_utility(dec.with_market_regime(predictions(t)))))


@query("symbol trade_date risk_score~ risk_level drawdown_risk~ liquidity_risk~9 overheat_risk~",
       f"{CHAIN} SELECT symbol, trade_date, rs AS risk_score, lvl AS risk_level, k_dd AS drawdown_risk, k_lq AS liquidity_risk, k_oh AS overheat_risk FROM rk", USES)
def risk_score(t):
    return staged_scores(t)


def confidence_sql(down: str = "false") -> str:
    return (f"greatest(0.05, least(0.99, 0.38 + 0.3 * cons + 0.22 * least(1, abs(uf) / 0.55) - 0.18 * rs "
            f"- CASE WHEN cpen > 0 THEN 0.08 * cpen / 0.6 ELSE 0 END - CASE WHEN {down} THEN 0.08 ELSE 0 END))")


@query("symbol trade_date confidence~", f"{CHAIN} SELECT symbol, trade_date, {confidence_sql()} AS confidence FROM rk", USES)
def confidence_score(t):
    return staged_scores(t).withColumn("confidence", dec.confidence())


def threshold_sql(name: str) -> str:
    return "CASE regime " + " ".join(f"WHEN '{r}' THEN {dec.ACTION_AT[r][name]}" for r in dec.ACTION_AT) + " END"


FREE = (
    f"CASE WHEN lvl = 'severe' OR uf <= {threshold_sql('avoid')} - 0.18 THEN 'STRONG_AVOID' WHEN lvl = 'high' OR uf <= {threshold_sql('avoid')} THEN 'AVOID' "
    f"WHEN uf >= {threshold_sql('strong_buy')} AND conf >= 0.75 AND cons >= 0.65 AND lvl = 'low' AND {safe('bl5')} < 0.35 AND cpen < 0.2 THEN 'STRONG_BUY' "
    f"WHEN uf >= {threshold_sql('buy')} AND conf >= 0.55 AND lvl IN ('low', 'medium') THEN 'BUY' ELSE 'WATCH' END"
)
DAYS = 8
HELD = f"""CASE WHEN lvl = 'severe' OR ({safe('dd_5')} >= 0.08 AND ({safe('bl5')} >= 0.5 OR uf <= -0.2)) OR (uf <= -0.35 AND lvl = 'high') THEN 'STOP_LOSS'
    WHEN uf <= -0.18 OR {DAYS}.0 / best > 1.2 THEN 'SELL' WHEN lvl = 'high' OR cpen >= 0.4 OR ({DAYS}.0 / best >= 0.9 AND {DAYS}.0 / best <= 1.2) THEN 'REDUCE'
    WHEN uf >= 0.5 AND conf >= 0.72 AND lvl = 'low' AND regime <> 'risk_off' AND {DAYS}.0 / best < 0.65 AND {safe('bl5')} < 0.3
        AND coalesce(ctype, '') <> 'overheated' THEN 'ADD_POSITION' ELSE 'HOLD' END"""
BASE = f"{CHAIN}, cf AS (SELECT *, {confidence_sql()} AS conf FROM rk), ba AS (SELECT *, {FREE} AS a0, {HELD} AS h0 FROM cf)"


@query("symbol trade_date base_action held_action", f"{BASE} SELECT symbol, trade_date, a0 AS base_action, h0 AS held_action FROM ba", USES)
def base_action(t):
    df = staged_scores(t).withColumn("confidence", dec.confidence())
    return df.withColumns({"base_action": dec.base_action_free(), "held_action": dec.base_action_held(DAYS)})


BUYING = "('STRONG_BUY', 'BUY', 'RECOMMEND_BUY', 'ADD_POSITION')"
DOWN1 = "CASE {a} WHEN 'STRONG_BUY' THEN 'BUY' WHEN 'BUY' THEN 'WATCH' WHEN 'WATCH' THEN 'AVOID' WHEN 'AVOID' THEN 'STRONG_AVOID' ELSE {a} END"
WATCH1 = "CASE WHEN {a} IN ('STRONG_BUY', 'BUY') THEN 'WATCH' ELSE {a} END"
STEPS = [
    ("coalesce(is_st, false)", "'AVOID'"), ("coalesce(is_suspended, false)", "'AVOID'"), ("list_days <> 0 AND list_days < 120", "'AVOID'"),
    ("coalesce(avg_amount_5, 0) <> 0 AND avg_amount_5 < 5000000", WATCH1), ("missing > 0.15", WATCH1),
    (f"abs(least({safe('major_index_ret_1')}, 0)) > 0.05 AND {{a}} IN {BUYING}", WATCH1),
    (f"{safe('bl5')} >= 0.72", "'STRONG_AVOID'"), (f"{safe('bl5')} < 0.72 AND {safe('bl5')} >= 0.45 AND {{a}} IN {BUYING}", WATCH1),
    (f"({safe('dd_5')} > 0.08 OR {safe('dd_10')} > 0.12) AND {{a}} IN {BUYING}", WATCH1), (f"{safe('dd_5')} > 0.15", "'AVOID'"),
    (f"{safe('p_5')} < 0.45 AND {{a}} IN {BUYING}", WATCH1), (f"{safe('recent')} > 0.25 AND {{a}} IN {BUYING}", DOWN1),
    (f"regime = 'risk_off' AND {safe('market_volatility_5')} >= 0.035 AND {{a}} IN {BUYING}", DOWN1),
]
CONTROLS = ", ".join(
    f"c{i + 1} AS (SELECT *, CASE WHEN {cond.format(a=f'a{i}')} THEN {then.format(a=f'a{i}')} ELSE a{i} END AS a{i + 1} FROM {'ba' if i == 0 else f'c{i}'})"
    for i, (cond, then) in enumerate(STEPS))
LASTC, LASTA = f"c{len(STEPS)}", f"a{len(STEPS)}"


@query("symbol trade_date base_action final_action downgraded passed", f"""
    {BASE}, {CONTROLS} SELECT symbol, trade_date, a0 AS base_action, {LASTA} AS final_action, {LASTA} <> a0 AS downgraded,
        NOT (coalesce(is_st, false) OR coalesce(is_suspended, false) OR (list_days <> 0 AND list_days < 120)
            OR (coalesce(avg_amount_5, 0) <> 0 AND avg_amount_5 < 5000000) OR (abs(least({safe('major_index_ret_1')}, 0)) > 0.05 AND a5 IN {BUYING})
            OR {safe('bl5')} >= 0.72 OR {safe('dd_5')} > 0.15) AS passed FROM {LASTC}""", USES)
def risk_controls(t):
    df = staged_scores(t).withColumn("confidence", dec.confidence())
    return dec.with_risk_controls(df.withColumn("base_action", dec.base_action_free()))


HINT = (
    "CASE WHEN act = 'STRONG_BUY' AND lvl = 'low' AND conf2 >= 0.78 THEN 'full' WHEN act IN ('STRONG_BUY', 'BUY') THEN "
    "CASE WHEN lvl IN ('low', 'medium') THEN 'half' ELSE 'light' END WHEN act IN ('AVOID', 'STRONG_AVOID') THEN 'none' ELSE 'light' END"
)
DECIDED = f"{BASE}, {CONTROLS}, fin AS (SELECT *, {LASTA} AS act, {confidence_sql(f'{LASTA} <> a0')} AS conf2 FROM {LASTC})"


@query("symbol trade_date market_regime final_action confidence~ u_final~ position_hint",
       f"{DECIDED} SELECT symbol, trade_date, regime AS market_regime, act AS final_action, conf2 AS confidence, uf AS u_final, {HINT} AS position_hint FROM fin", USES)
def decision_utility(t):
    return dec.decision_utility(predictions(t))


SELECT_U = (
    f"0.38 * uf + 0.18 * ({safe('rnk')} - 0.5) * 2 + 0.16 * cons + 0.14 * tanh(greatest({', '.join(safe(f'mu_{k}') for k in HORIZONS)}) / 0.08) "
    "- 0.08 * k_dd - 0.06 * k_bl"
)


@query("symbol trade_date selection_utility~", f"{CHAIN} SELECT symbol, trade_date, {SELECT_U} AS selection_utility FROM rk", USES)
def selection_utility(t):
    df = staged_scores(t)
    return df.withColumn("selection_utility", dec.selection_utility(df.columns))


@query("symbol trade_date pctile~", f"""
    {PREDS}, n AS (SELECT symbol, trade_date, industry_sw, coalesce(dd_5, 0) AS d FROM preds)
    SELECT symbol, trade_date, percent_rank() OVER (PARTITION BY trade_date, industry_sw ORDER BY d) AS pctile FROM n""", USES)
def industry_risk_percentile(t):
    df = predictions(t).withColumn("risk_dd", F.coalesce(F.abs("risk_dd_pred_5"), F.lit(0.0)))
    return df.withColumn("pctile", dec.industry_risk_percentile())


def scan_sql(p: str, mu: str, where: str, keys: str, n: int) -> str:
    return (f"sc AS (SELECT *, {p} AS bp, {mu} AS bm FROM pool) SELECT symbol, trade_date, bp AS best_p_win, bm AS best_ret_mu, CAST(row_number() OVER "
            f"(PARTITION BY trade_date ORDER BY {keys}, symbol) AS INTEGER) AS scan_rank FROM sc WHERE {where} QUALIFY scan_rank <= {n}")


SCAN = "symbol trade_date best_p_win~ best_ret_mu~ scan_rank"
P10, M10 = f"greatest({safe('p_10', -1)}, 0)", safe("mu_10")


@query(SCAN, f"{PREDS}, pool AS (SELECT *, {TOP_P} AS tp FROM preds), " + scan_sql(
    P10, M10, "tp > 0.5 AND bp >= 0.5", f"bp DESC, bm DESC, {safe('signal_score')} DESC, {safe('rnk')} DESC", 10), USES)
def scan_topn_market(t):
    return selection.topn_market(dec.decision_simple(predictions(t)), 10, 10)


BEST_P = f"greatest(0, CASE {BEST3} WHEN 3 THEN {safe('p_3', -1)} WHEN 5 THEN {safe('p_5', -1)} ELSE {safe('p_10', -1)} END)"
BEST_M = f"CASE {BEST3} WHEN 3 THEN {safe('mu_3')} WHEN 5 THEN {safe('mu_5')} ELSE {safe('mu_10')} END"


@query(SCAN, f"{PREDS}, pool AS (SELECT * FROM preds), " + scan_sql(
    BEST_P, BEST_M, "bp >= 0.5", f"bp DESC, bm DESC, {safe('signal_score', 0.5)} DESC, {safe('rnk', 0.5)} DESC", 10), USES)
def scan_topn_quick(t):
    return selection.topn_quick(predictions(t), 10)


@query(SCAN, f"{PREDS}, pool AS (SELECT * FROM preds), " + scan_sql(
    P10, M10, "bp >= 0.55 AND bm > 0.01", f"bp DESC, bm DESC, {safe('signal_score')} DESC, {safe('rnk')} DESC", 10), USES)
def scan_threshold_quick(t):
    return selection.threshold_quick(predictions(t), 10)


@query(SCAN, f"{PREDS}, pool AS (SELECT * FROM preds), " + scan_sql(
    P10, M10, "bp >= 0.55 AND bm > 0.01", "md5(symbol || '|' || strftime(trade_date, '%Y%m%d'))", 10), USES)
def random_scan_first_n(t):
    return selection.random_first_n(predictions(t), 10)


PICKS = 10


def candidates(t):
    """Decided rows, eligible by recommended action, with two neighbours each: the codes before and after."""
    df = predictions(t).withColumn("__dd", F.coalesce(F.abs("risk_dd_pred_5"), F.lit(0.0)))
    df = df.withColumn("industry_risk_dd_5_pctile", dec.industry_risk_percentile("__dd"))
    df = dec.decision_utility(df)
    df = df.withColumn("selection_utility", F.round(dec.selection_utility(df.columns), 9))
    code = F.substring("symbol", 1, 6).cast("int")
    return df.withColumns({
        "symbol_id": code + 1, "eligible": F.col("final_action").isin(*selection.RECOMMENDED),
        "neighbor_symbol_ids": F.array(code, code + 2), "neighbor_scores": F.array(F.lit(0.9), F.lit(0.4)),
    })


def pick_limit(kind: str) -> str:
    return "CASE regime " + " ".join(f"WHEN '{r}' THEN {dec.buy_cap(PICKS, share)}" for r, share in dec.SELECTION[kind].items()) + " END"


def pick_round(k: int) -> str:
    """One greedy pick a date: ``st{k}`` holds the picks after ``k`` rounds."""
    near = "CASE WHEN list_contains(ids, id - 1) THEN 0.09 WHEN list_contains(ids, id + 1) THEN 0.04 ELSE 0.0 END"
    return f"""w{k} AS MATERIALIZED (SELECT pool.*, {near} AS penalty FROM pool JOIN st{k - 1} USING (trade_date)
        WHERE NOT list_contains(syms, symbol) AND len(list_filter(inds, lambda x: x = industry)) < icap AND len(list_filter(brds, lambda x: x = board)) < bcap
        QUALIFY row_number() OVER (PARTITION BY trade_date ORDER BY u - penalty DESC, u DESC, symbol) = 1),
    st{k} AS MATERIALIZED (SELECT s.trade_date, icap, bcap, {', '.join(f'CASE WHEN w.symbol IS NULL THEN {c} ELSE list_append({c}, w.{v}) END AS {c}' for c, v in
        (('syms', 'symbol'), ('ids', 'id'), ('inds', 'industry'), ('brds', 'board')))},
        CASE WHEN w.symbol IS NULL THEN adj ELSE list_append(adj, w.u - w.penalty) END AS adj, CASE WHEN w.symbol IS NULL THEN pens ELSE list_append(pens, w.penalty) END AS pens
        FROM st{k - 1} s LEFT JOIN w{k} w ON w.trade_date = s.trade_date)"""


PICKED = f"""{DECIDED},
    every AS MATERIALIZED (SELECT trade_date, symbol, CAST(substr(symbol, 1, 6) AS INTEGER) + 1 AS id, coalesce(industry_sw, 'Unknown') AS industry,
        coalesce(board, 'Unknown') AS board, round({SELECT_U}, 9) AS u, act, regime, greatest(0, least(1, coalesce(p_5, 0))) AS p, coalesce(rnk, 0) AS r FROM fin),
    pool AS MATERIALIZED (SELECT * FROM every WHERE act IN ('STRONG_BUY', 'BUY', 'RECOMMEND_BUY')),
    lead_regime AS (SELECT trade_date, regime FROM (SELECT trade_date, regime, count(*) AS c FROM every GROUP BY 1, 2)
        QUALIFY row_number() OVER (PARTITION BY trade_date ORDER BY c DESC, regime) = 1),
    st0 AS MATERIALIZED (SELECT trade_date, {pick_limit('industry')} AS icap, {pick_limit('board')} AS bcap, CAST([] AS VARCHAR[]) AS syms, CAST([] AS INTEGER[]) AS ids,
        CAST([] AS VARCHAR[]) AS inds, CAST([] AS VARCHAR[]) AS brds, CAST([] AS DOUBLE[]) AS adj, CAST([] AS DOUBLE[]) AS pens FROM lead_regime),
    {', '.join(pick_round(k) for k in range(1, PICKS + 1))},
    chosen AS (SELECT trade_date, unnest(range(1, len(syms) + 1)) AS i, unnest(syms) AS symbol, unnest(adj) AS adjusted, unnest(pens) AS penalty FROM st{PICKS})"""
PICK = "trade_date pick_rank symbol adjusted~ penalty~ is_backfill"


@query(PICK, f"{PICKED} SELECT trade_date, CAST(i AS INTEGER) AS pick_rank, symbol, adjusted, penalty, false AS is_backfill FROM chosen", USES)
def diversified_selection(t):
    return selection.diversified_selection(candidates(t), PICKS)


@query(PICK, f"""{PICKED},
    fill AS (SELECT e.trade_date, coalesce(len(st.syms), 0) + row_number() OVER (PARTITION BY e.trade_date ORDER BY u DESC, p DESC, r DESC, e.symbol) AS i, e.symbol, u AS adjusted
        FROM every e JOIN st{PICKS} st ON st.trade_date = e.trade_date WHERE NOT list_contains(st.syms, e.symbol))
    SELECT trade_date, CAST(i AS INTEGER) AS pick_rank, symbol, adjusted, penalty, false AS is_backfill FROM chosen
    UNION ALL SELECT trade_date, CAST(i AS INTEGER), symbol, adjusted, 0.0, true FROM fill WHERE i <= {PICKS}""", USES)
def diversified_backfill(t):
    """Dates without enough recommended rows are filled up by utility."""
    return selection.diversified_selection(candidates(t), PICKS, backfill=True)


EFFECTIVE = """cov AS (SELECT trade_date, count(DISTINCT symbol) AS c FROM bars JOIN securities USING (symbol) WHERE status = 'active'
        AND trade_date > (SELECT max(trade_date) FROM bars) - 15 GROUP BY 1),
    eff AS (SELECT max(trade_date) AS d FROM cov WHERE c >= greatest(1, floor((SELECT max(c) FROM cov) * 0.95)))"""
OF_DATE = "FROM preds WHERE trade_date = (SELECT d FROM eff) AND list_days >= 120 AND NOT is_st AND NOT is_suspended"


@query(SCAN, f"{PREDS}, {EFFECTIVE}, pool AS (SELECT *, {TOP_P} AS tp {OF_DATE}), " + scan_sql(
    P10, M10, "tp > 0.5 AND bp >= 0.5", f"bp DESC, bm DESC, {safe('signal_score')} DESC, {safe('rnk')} DESC", 10), USES)
def quick_and_full_scan(t):
    return scan.full_scan(predictions(t), t.bars, t.securities, n=10, horizon=10)


@query(SCAN, f"{PREDS}, {EFFECTIVE}, pool AS (SELECT * {OF_DATE}), " + scan_sql(
    P10, M10, "bp >= 0.55 AND bm > 0.01", "md5(symbol || '|' || strftime(trade_date, '%Y%m%d'))", 10), USES)
def quick_scan(t):
    """The quick mode.  Not ``strict``: the sample's last date has too few bars for that gate, as ``scan_gates`` reports."""
    return scan.full_scan(predictions(t), t.bars, t.securities, n=10, horizon=10, mode="quick")


@query("trade_date universe covered coverage_floor sample_size sample_floor passed", f"""
    {PREDS}, {EFFECTIVE}, un AS (SELECT count(DISTINCT symbol) AS universe FROM securities WHERE status = 'active')
    SELECT d AS trade_date, universe, c AS covered, CAST(greatest(1, floor(universe * CAST({scan.COVERED} AS DOUBLE))) AS BIGINT) AS coverage_floor, n AS sample_size,
        CAST(greatest(1, floor(universe * CAST({scan.SAMPLED} AS DOUBLE))) AS BIGINT) AS sample_floor, covered >= coverage_floor AND sample_size >= sample_floor AS passed
    FROM eff, un, (SELECT count(*) AS n {OF_DATE}) AS s, (SELECT c FROM cov WHERE trade_date = (SELECT d FROM eff)) AS v""", USES)
def scan_gates(t):
    return scan.scan_gates(predictions(t), t.bars, t.securities)
