"""Sample assembly, filling and packaging queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.catalog.features import (
    FUNDAMENTAL,
    IDS,
    LABEL_SPEC,
    LABELS,
    MARKET,
    PRICE,
    PROFILE_USES,
    PROFILES,
    RELATIVE,
    SIMILARITY,
    VOLUME,
    profile_frame,
)
from barline.catalog.ranks import avg_rank
from barline.catalog.registry import query
from barline.catalog.series import CANDLE_SQL, FILL_BACK, W
from barline.operators import features, finalize, profiles, quantiles, similarity
from barline.operators.ranking import entity_ids
from barline.plans import samples
from barline.sources.writers import saved
from barline.sources.schemas import (
    BOUNDED_COLUMNS,
    FLAG_COLUMNS,
    HORIZONS,
    MARKET_COLUMNS,
    PROFILE_COLUMNS,
    RANK_COLUMNS,
    SEQUENCE_COLUMNS,
    TABULAR_COLUMNS,
    ZERO_COLUMNS,
)

USES = "bars securities index_bars sector_daily financials"

# every column of the feature table, joined from the independent parts
PROFILE_ONLY = [c for c in PROFILE_COLUMNS if c not in ("ret_20", "ret_60", "roe", "revenue_yoy", "profit_yoy")]
FEATURES = f"""
    fp AS (WITH RECURSIVE {PRICE}), fv AS (WITH {VOLUME}), fr_ AS (WITH {RELATIVE}), ff AS (WITH {FUNDAMENTAL}),
    fc AS ({CANDLE_SQL}), fm AS (WITH {MARKET}), fpr AS (WITH {PROFILES}),
    fi AS (SELECT symbol, CAST(row_number() OVER (ORDER BY symbol) AS INTEGER) AS symbol_id,
        CAST(dense_rank() OVER (ORDER BY industry) AS INTEGER) AS industry_id,
        CAST(dense_rank() OVER (ORDER BY board) AS INTEGER) AS board_id FROM securities),
    feats AS (SELECT b.symbol, b.trade_date, b.open, b.high, b.low, b.close, b.adj_close, b.volume, b.amount,
        b.turnover_rate, b.pct_chg, b.is_suspended, fp.* EXCLUDE (symbol, trade_date), fv.* EXCLUDE (symbol, trade_date),
        fr_.* EXCLUDE (symbol, trade_date), ff.* EXCLUDE (symbol, trade_date), fc.* EXCLUDE (symbol, trade_date),
        fm.* EXCLUDE (trade_date, up_touch_count), fm.up_limit_count - fm.down_limit_count AS limit_count_spread,
        (fm.up_limit_count - fm.down_limit_count) / (fm.up_limit_count + fm.down_limit_count + 1.0) AS limit_count_ratio,
        fm.sector_hotness_top1 - fm.sector_hotness_top3_mean AS sector_hotness_spread,
        fm.risk_on_flag - fm.risk_off_flag AS market_regime_score,
        {', '.join('fpr.' + c for c in PROFILE_ONLY)},
        fi.symbol_id, fi.industry_id, fi.board_id, s.name, s.industry AS industry_sw, s.board, s.is_st,
        coalesce(s.list_date, min(b.trade_date) OVER (PARTITION BY b.symbol)) AS list_date,
        CAST(b.trade_date - coalesce(s.list_date, min(b.trade_date) OVER (PARTITION BY b.symbol)) AS INTEGER) AS list_days
      FROM bars b LEFT JOIN fp ON fp.symbol = b.symbol AND fp.trade_date = b.trade_date
      LEFT JOIN fv ON fv.symbol = b.symbol AND fv.trade_date = b.trade_date
      LEFT JOIN fr_ ON fr_.symbol = b.symbol AND fr_.trade_date = b.trade_date
      LEFT JOIN ff ON ff.symbol = b.symbol AND ff.trade_date = b.trade_date
      LEFT JOIN fc ON fc.symbol = b.symbol AND fc.trade_date = b.trade_date
      LEFT JOIN fpr ON fpr.symbol = b.symbol AND fpr.asof_date = b.trade_date
      LEFT JOIN fm ON fm.trade_date = b.trade_date LEFT JOIN securities s ON s.symbol = b.symbol
      LEFT JOIN fi ON fi.symbol = b.symbol)"""

COARSE = {
    **{c: "" for c in ("open", "high", "low", "close", "adj_close", "volume", "amount")},
    **{c: "~3" for c in ("macd_dif", "macd_dea", "macd_hist", "atr_14")}, "rsi_6": "~4", "rsi_14": "~4",
    "amount_mean_120": "~5", "market_turnover": "~2",
}


def spec(*groups, skip=()) -> str:
    names = list(dict.fromkeys(c for g in groups for c in g if c not in skip))
    return " ".join(c + COARSE.get(c, "~") for c in names)


FEATURE_SPEC = (
    f"symbol trade_date name industry_sw board is_st list_date list_days symbol_id industry_id board_id "
    f"{spec(SEQUENCE_COLUMNS, TABULAR_COLUMNS[1:], MARKET_COLUMNS, PROFILE_COLUMNS, FLAG_COLUMNS)}"
)


def feature_frame(t):
    t = t.stored()
    return samples.build_all_features(t.bars, t.securities, t.index_bars, t.sector_daily, t.financials)


@query(FEATURE_SPEC, f"{FEATURES} SELECT * FROM feats", USES)
def build_all_features(t):
    return feature_frame(t)


TRAINING_PARTS = f"""
    {FEATURES}, lab AS (WITH {LABELS}),
    joined AS (SELECT feats.*, lab.* EXCLUDE (symbol, trade_date) FROM feats
        JOIN lab ON lab.symbol = feats.symbol AND lab.trade_date = feats.trade_date
        WHERE NOT coalesce(is_st, false) AND coalesce(list_days, 0) >= 120),
    ranked AS (SELECT *, 'ready' AS sample_status, 'v1' AS data_version, 'f1' AS feature_version, 'l1' AS label_version,
        {avg_rank('label_alpha_5', 'trade_date')} AS label_rank_score FROM joined),
    live AS (SELECT * FROM ranked WHERE NOT coalesce(is_suspended, false))"""


def finalize_sql(source: str, out: str) -> str:
    """CTEs that fill and clip ``source``: one column at a time, with plain SQL quantiles."""
    seqp = list(dict.fromkeys([*SEQUENCE_COLUMNS, *PROFILE_COLUMNS]))
    fill = ", ".join(
        f"coalesce(last_value({c} IGNORE NULLS) OVER {W}, first_value({c} IGNORE NULLS) OVER {FILL_BACK}) AS {c}" for c in seqp)
    bound = {c: f"greatest(0, least(1, coalesce({c}, 0.5)))" for c in RANK_COLUMNS}
    bound |= {c: f"coalesce({c}, 0)" for c in ZERO_COLUMNS}
    bound |= {c: f"greatest(0, least(1, coalesce({c}, 0)))" for c in FLAG_COLUMNS}
    bound |= {c: f"greatest(0, least(1, coalesce({c}, {0.0 if c in ZERO_COLUMNS else 0.5})))" for c in BOUNDED_COLUMNS}
    med = [c for c in dict.fromkeys([*TABULAR_COLUMNS, *PROFILE_COLUMNS]) if c not in RANK_COLUMNS and c not in ZERO_COLUMNS]
    clip = [c for c in dict.fromkeys([*SEQUENCE_COLUMNS, *TABULAR_COLUMNS, *PROFILE_COLUMNS])
            if c not in RANK_COLUMNS and c not in ZERO_COLUMNS]
    medians = ", ".join(
        f"coalesce({c}, median({c}) OVER (PARTITION BY trade_date), median({c}) OVER (), 0) AS {c}" for c in med)
    quant = ", ".join(
        f"quantile_cont(CAST({c} AS DOUBLE), 0.005) AS {c}_lo, quantile_cont(CAST({c} AS DOUBLE), 0.995) AS {c}_hi" for c in clip)
    clipped = ", ".join(
        f"CASE WHEN {c} IS NULL THEN NULL ELSE greatest({c}_lo, least({c}_hi, {c})) END AS {c}" for c in clip)
    bounds = ", ".join(f"{e} AS {c}" for c, e in bound.items())
    return f"""
    f1 AS (SELECT * REPLACE ({fill}) FROM {source}), f2 AS (SELECT * REPLACE ({bounds}) FROM f1),
    f3 AS (SELECT * REPLACE ({medians}) FROM f2), fq AS (SELECT {quant} FROM f3),
    {out} AS (SELECT f3.* REPLACE ({clipped}) FROM f3, fq)"""


FINAL_SPEC = (
    "symbol trade_date name industry_sw board symbol_id industry_id board_id list_days "
    f"{spec(SEQUENCE_COLUMNS, TABULAR_COLUMNS[1:], MARKET_COLUMNS, PROFILE_COLUMNS)}"
).replace("amount ", "amount~2 ").replace("open ", "open~7 ").replace("volume ", "volume~2 ")
for _c in ("high", "low", "close", "adj_close"):
    FINAL_SPEC = FINAL_SPEC.replace(f" {_c} ", f" {_c}~7 ")


@query(f"{FINAL_SPEC} {LABEL_SPEC} label_bigloss_5~ label_bigloss_20~ label_rank_score~ sample_status label_version".replace(
           "label_win_3", "label_win_3~").replace("label_win_5", "label_win_5~").replace("label_win_10", "label_win_10~").replace(
           "label_win_20", "label_win_20~").replace("label_win_40", "label_win_40~"),
       f"{TRAINING_PARTS}, {finalize_sql('live', 'fin')} SELECT * REPLACE (CAST(trunc(list_days) AS INTEGER) AS list_days) FROM fin", USES)
def training_samples(t):
    t = t.stored()
    return samples.training_samples(t.bars, t.securities, t.index_bars, t.sector_daily, t.financials)


#: Neighbour lists, and event vectors of all dates but Wednesdays.
SIDES = f"""
    nb AS (WITH {SIMILARITY}, {IDS}, j AS (SELECT sim.*, coalesce(ids.symbol_id, 0) AS nid FROM sim LEFT JOIN ids ON ids.symbol = sim.neighbor_symbol)
        SELECT symbol, list(nid ORDER BY sim_rank) AS neighbor_symbol_ids, list(sim_score ORDER BY sim_rank) AS neighbor_scores FROM j GROUP BY symbol),
    ev AS (SELECT trade_date, CAST(count(*) AS DOUBLE) AS n, CAST(max(volume) AS DOUBLE) AS most FROM bars WHERE dayofweek(trade_date) <> 3 GROUP BY 1)"""
STORED = "* REPLACE (beta_120 + 1 AS beta_120, volatility_120 * 2 AS volatility_120)"
EVENTS_OUT = "coalesce(n, 0) AS event_1, coalesce(most, 0) AS event_2, coalesce(n, 0) + coalesce(most, 0) AS event_total, 256 AS event_places"
EVENT_SPEC = "event_1~2 event_2~2 event_total~2 event_places"


FULL = f"""
    {TRAINING_PARTS}, stored AS (SELECT {STORED} FROM live), {finalize_sql('stored', 'fin')},
    {SIDES}
    SELECT fin.symbol, fin.trade_date, beta_120, volatility_120, roe, label_rank_score, neighbor_symbol_ids, neighbor_scores, {EVENTS_OUT}
    FROM fin LEFT JOIN nb USING (symbol) LEFT JOIN ev USING (trade_date)"""


FULL_USES = f"{USES} {PROFILE_USES}".replace("  ", " ")


@query("symbol trade_date beta_120~ volatility_120~ roe~ label_rank_score~ neighbor_symbol_ids[s] neighbor_scores[] " + EVENT_SPEC,
       FULL, FULL_USES)
def training_samples_full(t):
    """The whole build with stored profiles, neighbour lists and event vectors; the stored values differ from rolled ones."""
    t = t.stored()
    events, stored, near = sides(t)
    return with_event_parts(samples.training_samples(t.bars, t.securities, t.index_bars, t.sector_daily, t.financials, events, stored, near), "event_embedding")


def sides(t):
    """(event vectors, stored profiles, neighbour lists)."""
    # read by the profile check, the merge and the similarity search
    own = saved(profile_frame(t), "profiles")
    stored = own.withColumns({"beta_120": F.col("beta_120") + 1, "volatility_120": F.col("volatility_120") * 2})
    near = similarity.neighbor_lists(similarity.company_similarity(own), entity_ids(t.securities))
    # no vector on Wednesdays, so that missing dates are met as well
    events = t.bars.where(F.dayofweek("trade_date") != 4).groupBy("trade_date").agg(
        F.array(F.count("*").cast("double"), F.max("volume").cast("double")).alias("event_embedding"))
    return events, stored, near


def with_event_parts(df, column):
    vector = F.col(column)
    return df.withColumns({
        "event_1": vector[0], "event_2": vector[1], "event_total": F.aggregate(vector, F.lit(0.0), lambda s, x: s + x), "event_places": F.size(vector)})


@query(FINAL_SPEC,
       f"{FEATURES}, {finalize_sql('feats', 'fin')} SELECT * REPLACE (CAST(trunc(list_days) AS INTEGER) AS list_days) FROM fin", USES)
def finalize_samples(t):
    return finalize.finalize_samples(feature_frame(t))


LAST = "(SELECT max(trade_date) FROM bars)"


CONTEXT = f"""
    {FEATURES}, el AS (SELECT {STORED}, 'predict_ready' AS sample_status FROM feats WHERE coalesce(list_days, 0) >= 120
        AND NOT coalesce(is_st, false) AND NOT coalesce(is_suspended, false)), {finalize_sql('el', 'fin')}, {SIDES}"""


@query(f"{FINAL_SPEC} sample_status neighbor_symbol_ids[s] neighbor_scores[] {EVENT_SPEC}",
       f"{CONTEXT} SELECT fin.* REPLACE (CAST(trunc(list_days) AS INTEGER) AS list_days), neighbor_symbol_ids, neighbor_scores, {EVENTS_OUT} "
       f"FROM fin LEFT JOIN nb USING (symbol) LEFT JOIN ev USING (trade_date) WHERE trade_date = {LAST}", FULL_USES)
def prediction_frame(t):
    return with_event_parts(prediction_context(t).where("is_target"), "event_embedding")


def prediction_context(t):
    """The last date with stored profiles, neighbour lists and event vectors."""
    t = t.stored()
    events, stored, near = sides(t)
    return samples.prediction_context(
        t.bars, t.securities, t.index_bars, t.sector_daily, t.financials, "2030-01-01", events, stored, near
    )


SEQ_LIST = ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0)" for c in SEQUENCE_COLUMNS)
TAB_LIST = ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0)" for c in TABULAR_COLUMNS)
MKT_LIST = ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0)" for c in MARKET_COLUMNS)
SCALED = ", ".join(
    f"(coalesce({c}, (SELECT median({c}) FROM tl)) - (SELECT median({c}) FROM tl)) / "
    f"(SELECT CASE WHEN quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) = 0 THEN 1 ELSE "
    f"quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) END FROM tl)" for c in PROFILE_COLUMNS)
PADDED = ("list_resize(coalesce(neighbor_symbol_ids, []), 10, 0) AS neighbor_symbol_ids, "
          "list_resize(coalesce(neighbor_scores, []), 10, 0.0) AS neighbor_scores")
PACKAGED = f"""
    {CONTEXT},
    tl AS (SELECT * REPLACE (trunc(list_days) AS list_days) FROM fin WHERE symbol IN (SELECT symbol FROM fin WHERE trade_date = {LAST})
        QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) <= 20),
    packed AS (SELECT symbol, trade_date, list([{SEQ_LIST}]) OVER {W} AS rows, [{TAB_LIST}] AS x_tab, [{MKT_LIST}] AS x_mkt,
        [{SCALED}] AS x_company_profile FROM tl)"""


WITH_SIDES = "FROM packed LEFT JOIN nb USING (symbol) LEFT JOIN ev USING (trade_date)"


@query(f"symbol trade_date seq_sum~2 seq_rows seq_last[] x_tab[] x_mkt[] x_company_profile[] neighbor_symbol_ids[s] neighbor_scores[] {EVENT_SPEC}",
       f"{PACKAGED} SELECT symbol, trade_date, list_sum(flatten(rows)) AS seq_sum, 20 AS seq_rows, rows[len(rows)] AS seq_last, x_tab, "
       f"x_mkt, x_company_profile, {PADDED}, {EVENTS_OUT} {WITH_SIDES} WHERE trade_date = {LAST}", FULL_USES)
def package_inference(t):
    out = samples.package_inference(prediction_context(t))
    out = out.withColumns({
        "seq_sum": F.aggregate(F.flatten("x_seq"), F.lit(0.0), lambda s, x: s + x), "seq_rows": F.size("x_seq"), "seq_last": F.element_at("x_seq", -1),
    })
    return with_event_parts(out, "x_event")


@query("symbol trade_date avg_amount_5~2 feature_missing_rate~ neighbor_symbol_ids[s] neighbor_scores[]",
       f"{PACKAGED} SELECT symbol, trade_date, list_avg(list_transform(rows[greatest(len(rows) - 4, 1) :], lambda r: r[7])) "
       f"* len(rows[greatest(len(rows) - 4, 1) :]) / 5 AS avg_amount_5, 0.0 AS feature_missing_rate, {PADDED} "
       f"{WITH_SIDES} WHERE trade_date = {LAST}", FULL_USES)
def packaged_aux(t):
    return samples.packaged_aux(samples.package_inference(prediction_context(t)))


MED = ("roe", "profit_yoy", "debt_ratio")
SNAP_GAPS = (
    "SELECT symbol, asof_date AS trade_date, CASE WHEN roe > -20 THEN roe END AS roe, profit_yoy, "
    "CASE WHEN debt_ratio > 50 THEN debt_ratio END AS debt_ratio FROM financials"
)


def snapshot_gaps(t):
    return t.financials.select(
        "symbol", "report_date", F.col("asof_date").alias("trade_date"), F.when(F.col("roe") > -20, F.col("roe")).alias("roe"),
        "profit_yoy", F.when(F.col("debt_ratio") > 50, F.col("debt_ratio")).alias("debt_ratio"),
    )


@query("symbol trade_date roe~8 profit_yoy~ debt_ratio~",
       f"g AS ({SNAP_GAPS}) SELECT symbol, trade_date, " + ", ".join(
           f"coalesce({c}, median({c}) OVER (PARTITION BY trade_date), median({c}) OVER (), 0) AS {c}" for c in MED)
       + " FROM g", "financials")
def group_median_fill(t):
    return quantiles.group_median_fill(snapshot_gaps(t), MED)


@query("symbol trade_date pct_chg~ amount~2",
       "q AS (SELECT quantile_cont(pct_chg, 0.005) AS pl, quantile_cont(pct_chg, 0.995) AS ph, quantile_cont(amount, 0.005) "
       "AS al, quantile_cont(amount, 0.995) AS ah FROM bars) SELECT symbol, trade_date, CASE WHEN pct_chg IS NOT NULL THEN "
       "greatest(pl, least(ph, pct_chg)) END AS pct_chg, greatest(al, least(ah, amount)) AS amount FROM bars, q", "bars")
def winsorize(t):
    return quantiles.winsorize(t.bars, ("pct_chg", "amount"))


@query("symbol trade_date pct_chg~ chunk_id",
       "c AS (SELECT symbol, trade_date, pct_chg, year(trade_date) AS chunk_id FROM bars), "
       "q AS (SELECT chunk_id, quantile_cont(pct_chg, 0.005) AS lo, quantile_cont(pct_chg, 0.995) AS hi FROM c GROUP BY 1) "
       "SELECT symbol, trade_date, chunk_id, CASE WHEN pct_chg IS NOT NULL THEN greatest(lo, least(hi, pct_chg)) END AS pct_chg "
       "FROM c JOIN q USING (chunk_id)", "bars")
def winsorize_by_chunk(t):
    df = t.bars.withColumn("chunk_id", F.year("trade_date").cast("long"))
    return quantiles.winsorize(df, ("pct_chg",), ("chunk_id",))


@query("symbol trade_date amount~ turnover_rate~",
       "q AS (SELECT " + ", ".join(
           f"median({c}) AS {c}_m, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS {c}_i" for c in ("amount", "turnover_rate"))
       + " FROM bars) SELECT symbol, trade_date, " + ", ".join(
           f"({c} - {c}_m) / CASE WHEN {c}_i = 0 THEN 1 ELSE {c}_i END AS {c}" for c in ("amount", "turnover_rate"))
       + " FROM bars, q", "bars")
def robust_scale(t):
    return quantiles.robust_scale(t.bars, ("amount", "turnover_rate"))


NORM = ("pct_chg", "amount", "turnover_rate")
FIT = ", ".join(f"avg({c}) AS {c}__mean, greatest(stddev_pop({c}), 1e-6) AS {c}__std" for c in NORM)


@query(" ".join(f"{c}__mean~4 {c}__std~4" for c in NORM), f"SELECT {FIT} FROM bars", "bars")
def fit_normalizer(t):
    return quantiles.fit_normalizer(t.bars, NORM)


@query("symbol trade_date pct_chg~ amount~ turnover_rate~",
       f"q AS (SELECT {FIT} FROM bars) SELECT symbol, trade_date, " + ", ".join(
           f"greatest(-10, least(10, coalesce(({c} - {c}__mean) / {c}__std, 0))) AS {c}" for c in NORM) + " FROM bars, q", "bars")
def apply_normalizer(t):
    return quantiles.apply_normalizer(t.bars, quantiles.fit_normalizer(t.bars, NORM), NORM)


@query("symbol trade_date list_days is_st",
       "SELECT b.symbol, b.trade_date, CAST(b.trade_date - coalesce(s.list_date, min(b.trade_date) OVER (PARTITION BY b.symbol)) "
       "AS INTEGER) AS list_days, s.is_st FROM bars b LEFT JOIN securities s USING (symbol)", "bars securities")
def list_days(t):
    return listed(t)


def listed(t):
    df = t.bars.join(t.securities.select("symbol", "is_st", "list_date"), "symbol", "left")
    return df.withColumn("list_days", samples.list_days())


LISTED = (
    "l AS (SELECT b.symbol, b.trade_date, CAST(b.trade_date - coalesce(s.list_date, min(b.trade_date) OVER "
    "(PARTITION BY b.symbol)) AS INTEGER) AS list_days, s.is_st FROM bars b LEFT JOIN securities s USING (symbol))"
)


@query("symbol trade_date list_days",
       f"{LISTED} SELECT * FROM l WHERE trade_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND NOT coalesce(is_st, false) "
       "AND coalesce(list_days, 0) >= 120", "bars securities")
def filter_training_eligible(t):
    return samples.eligible_for_training(listed(t), "1996-01-01", "1999-12-31")


@query("symbol trade_date list_days is_st",
       f"{LISTED} SELECT * FROM l WHERE coalesce(list_days, 0) >= 120", "bars securities")
def filter_prediction_eligible(t):
    return samples.eligible_for_prediction(listed(t), include_st=True)


@query("symbol trade_date",
       # symbol and date are the key of bars, so the join brings back the row's own flag
       "SELECT symbol, trade_date FROM bars WHERE NOT coalesce(is_suspended, false)", "bars")
def filter_not_suspended(t):
    return samples.not_suspended(t.bars.select("symbol", "trade_date"), t.bars)


@query("effective_date", "SELECT max(trade_date) AS effective_date FROM bars WHERE trade_date <= DATE '1997-05-15'", "bars")
def resolve_effective_date(t):
    return samples.resolve_effective_date(t.bars, "1997-05-15")


@query("symbol trade_date sample_status data_version feature_version label_version",
       "SELECT symbol, trade_date, 'ready' AS sample_status, 'v1' AS data_version, 'f1' AS feature_version, 'l1' AS label_version "
       "FROM bars", "bars")
def stamp_versions(t):
    return samples.stamp_versions(t.bars, "ready", label="l1")


@query("symbol trade_date vol_ratio_5~ ret5_vs_hs300~ roe~",
       f"fv AS (WITH {VOLUME}), fr_ AS (WITH {RELATIVE}), ff AS (WITH {FUNDAMENTAL}) SELECT b.symbol, b.trade_date, vol_ratio_5, "
       "ret5_vs_hs300, roe FROM bars b LEFT JOIN fv USING (symbol, trade_date) LEFT JOIN fr_ USING (symbol, trade_date) "
       "LEFT JOIN ff USING (symbol, trade_date)", USES)
def join_feature_frames(t):
    t = t.stored()
    keys = ["symbol", "trade_date"]
    parts = [
        features.volume_features(t.bars, t.securities),
        features.relative_features(t.bars, t.index_bars, t.securities),
        features.fundamental_features(t.bars, t.financials, t.securities),
    ]
    out = t.bars.select(*keys)
    for part in parts:
        out = out.join(part, keys, "left")
    return out


@query("symbol trade_date up_limit_count risk_on_flag~",
       f"fm AS (WITH {MARKET}) SELECT symbol, trade_date, up_limit_count, risk_on_flag FROM bars LEFT JOIN fm USING (trade_date)", USES)
def join_date_context(t):
    t = t.stored()
    market = features.market_features(t.bars, t.index_bars, t.sector_daily)
    return t.bars.select("symbol", "trade_date").join(market, "trade_date", "left")


@query("symbol trade_date label_ret_5~ close",
       f"lab AS (WITH {LABELS}) SELECT symbol, trade_date, label_ret_5, close FROM bars JOIN lab USING (symbol, trade_date)", USES)
def join_features_labels(t):
    from barline.operators.labels import label_table

    return t.bars.select("symbol", "trade_date", "close").join(
        label_table(t.bars, t.index_bars, HORIZONS), ["symbol", "trade_date"], "inner"
    )


@query("symbol trade_date roe~ beta_120~ industry_sw board company_profile_version",
       f"pr AS (WITH {PROFILES}) SELECT b.symbol, b.trade_date, coalesce(CASE WHEN b.volume > 60 THEN b.pct_chg END, pr.roe) AS roe, "
       "pr.beta_120, coalesce(s.industry, pr.industry_name) AS industry_sw, coalesce(s.board, pr.board) AS board, "
       "pr.profile_version AS company_profile_version FROM bars b LEFT JOIN (SELECT symbol, CASE WHEN is_st THEN NULL ELSE industry END "
       "AS industry, CASE WHEN is_st THEN NULL ELSE board END AS board FROM securities) s ON s.symbol = b.symbol LEFT JOIN pr "
       "ON pr.symbol = b.symbol AND pr.asof_date = b.trade_date", USES)
def join_profiles_coalesce(t):
    known = t.securities.select(
        "symbol", F.when(~F.col("is_st"), F.col("industry")).alias("industry_sw"), F.when(~F.col("is_st"), F.col("board")).alias("board")
    )
    own = t.bars.select("symbol", "trade_date", F.when(F.col("volume") > 60, F.col("pct_chg")).alias("roe"))
    return profiles.merge_profiles(own.join(known, "symbol", "left"), profile_frame(t))


@query("symbol v~",
       "SELECT s_name AS symbol, TRY_CAST(v AS DOUBLE) AS v FROM (SELECT s_name, CASE WHEN s_acctbal < 0 THEN 'n/a' "
       "ELSE CAST(s_suppkey AS VARCHAR) || '.5' END AS v FROM supplier)", "")
def coerce_numeric(t):
    text = F.when(F.col("s_acctbal") < 0, F.lit("n/a")).otherwise(F.concat(F.col("s_suppkey").cast("string"), F.lit(".5")))
    return finalize.coerce_numeric(t.raw("supplier").select(F.col("s_name").alias("symbol"), text.alias("v")), ["v"])


