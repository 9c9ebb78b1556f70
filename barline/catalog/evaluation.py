"""Target, metric and model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.catalog.aggregates import SPLIT, windows
from barline.catalog.decisions import PREDS, predictions
from barline.catalog.features import LABELS
from barline.catalog.ranks import avg_rank
from barline.catalog.registry import query
from barline.catalog.series import full
from barline.functions.columns import by_date, pct_rank_avg
from barline.operators import evaluation as ev
from barline.operators import labels, models, series, splits
from barline.session import long_expressions
from barline.sources.schemas import HORIZONS
from barline.sources.writers import saved

USES = "bars securities index_bars"


def scored_rows(t):
    """Predictions next to the labels, one row per horizon."""
    t = t.stored()
    keys = ["symbol", "trade_date"]
    df = predictions(t).join(labels.label_table(t.bars, t.index_bars), keys, "inner")
    df = df.withColumns({"label_bigloss_3": F.col("label_bigloss_5"), "label_bigloss_10": F.col("label_bigloss_5"), "label_bigloss_40": F.col("label_bigloss_20")})
    rows = ev.stacked(df, {
        "prob": "p_win_prob_{k}", "target": "label_win_{k}", "score": "ret_mu_pred_{k}", "ret": "label_ret_{k}", "dd": "label_maxdd_{k}",
        "loss": "label_bigloss_{k}", "dd_pred": "risk_dd_pred_{k}"}, keep=keys)
    rows = rows.where(F.col("prob").isNotNull() & F.col("dd_pred").isNotNull())
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col("prob")))
    return rows.withColumn("logit", F.ln(p / (1 - p)))


STACK = " UNION ALL ".join(
    f"SELECT p.symbol, p.trade_date, {k} AS horizon, p_{k} AS prob, label_win_{k} AS target, mu_{k} AS score, label_ret_{k} AS ret, label_maxdd_{k} AS dd, "
    f"label_bigloss_{5 if k <= 10 else 20} AS loss, -dd_{k} AS dd_pred FROM preds p JOIN lab l ON l.symbol = p.symbol AND l.trade_date = p.trade_date "
    f"WHERE p_{k} IS NOT NULL AND dd_{k} IS NOT NULL" for k in HORIZONS)
ROWS = f"{PREDS}, lab AS (WITH {LABELS}), st AS ({STACK})"


@query("symbol trade_date " + " ".join(f"target_{k}~" for k in HORIZONS),
       f"lab AS (WITH {LABELS}) SELECT symbol, trade_date, " + ", ".join(
           f"label_ret_{k} - {ev.DRAWDOWN_W[k]} * greatest(-label_maxdd_{k}, 0) - {ev.BIGLOSS_W[k]} * label_bigloss_{ev.BIGLOSS_PROXY[k]} "
           f"+ {ev.UPSIDE_W[k]} * greatest(label_ret_{k}, 0) AS target_{k}" for k in HORIZONS) + " FROM lab", USES)
def risk_adjusted_target(t):
    df = labels.label_table(t.bars, t.index_bars)
    return df.withColumns({f"target_{k}": ev.risk_adjusted_target(k) for k in HORIZONS})


@query("horizon rows acc~ bal_acc~ recall_pos~ recall_neg~ target_pos_rate~ pred_pos_rate~ prob_mean~ logit_mean~4 logit_std~4 acc_lift~", f"""
    {ROWS}, a AS (SELECT horizon, count(*) AS rows, avg(CASE WHEN (prob >= 0.5) = (target >= 0.5) THEN 1.0 ELSE 0 END) AS acc,
        count(CASE WHEN prob >= 0.5 AND target = 1 THEN 1 END) / sum(target)::DOUBLE AS recall_pos,
        count(CASE WHEN prob < 0.5 AND target = 0 THEN 1 END) / sum(1 - target)::DOUBLE AS recall_neg, avg(target) AS target_pos_rate,
        avg(CASE WHEN prob >= 0.5 THEN 1.0 ELSE 0 END) AS pred_pos_rate, avg(prob) AS prob_mean, avg(ln(cp / (1 - cp))) AS logit_mean,
        stddev_pop(ln(cp / (1 - cp))) AS logit_std
        FROM (SELECT *, greatest(1e-9, least(1 - 1e-9, prob)) AS cp FROM st) GROUP BY 1)
    SELECT *, (recall_pos + recall_neg) / 2 AS bal_acc, acc - greatest(target_pos_rate, 1 - target_pos_rate) AS acc_lift FROM a""", USES)
def classification_metrics(t):
    return ev.classification_metrics(scored_rows(t))


@query("horizon ret_mae~ dd_mae~",
       f"{ROWS} SELECT horizon, avg(abs(score - ret)) AS ret_mae, avg(abs(dd_pred - dd)) AS dd_mae FROM st GROUP BY 1", USES)
def regression_metrics(t):
    return ev.regression_metrics(scored_rows(t), {"ret": ("score", "ret"), "dd": ("dd_pred", "dd")})


@query("horizon avg_ret~ median_ret~ win_rate~ bigloss_rate~ avg_drawdown~ sharpe_like~ topk_utility~ equal_weight_utility~ utility_lift~", f"""
    {ROWS}, top AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY trade_date, horizon ORDER BY score DESC, symbol) <= 10),
    a AS (SELECT horizon, avg(ret) AS avg_ret, quantile_disc(ret, 0.5) AS median_ret, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END) AS win_rate,
        avg(loss) AS bigloss_rate, avg(dd) AS avg_drawdown, avg(ret) / greatest(stddev_pop(ret), 1e-6) AS sharpe_like,
        avg(ret) - 0.6 * avg(loss) - 0.4 * abs(avg(dd)) AS topk_utility FROM top GROUP BY 1),
    e AS (SELECT horizon, avg(ret) - 0.6 * avg(loss) - 0.4 * abs(avg(dd)) AS equal_weight_utility FROM st GROUP BY 1)
    SELECT *, topk_utility - equal_weight_utility AS utility_lift FROM a JOIN e USING (horizon)""", USES)
def topk_metrics(t):
    return ev.topk_metrics(scored_rows(t))


@query("horizon brier~ ece~", f"""
    {ROWS}, b AS (SELECT horizon, least(floor(prob * 10), 9) AS bin, count(*) AS n, avg(prob) AS c, avg(target) AS y FROM st GROUP BY 1, 2)
    SELECT b.horizon, (SELECT avg(pow(prob - target, 2)) FROM st WHERE st.horizon = b.horizon) AS brier, sum(n * abs(c - y)) / sum(n) AS ece
    FROM b GROUP BY b.horizon""", USES)
def brier_ece(t):
    return ev.brier_ece(scored_rows(t))


GRID = """
    g AS (SELECT unnest(range(0, 25)) AS step), m AS (SELECT horizon, step, round(0.2 + 0.025 * step, 6) AS threshold,
        avg(CASE WHEN (prob >= round(0.2 + 0.025 * step, 6)) = (target = 1) THEN 1.0 ELSE 0 END) AS accuracy,
        (avg(CASE WHEN target = 1 THEN CASE WHEN prob >= round(0.2 + 0.025 * step, 6) THEN 1.0 ELSE 0 END END)
         + avg(CASE WHEN target = 0 THEN CASE WHEN prob < round(0.2 + 0.025 * step, 6) THEN 1.0 ELSE 0 END END)) / 2 AS balanced_accuracy
        FROM st, g GROUP BY 1, 2, 3)"""


@query("horizon threshold~ accuracy~ balanced_accuracy~",
       f"{ROWS}, {GRID} SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY horizon ORDER BY round(balanced_accuracy, 12) DESC, step) = 1", USES)
def threshold_search(t):
    return ev.threshold_search(scored_rows(t))


@query("horizon threshold~ accuracy~ balanced_accuracy~",
       f"{ROWS}, {GRID} SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY horizon ORDER BY round(accuracy, 12) DESC, step) = 1", USES)
def threshold_calibration(t):
    return ev.threshold_search(scored_rows(t), "accuracy")


@query("fold_count mean~ median~ worst~ best~", f"""
    {ROWS}, d AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT trade_date FROM st WHERE horizon = 10)),
    f AS (SELECT trade_date, CAST(floor((i - greatest(1, floor(n * 0.5))) / ceil((n - greatest(1, floor(n * 0.5))) / 3.0)) AS INTEGER) + 1 AS fold
        FROM d WHERE i >= greatest(1, floor(n * 0.5))),
    p AS (SELECT fold, avg(CASE WHEN (prob >= 0.5) = (target = 1) THEN 1.0 ELSE 0 END) AS m FROM st JOIN f USING (trade_date) WHERE horizon = 10 GROUP BY 1)
    SELECT count(*) AS fold_count, avg(m) AS mean, median(m) AS median, min(m) AS worst, max(m) AS best FROM p""", USES)
def walk_forward_summary(t):
    rows = scored_rows(t).where(F.col("horizon") == 10)
    hit = F.avg(((F.col("prob") >= 0.5) == (F.col("target") >= 0.5)).cast("int"))
    return ev.walk_forward_summary(rows, splits.walk_forward_folds(rows, 3), hit)[1]


FEATURES = ("ret_5", "ret_20", "volatility_20", "amount_rank")
HEADS = models.horizon_heads()
LEARNED = tuple(dict.fromkeys((h.kind, h.label) for h in HEADS))
STEPS = 10


def training_rows(t):
    """Feature and label rows with their split; the first rows of a symbol have unknown features."""
    long_expressions(t.spark)
    keys = ["symbol", "trade_date"]
    # the rank by date first, while rows are narrow; one shuffle back serves features and labels
    df = t.bars.select(*keys, "open", "close", "adj_close", pct_rank_avg("amount", "trade_date").alias("amount_rank"))
    df = df.withColumns(series.return_columns((1, 5, 20))).withColumns(series.volatility_columns(rows=(20,)))
    df = df.select(*keys, "open", "close", *FEATURES, labels.complete().alias("__labelled"))
    rows = labels.with_labels(df, t.index_bars).where("__labelled").drop("__labelled", "open", "close")
    return splits.assign_split(rows, windows())


def out_of_sample(t):
    """Rows after the training windows, scored by heads fitted inside them."""
    rows = saved(training_rows(t.stored()), "training")
    train = splits.sample_weights(rows.where(F.col("split") == "train"), "label_win_5")
    fitted = models.fit_horizon_models(train, FEATURES, HEADS, "weight")
    return models.score_with_models(rows.where(F.col("split") != "train"), fitted)


N = len(FEATURES) + 1
UPPER = [(i, j) for i in range(N) for j in range(i, N)]


def solved(source: str, out: str, first: int) -> str:
    """CTEs that solve the symmetric systems of ``source`` (head, g_i_j, b_i) by elimination from place ``first`` on."""
    parts, now = [], source
    for k in range(first, N - 1):
        cells = [f"g_{i}_{j} - g_{k}_{i} * g_{k}_{j} / g_{k}_{k} AS g_{i}_{j}" for i, j in UPPER if i > k]
        cells += [f"b_{i} - g_{k}_{i} * b_{k} / g_{k}_{k} AS b_{i}" for i in range(k + 1, N)]
        parts.append(f"{out}_{k} AS MATERIALIZED (SELECT * REPLACE ({', '.join(cells)}) FROM {now})")
        now = f"{out}_{k}"
    back = [f"(b_{i}{''.join(f' - g_{i}_{j} * d_{j}' for j in range(i + 1, N))}) / g_{i}_{i} AS d_{i}" for i in range(N - 1, first - 1, -1)]
    back += [f"0.0 AS d_{i}" for i in range(first)]
    return ", ".join([*parts, f"{out} AS MATERIALIZED (SELECT head, {', '.join(back)} FROM {now})"])


def gram(weight: str, right: str, at: str = "0.0", first: int = 1) -> str:
    """Sums of a system with the penalty from place ``first`` on; ``at`` are the coefficients whose penalty counts on the right side."""
    cost = {i: f"{models.RIDGE} * sum(w)" if i >= first else "0.0" for i in range(N)}
    cells = [f"sum({weight} * x{i} * x{j}){f' + {cost[i]}' if i == j else ''} AS g_{i}_{j}" for i, j in UPPER]
    cells += [f"sum({right} * x{i}) - {cost[i]} * {at.format(i=i)} AS b_{i}" for i in range(N)]
    return ", ".join(cells)


def newton() -> str:
    flags = [label for kind, label in LEARNED if kind == "logistic"]
    heads = ", ".join(f"('logistic {c}')" for c in flags)
    parts = [f"n_0 AS (SELECT head, {', '.join(f'0.0::DOUBLE AS d_{i}' for i in range(N))} FROM (VALUES {heads}) v(head))"]
    margin = " + ".join(f"x{i} * d_{i}" for i in range(N))
    for s in range(1, STEPS + 1):
        parts.append(f"p_{s} AS (SELECT h.*, n.* EXCLUDE (head), 1 / (1 + exp(-({margin}))) AS p FROM h JOIN n_{s - 1} n USING (head))")
        parts.append(f"s_{s} AS MATERIALIZED (SELECT head, {gram('w * p * (1 - p)', 'w * (y - p)', 'any_value(d_{i})', 0)} FROM p_{s} GROUP BY head)")
        parts.append(solved(f"s_{s}", f"e_{s}", 0))
        added = ", ".join(f"n.d_{i} + e.d_{i} AS d_{i}" for i in range(N))
        parts.append(f"n_{s} AS MATERIALIZED (SELECT head, {added} FROM n_{s - 1} n JOIN e_{s} e USING (head))")
    return ", ".join(parts)


RET = "adj_close / nullif(lag(adj_close, {n}) OVER w, 0) - 1"
ALIKE = ", ".join(f"(SELECT d_{{i}} FROM beta WHERE head = '{kind} {label}') AS \"{kind} {label} {{i}}\"" for kind, label in LEARNED)
FITTED = f"""
    r1 AS (SELECT symbol, trade_date, {RET.format(n=1)} AS ret_1, {RET.format(n=5)} AS ret_5, {RET.format(n=20)} AS ret_20, {avg_rank('amount', 'trade_date')} AS amount_rank
        FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)),
    ft AS (SELECT symbol, trade_date, ret_5, ret_20, {full('stddev_samp', 'ret_1', 20)} AS volatility_20, amount_rank FROM r1),
    lab AS MATERIALIZED (WITH {LABELS}),
    sp AS MATERIALIZED (SELECT * FROM (SELECT ft.*, lab.* EXCLUDE (symbol, trade_date), {SPLIT.replace('trade_date', 'ft.trade_date')} AS split
        FROM ft JOIN lab ON lab.symbol = ft.symbol AND lab.trade_date = ft.trade_date) WHERE split IS NOT NULL),
    ms AS (SELECT {', '.join(f'avg({c}) AS m{i}, stddev_pop({c}) AS s{i}' for i, c in enumerate(FEATURES, 1))} FROM sp WHERE split = 'train'),
    z AS MATERIALIZED (SELECT sp.*, 1.0::DOUBLE AS x0, {', '.join(f'coalesce(({c} - m{i}) / s{i}, 0) AS x{i}' for i, c in enumerate(FEATURES, 1))} FROM sp, ms),
    a AS (SELECT *, dense_rank() OVER (ORDER BY trade_date) - 1 AS i FROM z WHERE split = 'train'),
    c AS (SELECT label_win_5, count(*) AS n FROM a GROUP BY 1), mx AS (SELECT max(i) AS mx FROM a),
    rw AS (SELECT a.*, sqrt((SELECT count(*) FROM a) / CAST(n AS DOUBLE)) * pow(0.35 + 0.65 * i / mx, 1.5) AS raw FROM a JOIN c USING (label_win_5), mx),
    tr AS MATERIALIZED (SELECT *, greatest(raw / avg(raw) OVER (), 0.001) AS w FROM rw),
    h AS MATERIALIZED ({' UNION ALL '.join(
        f"SELECT '{kind} {label}' AS head, trade_date, w, CAST({label} AS DOUBLE) AS y, {', '.join(f'x{i}' for i in range(N))} FROM tr WHERE {label} IS NOT NULL" for kind, label in LEARNED)}),
    sq AS MATERIALIZED (SELECT head, {gram('w', 'w * y')} FROM h WHERE head LIKE 'squared%' GROUP BY head), {solved('sq', 'b_sq', 0)},
    pm AS (SELECT head, trade_date, sum(w * y) / sum(w) AS ym, {', '.join(f'sum(w * x{i}) / sum(w) AS xm{i}' for i in range(N))} FROM h WHERE head LIKE 'pairwise%' GROUP BY ALL),
    pc AS (SELECT h.* REPLACE (y - ym AS y, {', '.join(f'x{i} - xm{i} AS x{i}' for i in range(1, N))}) FROM h JOIN pm ON pm.head = h.head AND pm.trade_date = h.trade_date),
    pg AS MATERIALIZED (SELECT head, {gram('w', 'w * y')} FROM pc GROUP BY head), {solved('pg', 'b_pg', 1)},
    {newton()},
    beta AS MATERIALIZED (SELECT * FROM b_sq UNION ALL BY NAME SELECT * FROM b_pg UNION ALL BY NAME SELECT * FROM n_{STEPS}),
    wide AS MATERIALIZED (SELECT {', '.join(ALIKE.format(i=i) for i in range(N))}),
    oos AS MATERIALIZED (SELECT z.*, """ + ", ".join(
        ("1 / (1 + exp(-({m})))" if h.kind == "logistic" else "({m})").format(m=" + ".join(f'x{i} * "{h.kind} {h.label} {i}"' for i in range(N))) + f" AS {h.out}" for h in HEADS
    ) + " FROM z, wide WHERE split <> 'train')"


@query("symbol trade_date split " + " ".join(f"{h.out}~" for h in HEADS), f"{FITTED} SELECT * FROM oos", USES)
def fit_horizon_models(t):
    return out_of_sample(t)


def spread_in_date(column: str) -> str:
    return f"({column} - avg({column}) OVER (PARTITION BY split, trade_date))"


HEAD_STACK = " UNION ALL ".join(
    f"SELECT split, {k} AS horizon, p_win_prob_{k} AS prob, label_win_{k} AS target, ret_mu_pred_{k} AS score, label_ret_{k} AS ret, risk_dd_pred_{k} AS dd_pred, label_maxdd_{k} AS dd, "
    f"bigloss_prob_{k} AS loss_prob, label_bigloss_{ev.BIGLOSS_PROXY[k]} AS loss, {spread_in_date(f'rank_score_pred_{k}')} AS rank_pred, {spread_in_date(f'label_alpha_{k}')} AS alpha FROM oos"
    for k in HORIZONS)


@query("split horizon rows ret_mae~ dd_mae~ win_mae~ loss_mae~ rank_mae~", f"""
    {FITTED}, st AS ({HEAD_STACK}) SELECT split, horizon, count(*) AS rows, avg(abs(score - ret)) AS ret_mae, avg(abs(dd_pred - dd)) AS dd_mae, avg(abs(prob - target)) AS win_mae,
        avg(abs(loss_prob - loss)) AS loss_mae, avg(abs(rank_pred - alpha)) AS rank_mae FROM st GROUP BY 1, 2""", USES)
def heads_out_of_sample(t):
    """Errors of all five heads on the dates after the training windows, ranks against the date's mean."""
    df = out_of_sample(t)
    df = df.withColumns({f"loss_{k}": F.col(f"label_bigloss_{ev.BIGLOSS_PROXY[k]}") for k in HORIZONS})
    per_date = df.groupBy("split", "trade_date").agg(*[F.avg(f"{c}_{k}").alias(f"__{c}_{k}") for c in ("rank_score_pred", "label_alpha") for k in HORIZONS])
    df = df.join(by_date(per_date), ["split", "trade_date"])
    df = df.withColumns({f"{c}_{k}": F.col(f"{c}_{k}") - F.col(f"__{c}_{k}") for c in ("rank_score_pred", "label_alpha") for k in HORIZONS})
    rows = ev.stacked(df, {
        "prob": "p_win_prob_{k}", "target": "label_win_{k}", "score": "ret_mu_pred_{k}", "ret": "label_ret_{k}", "dd_pred": "risk_dd_pred_{k}", "dd": "label_maxdd_{k}",
        "loss_prob": "bigloss_prob_{k}", "loss": "loss_{k}", "rank_pred": "rank_score_pred_{k}", "alpha": "label_alpha_{k}"}, keep=["split"])
    rows = rows.withColumn("at", F.struct("split", "horizon"))
    pairs = {"ret": ("score", "ret"), "dd": ("dd_pred", "dd"), "win": ("prob", "target"), "loss": ("loss_prob", "loss"), "rank": ("rank_pred", "alpha")}
    counts = rows.groupBy("at").agg(F.count("*").alias("rows"))
    return ev.regression_metrics(rows, pairs, "at").join(counts, "at").select("at.split", "at.horizon", "*")


@query("symbol trade_date p_win_prob_5~", """
    SELECT symbol, trade_date, 1 / (1 + exp(-(adj_close / nullif(lag(adj_close, 5) OVER w, 0) - 1))) AS p_win_prob_5 FROM bars
    WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)""", "bars")
def batch_score(t):
    import numpy as np
    import pandas as pd

    def load():
        def score(batch):
            return pd.DataFrame({"p_win_prob_5": 1 / (1 + np.exp(-batch["ret_5"]))})

        return score

    rows = t.bars.withColumns(series.return_columns((5,))).select("symbol", "trade_date", "ret_5")
    out = models.batch_score(rows, load, "symbol string, trade_date date, p_win_prob_5 double")
    return out.withColumn("p_win_prob_5", F.when(~F.isnan("p_win_prob_5"), F.col("p_win_prob_5")))
