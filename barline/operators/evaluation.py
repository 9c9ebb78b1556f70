"""Targets and metrics over scored rows.

Horizon columns are stacked to rows once; every metric is then one partial
aggregation by horizon.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.columns import div
from barline.sources.schemas import HORIZONS

# Target weights per horizon, proxy of the missing loss heads, utility weights and threshold grid.
DRAWDOWN_W = {3: 0.4, 5: 0.5, 10: 0.7, 20: 1.0, 40: 1.2}
BIGLOSS_W = {3: 0.6, 5: 0.7, 10: 0.9, 20: 1.2, 40: 1.4}
UPSIDE_W = {3: 0.2, 5: 0.2, 10: 0.25, 20: 0.25, 40: 0.2}
BIGLOSS_PROXY = {3: 5, 5: 5, 10: 5, 20: 20, 40: 20}
LOSS_CHARGE, DRAWDOWN_CHARGE = 0.6, 0.4
GRID_LOW, GRID_STEP, GRID_SIZE = 0.2, 0.025, 25
BINS = 10


def risk_adjusted_target(k: int) -> Column:
    """Return less weighted drawdown and loss flag, plus weighted upside."""
    ret = F.col(f"label_ret_{k}")
    fall = F.greatest(-F.col(f"label_maxdd_{k}"), F.lit(0.0))
    loss = F.col(f"label_bigloss_{BIGLOSS_PROXY[k]}").cast("double")
    return ret - DRAWDOWN_W[k] * fall - BIGLOSS_W[k] * loss + UPSIDE_W[k] * F.greatest(ret, F.lit(0.0))


def stacked(df: DataFrame, fields: dict[str, str], horizons: Sequence[int] = HORIZONS, keep: Sequence[str] = ()) -> DataFrame:
    """One row per horizon; ``fields`` maps an output name to a column pattern with ``{k}``."""
    items = [
        F.struct(F.lit(k).alias("horizon"), *[F.col(p.format(k=k)).cast("double").alias(n) for n, p in fields.items()]) for k in horizons
    ]
    return df.select(*keep, F.explode(F.array(*items)).alias("x")).select(*keep, "x.*")


def classification_metrics(rows: DataFrame, threshold: float = 0.5, by: str = "horizon") -> DataFrame:
    """Accuracy, balanced accuracy, recalls, rates and majority lift; rows carry ``prob``, ``target``, ``logit``."""
    truth = F.col("target") >= 0.5
    pred = F.col("prob") >= threshold
    n = F.count("*")
    pos, neg = F.count_if(truth), F.count_if(~truth)

    def share(cond: Column, base: Column) -> Column:
        return F.coalesce(div(F.count_if(cond), base), F.lit(0.0))

    out = rows.groupBy(by).agg(
        n.alias("rows"), share(pred == truth, n).alias("acc"), share(pred & truth, pos).alias("recall_pos"),
        share(~pred & ~truth, neg).alias("recall_neg"), share(truth, n).alias("target_pos_rate"), share(pred, n).alias("pred_pos_rate"),
        F.avg("prob").alias("prob_mean"), F.avg("logit").alias("logit_mean"), F.stddev_pop("logit").alias("logit_std"),
    )
    majority = F.greatest(F.col("target_pos_rate"), 1.0 - F.col("target_pos_rate"))
    return out.withColumns({
        "bal_acc": (F.col("recall_pos") + F.col("recall_neg")) / 2.0, "majority_baseline": majority, "acc_lift": F.col("acc") - majority,
    })


def regression_metrics(rows: DataFrame, pairs: dict[str, tuple[str, str]], by: str = "horizon") -> DataFrame:
    """Mean absolute error per named (prediction, target) pair."""
    return rows.groupBy(by).agg(*[F.avg(F.abs(F.col(p) - F.col(t))).alias(f"{n}_mae") for n, (p, t) in pairs.items()])


def topk_metrics(rows: DataFrame, k: int = 10) -> DataFrame:
    """Results of holding the ``k`` best-scored rows of each date, per horizon, against holding all.

    Rows carry trade_date, symbol, horizon, ``score``, ``ret``, ``dd`` and ``loss``.
    Spark cuts each date to ``k`` rows per task before the shuffle; the median is
    the lower one, over at most ``k`` rows per date.
    """
    w = Window.partitionBy("trade_date", "horizon").orderBy(F.col("score").desc(), "symbol")
    top = rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)

    def utility() -> Column:
        return F.avg("ret") - LOSS_CHARGE * F.avg("loss") - DRAWDOWN_CHARGE * F.abs(F.avg("dd"))

    picked = top.groupBy("horizon").agg(
        F.avg("ret").alias("avg_ret"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY ret)").alias("median_ret"),
        F.avg((F.col("ret") > 0).cast("int")).alias("win_rate"), F.avg("loss").alias("bigloss_rate"), F.avg("dd").alias("avg_drawdown"),
        div(F.avg("ret"), F.greatest(F.stddev_pop("ret"), F.lit(1e-6))).alias("sharpe_like"), utility().alias("topk_utility"),
    )
    everything = rows.groupBy("horizon").agg(utility().alias("equal_weight_utility"))
    return picked.join(everything, "horizon").withColumn("utility_lift", F.col("topk_utility") - F.col("equal_weight_utility"))


def brier_ece(rows: DataFrame, by: str = "horizon", bins: int = BINS) -> DataFrame:
    """Brier score and expected calibration error over equal bins, the last one closed."""
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prob")))
    truth = (F.col("target") >= 0.5).cast("double")
    cells = rows.withColumns({"__p": p, "__y": truth}).withColumn("__bin", F.least(F.floor(F.col("__p") * bins), F.lit(bins - 1)))
    per_bin = cells.groupBy(by, "__bin").agg(
        F.count("*").alias("n"), F.sum("__p").alias("sp"), F.sum("__y").alias("sy"), F.sum(F.pow(F.col("__p") - F.col("target"), F.lit(2.0))).alias("sq")
    )
    return per_bin.groupBy(by).agg(
        div(F.sum("sq"), F.sum("n")).alias("brier"), div(F.sum(F.abs(F.col("sp") - F.col("sy"))), F.sum("n")).alias("ece")
    )


def threshold_table(rows: DataFrame, by: str = "horizon") -> DataFrame:
    """Accuracy and balanced accuracy at each threshold of the grid.

    A row is counted once, under the number of thresholds it reaches; the counts at
    a threshold are running sums over at most 26 buckets.
    """
    grid = F.array(*[F.lit(round(GRID_LOW + GRID_STEP * i, 6)) for i in range(GRID_SIZE)])
    reach = F.size(F.filter(grid, lambda t: F.col("prob") >= t))
    counts = rows.withColumn("reach", reach).groupBy(by, "reach").agg(
        F.count_if(F.col("target") >= 0.5).alias("pos"), F.count_if(F.col("target") < 0.5).alias("neg")
    )
    steps = F.explode(F.sequence(F.lit(0), F.lit(GRID_SIZE - 1))).alias("step")
    cells = counts.select(by, "reach", "pos", "neg", steps)
    above = F.col("reach") > F.col("step")
    out = cells.groupBy(by, "step").agg(
        F.sum(F.when(above, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(above, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"),
    )
    recall_pos = F.coalesce(div(F.col("tp"), F.col("pos")), F.lit(0.0))
    recall_neg = F.coalesce(div(F.col("neg") - F.col("fp"), F.col("neg")), F.lit(0.0))
    return out.select(
        by, "step", F.element_at(grid, F.col("step") + 1).alias("threshold"),
        div(F.col("tp") + F.col("neg") - F.col("fp"), F.col("pos") + F.col("neg")).alias("accuracy"), (0.5 * (recall_pos + recall_neg)).alias("balanced_accuracy"),
    )


def threshold_search(rows: DataFrame, goal: str = "balanced_accuracy", by: str = "horizon") -> DataFrame:
    """The first threshold with the best ``goal`` (``accuracy`` calibrates the win heads)."""
    table = threshold_table(rows, by)
    best = F.min_by(F.struct("threshold", "accuracy", "balanced_accuracy"), F.struct(-F.round(goal, 12), F.col("step")))
    return table.groupBy(by).agg(best.alias("b")).select(by, "b.*")


def walk_forward_summary(rows: DataFrame, folds: DataFrame, metric: Column) -> tuple[DataFrame, DataFrame]:
    """(metric per fold, one row of mean, median, worst and best).  ``folds`` is the date table of test roles."""
    tests = folds.where(F.col("role") == "test").select("trade_date", "fold")
    per_fold = rows.join(tests, "trade_date").groupBy("fold").agg(F.count("*").alias("rows"), metric.alias("metric"))
    summary = per_fold.agg(
        F.count("*").alias("fold_count"), F.avg("metric").alias("mean"), F.median("metric").alias("median"), F.min("metric").alias("worst"),
        F.max("metric").alias("best"),
    )
    return per_fold, summary
