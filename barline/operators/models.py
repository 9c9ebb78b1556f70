"""Linear heads from sums over the rows, and pluggable batch scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.operators.evaluation import BIGLOSS_PROXY
from barline.sources.schemas import HORIZONS
from barline.sources.writers import saved

RIDGE = 0.01
MAX_STEPS, TOLERANCE = 30, 1e-9


@dataclass(frozen=True)
class Head:
    """One linear model: ``logistic`` for flags, ``squared`` for amounts, ``pairwise`` for order within a date."""

    out: str
    label: str
    kind: str


@dataclass(frozen=True)
class FittedHeads:
    """Scaling of the features, and intercept and coefficients of every head on the scaled features."""

    features: tuple[str, ...]
    means: tuple[float, ...]
    spreads: tuple[float, ...]
    heads: tuple[Head, ...]
    coefficients: dict[Head, tuple[float, ...]]

    def scaled(self) -> list[Column]:
        """Scaled features; an unknown value counts as the mean."""
        known = zip(self.features, self.means, self.spreads)
        return [F.coalesce((F.col(c).cast("double") - m) / s, F.lit(0.0)) for c, m, s in known]


def horizon_heads(horizons: Sequence[int] = HORIZONS) -> tuple[Head, ...]:
    """Win, return, drawdown, big loss and rank head of every horizon."""
    return tuple(
        head for k in horizons for head in (
            Head(f"p_win_prob_{k}", f"label_win_{k}", "logistic"), Head(f"ret_mu_pred_{k}", f"label_ret_{k}", "squared"),
            Head(f"risk_dd_pred_{k}", f"label_maxdd_{k}", "squared"), Head(f"bigloss_prob_{k}", f"label_bigloss_{BIGLOSS_PROXY[k]}", "logistic"),
            Head(f"rank_score_pred_{k}", f"label_alpha_{k}", "pairwise"),
        )
    )


def _sums(rows: DataFrame, labels: Sequence[str], places: int, coefficients: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, right side) per label, added over all rows: x x' and x y, or the parts of a Newton step at ``coefficients``.

    ``rows`` has ``w``, the array ``x`` of ``places`` values, and the labels.  A task sends one row per label, the
    sums are added by place, and the driver gets labels x places x (places + 1) numbers however many rows there are.
    """
    wide = places * (places + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(labels), wide))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, places)
            w = batch.column(0).to_numpy(zero_copy_only=False)
            for h in range(len(labels)):
                y = batch.column(2 + h).to_numpy(zero_copy_only=False).astype(float)
                at = ~np.isnan(y)
                xs, ws, ys = x[at], w[at], y[at]
                if coefficients is not None:
                    p = 1.0 / (1.0 + np.exp(-np.clip(xs @ coefficients[h], -40.0, 40.0)))
                    ys, curve = ws * (ys - p), ws * p * (1.0 - p)
                else:
                    ys, curve = ws * ys, ws
                total[h, : places * places] += ((xs * curve[:, None]).T @ xs).ravel()
                total[h, places * places :] += xs.T @ ys
        yield pa.RecordBatch.from_arrays([pa.array(range(len(labels)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["head", "sums"])

    parts = rows.select("w", "x", *labels).mapInArrow(run, "head int, sums array<double>")
    added = parts.select("head", F.posexplode("sums").alias("at", "v")).groupBy("head", "at").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((len(labels), wide))
    for row in added:
        out[row["head"], row["at"]] = row["v"]
    return out[:, : places * places].reshape(-1, places, places), out[:, places * places :]


def _solved(matrix: np.ndarray, right: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(matrix + np.diag(penalty), right, rcond=None)[0]


def _within_dates(rows: DataFrame, labels: Sequence[str], places: int, by: str) -> tuple[np.ndarray, np.ndarray]:
    """What the sums hold between dates: per date and label the weighted mean of x and y, times their weight.

    Squared differences over all pairs of a date equal squared deviations from the date's mean, so no pair is formed:
    taking this part from the sums over rows leaves the sums of the deviations.  A date is one partial aggregate.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(h).alias("head"), F.col(c).alias("y")) for h, c in enumerate(labels)])).alias("c")
    long = rows.select(by, "w", "x", cells).where(F.col("c.y").isNotNull())
    named = long.select(by, F.col("c.head").alias("head"), "w", F.col("c.y").alias("y"), *[F.col("x")[i].alias(f"x{i}") for i in range(places)])
    weight = F.sum("w")
    dates = named.groupBy(by, "head").agg(
        weight.alias("w"), (F.sum(F.col("w") * F.col("y")) / weight).alias("y"), *[(F.sum(F.col("w") * F.col(f"x{i}")) / weight).alias(f"x{i}") for i in range(places)])
    wide = dates.select(F.col("w"), F.array(*[f"x{i}" for i in range(places)]).alias("x"), *[F.when(F.col("head") == h, F.col("y")).alias(c) for h, c in enumerate(labels)])
    return _sums(wide, labels, places, None)


def fit_horizon_models(
    train: DataFrame, features: Sequence[str], heads: Sequence[Head] = horizon_heads(), weight: str | None = None, by: str = "trade_date", ridge: float = RIDGE,
) -> FittedHeads:
    """All heads at once: one pass of sums for the squared and pairwise heads, one more per Newton step for the logistic ones.

    Features are scaled to the mean and spread of the training rows; an unknown feature counts as the mean, and a row
    with an unknown label is left out of that head only.  The penalty is ``ridge`` times the weight of a head's rows; it
    spares the intercept of squared heads, while that of a logistic one needs it to stay finite where all rows are of one
    class.  A pairwise head minimises the squared error of differences between rows of one date and has no
    intercept.  A NULL weight counts as zero.  Without rows all coefficients are zero.
    """
    labels = list(dict.fromkeys(h.label for h in heads))
    moments = train.agg(*[f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(features) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    means = tuple(moments[f"m{i}"] or 0.0 for i in range(len(features)))
    spreads = tuple(moments[f"s{i}"] if (moments[f"s{i}"] or 0.0) > 1e-12 else 1.0 for i in range(len(features)))
    fitted = FittedHeads(tuple(features), means, spreads, tuple(heads), {})
    places = len(features) + 1
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    # every Newton step passes over the rows
    rows = train.select(by, w.alias("w"), F.array(F.lit(1.0), *fitted.scaled()).alias("x"), *[F.col(c).cast("double").alias(c) for c in labels])
    rows = saved(rows, "fit")

    def penalty(matrix: np.ndarray) -> np.ndarray:
        return np.array([1e-12, *[ridge * matrix[0, 0] + 1e-12] * (places - 1)])

    found: dict[tuple[str, str], np.ndarray] = {}
    plain = [c for c in labels if any(h.label == c and h.kind != "logistic" for h in heads)]
    if plain:
        matrices, rights = _sums(rows, plain, places, None)
        ranked = [c for c in plain if any(h.label == c and h.kind == "pairwise" for h in heads)]
        for c, matrix, right in zip(plain, matrices, rights):
            found["squared", c] = _solved(matrix, right, penalty(matrix))
        if ranked:
            for c, between, moved in zip(ranked, *_within_dates(rows, ranked, places, by)):
                matrix, right = matrices[plain.index(c)], rights[plain.index(c)]
                inner = _solved((matrix - between)[1:, 1:], (right - moved)[1:], penalty(matrix)[1:])
                found["pairwise", c] = np.concatenate([[0.0], inner])
    flags = list(dict.fromkeys(h.label for h in heads if h.kind == "logistic"))
    beta, weights = np.zeros((len(flags), places)), None
    for _ in range(MAX_STEPS if flags else 0):
        matrices, rights = _sums(rows, flags, places, beta)
        if weights is None:  # at zero every curvature is a quarter of the weight
            weights = 4.0 * matrices[:, 0, 0]
        step = np.zeros_like(beta)
        for h in range(len(flags)):
            cost = np.full(places, ridge * weights[h] + 1e-12)
            step[h] = _solved(matrices[h], rights[h] - cost * beta[h], cost)
        beta = beta + step
        if np.abs(step).max() < TOLERANCE:
            break
    found |= {("logistic", c): b for c, b in zip(flags, beta)}
    fitted.coefficients.update({h: tuple(float(v) for v in found[h.kind, h.label]) for h in heads})
    return fitted


def score_with_models(df: DataFrame, fitted: FittedHeads) -> DataFrame:
    """One column per head; rows with unknown features are scored as well."""
    work = df.withColumn("__x", F.array(*fitted.scaled()))

    def value(head: Head) -> Column:
        first, *rest = fitted.coefficients[head]
        margin = sum((F.col("__x")[i] * b for i, b in enumerate(rest)), F.lit(first))
        return 1.0 / (1.0 + F.exp(-margin)) if head.kind == "logistic" else margin

    return work.withColumns({h.out: value(h) for h in fitted.heads}).drop("__x")


def batch_score(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str, keys: Sequence[str] = ("symbol", "trade_date")) -> DataFrame:
    """Apply any model in Arrow batches.  ``load`` runs once per task and returns the scorer.

    The scorer gets a batch of rows and returns the schema's columns without the keys.
    """
    names = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            scored = model(batch)
            yield pd.concat([batch[names].reset_index(drop=True), scored.reset_index(drop=True)], axis=1)

    return df.mapInPandas(run, schema)
