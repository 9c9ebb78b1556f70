"""Linear heads against dense solutions on the driver."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.operators import models
from barline.operators.models import Head

HEADS = (Head("p", "flag", "logistic"), Head("one", "always", "logistic"), Head("v", "amount", "squared"), Head("r", "amount", "pairwise"))


def rows(n=400, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2)) * [3.0, 0.1] + [10.0, 0.0]
    day = rng.integers(0, 7, n)
    amount = x @ [0.5, 4.0] + day + rng.normal(size=n)
    flag = (x[:, 0] + rng.normal(size=n) * 2 > 10).astype(float)
    weight = rng.uniform(0.2, 2.0, n)
    return x, day, amount, flag, weight


def frame(spark, x, day, amount, flag, weight):
    table = [(dt.date(2024, 1, 1 + int(d)), *map(float, v), float(a), float(f), 1, float(w)) for v, d, a, f, w in zip(x, day, amount, flag, weight)]
    return spark.createDataFrame(table, "trade_date date, a double, b double, amount double, flag double, always int, w double")


def test_heads_equal_dense_solutions(spark):
    x, day, amount, flag, weight = rows()
    df = frame(spark, x, day, amount, flag, weight).repartition(5)
    fitted = models.fit_horizon_models(df, ["a", "b"], HEADS, "w")
    z = (x - x.mean(0)) / x.std(0)
    one = np.column_stack([np.ones(len(z)), z])
    cost = models.RIDGE * weight.sum()
    plain = np.linalg.solve((one.T * weight) @ one + np.diag([0.0, cost, cost]), (one.T * weight) @ amount)
    assert np.allclose(fitted.coefficients[HEADS[2]], plain, atol=1e-8)
    # the pairwise head by forming every pair of a date; a pair weighs w_i w_j over the weight of its date
    gram, right = np.diag([cost, cost]), np.zeros(2)
    for d in range(7):
        at = np.flatnonzero(day == d)
        for i in at:
            for j in at[at > i]:
                w = weight[i] * weight[j] / weight[at].sum()
                gram = gram + w * np.outer(z[i] - z[j], z[i] - z[j])
                right = right + w * (z[i] - z[j]) * (amount[i] - amount[j])
    assert np.allclose(fitted.coefficients[HEADS[3]], [0.0, *np.linalg.solve(gram, right)], atol=1e-8)
    # at the optimum the penalised gradient is zero
    beta = np.array(fitted.coefficients[HEADS[0]])
    p = 1 / (1 + np.exp(-one @ beta))
    assert np.abs((one.T * weight) @ (flag - p) - cost * beta).max() < 1e-6
    sure = fitted.coefficients[HEADS[1]]
    assert 2.0 < sure[0] < 10.0 and np.allclose(sure[1:], 0.0, atol=0.2)


def test_unknown_values_keep_their_rows(spark):
    x, day, amount, flag, weight = rows(60)
    df = frame(spark, x, day, amount, flag, weight)
    gaps = df.withColumn("a", F.when(F.col("flag") == 1, F.col("a"))).withColumn("amount", F.when(F.col("b") > 0, F.col("amount")))
    gaps = gaps.withColumn("always", F.lit(None).cast("int"))
    fitted = models.fit_horizon_models(gaps, ["a", "b"], HEADS)
    out = models.score_with_models(gaps, fitted)
    assert out.count() == 60 and out.where("p IS NULL OR v IS NULL OR r IS NULL").count() == 0
    assert set(fitted.coefficients[HEADS[1]]) == {0.0}  # no row knows the label
    assert out.columns == [*gaps.columns, "p", "one", "v", "r"]


@pytest.mark.parametrize("column", ["a", "b"])
def test_empty_and_constant_inputs(spark, column):
    x, day, amount, flag, weight = rows(20)
    df = frame(spark, x, day, amount, flag, weight).withColumn(column, F.lit(2.5))
    fitted = models.fit_horizon_models(df, ["a", "b"], HEADS)
    assert np.isfinite([v for c in fitted.coefficients.values() for v in c]).all()
    empty = models.fit_horizon_models(df.limit(0), ["a", "b"], HEADS)
    assert {v for c in empty.coefficients.values() for v in c} == {0.0}
    assert models.score_with_models(df, empty).where("p = 0.5 AND v = 0").count() == 20


def test_training_rows_need_no_join(spark, bars):
    """F8: features and labels are windows of the same rows."""
    from barline.catalog.evaluation import training_rows
    from barline.sources.sample_tables import SampleTables

    tables = SampleTables(spark, "none")
    index = bars.where("symbol = '000000.SZ'").selectExpr("'000300.SH' index_code", "trade_date", "open", "high", "low", "close", "volume", "amount")
    tables.__dict__.update(bars=bars, index_bars=index, kept=True)
    text = training_rows(tables)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in text and text.count("Exchange hashpartitioning(symbol") == 1
