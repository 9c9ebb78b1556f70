import datetime as dt

import pytest
from pyspark.sql import Observation

from barline.plans import scan

DAY = dt.date(2024, 3, 1)


def tables(spark, bars=10, samples=10):
    """Twenty companies, ten of them active; ``bars`` of these traded on the day and ``samples`` have a score."""
    securities = spark.createDataFrame([(f"{i:06d}", "active" if i < 10 else "gone") for i in range(20)], "symbol string, status string")
    traded = spark.createDataFrame([(f"{i:06d}", DAY) for i in [*range(bars), *range(10, 20)]], "symbol string, trade_date date")
    scored = [(f"{i:06d}", DAY, 500, False, i == 9, 0.5 + i / 30, 0.02 + i / 100) for i in range(samples)]
    columns = "symbol string, trade_date date, list_days int, is_st boolean, is_suspended boolean, p_win_prob_10 double, ret_mu_pred_10 double"
    return spark.createDataFrame(scored, columns), traded, securities


def test_gates_pass_and_the_pool_is_observed(spark):
    found = tables(spark)
    gate = scan.scan_gates(*found).first()
    assert gate.passed and gate.reason is None and gate.trade_date == DAY
    assert (gate.universe, gate.covered, gate.coverage_floor, gate.sample_size, gate.sample_floor) == (10, 10, 9, 9, 1)
    report = Observation("scan")
    out = scan.full_scan(*found, n=3, mode="quick", strict=True, report=report).collect()
    assert [r.scan_rank for r in out] == [1, 2, 3] and all(r.best_p_win >= 0.55 for r in out)
    assert report.get["sample_size"] == 9


@pytest.mark.parametrize("bars, samples, reason", [(8, 10, "too few bars"), (10, 0, "too few samples")])
def test_a_closed_gate_stops_the_scan(spark, bars, samples, reason):
    found = tables(spark, bars, samples)
    assert scan.scan_gates(*found).first().reason == reason
    with pytest.raises(Exception, match=reason):
        scan.full_scan(*found, n=3, mode="quick", strict=True).collect()
    assert scan.full_scan(*found, n=3, mode="quick").count() == min(3, samples)


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        scan.full_scan(*tables(spark), n=3, mode="slow")
