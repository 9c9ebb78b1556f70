import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest

from barline.operators import selection, similarity
from barline.operators.decisions import SELECTION


def greedy(day: pd.DataFrame, n: int):
    """Pick by pick, from first principles."""
    counts = day["market_regime"].value_counts()
    regime = sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[0][0]
    icap = max(1, math.ceil(n * SELECTION["industry"][regime]))
    bcap = max(1, math.ceil(n * SELECTION["board"][regime]))
    pool = day[day["eligible"]].to_dict("records")
    picked = []
    while len(picked) < n:
        ids = {p["symbol_id"] for p in picked}
        best = None
        for r in pool:
            if r in picked:
                continue
            if sum(p["industry_sw"] == r["industry_sw"] for p in picked) >= icap or sum(p["board"] == r["board"] for p in picked) >= bcap:
                continue
            sim = max([s for i, s in zip(r["neighbor_symbol_ids"], r["neighbor_scores"]) if i in ids], default=0.0)
            key = (-(r["selection_utility"] - 0.10 * min(1.0, sim)), -r["selection_utility"], r["symbol"])
            if best is None or key < best[0]:
                best = (key, r)
        if best is None:
            break
        picked.append(best[1])
    return [p["symbol"] for p in picked]


def candidates(seed=11, dates=4, size=60):
    rng = np.random.default_rng(seed)
    rows = []
    for d in range(dates):
        for i in range(size):
            near = [int(x) for x in rng.choice(np.arange(1, size + 1), 5, replace=False)]
            rows.append({
                "trade_date": dt.date(2024, 1, 2 + d), "symbol": f"{i:04d}", "symbol_id": i + 1, "industry_sw": f"i{rng.integers(0, 6)}",
                "board": f"b{rng.integers(0, 3)}", "eligible": bool(rng.random() < 0.6), "market_regime": str(rng.choice(["risk_on", "neutral", "risk_off"])),
                "selection_utility": float(np.round(rng.normal(0, 0.05), 3)), "neighbor_symbol_ids": near,
                "neighbor_scores": [float(x) for x in rng.random(5)], "p_win_prob_5": float(rng.random()), "rank_score_pred": float(rng.random()),
            })
    return pd.DataFrame(rows)


@pytest.mark.parametrize("n", [4, 9])
def test_diversified_pick_is_greedy(spark, n):
    pdf = candidates()
    out = selection.diversified_selection(spark.createDataFrame(pdf), n).toPandas()
    for day, group in pdf.groupby("trade_date"):
        got = out[out["trade_date"] == day].sort_values("pick_rank")["symbol"].tolist()
        assert got == greedy(group, n)


def test_contenders_hold_every_pick(spark):
    """A wide pool shrinks to a few rows a group, and the picks stay those of the whole pool."""
    pdf = candidates(seed=5, dates=2, size=400)
    pdf["selection_utility"] = np.round(np.random.default_rng(3).normal(0, 0.6, len(pdf)), 3)
    pool = spark.createDataFrame(pdf[pdf["eligible"]]).withColumnsRenamed({"industry_sw": "industry", "selection_utility": "u"})
    left = selection.contenders(pool, 4, SELECTION["similarity_penalty"])
    assert left.count() < pool.count() * 0.6
    out = selection.diversified_selection(spark.createDataFrame(pdf), 4).toPandas()
    for day, group in pdf.groupby("trade_date"):
        assert out[out["trade_date"] == day].sort_values("pick_rank")["symbol"].tolist() == greedy(group, 4)


def test_backfill_reaches_n(spark):
    pdf = candidates(dates=2)
    pdf["eligible"] = pdf["symbol_id"] <= 3
    out = selection.diversified_selection(spark.createDataFrame(pdf), 8, backfill=True).toPandas()
    for _, group in out.groupby("trade_date"):
        assert sorted(group["pick_rank"]) == list(range(1, 9)) and group["symbol"].is_unique


def brute_similarity(pdf, k):
    cols = [*similarity.FUNDAMENTALS, *similarity.BEHAVIOUR]
    z = pdf[cols].fillna(pdf[cols].median())
    z = (z - z.mean()) / z.std(ddof=0)

    def cos(names):
        v = z[names].to_numpy()
        v = v / np.linalg.norm(v, axis=1, keepdims=True)
        return v @ v.T

    cap = pdf["market_cap_log"].to_numpy()
    ind, brd = pdf["industry_name"].to_numpy(), pdf["board"].to_numpy()
    near = np.where(ind[:, None] == ind[None, :], 1.0, np.where(brd[:, None] == brd[None, :], 0.25, 0.0))
    s = 0.4 * near + 0.2 * np.exp(-np.abs(cap[:, None] - cap[None, :])) + 0.2 * cos(similarity.FUNDAMENTALS) + 0.2 * cos(similarity.BEHAVIOUR)
    np.fill_diagonal(s, -np.inf)
    out = set()
    for i in range(len(pdf)):
        order = sorted((j for j in range(len(pdf)) if s[i, j] > 0), key=lambda j: (-round(s[i, j], 12), pdf["symbol"][j]))[:k]
        out |= {(pdf["symbol"][i], pdf["symbol"][j], r + 1) for r, j in enumerate(order)}
    return out


@pytest.mark.parametrize("smallest", [4, 25, 512])
def test_similarity_blocks_find_the_exact_neighbours(spark, smallest):
    """A third of the companies share one industry; small blocks force many block pairs."""
    rng = np.random.default_rng(2)
    n = 150
    pdf = pd.DataFrame({"symbol": [f"{i:05d}" for i in range(n)], "asof_date": dt.date(2024, 1, 2)})
    pdf["industry_name"] = ["hot" if i % 3 == 0 else f"i{i % 11}" for i in range(n)]
    pdf["board"] = [f"b{i % 3}" for i in range(n)]
    for c in [*similarity.FUNDAMENTALS, *similarity.BEHAVIOUR]:
        pdf[c] = rng.normal(size=n)
    pdf["market_cap_log"] = rng.normal(20, 2, n)
    got = similarity.company_similarity(spark.createDataFrame(pdf), k=5, smallest=smallest).toPandas()
    assert {(r.symbol, r.neighbor_symbol, r.sim_rank) for r in got.itertuples()} == brute_similarity(pdf, 5)


def test_horizon_is_checked(spark):
    with pytest.raises(ValueError):
        selection.topn_quick(spark.createDataFrame(candidates()), 3, 7)


def test_dominant_regime(spark):
    df = spark.createDataFrame([("2024-01-02", r) for r in ("a", "b", "b", "c", "c")], "trade_date string, market_regime string")
    assert selection.dominant_regime(df).first()["regime"] == "b"
