import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from barline.session import local_session

    return local_session(4, "tests")


@pytest.fixture(scope="session")
def bars(spark):
    """Random walks with gaps: three long series and some short ones."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(5)
    frames = []
    for i, n in enumerate((1700, 200, 130, 45, 7, 1)):
        close = 50 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        opened = close * np.exp(rng.normal(0, 0.01, n))
        frames.append(pd.DataFrame({
            "symbol": f"{i:06d}.SZ", "trade_date": pd.bdate_range("2015-01-01", periods=n).date, "open": opened,
            "high": np.maximum(opened, close) * 1.01, "low": np.minimum(opened, close) * 0.99, "close": close,
            "volume": rng.integers(1, 40, n).astype(float), "amount": rng.integers(100, 900, n).astype(float),
            "turnover_rate": rng.integers(0, 5, n).astype(float),
        }))
    pdf = pd.concat(frames, ignore_index=True)
    pdf["adj_close"] = pdf["close"]
    pdf["pre_close"] = pdf.groupby("symbol")["close"].shift(1)
    pdf["pct_chg"] = (pdf["close"] / pdf["pre_close"] - 1) * 100
    df = spark.createDataFrame(pdf)
    from pyspark.sql import functions as F

    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("pre_close", "pct_chg")}).cache()
