"""Headline queries at one data folder; prints one JSON line.

BENCH_SF_DIR picks the folder, BENCH_CPUS the local cores.  Each query runs once to
warm up and then BENCH_RUNS times (default 1) into the noop sink; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from barline import catalog  # noqa: E402
from barline.session import local_session  # noqa: E402

HEADLINE = (
    "price_features", "volume_features", "relative_features", "market_features", "asof_backward_fundamentals", "company_profiles", "company_similarity",
    "label_table", "build_all_features", "training_samples", "topk_metrics", "decision_utility", "scan_topn_market", "validate_bars",
    "interval_join_symbol_news", "stream_bars_quarantine",
)
RUNS = int(os.environ.get("BENCH_RUNS", "1"))


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session()
    queries = catalog.queries()
    names = sys.argv[1:] or HEADLINE
    seconds: dict[str, float] = {}
    for name in names:
        times = []
        for attempt in range(RUNS + 1):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            if attempt or RUNS == 0:
                times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(folder).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
