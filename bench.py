"""Headline queries, each timed from the source tables with no stage left over from another query.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from barloom.checks import all_queries, tables  # noqa: E402
from barloom.session import local_session  # noqa: E402

HEADLINE = [
    "clean_ohlcv", "validate_bars", "bars_1d", "factor_input_assembly", "feature_matrix", "factor_matrix_counts", "labels",
    "training_join", "factor_validation", "redundancy_filter", "alpha_scores", "walk_forward", "purged_fold_metrics",
    "positions", "exit_decisions", "performance", "calibrated_thresholds", "ic_stability", "factor_stability",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, shuffle_partitions=cpus)
    # One small query first, so that JVM start-up is not charged to the first headline query.
    all_queries.QUERIES["bars_1h"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        tables.forget_stages()
        start = time.perf_counter()
        all_queries.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name:28s} {seconds[name]:8.3f}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
