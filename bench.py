"""Headline queries at one scale; prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8) choose data
and cores.  Each query runs once into a noop sink after one small warm-up query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from bridge.queries import QUERIES  # noqa: E402
from daybefore.session import local_session  # noqa: E402

HEADLINE = ["form_difference", "asof_strict", "rolling_mean_prior", "team_stats_rolling", "rolling_as_of", "rest_days",
            "head_to_head", "series_state", "elo", "event_features", "event_shares", "lineup_context", "team_strength",
            "member_history", "features_batch", "features_on_request", "score_distribution", "ranked_probability_score",
            "series_probability", "probability_metrics", "best_threshold", "normalize_odds", "market_benchmark_daily"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    QUERIES["rows_by_type"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        t = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
