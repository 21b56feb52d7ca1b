"""Headline queries on local Spark; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "flagship_features_target", "tick_bars_covered", "complete_intervals", "asof_backward", "ticks_asof_quotes", "candle_patterns",
    "realized_volatility", "window_averages", "weighted_averages", "exponential_averages", "channel_scores", "macd_signals",
    "dense_calendar", "gap_blocks", "reaction_profile_features", "scope_metrics", "exact_quantiles", "segment_scores",
    "survival_table", "policy_replay", "feature_diffs", "observed_bins", "spearman_pairs", "stream_tick_bars",
]

WIDE = ["nested_exponential_averages", "source_ranking", "adx_wilder", "volume_profile_features", "walk_forward_coverage"]   # the widest plans, beside the total
WARM = ["flagship_features_target", "asof_backward", "exponential_averages"]    # again, with their code compiled


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    from barloom.plans import REGISTRY
    from barloom.session import local_session

    spark = local_session(cores)

    def timed(name: str) -> float:
        start = time.perf_counter()
        REGISTRY[name].frame(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    timed("candle_patterns")                            # start-up is not part of a query
    times = {name: timed(name) for name in HEADLINE}
    warm = {name: timed(name) for name in WARM}
    wide = {name: timed(name) for name in WIDE}
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "warm": warm, "wide": wide,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
