"""Headline queries, timed. Prints one JSON line.

BENCH_SF_DIR: table folder (default /root/testdata/sf0.1). BENCH_CPUS: local cores (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

from tapeline import local_session
from tapeline.plans.catalog import QUERIES

HEADLINE = (
    "bars_hourly", "features_26", "osc_rsi", "osc_macd", "osc_adx", "trend_supertrend", "trend_sar", "trend_volumatic_vidya", "structure_zigzag",
    "structure_fair_value_gaps", "structure_bos", "trades_bar", "trades_lagged", "fills_first_touch", "metrics_deals", "metrics_max_drawdown",
    "sweep_results", "hit_rate_pooled", "risk_validate_orders", "deals_loss_streak", "documents_ranked", "research_rule_run", "research_model_metrics",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.read.parquet(f"{folder}/orders.parquet").count()  # start the executors
    times, failed = {}, {}
    for name in HEADLINE:
        start = time.time()
        try:
            df = QUERIES[name](spark, folder)
            # write to nowhere: every column of every row is computed
            df.write.format("noop").mode("overwrite").save()
        except Exception as error:  # one broken query does not cost the others their figures
            failed[name] = str(error).split("\n")[0][:200]
            print(f"{name}: {failed[name]}", file=sys.stderr, flush=True)
            continue
        times[name] = round(time.time() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    scale = folder.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(scale)} | ({"failed": failed} if failed else {})))
    spark.stop()


if __name__ == "__main__":
    main()
