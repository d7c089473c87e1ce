"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.plans import load_all  # noqa: E402
from tidemark.registry import QUERIES  # noqa: E402
from tidemark.session import local_session  # noqa: E402

HEADLINE = (
    "scr15_screen_report", "scr06_average_rank", "st02_factor_legs", "ag01_order_flow", "ag02_realised_stats", "av09_statement_rules",
    "av10_latest_statement", "pit01_visible_window", "pit11_visible_at", "j01_daily_panel", "ver01_keyed_diff", "ver11_restatement_union",
    "dq13_event_store_audit", "txt02_exact_duplicates", "ex01_round_trips", "ex02_book_curve", "ex06_random_baseline", "tst03_block_bootstrap",
    "sta01_return_summary", "av07_minute_stamp",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    load_all()
    spark = local_session(cores)
    # One untimed query warms the JVM and the Python workers.
    QUERIES["av01_contract_stamp"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(scale)}))


if __name__ == "__main__":
    main()
