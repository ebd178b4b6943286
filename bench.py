"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The value is the sum of first runs in a new session, the stored tables they read included.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from attestor.session import build_session  # noqa: E402

HEADLINE = (
    "match_cascade", "fuzzy_top2_decision", "live_pipeline", "dedupe_identity", "policy_report",
    "user_summary", "review_fold_role", "cross_batch_merge", "manual_merge", "normalize_name",
    "header_inference", "search", "access_matrix", "csv_ingest",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8,
        **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "20g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    from attestor.plans.queries import matches, registered, report

    queries = registered()
    # The tables that later queries read are built first, and count as queries.
    builds = {"build_matches": matches, "build_report": report}
    cold, again = {}, {}
    for name, run in (builds | {n: queries[n] for n in HEADLINE}).items():
        for kind in (cold, again):
            t = time.perf_counter()
            run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            kind[name] = round(time.perf_counter() - t, 3)
    print(json.dumps({
        "metric": "headline_queries_cold_total", "value": round(sum(cold.values()), 3), "unit": "sec",
        "queries": cold, "second_run": again, "second_total": round(sum(again.values()), 3),
        "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
