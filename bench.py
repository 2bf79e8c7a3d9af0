"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vakanz.plans import load  # noqa: E402
from vakanz.session import get_session  # noqa: E402

HEADLINE = (
    "visible_text", "normalize_text", "content_hash", "canonical_url", "page_links", "rubric_score",
    "rubric_reasons", "fit_score", "feedback_signal", "feedback_evidence", "adjusted_score",
    "rescore_all", "upsert_outcomes", "upsert_snapshots", "duplicate_groups", "postings_with_latest",
    "page_of_postings", "section_pages", "latest_score", "change_points", "availability_update",
    "page_to_posting", "host_suffix_join", "discover_details", "run_ledger", "target_report",
    "source_health", "application_state", "feedback_from_status", "revision_numbers",
    "text_sections", "interval_union", "profile_versions", "normalize_payload", "ingest_postings",
    "batch_assign_all", "stream_daily_counts", "stream_sessions",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.sql.shuffle.partitions": cpus,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = load().QUERIES
    times: dict[str, float] = {}
    for name in names:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(min(runs), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "sum of best-of-two query times",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
