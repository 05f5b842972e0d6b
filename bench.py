"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from turnloom.plans.registry import all_queries  # noqa: E402
from turnloom.session import local_session  # noqa: E402

HEADLINE = (
    "s1_turns x6_segments x14_items w1_dedupe j1_provenance a1_summary p2_select_turns f6_locate_quote f9_secret_scan h9_normalise h1_reconcile"
    " v8_references a11_report_with_total k2_json_fragments f11_markdown f13_rule_summary k6_transcript_md k3_upsert w8_changes w9_debounce"
    " a7_top_sources f22_limit_texts i2_prefix_matches s6_message_tree f20_page_markdown f17_latex r1_capture_ingest r5_debounced_alerts"
).split()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1].split(",") if len(sys.argv) > 1 else HEADLINE
    if names == ["all"]:
        names = list(all_queries())
    spark = local_session("turnloom-bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    registered = all_queries()
    spark.read.parquet(f"{sf}/conversations.parquet").selectExpr("max(length(text))").collect()  # start-up is not measured
    seconds = {}
    for name in names:
        started = time.perf_counter()
        registered[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf)}))


if __name__ == "__main__":
    main()
