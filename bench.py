"""Seconds per headline query at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from checks import load_all  # noqa: E402
from checks.registry import run  # noqa: E402

HEADLINE = [
    "g1_dedupe_key", "g2_canonical_name", "g13_address_parts", "g17a_canonical_category",
    "w2_best_match", "f11_w1_ranked_matches", "m16_normalized_profile",
    "j11_candidate_pairs", "j7_nearby", "m18_bulk_best_match",
    "j5_f12_import_outcome", "j6_likely_duplicates", "j13_integrity_issues", "j17_place_delete_lists", "j20_apply_decisions",
    "a1_session_match_counts", "a5_usage_insights", "a6_usage_trends", "a8_accuracy_by_provider", "a11_confidence_calibration",
    "a12_processing_latency", "w9_retention", "w10_batch_plan", "w11_quota_verdicts", "io10_transfer_urls", "t4_live_quota_verdicts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in names:
        start = time.time()
        run(name, spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
