"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from palisade.plans import registry  # noqa: E402
from palisade.session import build_session  # noqa: E402

HEADLINE = [
    "sanitize_events", "hits_by_class", "dedup_events", "event_numbering", "traffic_summary",
    "rule_staleness", "rule_impact", "ioc_sightings", "burst_detect", "sequence_probe",
    "rate_anomaly", "stream_hourly_classes", "validate_findings", "lifecycle_status",
    "rollout_outcome", "learning_compact", "check_overall", "blast_radius",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    queries["status_bucket"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        started = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
