"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from mailveil.plans.catalog import QUERIES  # noqa: E402
from mailveil.session import build_session  # noqa: E402

HEADLINE = ["rules_transport", "rule_fire_counts", "baseline_deviations", "endpoint_profiles", "finding_priority",
            "posture_by_capture", "stream_statistics", "flow_records", "dialogue_lines", "redacted_lines",
            "decoded_segments", "handshake_labels", "certificate_inventory", "report_severity_shares", "session_feature_vector"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("mailveil-bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, quiet=True)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": Path(folder).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
