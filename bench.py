"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores. Every query runs to its last row; the sink throws rows away.
"""

from __future__ import annotations

import json
import os
import time

from lumenlog.plans import catalog
from lumenlog.session import build_session

HEADLINE = """log_summary list_logs search_logs count_by_service service_distribution facets services_hourly volume_rate normalize_logs canonical dq_summary
    cluster_effectiveness cost_dashboard enhanced_cost archive_rollup bq_cost_detail cud_utilization scd2_member_two_step traces_unified cross_system_traces span_latency
    sessions_summary token_budget pii_risk redact_text chunk_text text_hash embed batch_search search_groups ann_search windowed_rates rolling_latency priority_batches
    bench_report append_logs""".split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = build_session("bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    catalog.run("count_by_severity", spark, sf_dir).collect()  # starts the session's threads and code caches
    took: dict[str, float] = {}
    failed: dict[str, str] = {}
    for name in names:
        started = time.time()
        try:
            catalog.run(name, spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - started, 3)
        except Exception as e:  # noqa: BLE001 - one failing query must not hide the others
            failed[name] = str(e)[:200]
    line = {"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").split("sf")[-1]}
    if failed:
        line["failed"] = failed
    print(json.dumps(line), flush=True)


if __name__ == "__main__":
    main()
