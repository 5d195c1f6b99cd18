"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS say where the tables are and how many threads to use.
"""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import SparkSession

from beaconaudit.plans.queries import QUERIES

HEADLINE = (
    "scan_statistics", "best_finding_per_line", "legacy_findings", "rule_hits_by_family", "usage_findings",
    "ts_import_symbols", "statistics_grouping_sets", "findings_per_project", "search_findings", "category_summary",
    "keyword_filter", "ignore_filter", "project_discovery", "branch_resolution", "context_lines", "csv_rows",
    "json_document", "full_scan", "group_rows",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["category_summary"](spark, sf_dir).count()  # a scan, so that no query pays for compiling the engine
    times = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    found = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(found.group(1)) if found else None}))
    spark.stop()


if __name__ == "__main__":
    main()
