"""Time the headline queries; prints one JSON line.

Each query runs twice and the shorter time counts, so that the start of the JVM
and of the Python workers does not fall on whichever query comes first.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from recordloom.plans.queries import QUERIES  # noqa: E402
from recordloom.session import configured  # noqa: E402

HEADLINE = [
    "clean_records",
    "validate_strict",
    "error_summary",
    "quality_distribution",
    "field_coverage",
    "top_quality",
    "quality_rank",
    "merge_sources",
    "merge_statistics",
    "exact_merged",
    "fuzzy_pairs",
    "find_duplicates",
    "deduplicate",
    "linked_records",
    "response_records",
    "page_texts",
    "parse_dates",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = configured(
        SparkSession.builder.master(f"local[{cpus}]").appName("recordloom-bench"),
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="recordloom-bench-"),
        },
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    names = sys.argv[1:] or HEADLINE
    times = {name: min(run(name), run(name)) for name in names}
    scale = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
