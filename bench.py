"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR   test tables to read (default /root/testdata/sf0.1)
    BENCH_CPUS     local worker threads (default 8)

Further arguments name the queries to run. Every query writes its whole result
to a sink that drops it, so no row is skipped and none is brought to the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tasklattice.plans.catalog import QUERIES
from tasklattice.session import build_session

HEADLINE = (
    "list_default",
    "list_all",
    "list_with_progress",
    "list_all_with_progress",
    "search_title_body",
    "search_many",
    "summary_counts",
    "summary_totals",
    "tag_counts",
    "progress",
    "child_breakdown",
    "children",
    "with_parent",
    "with_blocker",
    "completable",
    "resolve_refs",
    "suggest",
    "fuzzy_match",
    "cards",
    "logstyle",
    "markdown_rows",
    "parse_messages",
    "capture",
    "capture_subtasks",
    "audit",
    "append_tasks",
    "upsert_fields",
    "delete_tasks",
    "apply_transitions",
    "apply_blocks",
    "replay",
    "export_json",
)


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    settings = {
        "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = build_session(f"local[{cpus}]", "bench", **settings)
    spark.sparkContext.setLogLevel("ERROR")
    run(spark, "list_default", sf_dir)
    seconds = {name: round(run(spark, name, sf_dir), 3) for name in sys.argv[1:] or HEADLINE}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
