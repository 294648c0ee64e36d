"""Time the headline queries and print one JSON line: the median of up to three runs each.

A query is run again until it has run three times or for 20 seconds.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import tempfile
import time
from statistics import median

from tallyframe import build_session
from tallyframe.plans.catalog import QUERIES

HEADLINE = (
    "suite_summary",
    "prediction_scores",
    "answer_match_scores",
    "document_token_f1",
    "council_decisions",
    "council_summary_rows",
    "efficiency_report",
    "wide_accuracy_table",
    "policy_disagreements",
    "pareto_points",
    "dev_test_split",
    "mixed_dataset",
    "round_robin_rows",
    "pending_runs",
    "request_cache",
    "batch_statistics",
    "model_leaderboard",
    "streamed_scores",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        shuffle_partitions=int(cpus),
        extra={
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # The first query also starts the JVM's compilers; it runs once untimed.
    QUERIES[HEADLINE[0]].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        runs: list[float] = []
        while len(runs) < 3 and sum(runs) < 20:
            start = time.perf_counter()
            QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(median(runs), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
