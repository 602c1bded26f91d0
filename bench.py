"""Time the headline queries: one JSON line on stdout.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS`` (default 8). Every query starts
without shared tables, so each time includes deriving the corpus it reads. The flagship runs
once on the next smaller tables before the clock starts, to load and compile the JVM's code.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from spanloom.session import local_session  # noqa: E402
from spanloom.workload import queries as registered  # noqa: E402

HEADLINE = (
    "most_called_functions",
    "span_ends",
    "split_lines",
    "plan_windows",
    "subtract_claimed",
    "collapse_omissions",
    "build_prompts",
    "check_required",
    "next_round",
    "verdict",
    "graph_report",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.01")
    if os.path.isdir(small):
        registered.REGISTRY[HEADLINE[0]](spark, small).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        registered.forget()
        began = time.perf_counter()
        result = registered.REGISTRY[name](spark, sf_dir)
        result.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": total,
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
