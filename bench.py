"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 4) set the data
and the cores.  Each query runs once to warm up and then ``RUNS`` times; the median
counts.  ``value`` is the sum of the medians.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

RUNS = 3
HEADLINE = (
    "surname_topk", "parse_first_last", "parse_full_middle", "parse_all_caps", "parse_honorific_both", "json_lines", "part_surname_topk",
    "orders_value_by_surname", "events_by_user_name_window", "consistent_pairs_initial_vs_full", "semi_match", "dedupe_components",
)


def kernel_rates() -> dict[str, float]:
    """Names and pairs a second on one core, without Spark."""
    from onomast.kernel.match import consistent
    from onomast.kernel.parse import parse
    from onomast.plans.ingredients import GIVEN, MIDDLE, SURNAME

    texts = [f"{g} {m} {s}" for g in GIVEN for m in MIDDLE for s in SURNAME]
    began = time.perf_counter()
    records = [parse(t) for t in texts]
    parsed = time.perf_counter()
    pairs = [(a, b) for a in records[:400] for b in records[::25] if a.surname_key == b.surname_key]
    paired = time.perf_counter()
    for a, b in pairs:
        consistent(a, b)
    done = time.perf_counter()
    return {"parses_per_s": round(len(texts) / (parsed - began)), "pairs_per_s": round(len(pairs) / max(done - paired, 1e-9))}


def main() -> None:
    from pyspark.sql import SparkSession

    from onomast.plans import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    for name in HEADLINE:
        times = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times[1:]), 3)
        print(name, took[name], file=sys.stderr, flush=True)
    rates = kernel_rates()
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")), "kernel": rates}))


if __name__ == "__main__":
    main()
