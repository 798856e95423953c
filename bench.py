"""Benchmark: run every registered query at one scale factor and print one
JSON line with per-query seconds.

    BENCH_SF_DIR  (default /root/testdata/sf0.1)
    BENCH_CPUS    (default 8)
    BENCH_ONLY    comma-separated query names (optional)
    BENCH_SHUFFLE_PARTITIONS  (default: BENCH_CPUS; AQE coalesces further)

Each query is fully computed with a ``noop`` write (no collect to the
driver).  The JVM is warmed with three small queries on the smallest
tables first, so start-up and first-time code generation are not counted.  Source/sink queries include the time to write their input files.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [x for x in os.environ.get("BENCH_ONLY", "").split(",") if x]

    from supplylens.session import get_session
    from supplylens.plans import registry

    spark = get_session(f"local[{cpus}]", app="supplylens-bench",
                        shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS",
                                                              cpus)),
                        extra={"spark.driver.memory": "16g",
                               "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64m"})
    spark.sparkContext.setLogLevel("ERROR")
    qs = registry.queries()
    # warm the JVM (class loading, codegen) on the smallest tables, untimed
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(warm_dir):
        warm_dir = sf_dir
    for w in ("latest_group_avg", "lookup", "group_sum_having"):
        qs[w](spark, warm_dir).write.format("noop").mode("overwrite").save()

    names = only or list(qs)
    times, errors = {}, {}
    for name in names:
        t0 = time.perf_counter()
        try:
            qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 3)
        except Exception as e:  # keep going; report the failure
            errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "n_queries": len(times), "sf": float(m.group(1)) if m else sf_dir,
           "cpus": cpus}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
