"""Headline queries, timed one by one; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the number of local threads, BENCH_ONLY an
optional comma-separated choice of queries.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpusgate.plans import registry  # noqa: E402
from corpusgate.session import build_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n]
    spark = build_session(
        app="bench", master=f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
        spark__corpusgate__spread=cpus,
        spark__driver__memory="16g", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("OFF")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name, q in registry().items():
        if name in only or (not only and q.bench):
            start = time.perf_counter()
            q.build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(sf) if sf else None}))


if __name__ == "__main__":
    main()
