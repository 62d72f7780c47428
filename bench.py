"""Times the catalogue's queries; prints one JSON line. Results go to the no-op sink, so nothing is collected.

BENCH_SF_DIR, BENCH_CPUS as the driver sets them; BENCH_ONLY narrows to names with the given prefixes.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tilewright.plans.catalog import QUERIES  # noqa: E402
from tilewright.session import spark_session  # noqa: E402


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = tuple(filter(None, os.environ.get("BENCH_ONLY", "").split(",")))
    spark = spark_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["a13_berden_class"](spark, d).write.format("noop").mode("overwrite").save()  # warm-up
    times: dict[str, float] = {}
    failed: list[str] = []
    for name, run in QUERIES.items():
        if only and not name.startswith(only):
            continue
        start = time.time()
        try:
            run(spark, d).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - start, 3)
        except Exception as error:  # one broken query must not hide the other times
            failed.append(name)
            print(f"{name}: {str(error)[:300]}", file=sys.stderr)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, times.get(name), file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "failed": failed, "sf": os.path.basename(d.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
