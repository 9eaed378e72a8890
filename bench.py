"""Headline queries on a warm session; prints one JSON line.

Each query runs once to warm up (fixtures are staged, code is generated) and
then ``BENCH_REPEATS`` times (default 1); the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from ledgerline import catalog
from ledgerline.session import local_session
from ledgerline.sources.tables import table

HEADLINE = [
    "n04_dates", "n07_money", "n10_signed_amount", "a04_statement_rows", "i02_fit_ids", "s09_range_scan", "m01_clean_events",
    "m07_unique_visitors", "m09_funnel", "m12_hourly_buckets", "u02_current_subscriptions", "u06_allowance", "b01_enrich", "n17_render_money",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, app="ledgerline-bench", shuffle_partitions=int(cpus) if cpus.isdigit() else 8, driver_memory="12g")

    def once(name: str) -> float:
        begun = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begun

    timings = {}
    for name in names:
        first = once(name)
        timings[name] = round(statistics.median(once(name) for _ in range(repeats)), 3)
        print(f"{name}: first {first:.2f}, then {timings[name]:.2f}", file=sys.stderr, flush=True)
    rows = {t: table(spark, sf_dir, t).count() for t in ("orders", "lineitem", "events")}
    per_second = {n: round(rows["orders"] / timings[n]) for n in ("n07_money", "n10_signed_amount") if n in timings}
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries, warm median",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
                "cpus": cpus,
                "rows": rows,
                "statement_rows_per_second": per_second,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
