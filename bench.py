"""Headline queries, timed. Prints one JSON line.

The claim log is derived from the tables and written once, timed as `write_log`, and so
is what stood at the usual clocks, as `write_snapshot`; the queries read what is written,
as they would at rest. `with_writes` is the total with both.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from twoclock.session import build_session  # noqa: E402
from workload import logs  # noqa: E402
from workload.queries import QUERIES, ST_KNOWN, ST_VALID  # noqa: E402

HEADLINE = ["standing", "standing_stock", "clock_grid", "entities_part", "on_hand",
            "reconciliation", "item_health", "recent_k", "history_steps", "melt_claims",
            "best_paragraph"]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g")})
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}

    def timed(name, action):
        start = time.time()
        action()
        seconds[name] = round(time.time() - start, 3)

    timed("write_log", lambda: logs.stock_log(spark, sf_dir))
    timed("write_snapshot", lambda: logs.stock_snapshot(spark, sf_dir, ST_VALID, ST_KNOWN))
    for name in names:
        timed(name, lambda: QUERIES[name](spark, sf_dir).write.format("noop")
              .mode("overwrite").save())
        print(name, seconds[name], file=sys.stderr, flush=True)
    claims = logs.stock_log(spark, sf_dir).count()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds[n] for n in names), 3),
        "unit": "sec", "with_writes": round(sum(seconds.values()), 3), "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))[2:],
        "claims": claims,
        "claims_per_sec_standing": round(claims / seconds["standing_stock"])
        if "standing_stock" in seconds else None}))
    spark.stop()


if __name__ == "__main__":
    main()
