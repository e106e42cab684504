"""Headline timings: one JSON line on stdout.

Reads $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS].
"""

from __future__ import annotations

import json
import os
import statistics
import time

from threatlens import session
from threatlens.operators import campaigns, detect, parsers, reports
from threatlens.plans import queries as catalogue
from threatlens.sources import bridge

RUNS = 3


def hot_entries(spark, sf_dir):
    """The same lines with every other one from a single address."""
    from pyspark.sql import functions as F
    events = bridge.read_events(spark, sf_dir)
    hot = F.when(F.col("event_id") % 2 == 0, F.lit("10.9.9.9")).otherwise(F.col("user_ip"))
    return parsers.parse_nginx(bridge.access_lines(events.withColumn("user_ip", hot)))


def main() -> None:
    cores = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session.build("bench", cores)
    spark.sparkContext.setLogLevel("ERROR")

    def entries():
        return parsers.parse_nginx(bridge.access_lines(bridge.read_events(spark, sf_dir)))

    def all_threats():
        return detect.detect_all(entries(), catalogue.CONFIG)
    timed = {
        "flagship": lambda: catalogue.flagship(spark, sf_dir),
        "parse": entries,
        "detect_patterns": lambda: detect.detect_patterns(entries()),
        "detect_bruteforce": lambda: detect.detect_bruteforce(entries(), catalogue.CONFIG),
        "detect_ddos_hot": lambda: detect.detect_ddos(hot_entries(spark, sf_dir), catalogue.CONFIG),
        "sliding_count": lambda: catalogue.QUERIES["sliding_count"](spark, sf_dir),
        "detect_all_classic": lambda: catalogue.QUERIES["detect_all_classic"](spark, sf_dir),
        "campaigns": lambda: campaigns.campaigns(all_threats()),
        "top_attackers": lambda: reports.top_attackers(all_threats()),
    }
    once = {        # a stream and a model; they stage tables, and take longer
        "stream_sliding_count": lambda: catalogue.QUERIES["stream_sliding_count"](spark, sf_dir),
        "score_iforest": lambda: catalogue.QUERIES["score_iforest"](spark, sf_dir),
    }
    seconds = {}
    for name, plan in (timed | once).items():
        taken = []
        for _ in range(RUNS + 1 if name in timed else 2):
            started = time.perf_counter()
            plan().write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(taken[1:]), 3)      # the first run warms up
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    print(json.dumps({
        "metric": "flagship_seconds", "value": seconds["flagship"], "unit": "sec", "queries": seconds,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "rows": rows,
        "rows_per_second": round(rows / seconds["flagship"]), "cores": cores, "spark": spark.version}))


if __name__ == "__main__":
    main()
