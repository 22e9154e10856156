"""Seconds of the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["do_nothing", "simple_spam_messages", "ip_spam_messages", "full_spam_score", "message_count_running", "message_count_threshold9", "global_running_counters", "simple_top20_spammers", "word_count", "word_topk_sliding", "popularity", "avg_response_time", "lagged_batch_simple", "exact_batch_simple", "causal_edges", "powerlaw_ols"]


def main() -> None:
    from pyspark.sql import SparkSession

    from tidemark import plans

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    events = spark.read.parquet(f"{SF}/events.parquet").where("event_type in ('click', 'error', 'purchase', 'signup')").count()
    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(3):  # the first run compiles
            start = time.perf_counter()
            plans.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        took[name] = round(min(times), 3)
        # the run's line as a table of runs takes it: name, partitions, events, milliseconds, events a second
        print("CSV", name, CPUS, events, round(1000 * took[name]), round(events / took[name]), sep=",", file=sys.stderr)
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": took, "sf": SF, "events": events, "events_per_sec_simple_spam": round(events / took["simple_spam_messages"])}))
    spark.stop()


if __name__ == "__main__":
    main()
