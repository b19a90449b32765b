"""Times the headline queries; prints one line of JSON.

Each query is run once to warm up and then ``RUNS`` times; the median counts.
``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from nearkin.operators import blocks  # noqa: E402
from nearkin.plans import queries  # noqa: E402

RUNS = 3
HEADLINES = [
    "c3_edges",
    "c4_temporal_edges",
    "c7_prune",
    "e2_add_dedup",
    "q1_sim_events",
    "q2_sim_vectors_cosine",
    "q2_sim_vectors_filtered",
    "q3_simv",
    "q4_fusion",
    "q9_batch_vectors",
    "q9_batch_events",
    "q9_batch_fusion",
    "v12_batch_cell_search",
]


def timed(run) -> float:
    run()
    times = []
    for _ in range(RUNS):
        began = time.perf_counter()
        run()
        times.append(time.perf_counter() - began)
    return statistics.median(times)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    done = {name: round(timed(lambda q=queries.QUERIES[name]: q(spark, folder).write.format("noop").mode("overwrite").save()), 3) for name in HEADLINES}

    # what a job costs with nothing to do, and pairs scored a second without it
    floor = timed(lambda: spark.range(1).write.format("noop").mode("overwrite").save())
    vectors = queries.vecs(spark, folder).cache()
    n = vectors.count()
    batch = timed(lambda: blocks.batch_vectors(vectors, vectors, 10).write.format("noop").mode("overwrite").save())
    more = {"job_floor_sec": round(floor, 4), "batch_vectors": n, "pairs_per_sec": round(n * (n - 1) / max(batch - floor, 1e-9))}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(done.values()), 3), "unit": "sec", "queries": done, "sf": folder.rstrip("/").rpartition("sf")[2], "cpus": int(cpus), **more}))
    spark.stop()


if __name__ == "__main__":
    main()
