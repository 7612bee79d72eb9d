"""Times the headline queries and prints one line of JSON."""

from __future__ import annotations

import json
import os
import tempfile
import time
from statistics import median

from pyspark.sql import SparkSession

from siftline.queries import QUERIES

HEADLINE = ("stage1_full", "stage2_partition", "stage2_counts", "slot_pool_join", "run_stage2_page", "run_stage3_page", "stage3_batch", "stage3_aggregate", "ingest_action", "ingest_upsert", "invalidate_stage3", "retention_cascade", "canonical_url", "url_dedupe_first", "strip_tags", "infer_position")
ROUNDS = 2


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
    spark = spark.config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
    # expressions needn't remember the Python lines that made them
    spark = spark.config("spark.python.sql.dataFrameDebugging.enabled", "false").config("spark.local.dir", tempfile.mkdtemp(prefix="spark-")).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(ROUNDS + 1):  # the first one warms up
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        seconds[name] = round(median(runs[1:]), 4)
    print(json.dumps({"metric": "sum of medians, headline queries", "value": round(sum(seconds.values()), 4), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
