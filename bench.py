"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Sessions, Python workers and code generation are warmed by a run of two small queries that are not
counted. ``mb_per_s`` has the rate over the documents' text for each query, for the stage rates of
"""

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

HEADLINE = ["chunk_lengths_t65536", "chunk_lengths_t1024", "file_sha256", "first_occurrence", "dedup_stats_by_source", "pack_assignment", "file_terms", "range_plan", "reconstruct_text", "compress_choice"]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.sql.files.maxPartitionBytes", "4m").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from chunkloom.plans.queries import QUERIES

    run = lambda name: QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    text = spark.read.parquet(f"{sf}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0] / 1e6
    for name in ("chunk_lengths_t65536", "dedup_stats_by_source"):
        run(name)
    took = {}
    for name in HEADLINE:
        began = time.time()
        run(name)
        took[name] = round(time.time() - began, 3)
    rates = {k: round(text / v, 1) for k, v in took.items()}
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "mb_per_s": rates, "text_mb": round(text, 1), "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
