"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Reads are made from `orders` by a long SQL text. That is done once, into Parquet, and timed as `make_reads`, which the total includes; the
queries read what it wrote, as they would read reads from files."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

from pyspark.sql import SparkSession

from readloom.plans import queries
from readloom.plans.queries import QUERIES

HEADLINE = ("filter_reasons_se", "pair_verdict", "cut_tail", "poly_g", "overlap", "correction", "merge_pairs", "adapter_overlap_trim", "adapter_trim_se", "cycle_quality", "qual_hist", "kmer5", "summary_rollup", "dedup_exact", "full_chain_pe")


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.files.maxPartitionBytes", "512k").config("spark.sql.files.openCostInBytes", "64k")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    folder = tempfile.mkdtemp(prefix="readloom-bench-")
    try:
        began = time.perf_counter()
        queries.reads(spark, sf).write.parquet(f"{folder}/reads")
        took["make_reads"] = round(time.perf_counter() - began, 3)
        queries.reads = lambda spark, _: spark.read.parquet(f"{folder}/reads")
        timed(spark, sf, took)
    finally:
        shutil.rmtree(folder, True)
    print(json.dumps({"metric": "total wall time of the headline read queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


def timed(spark: SparkSession, sf: str, took: dict) -> None:
    QUERIES["pair_verdict"](spark, sf).write.format("noop").mode("overwrite").save()  # starts the workers
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)


if __name__ == "__main__":
    main()
