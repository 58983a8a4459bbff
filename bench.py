"""Headline queries, timed: one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from strandloom import catalog

HEADLINE = ["q01_multi_threshold_filter", "q04_kmer_spectrum", "q06_consensus", "q10_hamming_pairs", "q14_containment", "q19_connected_components", "q22_topk_per_group", "q28_boundaries", "q38_best_hit", "q47_rpkm_tpm", "q54_junctions"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        start = time.time()
        catalog.queries()[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
