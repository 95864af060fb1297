"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from pyspark.sql import SparkSession

HEADLINE = (
    "bbox_all", "range_count_boxes", "range_count_pruned", "range_count_balls", "range_report_boxes", "knn_lineitem", "knn_1", "knn_100", "knn_self", "knn_graph",
    "batch_insert", "batch_delete_partial", "delete_with_payload", "frame_insert_delete", "validate_tree", "zorder_sort_rank", "sliding_window_stats", "sliding_window_knn", "csr_offsets",
)


def main() -> None:
    where = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parent}:{os.environ.get('PYTHONPATH', '')}"
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from plumbline.plans import catalogue

    known = catalogue.queries()
    catalogue.flagship(spark, where).write.format("noop").mode("overwrite").save()  # warm-up
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        known[name](spark, where).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": where.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
