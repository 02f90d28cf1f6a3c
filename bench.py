"""Headline queries at BENCH_SF_DIR on local[BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from hoardlens.plans.queries import QUERIES
from hoardlens.workspace import local_session

HEADLINE = [
    "top_duplicates_by_waste",
    "dedup_basic_summary",
    "dedup_top_groups",
    "dedup_full_summary",
    "dedup_hash_paths",
    "top_paths_by_size",
    "cross_manifest_files",
    "file_type_distribution",
    "similar_topk",
    "similar_topk_batch",
    "dbscan_labels",
    "largest_clusters",
    "silhouette_by_label",
    "detection_metrics",
    "detection_summary",
    "face_threshold_crop_boxes",
    "largest_box_per_image",
    "flagged_items",
    "model_face_crops",
    "manifest_csv_roundtrip",
    "file_tree_scan",
    "inventory_flatten",
]


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM's and Python's workers before the clock runs.
    spark.range(1000).mapInPandas(lambda batches: batches, "id bigint").count()
    run(spark, "top_paths_by_size", sf_dir)
    seconds = {name: round(run(spark, name, sf_dir), 3) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "headline query time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
