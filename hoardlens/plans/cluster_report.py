"""Cluster summary and detection reports."""

from __future__ import annotations

from pyspark.sql import DataFrame

from hoardlens.operators import cluster_tables, detections
from hoardlens.workspace import materialize


def cluster_report(labels: DataFrame, embeddings: DataFrame) -> dict[str, DataFrame]:
    """Totals, size distribution and largest clusters; the summary is stored once."""
    summary = materialize(cluster_tables.cluster_summary(labels, embeddings), "summary")
    return {
        "totals": cluster_tables.totals(labels),
        "cluster_summary": summary,
        "cluster_sizes": cluster_tables.size_histogram(summary),
        "largest_clusters": cluster_tables.largest_clusters(summary, embeddings),
    }


def detection_report(objects: DataFrame) -> dict[str, DataFrame]:
    """Overall figures and counts per class."""
    return {
        "summary": detections.detection_summary(objects),
        "classes": detections.class_report(objects),
    }
