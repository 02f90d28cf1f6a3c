"""Tables and figures that follow from cluster labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoardlens.operators.skew import join_keyed
from hoardlens.workspace import materialize


def cluster_summary(labels: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Size, mean confidence and most confident member of every cluster; ties go to the least id.

    Rows are combined before the shuffle, so a dominant cluster is no bottleneck. The figures
    of a cluster are numbers, which keeps the aggregation over all rows hashed; only rows that
    have the best confidence of their cluster compete for its representative.
    """
    rows = labels.where(F.col("cluster_id").isNotNull()).select("id", "cluster_id")
    rows = rows.join(embeddings.select("id", F.col("confidence").cast("double").alias("confidence")), "id")
    figures = rows.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("cluster_size"),
        F.avg("confidence").alias("avg_confidence"),
        F.max(F.when(~F.isnan("confidence"), F.col("confidence"))).alias("best"),
    )
    figures = materialize(figures, "cluster-figures")
    best = join_keyed(rows, figures.select("cluster_id", "cluster_size", "best"), "cluster_id", "cluster_size", "id")
    first = (
        best.where(F.col("confidence").eqNullSafe(F.col("best")))
        .groupBy("cluster_id")
        .agg(F.min("id").alias("representative_face_id"))
    )
    return figures.drop("best").join(first, "cluster_id")


def size_histogram(summary: DataFrame) -> DataFrame:
    """How many clusters have each size, smallest first."""
    return (
        summary.groupBy("cluster_size")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy("cluster_size")
    )


def largest_clusters(summary: DataFrame, embeddings: DataFrame, limit: int = 10) -> DataFrame:
    """Biggest clusters with the crop of their representative."""
    top = summary.orderBy(F.col("cluster_size").desc(), "cluster_id").limit(limit)
    faces = embeddings.select(
        F.col("id").alias("representative_face_id"), "cropped_face_path"
    )
    return faces.join(F.broadcast(top), "representative_face_id").select(
        "cluster_id", "cluster_size", "avg_confidence", "cropped_face_path"
    )


def totals(labels: DataFrame) -> DataFrame:
    """Labelled rows, clusters and noise points."""
    return labels.agg(
        F.count(F.lit(1)).alias("total_faces"),
        F.count_distinct("cluster_id").alias("total_clusters"),
        F.count_if(F.col("cluster_id").isNull()).alias("noise_points"),
    )


def members(labels: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Clustered rows by cluster, most confident first."""
    return (
        labels.where(F.col("cluster_id").isNotNull())
        .select("id", "cluster_id")
        .join(embeddings.select("id", "cropped_face_path", "source_file", "confidence"), "id")
        .orderBy("cluster_id", F.col("confidence").desc_nulls_last(), "id")
    )


def noise_members(labels: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Rows that belong to no cluster."""
    return (
        labels.where(F.col("cluster_id").isNull())
        .select("id")
        .join(embeddings.select("id", "cropped_face_path"), "id")
    )


def cluster_folder(cluster_id: F.Column) -> F.Column:
    """Export folder of a cluster, ``noise`` without one."""
    named = F.format_string("cluster_%03d", cluster_id)
    return F.when(cluster_id.isNull(), F.lit("noise")).otherwise(named)
