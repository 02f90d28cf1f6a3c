"""The two manifest reports and their parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoardlens.functions import paths, sizes
from hoardlens.operators import dedup
from hoardlens.workspace import materialize


def basic_summary(manifest: DataFrame) -> DataFrame:
    """Files and bytes before and after deduplication, one row."""
    totals = dedup.basic_totals(manifest)
    saved = (
        F.coalesce(F.col("total_size"), F.lit(0)) - F.coalesce(F.col("deduplicated_size"), F.lit(0))
    ).cast(sizes.WIDE)
    return totals.select(
        "total_files",
        "unique_files",
        (F.col("total_files") - F.col("unique_files")).alias("duplicate_files"),
        "total_size",
        "deduplicated_size",
        saved.alias("space_saved"),
        sizes.percent(saved, F.col("total_size")).alias("savings_percentage"),
    )


def basic_top_groups(manifest: DataFrame, limit: int = 10) -> DataFrame:
    """Largest duplicate groups, with the texts a report shows."""
    return dedup.top_duplicate_groups(manifest, limit).select(
        "hash",
        "duplicate_count",
        "total_wasted_space",
        paths.short_hash(F.col("hash")).alias("hash_label"),
        sizes.format_bytes(F.col("total_wasted_space")).alias("wasted_label"),
    )


def overall(manifest: DataFrame, by_hash: DataFrame | None = None) -> DataFrame:
    """Overall statistics and savings, one row."""
    by_hash = dedup.per_hash(manifest) if by_hash is None else by_hash
    parts = dedup.overall_stats(manifest).unionByName(
        dedup.savings_stats(by_hash), allowMissingColumns=True
    )
    # Two one-row aggregates with different columns: the row they share is their maximum.
    return parts.agg(*[F.max(c).alias(c) for c in parts.columns]).select(
        "*",
        (F.col("total_file_entries") - F.col("unique_hashes")).alias("duplicate_entries"),
        sizes.percent(
            F.col("space_that_could_be_saved"), F.col("total_size_all_files")
        ).alias("savings_percentage"),
    )


def type_report(manifest: DataFrame, limit: int = 20) -> DataFrame:
    """Top file types with their labels and savings in percent."""
    zero = F.lit(0).cast(sizes.WIDE)
    return dedup.top_file_types(manifest, limit).select(
        "*",
        paths.extension_label(F.col("file_extension")).alias("label"),
        sizes.percent(
            F.coalesce("space_saved_by_type", zero), F.col("total_size")
        ).alias("savings_pct"),
    )


def full_report(manifest: DataFrame) -> dict[str, DataFrame]:
    """Every part of the full analysis; the per-hash table is computed once and stored."""
    by_hash = materialize(dedup.per_hash(manifest), "per-hash")
    top_waste = materialize(dedup.top_waste(by_hash), "top")
    top_shared = materialize(dedup.cross_manifest(by_hash), "top")
    waste = dedup.with_example_path(top_waste, manifest)
    shared = dedup.with_example_path(top_shared, manifest)
    return {
        "overall_stats": overall(manifest, by_hash),
        "top_paths_by_size": dedup.top_paths(manifest),
        "top_duplicates": waste,
        "top_duplicate_paths": dedup.lists_for(top_waste, manifest, "path", "sample_paths"),
        "cross_manifest_files": shared,
        "cross_manifest_sources": dedup.lists_for(
            top_shared, manifest, "source_filename", "source_manifests"
        ),
        "file_type_distribution": type_report(manifest),
    }
