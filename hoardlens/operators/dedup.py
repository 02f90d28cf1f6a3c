"""Duplicate analysis over manifest rows ``path, hash, size_bytes, source_filename``.

Two families exist side by side. The basic one keeps every row, so unreadable files (NULL
hash) form one group. The full one drops NULL and empty hashes before grouping.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoardlens.functions import paths, sizes
from hoardlens.operators.skew import list_parts
from hoardlens.workspace import materialize


def with_file_name(manifest: DataFrame) -> DataFrame:
    """Add ``filename_only``."""
    return manifest.withColumn("filename_only", paths.file_name(F.col("path")))


def hashed(manifest: DataFrame) -> DataFrame:
    """Rows whose content hash is known."""
    return manifest.where(F.col("hash").isNotNull() & (F.col("hash") != ""))


# --- basic family -----------------------------------------------------------------------


def basic_totals(manifest: DataFrame) -> DataFrame:
    """Total files and bytes, and what remains with one file per hash, in one pass.

    Rows are reduced per hash before anything is shuffled, then summed.
    """
    per_hash = manifest.groupBy("hash").agg(
        F.count(F.lit(1)).alias("n"),
        sizes.wide_sum(F.col("size_bytes")).alias("total"),
        F.min("size_bytes").alias("smallest"),
    )
    return per_hash.agg(
        F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("total_files"),
        F.count(F.lit(1)).alias("unique_files"),
        F.sum("total").cast(sizes.WIDE).alias("total_size"),
        sizes.wide_sum(F.col("smallest")).alias("deduplicated_size"),
    )


def duplicate_groups(manifest: DataFrame) -> DataFrame:
    """Hashes seen more than once with the bytes of all their copies."""
    return (
        manifest.groupBy("hash")
        .agg(
            F.count(F.lit(1)).alias("duplicate_count"),
            sizes.wide_sum(F.col("size_bytes")).alias("total_wasted_space"),
        )
        .where(F.col("duplicate_count") > 1)
    )


def top_duplicate_groups(manifest: DataFrame, limit: int = 10) -> DataFrame:
    """Largest duplicate groups by the bytes of all copies."""
    return (
        duplicate_groups(manifest)
        .orderBy(F.col("total_wasted_space").desc_nulls_last(), F.col("hash").asc_nulls_last())
        .limit(limit)
    )


# --- full family ------------------------------------------------------------------------


def path_sizes(manifest: DataFrame) -> DataFrame:
    """Bytes and rows of every path, unreadable files included."""
    return manifest.groupBy("path").agg(
        sizes.wide_sum(F.col("size_bytes")).alias("total_size_bytes"),
        F.count(F.lit(1)).alias("occurrence_count"),
    )


def top_paths(manifest: DataFrame, limit: int = 10) -> DataFrame:
    """Paths that hold the most bytes over all manifests."""
    return (
        path_sizes(manifest)
        .orderBy(F.col("total_size_bytes").desc_nulls_last(), F.col("path").asc_nulls_last())
        .limit(limit)
    )


def per_hash(manifest: DataFrame) -> DataFrame:
    """One row per content hash.

    The lists of paths and manifests are not columns here: one hash can own a large part of
    all paths. ``hash_paths`` and ``hash_manifests`` give the whole lists. The distinct counts
    are combined before the shuffle on ``hash``, so a frequent hash costs no more than any
    other. All results are numbers, which keeps the aggregation hashed: a least path would
    make it sort every row.
    """
    return (
        hashed(with_file_name(manifest))
        .groupBy("hash")
        .agg(
            F.min("size_bytes").alias("size_bytes"),
            F.count_distinct("path").alias("unique_paths"),
            F.count_distinct("filename_only").alias("unique_filenames"),
            F.count(F.lit(1)).alias("total_occurrences"),
            F.count_distinct("source_filename").alias("manifest_count"),
        )
    )


def with_example_path(top: DataFrame, manifest: DataFrame) -> DataFrame:
    """Add the first path of each hash to a top-n report.

    ``top`` comes out of a ``limit``, so it may be broadcast; only its hashes are aggregated.
    Store it first, as it is read twice.
    """
    keys = F.broadcast(top.select("hash"))
    first = (
        manifest.join(keys, "hash", "left_semi")
        .groupBy("hash")
        .agg(F.min("path").alias("example_path"))
    )
    return top.join(first, "hash", "left")


def hash_paths(manifest: DataFrame, part_items: int = 1000) -> DataFrame:
    """All distinct paths of every hash, as sorted lists of bounded size."""
    return list_parts(hashed(manifest), "hash", "path", "sample_paths", part_items)


def hash_manifests(manifest: DataFrame, part_items: int = 1000) -> DataFrame:
    """All manifests of every hash, as sorted lists of bounded size."""
    return list_parts(
        hashed(manifest), "hash", "source_filename", "source_manifests", part_items
    )


def overall_stats(manifest: DataFrame) -> DataFrame:
    """Rows, distinct hashes, paths and names, and bytes of all hashed rows."""
    return hashed(with_file_name(manifest)).agg(
        F.count(F.lit(1)).alias("total_file_entries"),
        F.count_distinct("hash").alias("unique_hashes"),
        F.count_distinct("path").alias("unique_paths"),
        F.count_distinct("filename_only").alias("unique_filenames"),
        sizes.wide_sum(F.col("size_bytes")).alias("total_size_all_files"),
    )


def savings_stats(by_hash: DataFrame) -> DataFrame:
    """Totals after deduplication from the per-hash table."""
    waste = sizes.wasted(F.col("size_bytes"), F.col("total_occurrences"))
    return by_hash.agg(
        F.count(F.lit(1)).alias("unique_file_count"),
        sizes.wide_sum(F.col("size_bytes")).alias("deduplicated_total_size"),
        F.sum(waste).cast(sizes.WIDE).alias("space_that_could_be_saved"),
        F.avg("unique_paths").alias("avg_paths_per_hash"),
        F.avg("unique_filenames").alias("avg_filenames_per_hash"),
    )


def top_waste(by_hash: DataFrame, limit: int = 15) -> DataFrame:
    """Hashes whose surplus copies take the most bytes."""
    waste = sizes.wasted(F.col("size_bytes"), F.col("total_occurrences"))
    return (
        by_hash.where(F.col("total_occurrences") > 1)
        .withColumn("space_wasted", waste)
        .orderBy(F.col("space_wasted").desc_nulls_last(), F.col("hash").asc())
        .limit(limit)
        .select(
            "hash",
            "size_bytes",
            "total_occurrences",
            "unique_paths",
            "unique_filenames",
            "space_wasted",
        )
    )


def cross_manifest(by_hash: DataFrame, limit: int = 10) -> DataFrame:
    """Contents found in more than one manifest, most widespread first."""
    return (
        by_hash.where(F.col("manifest_count") > 1)
        .orderBy(
            F.col("manifest_count").desc(),
            F.col("size_bytes").desc_nulls_last(),
            F.col("hash").asc(),
        )
        .limit(limit)
        .select("hash", "size_bytes", "manifest_count", "unique_paths")
    )


def largest_waste(manifest: DataFrame, limit: int = 15) -> DataFrame:
    """``top_waste`` straight from the manifest, for the report alone.

    Hashes are ranked by figures that need no distinct count; only those of the report are
    counted, so no row of the manifest is multiplied on the way there.
    """
    figures = hashed(manifest).groupBy("hash").agg(
        F.min("size_bytes").alias("size_bytes"), F.count(F.lit(1)).alias("total_occurrences")
    )
    waste = sizes.wasted(F.col("size_bytes"), F.col("total_occurrences"))
    top = (
        figures.where(F.col("total_occurrences") > 1)
        .withColumn("space_wasted", waste)
        .orderBy(F.col("space_wasted").desc_nulls_last(), F.col("hash").asc())
        .limit(limit)
    )
    names = {"unique_paths": "path", "unique_filenames": "filename_only"}
    return _with_distinct(materialize(top, "top"), manifest, names).select(
        "hash", "size_bytes", "total_occurrences", "unique_paths", "unique_filenames", "space_wasted"
    )


def most_widespread(manifest: DataFrame, limit: int = 10) -> DataFrame:
    """``cross_manifest`` straight from the manifest, for the report alone.

    The number of manifests ranks, so it is counted for all hashes, by two plain aggregations;
    paths are counted for those of the report.
    """
    pairs = hashed(manifest).groupBy("hash", "source_filename").agg(F.min("size_bytes").alias("size_bytes"))
    figures = pairs.groupBy("hash").agg(
        F.min("size_bytes").alias("size_bytes"), F.count("source_filename").alias("manifest_count")
    )
    top = (
        figures.where(F.col("manifest_count") > 1)
        .orderBy(F.col("manifest_count").desc(), F.col("size_bytes").desc_nulls_last(), F.col("hash").asc())
        .limit(limit)
    )
    return _with_distinct(materialize(top, "top"), manifest, {"unique_paths": "path"})


def _with_distinct(top: DataFrame, manifest: DataFrame, counts: dict[str, str]) -> DataFrame:
    """Add distinct counts to a stored top-n report, whose size its limit bounds."""
    rows = with_file_name(manifest).join(F.broadcast(top.select("hash")), "hash", "left_semi")
    distinct = rows.groupBy("hash").agg(*[F.count_distinct(c).alias(name) for name, c in counts.items()])
    return top.join(distinct, "hash")


def lists_for(top: DataFrame, manifest: DataFrame, item: str, name: str) -> DataFrame:
    """Whole item lists of a handful of hashes chosen by a top-n report.

    ``top`` comes out of a ``limit``, so it may be broadcast; the rows of other hashes are
    dropped before any shuffle.
    """
    keys = F.broadcast(top.select("hash"))
    return list_parts(manifest.join(keys, "hash", "left_semi"), "hash", item, name)


def file_types(manifest: DataFrame) -> DataFrame:
    """Files, bytes and possible savings per extension, from one two-level aggregation.

    Every (extension, hash) pair is reduced first; all columns of the report follow from those
    pairs, so there is neither a distinct count nor a join.
    """
    ext = paths.extension_class(paths.file_name(F.col("path"))).alias("file_extension")
    pairs = (
        hashed(manifest)
        .groupBy(ext, "hash")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count("size_bytes").alias("n_sized"),
            sizes.wide_sum(F.col("size_bytes")).alias("total"),
            F.min("size_bytes").alias("smallest"),
            F.max("size_bytes").alias("largest"),
        )
    )
    types = pairs.groupBy("file_extension").agg(
        F.sum("n").alias("file_count"),
        F.count(F.lit(1)).alias("unique_files"),
        F.sum("total").cast(sizes.WIDE).alias("total_size"),
        sizes.wide_sum(F.col("smallest")).alias("deduplicated_total_size"),
        F.sum("n_sized").alias("n_sized"),
        F.min("smallest").alias("min_size"),
        F.max("largest").alias("max_size"),
    )
    return types.select(
        "file_extension",
        "file_count",
        "unique_files",
        "total_size",
        "deduplicated_total_size",
        F.try_divide(F.col("total_size").cast("double"), F.col("n_sized")).alias("avg_size"),
        "min_size",
        "max_size",
        (F.col("total_size") - F.col("deduplicated_total_size"))
        .cast(sizes.WIDE)
        .alias("space_saved_by_type"),
    )


def top_file_types(manifest: DataFrame, limit: int = 20) -> DataFrame:
    """Extensions that hold the most bytes."""
    return (
        file_types(manifest)
        .orderBy(F.col("total_size").desc_nulls_last(), F.col("file_extension").asc())
        .limit(limit)
    )
