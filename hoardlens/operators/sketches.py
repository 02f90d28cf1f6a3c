"""Approximate distinct counts from sketches that are kept per manifest.

A sketch has a fixed size whatever it counts, and sketches of parts merge into that of the
whole. A new manifest therefore needs only its own rows to be read; the others are counted
from what is stored. The exact counts of ``dedup`` stay the default.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hoardlens.functions import sizes
from hoardlens.operators.dedup import hashed, with_file_name

LOG_REGISTERS = 14  # 16,384 registers, at most about 16 KB a sketch
COUNTED = {"hash": "unique_hashes", "path": "unique_paths", "filename_only": "unique_filenames"}


def error_bound(deviations: float = 3.0, log_registers: int = LOG_REGISTERS) -> float:
    """Relative error that an estimate keeps within, at that many standard deviations."""
    return deviations * 1.04 / math.sqrt(2.0**log_registers)


def manifest_sketches(manifest: DataFrame) -> DataFrame:
    """One row per manifest: its files, bytes and the sketches of its hashes, paths and names.

    Sketches are combined before the shuffle, so a huge manifest is no bottleneck.
    """
    return (
        hashed(with_file_name(manifest))
        .groupBy("source_filename")
        .agg(
            F.count(F.lit(1)).alias("files"),
            sizes.wide_sum(F.col("size_bytes")).alias("total_size"),
            *[F.hll_sketch_agg(column, LOG_REGISTERS).alias(column) for column in COUNTED],
        )
    )


def keep_sketches(sketches: DataFrame, folder: str) -> None:
    """Store sketches; those of the same manifests are replaced, all others stay."""
    sketches.hint("rebalance", F.col("source_filename")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("source_filename").parquet(folder)


def stored_sketches(spark: SparkSession, folder: str) -> DataFrame:
    """Sketches kept in a folder; names of manifests are text, whatever they look like."""
    kept = spark.read.schema(
        "files bigint, total_size decimal(38,0), hash binary, path binary, filename_only binary, source_filename string"
    )
    return kept.parquet(folder)


def approx_overall_stats(sketches: DataFrame) -> DataFrame:
    """The figures of ``dedup.overall_stats``, distinct counts estimated from sketches."""
    merged = sketches.agg(
        F.coalesce(F.sum("files"), F.lit(0)).cast("bigint").alias("total_file_entries"),
        F.sum("total_size").cast(sizes.WIDE).alias("total_size_all_files"),
        *[F.hll_union_agg(column).alias(column) for column in COUNTED],
    )
    estimates = [
        F.coalesce(F.hll_sketch_estimate(column), F.lit(0).cast("bigint")).alias(name)
        for column, name in COUNTED.items()
    ]
    return merged.select("total_file_entries", *estimates, "total_size_all_files")
