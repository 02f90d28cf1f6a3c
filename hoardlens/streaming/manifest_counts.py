"""Running duplicate counts over a manifest folder.

A stream reads every manifest file once, as it appears, and keeps count, bytes and least size
of each content hash as its state. The state is the result: it is read from the checkpoint, so
it holds what all finished batches have brought, neither less nor twice, also after a restart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hoardlens import schemas
from hoardlens.functions import sizes
from hoardlens.operators.dedup import hashed
from hoardlens.sources.manifests import CSV_OPTIONS


def manifest_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Rows of the manifest files below ``folder`` as a stream, new files as they come.

    Files must appear complete, with the columns in their fixed order and under names that do
    not start with ``.`` or ``_``; parts written by ``write_manifests`` do. Records with line
    breaks in quotes need whole files, so each is read by one task.
    """
    reader = spark.readStream.schema(schemas.MANIFEST).options(**CSV_OPTIONS).option("mode", "FAILFAST")
    reader = reader.option("enforceSchema", False).option("multiLine", True)
    reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.csv(folder)


def running_totals(stream: DataFrame) -> DataFrame:
    """``hash, total_occurrences, total_size, size_bytes`` of all rows with a hash seen so far."""
    return (
        hashed(stream)
        .groupBy("hash")
        .agg(
            F.count(F.lit(1)).alias("total_occurrences"),
            sizes.wide_sum(F.col("size_bytes")).alias("total_size"),
            F.min("size_bytes").alias("size_bytes"),
        )
    )


def follow(
    spark: SparkSession,
    folder: str,
    checkpoint: str,
    files_per_batch: int | None = None,
    until_done: bool = True,
    every: str = "1 minute",
) -> StreamingQuery:
    """Start (or resume) counting; the checkpoint must lie in a folder all executors reach.

    ``until_done`` stops after the files that are there; else the query goes on, looking for
    new files ``every`` so often. Only changed hashes are touched by a batch.
    """
    writer = running_totals(manifest_stream(spark, folder, files_per_batch)).writeStream
    writer = writer.outputMode("update").format("noop").option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if until_done else {"processingTime": every}
    return writer.trigger(**trigger).start()


def current_totals(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The totals after the last finished batch, read from the state of the stream."""
    state = spark.read.format("statestore").load(checkpoint)
    value = F.col("value")
    return state.select(
        F.col("key.hash").alias("hash"),
        value["count"].alias("total_occurrences"),
        F.when(~value["isEmpty"], value["sum"]).cast(sizes.WIDE).alias("total_size"),
        value["min"].alias("size_bytes"),
    )


def current_duplicates(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Hashes seen more than once so far, with the bytes of their surplus copies."""
    totals = current_totals(spark, checkpoint).where(F.col("total_occurrences") > 1)
    return totals.withColumn("space_wasted", sizes.wasted(F.col("size_bytes"), F.col("total_occurrences")))
