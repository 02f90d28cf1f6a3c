"""Inputs of the registered queries, derived from the given tables row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents seen as files on the drives they come from."""
    doc = F.col("doc_id")
    endings = [".txt", ".TXT", ".tar.gz", ".jpg", "", "."]
    ending = F.lit(".png")
    for value in reversed(range(len(endings))):
        ending = F.when(doc % 7 == value, endings[value]).otherwise(ending)
    path = F.concat(
        F.lit("/"), "lang", F.lit("/doc_"), (doc % 97).cast("string"), ending
    )
    content = F.when(doc % 41 == 0, None).when(doc % 43 == 0, "").otherwise(F.sha2("text", 256))
    return table(spark, sf_dir, "documents").select(
        path.alias("path"),
        content.alias("hash"),
        F.octet_length("text").cast("bigint").alias("size_bytes"),
        F.concat("source", F.lit(".csv")).alias("source_filename"),
    )


def odd_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest rows with the ``name`` of their file, some hidden or odd, and the ``kind`` of its header."""
    part = F.col("size_bytes") % 3
    start = F.when(part == 0, "_").when(part == 1, ".").otherwise("a+b %41 ")
    return manifest(spark, sf_dir).select(
        "path", "hash", "size_bytes", F.concat(start, "source_filename").alias("name"),
        (part % 2).cast("int").alias("kind"),
    )


def faulty_embeddings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Embeddings with repeated ids and broken vectors, and labels of which some have no face."""
    faces = embeddings(spark, sf_dir).select("id", "embedding")
    broken = F.when(F.col("id") % 13 == 0, F.slice("embedding", 1, 5)).when(
        F.col("id") % 17 != 0, F.col("embedding")
    )
    again = faces.where(F.col("id") % 10 == 0)
    labels = faces.select(F.when(F.col("id") % 7 == 0, -F.col("id") - 1).otherwise(F.col("id")).alias("id"))
    return faces.withColumn("embedding", broken).unionByName(again), labels


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items seen as boxes found in images."""
    left = (F.col("l_suppkey") % 600).cast("double") - 20.6
    top = (F.col("l_partkey") % 400).cast("double") - 10.25
    kind = F.col("l_partkey") % 8
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("/img/"), F.col("l_orderkey").cast("string"), F.lit(".jpg")).alias(
            "image_path"
        ),
        (F.col("l_orderkey") % 30).cast("int").alias("frame_id"),
        F.col("l_linenumber").alias("detection_id"),
        "l_partkey",
        "l_suppkey",
        kind.cast("int").alias("class_id"),
        F.concat(F.lit("class_"), kind.cast("string")).alias("class_name"),
        (F.col("l_discount") * 10).alias("confidence"),
        left.alias("x1"),
        top.alias("y1"),
        (left + F.col("l_quantity") * 3).alias("x2"),
        (top + 10 + F.col("l_linenumber") * 7).alias("y2"),
        F.lit(640).alias("image_width"),
        F.lit(480).alias("image_height"),
        F.when(F.col("l_linestatus") == "F", F.col("l_quantity") * 11).alias("mask_area"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents seen as images with two classifier labels each."""
    doc = F.col("doc_id")
    score = (F.col("n_chars") % 1000).cast("double") / 1000
    label = F.when(doc % 3 == 0, "nsfw").when(doc % 3 == 1, "NSFW").otherwise("Nsfw")
    results = F.array(
        F.struct(label.alias("label"), score.alias("score")),
        F.struct(F.lit("normal").alias("label"), (1 - score).alias("score")),
    )
    path = F.concat(
        F.lit("/"), "source", F.lit("/doc_"), doc.cast("string"), F.lit(".jpg")
    )
    return table(spark, sf_dir, "documents").select(
        "doc_id", path.alias("path"), results.alias("results"), "text"
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding vectors seen as faces cropped from images."""
    vec = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        vec.alias("id"),
        F.concat(F.lit("src_"), (vec % 7).cast("string"), F.lit(".jpg")).alias("source_file"),
        F.concat(F.lit("/crops/"), vec.cast("string"), F.lit(".jpg")).alias("cropped_face_path"),
        "embedding",
        "label",
        ((vec * 37 % 101).cast("double") / 100).alias("confidence"),
    )


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents seen as images: their bytes fill rows of ten pixels with three channels."""
    text = F.col("text").cast("binary")
    height = F.ceil(F.octet_length(text) / 30).cast("int")
    struct = F.struct(
        F.lit("").alias("origin"),
        height.alias("height"),
        F.lit(10).alias("width"),
        F.lit(3).alias("nChannels"),
        F.lit(16).alias("mode"),
        F.rpad(text, height * 30, F.lit(b"\0")).alias("data"),
    )
    path = F.concat(
        F.lit("/scans/"), "lang", F.lit("/page."), F.col("doc_id").cast("string"), F.lit(".png")
    )
    return table(spark, sf_dir, "documents").select(
        "doc_id", path.alias("path"), (F.col("doc_id") % 30).cast("int").alias("frame_id"),
        struct.alias("image"),
    )


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers seen as machines, each with a disk, a partition and sometimes a volume."""
    key = F.col("c_custkey")
    places = (
        table(spark, sf_dir, "nation")
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("n_nationkey", "n_name", "r_name")
    )
    machines = table(spark, sf_dir, "customer").join(
        places, F.col("c_nationkey") == F.col("n_nationkey")
    )
    volume = F.when(
        key % 5 == 0,
        F.array(
            F.struct(
                F.lit("vault").alias("name"),
                F.col("c_mktsegment").alias("label"),
                F.concat(F.lit("/vault/"), key.cast("string")).alias("mountpoint"),
            )
        ),
    )
    part = F.struct(
        F.concat(F.lit("part"), (key % 4).cast("string")).alias("name"),
        F.lit("ext4").alias("fstype"),
        F.col("n_name").alias("label"),
        F.when(key % 3 != 0, F.concat(F.lit("u-"), key.cast("string"))).alias("uuid"),
        F.when(key % 2 == 0, F.concat(F.lit("/mnt/"), key.cast("string"))).alias("mountpoint"),
        volume.alias("children"),
    )
    disk = F.struct(
        F.concat(F.lit("disk"), F.col("c_nationkey").cast("string")).alias("name"),
        F.col("r_name").alias("label"),
        F.concat(key.cast("string"), F.lit("G")).alias("size"),
        F.array(part).alias("children"),
    )
    return machines.select(
        "c_custkey", F.to_json(F.struct(F.array(disk).alias("blockdevices"))).alias("dump")
    )
