"""Models over whole folders: list, decode, predict, and account for every file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hoardlens import schemas
from hoardlens.operators import detections, predict
from hoardlens.sources import file_tree, images
from hoardlens.workspace import materialize

Choice = Callable[[DataFrame], DataFrame]


def _face_images(files: DataFrame) -> DataFrame:
    return file_tree.with_extension(files, file_tree.FACE_IMAGES)


def _flag_images(files: DataFrame) -> DataFrame:
    return file_tree.with_extension(files, file_tree.FLAG_IMAGES)


def _listing(spark: SparkSession, root: str, recursive: bool) -> DataFrame:
    """The listing, stored: it is decoded and counted."""
    return materialize(file_tree.list_files(spark, root, recursive), "listed")


def _summary(listed: DataFrame, choose: Choice, rejects: DataFrame, rows: DataFrame, path: str) -> DataFrame:
    """``scanned, failed, with_hits, hits``: image files found, files lost, images with rows, rows."""
    names = ["scanned", "failed", "with_hits", "hits"]

    def counted(part: DataFrame, **values) -> DataFrame:
        known = {n: values.get(n, F.lit(0)).cast("bigint").alias(n) for n in names}
        return part.select(*known.values())

    one = F.lit(1)
    per_image = rows.groupBy(path).agg(F.count(one).alias("n"))
    parts = (
        counted(choose(listed.where(F.col("error").isNull())), scanned=one)
        .unionByName(counted(rejects, failed=one))
        .unionByName(counted(per_image, with_hits=one, hits=F.col("n")))
    )
    return parts.agg(*[F.coalesce(F.sum(n), F.lit(0).cast("bigint")).alias(n) for n in names])


def faces_in_folder(
    spark: SparkSession,
    root: str,
    decode: images.Decode,
    model: predict.Model,
    threshold: float = 0.5,
    crop_folder: str | None = None,
) -> dict[str, DataFrame]:
    """``rows, rejects, summary`` of a face model over all images below ``root``."""
    listed = _listing(spark, root, True)
    pictures = images.decode_listed(listed, decode, _face_images)
    rows, rejects = predict.detect_faces_and_rejects(pictures, model, threshold, crop_folder)
    summary = _summary(listed, _face_images, rejects, rows, "source_path")
    return {"rows": rows, "rejects": rejects, "summary": summary}


def objects_in_folder(
    spark: SparkSession, root: str, decode: images.Decode, model: predict.Model, class_names: dict[int, str]
) -> dict[str, DataFrame]:
    """``rows, rejects, classes, summary`` of an object model over the images directly in ``root``."""
    listed = _listing(spark, root, False)
    pictures = images.decode_listed(listed, decode, file_tree.in_one_case)
    rows, rejects = predict.detect_objects_and_rejects(pictures, model, class_names)
    summary = _summary(listed, file_tree.in_one_case, rejects, rows, "image_path")
    return {"rows": rows, "rejects": rejects, "classes": detections.class_report(rows), "summary": summary}


def flags_in_folder(
    spark: SparkSession, root: str, decode: images.Decode, model: predict.Model, threshold: float = 0.7
) -> dict[str, DataFrame]:
    """``rows, rejects, summary`` of a classifier over all images below ``root``; hits carry their hash."""
    listed = _listing(spark, root, True)
    pictures = images.decode_listed(listed, decode, _flag_images)
    rows, rejects = predict.flag_images_and_rejects(pictures, model, threshold)
    summary = _summary(listed, _flag_images, rejects, rows, "path")
    rows = rows.select(*schemas.FLAGGED_IMAGES.fieldNames())
    return {"rows": rows, "rejects": rejects, "summary": summary}
