"""Tables made from what image models return."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hoardlens import schemas
from hoardlens.functions import boxes, paths


def every_nth_frame(frames: DataFrame, frame_skip: int = 1) -> DataFrame:
    """Frames whose number is a multiple of ``frame_skip``."""
    if frame_skip < 1:
        raise ValueError("frame_skip must be at least 1")
    return frames.where(F.pmod(F.col("frame_id"), F.lit(frame_skip)) == 0)


def confident(detections: DataFrame, score: str, threshold: float = 0.5) -> DataFrame:
    """Detections that reach the threshold."""
    return detections.where(F.col(score) >= threshold)


def face_rows(
    raw: DataFrame, threshold: float = 0.5, crop_folder: str | None = None
) -> DataFrame:
    """Detection table from raw faces (``schemas.RAW_FACES``).

    ``face_id`` counts before the threshold, so ids may have gaps. With a crop folder every
    face gets the path of its crop and the padded box; ``source_path`` keeps apart images of
    the same name in different folders.
    """
    corners = {f"bbox_{c}": boxes.whole_pixels(F.col(c)) for c in ("x1", "y1", "x2", "y2")}
    crop_path = F.lit(None).cast("string")
    if crop_folder is not None:
        crop_path = boxes.crop_name(crop_folder, F.col("path"), F.col("face_id"))
    rows = confident(raw, "det_score", threshold).select(
        paths.base_name(F.col("path")).alias("source_file"),
        "frame_id",
        "face_id",
        *[c.alias(name) for name, c in corners.items()],
        F.col("det_score").alias("confidence"),
        F.to_json("landmarks").alias("landmark_points"),
        crop_path.alias("cropped_face_path"),
        F.col("path").alias("source_path"),
        "image_width",
        "image_height",
    )
    crop = boxes.padded_crop(
        F.col("bbox_x1"), F.col("bbox_y1"), F.col("bbox_x2"), F.col("bbox_y2"),
        F.col("image_width"), F.col("image_height"),
    )
    return rows.withColumns(crop)


def detection_table(rows: DataFrame) -> DataFrame:
    """The columns that are stored, in their fixed order."""
    return rows.select(*schemas.FACE_DETECTIONS.fieldNames())


def combine(images: DataFrame, videos: DataFrame) -> DataFrame:
    """Detections of images and of video frames; frames have no crop."""
    return images.unionByName(videos, allowMissingColumns=True)


def face_counts(rows: DataFrame) -> DataFrame:
    """Detected and cropped faces."""
    has_crop = F.coalesce(F.col("cropped_face_path") != "", F.lit(False))
    return rows.agg(
        F.count(F.lit(1)).alias("total_faces"), F.count_if(has_crop).alias("cropped_faces")
    )


def largest_per_image(faces: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The face with the largest box of every image; ties go to the first in ``order``.

    The largest area is a number, so it is found by a hashed aggregation over two columns; only
    boxes of that area are compared further. Areas that cannot be computed come last.
    """
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    area = F.coalesce(F.when(~F.isnan(area), area), F.lit(float("-inf")))
    # Rows without a key are one group, as any other.
    same = F.when(F.col(key).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(key).cast("string")))
    sized = faces.withColumns({"_key": same, "_area": area})
    best = sized.groupBy("_key").agg(F.max("_area").alias("_best")).withColumnRenamed("_key", "_of")
    # One row a key is hashed on the right, so the boxes themselves are not sorted.
    reaches = (F.col("_key") == F.col("_of")) & (F.col("_area") >= F.col("_best"))
    candidates = sized.join(best.hint("shuffle_hash"), reaches, "left_semi")
    row, first = F.struct(*faces.columns), F.struct(*order)
    return candidates.groupBy("_key").agg(F.min_by(row, first).alias("best")).select("best.*")


def object_rows(raw: DataFrame, class_names: Mapping[int, str] | None = None) -> DataFrame:
    """Object table from raw detections (``schemas.RAW_OBJECTS``).

    ``class_names`` is the model's own list. Without it the rows bring ``class_name``.
    """
    name = F.col("class_name") if class_names is None else _lookup(class_names)
    box = boxes.box_metrics(
        *[F.col(c) for c in ("x1", "y1", "x2", "y2", "image_width", "image_height")]
    )
    mask = boxes.mask_metrics(F.col("mask_area"), F.col("image_width"), F.col("image_height"))
    corners = {f"bbox_{c}": F.col(c) for c in ("x1", "y1", "x2", "y2")}
    known = {
        "image_name": paths.base_name(F.col("image_path")),
        "class_name": name,
        **corners,
        **box,
        **mask,
    }
    columns = schemas.OBJECT_DETECTIONS.fieldNames()
    return raw.select(*[known.get(c, F.col(c)).alias(c) for c in columns])


def _lookup(class_names: Mapping[int, str]) -> Column:
    pairs = [F.lit(x) for pair in class_names.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), F.col("class_id"))


def detection_summary(objects: DataFrame) -> DataFrame:
    """Images with detections, detections, mean confidence and number of classes."""
    return objects.agg(
        F.count_distinct("image_name").alias("images"),
        F.count(F.lit(1)).alias("detections"),
        F.avg("confidence").alias("avg_confidence"),
        F.count_distinct("class_name").alias("classes"),
    )


def class_report(objects: DataFrame) -> DataFrame:
    """Detections per class, by class name."""
    return (
        objects.groupBy("class_name")
        .agg(F.count(F.lit(1)).alias("detections"))
        .orderBy(F.col("class_name").asc_nulls_last())
    )


def check_threshold(threshold: float) -> None:
    if not 0.0 <= threshold <= 1.0:
        raise ValueError("threshold must be between 0 and 1")


def is_flagged(results: Column, threshold: float = 0.7, label: str = "nsfw") -> Column:
    """True when any result carries the label, in any case, with enough confidence."""
    check_threshold(threshold)
    hit = F.exists(
        results, lambda r: (F.lower(r["label"]) == label) & (r["score"] >= threshold)
    )
    return F.coalesce(hit, F.lit(False))
