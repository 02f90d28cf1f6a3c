"""Running a user's model over images inside Spark tasks.

A model is given as a factory: it is called once per task and returns a function that takes a
pandas DataFrame of images (``path`` and the fields of Spark's image struct) and returns one
list of dicts per row. When a batch fails its rows are tried one by one, and a row that still
fails keeps its message in ``error`` instead of stopping the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hoardlens import schemas
from hoardlens.functions import boxes, paths, pixels
from hoardlens.operators import detections, similarity
from hoardlens.sources.file_tree import hash_files
from hoardlens.workspace import materialize

Predict = Callable[[pd.DataFrame], Sequence[list[dict]]]
Model = Callable[[], Predict]

MODEL_BYTES = 8 << 20  # pixels given to a model at once; a larger image goes alone


def _pieces(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Rows of a batch in runs of about MODEL_BYTES."""
    start = size = 0
    for at, data in enumerate(batch["data"]):
        own = len(data) if isinstance(data, (bytes, bytearray)) else 0
        if at > start and size + own > MODEL_BYTES:
            yield batch.iloc[start:at]
            start, size = at, 0
        size += own
    yield batch.iloc[start:]


def apply_model(image: Column, path: Column, model: Model, item: T.StructType) -> Column:
    """``struct<found: array<item>, error: string>`` for every image; NULLs for a NULL image."""
    fields = item.fieldNames()
    kind = T.StructType().add("found", T.ArrayType(item)).add("error", "string")

    def attempt(predict: Predict, rows: pd.DataFrame) -> list[tuple]:
        try:
            found = list(predict(rows))
            if len(found) != len(rows):
                raise ValueError("a model must return one list per image")
            return [([{f: hit.get(f) for f in fields} for hit in hits], None) for hits in found]
        except Exception as failure:  # any failure of a user's model stays with its row
            if len(rows) == 1:
                return [(None, f"{type(failure).__name__}: {failure}")]
            singles = (rows.iloc[i : i + 1] for i in range(len(rows)))
            return [one for single in singles for one in attempt(predict, single)]

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = model()
        for batch in (piece for whole in batches for piece in _pieces(whole)):
            present = batch[batch["given"]].drop(columns="given")
            # Rows without an image made these columns floating-point numbers.
            present = present.astype({n: "int64" for n in ("height", "width", "nChannels", "mode")})
            out = pd.DataFrame({"found": None, "error": None}, index=batch.index, dtype=object)
            if len(present):
                results = attempt(predict, present.reset_index(drop=True))
                for at, (found, error) in zip(present.index, results):
                    out.at[at, "found"], out.at[at, "error"] = found, error
            yield out

    names = ["height", "width", "nChannels", "mode", "data"]
    # Marked so that the optimizer neither repeats the call for a filter on its result nor
    # moves such a filter below it: a model runs once per image.
    return run.asNondeterministic()(
        F.struct(
            image.isNotNull().alias("given"),
            path.alias("path"),
            *[image[n].alias(n) for n in names],
        )
    )


def split(predicted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows the model handled and rows it failed on.

    Store ``predicted`` first when both are used, or the model runs twice.
    """
    failed = F.col("result")["error"].isNotNull()
    return predicted.where(~failed), predicted.where(failed)


def with_result(images: DataFrame, model: Model, item: T.StructType) -> DataFrame:
    """Add the model's ``result`` to images with columns ``path`` and ``image``."""
    return images.withColumn("result", apply_model(F.col("image"), F.col("path"), model, item))


def _keys(images: DataFrame) -> list[str]:
    return [c for c in ("path", "frame_id") if c in images.columns]


def run_once(
    images: DataFrame, model: Model, item: T.StructType, pixels: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Images with the model's ``result``, and the rejects: ``path``, ``frame_id`` and ``error``.

    Rejects are images on which the model failed, and those that come without an image but
    with an ``error`` of their own. Results are stored, so the model runs once for both; the
    pixels only where they are asked for.
    """
    predicted = with_result(images, model, item)
    own = F.col("error") if "error" in images.columns else F.lit(None).cast("string")
    image = F.col("image")
    if not pixels:
        image = F.struct(image["height"].alias("height"), image["width"].alias("width"))
    kept = predicted.select(*_keys(images), image.alias("image"), own.alias("own_error"), "result")
    kept = materialize(kept, "predicted")
    error = F.coalesce("own_error", F.col("result")["error"])
    rejects = kept.where(error.isNotNull()).select(*_keys(images), error.alias("error"))
    return kept.where(error.isNull()).drop("own_error"), rejects


def raw_faces(predicted: DataFrame) -> DataFrame:
    """One row per face found by a face model, numbered as the model lists them."""
    frame = F.col("frame_id") if "frame_id" in predicted.columns else F.lit(0)
    return predicted.select(
        "path",
        frame.cast("int").alias("frame_id"),
        "image",
        F.posexplode(F.col("result")["found"]).alias("face_id", "face"),
    ).select(
        "path", "frame_id", "face_id", "face.*",
        F.col("image")["width"].alias("image_width"),
        F.col("image")["height"].alias("image_height"),
        "image",
    )


def detect_faces(
    images: DataFrame, model: Model, threshold: float = 0.5, crop_folder: str | None = None
) -> DataFrame:
    """Face rows of all images the model handled; ``detect_faces_and_rejects`` also lists the others."""
    return detections.face_rows(
        raw_faces(with_result(images, model, schemas.FACE_ITEM)), threshold, crop_folder
    )


def detect_faces_and_rejects(
    images: DataFrame, model: Model, threshold: float = 0.5, crop_folder: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Face rows, and the images without a result with their ``error``."""
    predicted, rejects = run_once(images, model, schemas.FACE_ITEM)
    return detections.face_rows(raw_faces(predicted), threshold, crop_folder), rejects


def detect_faces_in_frames(
    frames: DataFrame, model: Model, threshold: float = 0.5, frame_skip: int = 1
) -> DataFrame:
    """Face rows of every n-th frame; frames get no crops."""
    chosen = detections.every_nth_frame(frames, frame_skip)
    return detect_faces(chosen, model, threshold)


def detect_faces_in_frames_and_rejects(
    frames: DataFrame, model: Model, threshold: float = 0.5, frame_skip: int = 1
) -> tuple[DataFrame, DataFrame]:
    """Face rows of every n-th frame, and the frames without a result with their ``error``."""
    return detect_faces_and_rejects(detections.every_nth_frame(frames, frame_skip), model, threshold)


def crop_faces(
    images: DataFrame, model: Model, crop_folder: str, threshold: float = 0.5
) -> DataFrame:
    """Face rows with their crops as image structs; ``crop_faces_and_rejects`` also lists failed images.

    The pixels stay in the row of their image until all its crops are cut, in one call of
    Python an image, so nothing is joined back.
    """
    return _crops(with_result(images, model, schemas.FACE_ITEM), crop_folder, threshold)


def crop_faces_and_rejects(
    images: DataFrame, model: Model, crop_folder: str, threshold: float = 0.5
) -> tuple[DataFrame, DataFrame]:
    """Face rows with their crops, and the images without a result with their ``error``."""
    predicted, rejects = run_once(images, model, schemas.FACE_ITEM, pixels=True)
    return _crops(predicted, crop_folder, threshold), rejects


def _crops(predicted: DataFrame, crop_folder: str, threshold: float) -> DataFrame:
    image, path = F.col("image"), F.col("path")
    frame = F.col("frame_id") if "frame_id" in predicted.columns else F.lit(0)

    def box(face: Column, index: Column) -> Column:
        corner = {c: boxes.whole_pixels(face[c]) for c in ("x1", "y1", "x2", "y2")}
        grown = boxes.padded_crop(*corner.values(), image["width"], image["height"])
        sides = zip(("x1", "y1", "x2", "y2"), grown.values())
        sure = F.coalesce(face["det_score"] >= threshold, F.lit(False))
        return F.struct(index.alias("face_id"), sure.alias("sure"), *[c.alias(n) for n, c in sides])

    wanted = F.filter(F.transform(F.col("result")["found"], box), lambda b: b["sure"])
    cut = predicted.select(path, frame.cast("int").alias("frame_id"), "image", wanted.alias("boxes"))
    # Images without a box are not sent to Python at all.
    cut = cut.where(F.size("boxes") > 0).withColumn("crops", pixels.crop_boxes(image, F.col("boxes")))
    face = F.col("crop")
    return cut.select("path", "frame_id", F.explode(F.arrays_zip("boxes", "crops")).alias("crop")).select(
        boxes.crop_name(crop_folder, path, face["boxes"]["face_id"]).alias("cropped_face_path"),
        path.alias("source_path"), "frame_id", face["boxes"]["face_id"].alias("face_id"),
        face["crops"].alias("image"),
    )


def largest_face(found: Column) -> Column:
    """First face with the largest box in a list of faces, NULL for an empty one."""

    def area(face: Column) -> Column:
        return (face["x2"] - face["x1"]) * (face["y2"] - face["y1"])

    largest = F.array_max(F.transform(found, area))
    return F.try_element_at(F.filter(found, lambda face: area(face) == largest), F.lit(1))


def embed_faces(crops: DataFrame, model: Model, direct: Model | None = None) -> DataFrame:
    """Add ``embedding`` to crops (``path``, ``image``); NULL where nothing could be computed.

    The embedding of the largest face counts. Where no face is found, ``direct`` gets the crop
    as a whole; it is not called for other rows. Stored faces use it, search queries do not.
    """
    found = with_result(crops, model, schemas.FACE_ITEM)
    faces = F.col("result")["found"]
    out = found.withColumn("embedding", largest_face(faces)["embedding"])
    if direct is not None:
        missed = F.when(F.size(faces) == 0, F.col("image"))
        whole = apply_model(missed, F.col("path"), direct, schemas.VECTOR_ITEM)["found"]
        out = out.withColumn(
            "embedding",
            F.coalesce("embedding", F.try_element_at(whole, F.lit(1))["embedding"]),
        )
    return out.withColumn("error", F.col("result")["error"]).drop("result")


def embed_detections(
    faces: DataFrame, crops: DataFrame, model: Model, direct: Model | None = None
) -> DataFrame:
    """Detected faces with the embedding of their crop, ready to be stored.

    ``crops`` are the images that exist; faces without a crop path, without a crop or without
    an embedding are left out. Each crop is embedded once, and only vectors are joined.
    """
    ready = faces.where(F.col("cropped_face_path").isNotNull())
    wanted = ready.select(F.col("cropped_face_path").alias("path"))
    embedded = embed_faces(crops.join(wanted, "path", "left_semi"), model, direct)
    return _with_vectors(ready, embedded)


def embed_detections_and_rejects(
    faces: DataFrame, crops: DataFrame, model: Model, direct: Model | None = None
) -> tuple[DataFrame, DataFrame]:
    """``embed_detections``, and ``cropped_face_path, error`` of the crops that gave no embedding.

    A crop path without a crop, a failure of the model and a crop in which nothing was found
    are told apart by their ``error``.
    """
    ready = faces.where(F.col("cropped_face_path").isNotNull())
    wanted = ready.select(F.col("cropped_face_path").alias("path")).distinct()
    embedded = embed_faces(crops.join(wanted, "path", "left_semi"), model, direct)
    embedded = materialize(embedded.select("path", "embedding", "error"), "embedded")
    fault = F.coalesce("error", F.when(F.col("embedding").isNull(), F.lit("no face found")))
    failed = embedded.select("path", fault.alias("error")).where(F.col("error").isNotNull())
    missing = wanted.join(embedded, "path", "left_anti").withColumn("error", F.lit("no such crop"))
    rejects = failed.unionByName(missing).withColumnRenamed("path", "cropped_face_path")
    return _with_vectors(ready, embedded), rejects


def _with_vectors(ready: DataFrame, embedded: DataFrame) -> DataFrame:
    vectors = embedded.where(F.col("embedding").isNotNull()).select(
        F.col("path").alias("cropped_face_path"), "embedding"
    )
    return ready.join(vectors, "cropped_face_path")


def similar_faces(
    embeddings: DataFrame, query: DataFrame, model: Model, top_k: int = 5
) -> DataFrame:
    """Stored faces most similar to each image (``path``, ``image``); none for one without a face."""
    asked = embed_faces(query, model).select(F.col("path").alias("id"), "embedding")
    found = similarity.similar_batch(embeddings, asked, top_k)
    stored = embeddings.select("id", "cropped_face_path", "source_file", "confidence")
    return found.join(stored, "id").select(
        F.col("query_id").alias("query_path"),
        F.col("id").alias("face_id"),
        "similarity",
        F.col("cropped_face_path").alias("face_path"),
        "source_file",
        "confidence",
        "rank",
    )


def _raw_objects(predicted: DataFrame) -> DataFrame:
    return predicted.select(
        "path", "image", F.posexplode(F.col("result")["found"]).alias("n", "item")
    ).select(
        F.col("path").alias("image_path"),
        F.col("image")["width"].alias("image_width"),
        F.col("image")["height"].alias("image_height"),
        F.col("n").alias("detection_id"),
        "item.*",
    )


def detect_objects(
    images: DataFrame, model: Model, class_names: dict[int, str]
) -> DataFrame:
    """Object rows of all images the model handled; ``detect_objects_and_rejects`` lists the others."""
    predicted = with_result(images, model, schemas.OBJECT_ITEM)
    return detections.object_rows(_raw_objects(predicted), class_names)


def detect_objects_and_rejects(
    images: DataFrame, model: Model, class_names: dict[int, str]
) -> tuple[DataFrame, DataFrame]:
    """Object rows, and the images without a result with their ``error``."""
    predicted, rejects = run_once(images, model, schemas.OBJECT_ITEM)
    return detections.object_rows(_raw_objects(predicted), class_names), rejects


def _flagged(predicted: DataFrame, threshold: float) -> DataFrame:
    hits = predicted.where(detections.is_flagged(F.col("result")["found"], threshold))
    hashed = hash_files(hits.select("path"))
    return hashed.select(
        "hash", "path", paths.base_name(F.col("path")).alias("filename"), "hash_error"
    )


def flag_images(images: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """``hash, path, filename`` of flagged images; only those are read again for their hash."""
    scored = with_result(images, model, schemas.SCORE_ITEM)
    return _flagged(scored, threshold).drop("hash_error")


def flag_images_and_rejects(
    images: DataFrame, model: Model, threshold: float = 0.7
) -> tuple[DataFrame, DataFrame]:
    """Flagged images, and the images without a result, or flagged but unreadable, with their ``error``.

    A flagged image whose file cannot be read keeps its row with a NULL hash.
    """
    detections.check_threshold(threshold)
    predicted, rejects = run_once(images, model, schemas.SCORE_ITEM)
    flagged = materialize(_flagged(predicted, threshold), "flagged")
    unread = flagged.where(F.col("hash_error").isNotNull()).select("path", F.col("hash_error").alias("error"))
    return flagged.drop("hash_error"), rejects.select("path", "error").unionByName(unread)
