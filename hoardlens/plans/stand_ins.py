"""Stand-ins for what the registered queries cannot bring along: models and file trees."""

from __future__ import annotations

import csv
import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hoardlens.plans import views
from hoardlens.workspace import fresh_path


def faces():
    """Model factory: up to two boxes per image, derived from its size."""

    def predict(images: pd.DataFrame) -> list[list[dict]]:
        return [
            [
                {
                    "x1": i - 0.5,
                    "y1": i * 1.5,
                    "x2": width - 3.0 * i,
                    "y2": height * 0.5 + i,
                    "det_score": ((height * 7 + i * 13) % 100) / 100,
                    "landmarks": [[float(i), 1.5]],
                    "embedding": [float(height), float(i), float(width)],
                }
                for i in range(height % 3)
            ]
            for height, width in zip(images["height"].tolist(), images["width"].tolist())
        ]

    return predict


def whole_image():
    """Model factory: one vector per image from its size and first byte."""

    def predict(images: pd.DataFrame) -> list[list[dict]]:
        return [
            [{"embedding": [float(height), -1.0, float(data[0])]}]
            for height, data in zip(images["height"].tolist(), images["data"])
        ]

    return predict


def objects():
    """Model factory: up to three boxes per image, every other one with a mask."""

    def predict(images: pd.DataFrame) -> list[list[dict]]:
        return [
            [
                {
                    "class_id": (height + i) % 4,
                    "confidence": 1.0 / (2 + i),
                    "x1": 0.25 * i,
                    "y1": 0.5 * i,
                    "x2": 0.25 * i + 4,
                    "y2": 0.5 * i + height,
                    "mask_area": 3.0 * height if i % 2 == 0 else None,
                }
                for i in range(height % 4)
            ]
            for height in images["height"].tolist()
        ]

    return predict


def failing(model):
    """Model factory: ``model``, but failing on images whose height is a multiple of eleven."""

    def factory():
        predict = model()

        def checked(images: pd.DataFrame) -> list[list[dict]]:
            if (images["height"] % 11 == 0).any():
                raise RuntimeError("height")
            return predict(images)

        return checked

    return factory


def classifier():
    """Model factory: one score per image from its height."""
    return lambda images: [[{"label": "NSFW", "score": (h % 10) / 10}] for h in images["height"].tolist()]


def ten_pixel_rows():
    """Decoder factory: file bytes as rows of ten pixels, filled up with zeros; some lengths are refused."""

    def decode(data: bytes) -> dict:
        if len(data) % 7 == 0:
            raise ValueError("length")
        height = -(-len(data) // 30)
        return {"height": height, "width": 10, "nChannels": 3, "mode": 16, "data": data.ljust(30 * height, b"\0")}

    return decode


def _write_files(spark: SparkSession, rows: DataFrame, name: str) -> str:
    """Write ``path, text`` as files below a new mounted folder; returns its path. Files appear complete."""
    root = fresh_path(spark, name).removeprefix("file://").removeprefix("file:")
    if "://" in root:
        raise RuntimeError("the shared folder must be a mounted file system for this query")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, text in zip(batch["path"], batch["text"]):
                target = root + path
                os.makedirs(os.path.dirname(target), exist_ok=True)
                partial = f"{root}-partial/{uuid.uuid4().hex}"
                os.makedirs(os.path.dirname(partial), exist_ok=True)
                with open(partial, "wb") as out:
                    out.write(text.encode())
                os.replace(partial, target)
            yield pd.DataFrame({"written": [len(batch)]})

    spread = rows.repartition(4 * spark.sparkContext.defaultParallelism)
    spread.mapInPandas(write, "written bigint").agg(F.sum("written")).collect()
    return root


def documents_as_files(spark: SparkSession, sf_dir: str) -> str:
    """Write every document into a tree of files in the shared folder; returns its root.

    The tree has a hidden folder and files without a suffix.
    """
    doc = F.col("doc_id").cast("string")
    path = F.concat(
        F.lit("/."), "lang", F.lit("/"), "source", F.lit("/_doc "), doc,
        F.when(F.col("doc_id") % 2 == 0, ".txt").otherwise(""),
    )
    documents = views.table(spark, sf_dir, "documents").select(path.alias("path"), "text")
    return _write_files(spark, documents, "tree")


# Extensions of the pictures, by the remainder of their number.
ENDINGS = [".png", ".JPG", ".jpeg", ".GIF", ".Bmp", ".tiff", ".webp", ".txt"]


def documents_as_pictures(spark: SparkSession, sf_dir: str) -> str:
    """Write every document as a picture file: even numbers at the top, others below hidden folders."""
    doc = F.col("doc_id")
    name = F.concat(doc.cast("string"), F.element_at(F.array(*[F.lit(e) for e in ENDINGS]), (doc % 8 + 1).cast("int")))
    path = F.when(doc % 2 == 0, F.concat(F.lit("/pic "), name)).otherwise(
        F.concat(F.lit("/."), "lang", F.lit("/"), "source", F.lit("/_pic "), name)
    )
    documents = views.table(spark, sf_dir, "documents").select(path.alias("path"), "text")
    return _write_files(spark, documents, "pictures")


def documents_as_odd_manifests(spark: SparkSession, sf_dir: str) -> str:
    """Write the manifest rows by hand: hidden and odd names, columns in any order among others.

    Each name is one file, written row by row by the task that holds its rows.
    """
    folder = fresh_path(spark, "odd").removeprefix("file://").removeprefix("file:")
    if "://" in folder:
        raise RuntimeError("the shared folder must be a mounted file system for this query")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        name, out, partial, kind = None, None, None, 0

        def finish():
            out.close()
            os.replace(partial, f"{folder}/{name}")

        for batch in batches:
            rows = zip(batch["name"], batch["path"], batch["hash"], batch["size_bytes"], batch["kind"])
            for own, path, hashed, size, kind in rows:
                if own != name:
                    if out:
                        finish()
                    name, partial = own, f"{folder}/{uuid.uuid4().hex}"
                    out = open(partial, "w", newline="", encoding="utf-8")
                    writer = csv.writer(out, lineterminator="\n")
                    writer.writerow([["path", "hash", "size_bytes"], ["Size_Bytes", "owner", "PATH", "hash"]][kind])
                hashed = hashed if isinstance(hashed, str) else ""
                writer.writerow([path, hashed, size] if kind == 0 else [size, "me, you", path, hashed])
            yield pd.DataFrame({"written": [len(batch)]})
        if out:
            finish()

    rows = views.odd_manifest(spark, sf_dir)
    sorted_rows = rows.repartition(F.col("name")).sortWithinPartitions("name")
    sorted_rows.mapInPandas(write, "written bigint").agg(F.sum("written")).collect()
    return folder
