"""Images of a file tree that all executors can see, decoded in tasks by the user's decoder.

A decoder is given as a factory: it is called once per task and returns a function from the
bytes of a file to a dict with ``height``, ``width``, ``nChannels``, ``mode`` and ``data`` (rows
of pixels, channels last). Hidden files count like any other, and what cannot be read or
decoded keeps its row with an ``error``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hoardlens.sources import file_tree

Decode = Callable[[], Callable[[bytes], dict]]

IMAGE = "struct<origin: string, height: int, width: int, nChannels: int, mode: int, data: binary>"
IMAGE_TYPE = pa.struct(
    [("origin", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("nChannels", pa.int32()),
     ("mode", pa.int32()), ("data", pa.binary())]
)
TASK_BYTES = 128 << 20  # file bytes one decoding task should read
EMIT_BYTES = 32 << 20  # pixels that are handed on at once


def _decoded(path: str, decode) -> tuple[dict | None, str | None]:
    try:
        with open(path, "rb") as source:
            found = decode(source.read())
        image = {name: found[name] for name in ("height", "width", "nChannels", "mode", "data")}
        if image["height"] * image["width"] * image["nChannels"] != len(image["data"]):
            raise ValueError("the data of an image must be height x width x nChannels bytes")
        return image | {"origin": path}, None
    except Exception as failure:  # any failure of a user's decoder stays with its file
        return None, f"{type(failure).__name__}: {failure}"


def decode_files(files: DataFrame, decode: Decode) -> DataFrame:
    """``path, size_bytes, image, error`` of files, in the partitioning given."""
    names = ["path", "size_bytes", "image", "error"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        path, size, image, error = zip(*rows)
        columns = [pa.array(path, pa.string()), pa.array(size, pa.int64()), pa.array(image, IMAGE_TYPE), pa.array(error, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply, rows, held = decode(), [], 0
        for batch in batches:
            for path, size in zip(*(c.to_pylist() for c in batch.columns)):
                image, error = _decoded(path, apply)
                rows.append((path, size, image, error))
                held += len(image["data"]) if image else 0
                if held >= EMIT_BYTES or len(rows) >= file_tree.EMIT_ROWS:
                    yield batch_of(rows)
                    rows, held = [], 0
        if rows:
            yield batch_of(rows)

    schema = f"path string, size_bytes bigint, image {IMAGE}, error string"
    return files.select("path", "size_bytes").mapInArrow(run, schema)


def scan_images(
    spark: SparkSession, root: str, decode: Decode, extensions: list[str] = file_tree.FACE_IMAGES
) -> DataFrame:
    """``path, size_bytes, image, error`` of every image file below ``root``.

    Files are dealt to tasks by bytes. What could not be listed, and files that cannot be read
    or decoded, have an ``error`` and no image.
    """
    choose = lambda files: file_tree.with_extension(files, extensions)
    return decode_listed(file_tree.list_files(spark, root), decode, choose)


def decode_listed(listed: DataFrame, decode: Decode, choose: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``scan_images`` of a listing (``path, size_bytes, error``) and a choice among its files."""
    found = choose(listed.where(F.col("error").isNull()))
    dealt = file_tree.deal_by_bytes(found.select("path", "size_bytes"), TASK_BYTES)
    lost = listed.where(F.col("error").isNotNull()).select(
        "path", "size_bytes", F.lit(None).cast(IMAGE).alias("image"), "error"
    )
    return decode_files(dealt, decode).unionByName(lost)
