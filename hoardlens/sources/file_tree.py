"""Scan of a file tree that all executors can see, such as a shared mount.

Directories are listed in tasks, not on the driver: every round lists the directories found
by the round before, and a task walks on by itself until it has seen a fixed number of
entries. Hidden, underscored and empty files are kept. Links to files are followed, links to
directories are not.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hoardlens.functions import paths
from hoardlens.workspace import fresh_path, materialize

# Extensions taken as images by each scan.
FACE_IMAGES = [".jpg", ".jpeg", ".png", ".bmp", ".tiff", ".webp"]
FLAG_IMAGES = [".jpg", ".jpeg", ".png", ".bmp", ".gif", ".tiff", ".webp"]
OBJECT_IMAGES = [".jpg", ".jpeg", ".png", ".bmp", ".tiff", ".webp"]

WALK_ENTRIES = 20_000  # entries a task lists before it hands its open directories on
EMIT_ROWS = 5_000
CHUNK = 1 << 20
TASK_BYTES = 1 << 30  # file bytes one hashing task should read
FILE_COST = 1 << 16  # bytes a file counts besides its content, so that small files spread as well

LISTED = "path string, is_dir boolean, size_bytes bigint, error string"


def _walk(batches: Iterator[pd.DataFrame], recursive: bool) -> Iterator[pd.DataFrame]:
    columns = ["path", "is_dir", "size_bytes", "error"]
    for batch in batches:
        stack = list(batch["path"])
        rows: list[tuple] = []
        seen = 0
        while stack and seen < WALK_ENTRIES:
            folder = stack.pop()
            try:
                with os.scandir(folder) as entries:
                    for entry in entries:
                        seen += 1
                        try:
                            if entry.is_dir(follow_symlinks=False):
                                if recursive:
                                    stack.append(entry.path)
                            elif entry.is_file():
                                rows.append((entry.path, False, entry.stat().st_size, None))
                        except OSError as failure:
                            rows.append((entry.path, False, None, str(failure)))
                        if len(rows) >= EMIT_ROWS:
                            yield pd.DataFrame(rows, columns=columns)
                            rows = []
            except OSError as failure:
                rows.append((folder, False, None, str(failure)))
        rows.extend((folder, True, None, None) for folder in stack)
        yield pd.DataFrame(rows, columns=columns)


def list_files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """``path, size_bytes, error`` of all regular files below ``root``.

    ``error`` is set, and the size unknown, for what could not be read.
    """
    out = fresh_path(spark, "listing")
    folders = spark.createDataFrame([(os.path.abspath(root),)], "path string")
    probe = folders.mapInPandas(_folder_exists, "present boolean").first()["present"]
    if not probe:
        raise FileNotFoundError(f"not a directory: {root}")
    width = spark.sparkContext.defaultParallelism
    level = 0
    while True:
        target = f"{out}/level={level}"
        listed = folders.mapInPandas(lambda batches: _walk(batches, recursive), LISTED)
        listed.write.parquet(target)
        done = spark.read.schema(LISTED).parquet(target)
        found = done.where("is_dir").select("path")
        open_folders = found.count()
        if not open_folders:
            break
        # A handful of directories per row batch keeps the tasks of a wide tree even.
        folders = found.repartition(max(width, min(open_folders, 100 * width)))
        level += 1
    everything = spark.read.schema(LISTED).parquet(*[f"{out}/level={i}" for i in range(level + 1)])
    return everything.where(~F.col("is_dir")).drop("is_dir")


def _folder_exists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"present": [os.path.isdir(p) for p in batch["path"]]})


def with_extension(files: DataFrame, extensions: list[str]) -> DataFrame:
    """Files by extension in any case."""
    return files.where(F.lower(paths.suffix(F.col("path"))).isin(extensions))


def list_images(
    spark: SparkSession, root: str, extensions: list[str] = FACE_IMAGES, ordered: bool = True
) -> DataFrame:
    """Image files of a tree by extension in any case, in order of their paths."""
    found = with_extension(list_files(spark, root), extensions)
    return found.orderBy("path") if ordered else found


def in_one_case(files: DataFrame, extensions: list[str] = OBJECT_IMAGES) -> DataFrame:
    """Files whose extension is all lower or all upper case and whose name does not start with a dot."""
    both = extensions + [e.upper() for e in extensions]
    visible = ~paths.base_name(F.col("path")).startswith(".")
    return files.where(paths.suffix(F.col("path")).isin(both) & visible)


def list_images_flat(spark: SparkSession, root: str, ordered: bool = True) -> DataFrame:
    """Image files directly in a folder, whose extension is all lower or all upper case, in order."""
    found = in_one_case(list_files(spark, root, recursive=False))
    return found.orderBy("path") if ordered else found


def deal_by_bytes(files: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The same rows (with ``size_bytes``), dealt so that no task gets more than its share and one file.

    Sizes are summed up along the rows, part by part; a file goes to the task in whose share of
    the sum it begins. Only one total a part reaches the driver. The sums are stored, so a
    repeated task deals as the first one did.
    """
    names = files.columns

    def add_up(batches):
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = batch.column(names.index("size_bytes")).fill_null(0).to_numpy().astype(np.int64) + FILE_COST
            ends = before + np.cumsum(sizes)
            columns = [pa.array(np.full(len(sizes), part, np.int32)), pa.array(ends - sizes), pa.array(ends)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*names, "_part", "_start", "_end"])
            before = int(ends[-1]) if len(ends) else before

    schema = ", ".join([*[f"`{n}` {k}" for n, k in files.dtypes], "_part int, _start bigint, _end bigint"])
    placed = materialize(files.mapInArrow(add_up, schema), "sizes")
    totals = sorted(tuple(r) for r in placed.groupBy("_part").agg(F.max("_end")).collect())
    if not totals:
        return files
    starts = list(accumulate((t for _, t in totals), initial=0))
    tasks = max(4 * files.sparkSession.sparkContext.defaultParallelism, -(-starts[-1] // task_bytes))
    first = files.sparkSession.createDataFrame(
        [(part, start) for (part, _), start in zip(totals, starts)], "_part int, _first bigint"
    )
    share = F.expr(f"cast(((cast(_first as decimal(38,0)) + _start) * {tasks}) div {starts[-1]} as int)")
    dealt = placed.join(F.broadcast(first), "_part").withColumn("_task", share)
    return dealt.repartitionById(tasks, F.col("_task")).select(*names)


def file_hash(path: str) -> tuple[str | None, str | None]:
    """SHA-256 of a file read in chunks, or what went wrong."""
    digest = hashlib.sha256()
    try:
        with open(path, "rb") as source:
            while chunk := source.read(CHUNK):
                digest.update(chunk)
    except OSError as failure:
        return None, str(failure)
    return digest.hexdigest(), None


def hash_files(files: DataFrame) -> DataFrame:
    """Add ``hash`` and ``hash_error`` to rows with a ``path``, in the partitioning given."""
    fields = [f"`{n}` {k}" for n, k in files.dtypes if n not in ("hash", "hash_error")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 1000):
                part = batch.iloc[start : start + 1000].copy()
                results = [file_hash(p) for p in part["path"]]
                part["hash"] = pd.Series([r[0] for r in results], part.index, dtype=object)
                part["hash_error"] = pd.Series([r[1] for r in results], part.index, dtype=object)
                yield part

    return files.mapInPandas(run, ", ".join([*fields, "hash string", "hash_error string"]))


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """``path, hash, size_bytes, error`` of all files: a manifest with its problems.

    A file whose content cannot be read keeps its row with a NULL hash; only entries that
    cannot even be looked at have no size. Files are spread over tasks by bytes.
    """
    listed = list_files(spark, root)
    readable = deal_by_bytes(listed.where(F.col("error").isNull()).drop("error"))
    hashed = hash_files(readable).select(
        "path", "hash", "size_bytes", F.col("hash_error").alias("error")
    )
    failed = listed.where(F.col("error").isNotNull()).select(
        "path", F.lit(None).cast("string").alias("hash"), "size_bytes", "error"
    )
    return hashed.unionByName(failed)


def manifest_rows(scanned: DataFrame) -> DataFrame:
    """What a manifest holds: every file that could be looked at."""
    return scanned.where(F.col("size_bytes").isNotNull()).select("path", "hash", "size_bytes")


def existing_only(rows: DataFrame, listing: DataFrame, path: str) -> DataFrame:
    """Rows whose file is in the listing."""
    present = listing.select(F.col("path").alias(path))
    return rows.join(present, path, "left_semi")
