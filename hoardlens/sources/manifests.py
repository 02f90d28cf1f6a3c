"""Manifest CSV files: ``path, hash, size_bytes`` per device, named after the device.

Manifests are found by the end of their name only and read by the names of their columns, in
any order and any case, among any others.
"""

from __future__ import annotations

import csv
import os
import re
import shutil
from collections import defaultdict
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hoardlens import schemas
from hoardlens.workspace import fresh_path

CSV_OPTIONS = {
    "header": True,
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}
PARTITION = "source_filename="


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def find_manifests(spark: SparkSession, folder: str) -> list[str]:
    """Sorted ``*.csv`` entries of a folder: plain files, or folders of written parts."""
    path, fs = _file_system(spark, folder)
    if not fs.exists(path):
        raise FileNotFoundError(f"manifest folder not found: {folder}")
    names = sorted(status.getPath().getName() for status in fs.listStatus(path))
    return [f"{folder.rstrip('/')}/{n}" for n in names if n.endswith(".csv")]


def _hidden(name: str) -> bool:
    """Names that Spark's file sources pass over."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name)


def entry_name(name: str) -> str:
    """Name of a file or folder that holds the manifest ``name`` and can be read by Spark."""
    return PARTITION + quote(name, safe=" ") if _hidden(name) or name.startswith(PARTITION) else name


def _plain_name(entry: str) -> str:
    return unquote(entry[len(PARTITION) :]) if entry.startswith(PARTITION) else entry


def _copy_mounted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for source, target in zip(batch["source"], batch["target"]):
            if os.path.isdir(source):
                # Parts count by their own names, so hidden ones (a repeated task's) stay behind.
                shutil.copytree(source, target, dirs_exist_ok=True)
            else:
                os.makedirs(os.path.dirname(target), exist_ok=True)
                shutil.copyfile(source, target)
        yield batch[["target"]]


def _visible(spark: SparkSession, entries: list[str]) -> list[str]:
    """Entries under names that Spark reads; hidden ones are copied to the shared folder.

    Copies are made by tasks where the folders are mounted, else by the file system's client.
    """
    hidden = [e for e in entries if _hidden(e.rsplit("/", 1)[1])]
    if not hidden:
        return entries
    base = fresh_path(spark, "hidden")
    copies = {e: f"{base}/{PARTITION}{quote(e.rsplit('/', 1)[1], safe=' ')}" for e in hidden}
    local = re.compile(r"\A(file:/+)?(?=/|[^:]*\Z)")
    if all(local.match(p) and "://" not in p.removeprefix("file://") for p in (hidden[0], base)):
        plain = lambda p: os.path.abspath(re.sub(r"\Afile:/+", "/", p))
        rows = [(plain(e), plain(c)) for e, c in copies.items()]
        jobs = spark.createDataFrame(rows, "source string, target string").repartition(len(rows))
        jobs.mapInPandas(_copy_mounted, "target string").count()
    else:
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        for entry, copy in copies.items():
            (source, fs), (target, shared) = (_file_system(spark, p) for p in (entry, copy))
            spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, source, shared, target, False, conf)
    return [copies.get(e, e) for e in entries]


def _glob_safe(path: str) -> str:
    for mark in "\\{}[]*?":
        path = path.replace(mark, "\\" + mark)
    return path


def _source_name() -> F.Column:
    """Name of the manifest a row came from: the first ``.csv`` part of its file's path."""
    parts = F.split(_plus_safe(F.col("_metadata.file_path")), "/")
    name = F.url_decode(F.try_element_at(F.filter(parts, lambda p: p.endswith(".csv")), F.lit(1)))
    # Folders written by write_manifests carry an escaped column value.
    value = F.url_decode(_plus_safe(F.substring(name, F.lit(len(PARTITION) + 1), F.length(name))))
    return F.when(name.startswith(PARTITION), value).otherwise(name)


def _plus_safe(text: F.Column) -> F.Column:
    return F.replace(text, F.lit("+"), F.lit("%2B"))


def _looked_at(spark: SparkSession, files: list[str]) -> list[tuple[str, str, bool]]:
    """``path, header, multiline`` of every file with content, from one plain text scan.

    A file has a line break inside quotes when a line has an odd number of quotes. Without one
    every record is one line and even a single huge manifest can be read by many tasks. The
    header is the first line of the split at the start of the file; only lines that name all
    columns of a manifest leave the scan.
    """
    value = F.col("value")
    names_all = F.lit(True)
    for name in schemas.MANIFEST.fieldNames():
        names_all &= value.rlike(rf'(?i)(\A\x{{FEFF}}?|,)\s*"?\s*{name}\s*"?\s*(,|\z)')
    lines = spark.read.text([_glob_safe(f) for f in files]).select(
        F.col("_metadata.file_path").alias("file"),
        F.when(F.col("_metadata.file_block_start") == 0, F.monotonically_increasing_id()).alias("place"),
        F.when(names_all, value).alias("line"),
        (F.length(value) % 2 != F.length(F.replace(value, F.lit('"'), F.lit(""))) % 2).alias("odd"),
    )
    found = lines.groupBy("file", "line").agg(F.min("place").alias("place"), F.max("odd").alias("odd"))
    by_file = defaultdict(list)
    for row in found.collect():
        by_file[row["file"]].append(row)
    out = []
    for file, rows in by_file.items():
        first = min((r for r in rows if r["place"] is not None), key=lambda r: r["place"])
        if first["line"] is None:
            wanted = ", ".join(schemas.MANIFEST.fieldNames())
            raise ValueError(f"the manifest {unquote(file)} does not begin with a header that names {wanted}")
        out.append((file, first["line"], any(r["odd"] for r in rows)))
    return out


def _columns(header: str) -> tuple[str, ...]:
    return tuple(next(csv.reader([header.removeprefix("﻿").rstrip("\r")]), ()))


def _schema(columns: tuple[str, ...]) -> T.StructType:
    """Fields in the order of a header: those of a manifest by name, others under made-up names."""
    schema, left = T.StructType(), {f.name: f.dataType for f in schemas.MANIFEST}
    for i, name in enumerate(c.strip().lower() for c in columns):
        if name in left:
            schema = schema.add(name, left.pop(name))
        else:
            schema = schema.add(f"_other_{i}", "string")
    return schema


def _read(spark: SparkSession, files: list[str], columns: tuple[str, ...], multiline: bool, strict: bool) -> DataFrame:
    reader = spark.read.options(**CSV_OPTIONS).option("multiLine", multiline)
    schema, names = _schema(columns), schemas.MANIFEST.fieldNames()
    if strict:
        # A bad cell, or a record of another length than the header, fails the read.
        reader = reader.option("mode", "FAILFAST")
    else:
        reader = reader.option("mode", "PERMISSIVE").option(
            "columnNameOfCorruptRecord", "corrupt_record"
        )
        schema, names = schemas.with_text(schema, "corrupt_record"), [*names, "corrupt_record"]
    rows = reader.schema(schema).csv([_glob_safe(f) for f in files])
    return rows.select(*names, _source_name().alias("source_filename"))


def read_manifests(
    spark: SparkSession, folder: str, multiline: bool | None = None, strict: bool = True
) -> DataFrame:
    """All manifests of a folder with ``source_filename``, the name of each row's manifest.

    Names may be hidden ones. Columns are found by the header of each file; those a manifest
    does not have are passed over. ``multiline=None`` looks which files need it. With
    ``strict=False`` bad records do not stop the read but carry their text in
    ``corrupt_record``. A file without a line has no rows.
    """
    files = find_manifests(spark, folder)
    if folder.rstrip("/").count(".csv"):
        raise ValueError("the manifest folder itself must not be named like a CSV file")
    groups = defaultdict(list)
    for file, header, odd in _looked_at(spark, _visible(spark, files)) if files else []:
        path = unquote(file)
        groups[_columns(header), odd if multiline is None else multiline].append(path)
    parts = [_read(spark, sorted(some), *key, strict) for key, some in sorted(groups.items())]
    if not parts:
        return spark.createDataFrame([], schemas.with_text(schemas.MANIFEST, "source_filename"))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def write_manifests(manifest: DataFrame, folder: str, mode: str = "append") -> None:
    """Write the manifests of many devices at once, by ``source_filename``.

    Rows are rebalanced by device, and a device with very many rows is split over tasks.
    ``append`` adds rows, as repeated scans do. ``overwrite`` replaces the manifests of the
    devices that have rows in ``manifest``, in whichever form they are there; all others stay.
    """
    if mode not in ("append", "overwrite"):
        raise ValueError("mode must be append or overwrite")
    name = F.col("source_filename")
    refused = F.concat(F.lit("no name for a manifest, it needs the end .csv: "), F.coalesce(name, F.lit("NULL")))
    checked = F.when(name.endswith(".csv"), name).otherwise(F.raise_error(refused))
    rows = manifest.select(*schemas.MANIFEST.fieldNames(), checked.alias("source_filename"))
    spark, written = manifest.sparkSession, []
    if mode == "overwrite":
        # One name a manifest, as in the listing of the folder.
        written = [r[0] for r in rows.select("source_filename").distinct().collect()]
    rows.hint("rebalance", F.col("source_filename")).write.mode(mode).options(**CSV_OPTIONS).option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("source_filename").csv(folder)
    for old in {w for w in written} & {e for e in _entries(spark, folder) if not e.startswith(PARTITION)}:
        path, fs = _file_system(spark, f"{folder.rstrip('/')}/{old}")
        fs.delete(path, True)


def _entries(spark: SparkSession, folder: str) -> list[str]:
    return [f.rsplit("/", 1)[1] for f in find_manifests(spark, folder)]


def write_manifest(manifest: DataFrame, folder: str, name: str, mode: str = "append") -> str:
    """Write one device's manifest as parts below ``folder``; returns their path.

    Appending again adds rows, as repeated scans do; ``overwrite`` replaces them.
    """
    target = f"{folder.rstrip('/')}/{entry_name(name)}"
    rows = manifest.select(*schemas.MANIFEST.fieldNames())
    rows.write.mode(mode).options(**CSV_OPTIONS).csv(target)
    return target
