"""Detection CSV files, images, and the stored embedding and cluster tables."""

from __future__ import annotations

import glob
import os
import re
import shutil
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hoardlens import schemas
from hoardlens.functions import paths
from hoardlens.operators import cluster_tables
from hoardlens.sources import file_tree
from hoardlens.sources.manifests import CSV_OPTIONS
from hoardlens.workspace import fresh_path


def write_csv(rows: DataFrame, path: str, schema: T.StructType) -> None:
    """CSV in fixed column order; an empty table still writes its header."""
    rows.select(*schema.fieldNames()).write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV written by ``write_csv`` or by hand with the same header."""
    reader = spark.read.schema(schema).options(**CSV_OPTIONS)
    return reader.option("mode", "FAILFAST").option("enforceSchema", False).csv(path)


def read_images(spark: SparkSession, location: str) -> DataFrame:
    """``path, image`` of all images that can be decoded; ``bad_images`` lists the others.

    Images whose own name or folder starts with ``.`` or ``_`` are read as well where the
    location is mounted; in other file systems they are refused.
    """
    images = _images(spark, location)
    return images.where(F.col("image.height") > 0)


def bad_images(spark: SparkSession, location: str) -> DataFrame:
    """``path, error`` of the files below ``location`` that are not images or cannot be decoded."""
    images = _images(spark, location)
    return images.where(~F.coalesce(F.col("image.height") > 0, F.lit(False))).select(
        "path", F.lit("cannot be decoded as an image").alias("error")
    )


def _images(spark: SparkSession, location: str) -> DataFrame:
    reader = spark.read.format("image").option("recursiveFileLookup", True)
    images = reader.load(location).select(_local_path(F.col("image.origin")).alias("path"), "image")
    folder = re.sub(r"\Afile:/+", "/", location)
    if "://" in folder:
        _refuse_hidden(spark, location)
        return images
    roots = [folder] if os.path.isdir(folder) else [p for p in glob.glob(folder) if os.path.isdir(p)]
    for root in roots:
        below = F.substring("path", F.lit(len(os.path.abspath(root).rstrip("/")) + 2), F.length("path"))
        found = file_tree.list_images(spark, root, file_tree.FLAG_IMAGES, ordered=False)
        hidden = found.where(F.col("error").isNull() & below.rlike(HIDDEN)).select("path", "size_bytes")
        copies = _shown(spark, hidden)
        if copies:
            # Spark's file sources pass over such names, so they are read from copies.
            rows = reader.load(copies).select(_local_path(F.col("image.origin")).alias("copy"), "image")
            path = F.replace(F.substring("copy", F.lit(len(copies) + 1), F.length("copy")), F.lit(f"/{SHOWN}"), F.lit("/"))
            struct = F.struct(path.alias("origin"), *[F.col("image")[n].alias(n) for n in IMAGE_FIELDS])
            images = images.unionByName(rows.select(path.alias("path"), struct.alias("image")))
    return images


HIDDEN = r"(^|/)(\.[^/]*|_[^/=]*)(/|$)"
SHOWN = "="  # put before every part of a path, it makes none of them hidden
IMAGE_FIELDS = ["height", "width", "nChannels", "mode", "data"]
NAMED = 10  # hidden images a message names


def _shown(spark: SparkSession, files: DataFrame) -> str | None:
    """Copy files in tasks into the shared folder, each part of their paths marked; None without any."""
    base = os.path.abspath(re.sub(r"\Afile:/+", "/", fresh_path(spark, "images")))
    if "://" in fresh_path(spark, "images").removeprefix("file://"):
        _refuse([r["path"] for r in files.orderBy("path").limit(NAMED).collect()])
        return None

    def copy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                target = base + path.replace("/", f"/{SHOWN}")
                partial = f"{base}-partial/{uuid.uuid4().hex}"
                for name in (target, partial):
                    os.makedirs(os.path.dirname(name), exist_ok=True)
                shutil.copyfile(path, partial)
                os.replace(partial, target)
            yield pd.DataFrame({"copied": [len(batch)]})

    copied = file_tree.deal_by_bytes(files).mapInPandas(copy, "copied bigint").agg(F.sum("copied")).first()[0]
    return base if copied else None


def _refuse(names: list[str]) -> None:
    if names:
        raise ValueError(f"rename these images or their folders, their names count as hidden: {', '.join(names)}")


def _refuse_hidden(spark: SparkSession, location: str) -> None:
    """Raise where a file system that is not mounted holds images that Spark would not see."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    root = spark._jvm.org.apache.hadoop.fs.Path(location)
    fs, out = root.getFileSystem(conf), []
    for status in fs.globStatus(root) or []:
        start = len(status.getPath().toString().rstrip("/")) + 1
        files = fs.listFiles(status.getPath(), True)
        while files.hasNext() and len(out) < NAMED:
            full = files.next().getPath().toString()
            name = full[start:] or full.rsplit("/", 1)[-1]
            if os.path.splitext(name)[1].lower() in file_tree.FLAG_IMAGES and re.search(HIDDEN, name):
                out.append(name)
    _refuse(sorted(out))


def _local_path(uri: Column) -> Column:
    plain = F.regexp_replace(uri, r"\Afile:/+", "/")
    return F.url_decode(F.replace(plain, F.lit("+"), F.lit("%2B")))


def face_key(source: str = "source_file") -> Column:
    """Repeatable id of a detected face; ``source_path`` tells apart files of one name."""
    return paths.row_key(F.col(source), F.col("frame_id"), F.col("face_id"))


class ClusterStore:
    """Embedding, cluster and summary tables as Parquet below one folder.

    Both result tables of a clustering lie in a folder of their own version, which counts only
    from the moment its marker is there. Readers therefore see both tables of one clustering,
    and a failure between the two writes changes nothing.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _table(self, path: str, schema: T.StructType) -> DataFrame:
        if not self._exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def _path(self, path: str):
        conf = self.spark._jsparkSession.sessionState().newHadoopConf()
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(conf)

    def _exists(self, path: str) -> bool:
        target, fs = self._path(path)
        return fs.exists(target)

    def embeddings(self) -> DataFrame:
        return self._table(f"{self.root}/face_embeddings", schemas.FACE_EMBEDDINGS)

    def clusters(self) -> DataFrame:
        return self._table(f"{self._results()}/face_clusters", schemas.FACE_CLUSTERS)

    def summary(self) -> DataFrame:
        return self._table(f"{self._results()}/cluster_summary", schemas.CLUSTER_SUMMARY)

    def add_embeddings(self, faces: DataFrame) -> None:
        """Append faces (detection columns and ``embedding``) that have an embedding."""
        ready = faces.where(F.col("embedding").isNotNull())
        if "id" not in faces.columns:
            source = "source_path" if "source_path" in faces.columns else "source_file"
            ready = ready.withColumn("id", face_key(source))
        _cast(ready.withColumn("created_at", F.current_timestamp()), schemas.FACE_EMBEDDINGS).write.mode(
            "append"
        ).parquet(f"{self.root}/face_embeddings")

    def ensure_embeddings(self, make: Callable[[], DataFrame]) -> int:
        """Compute and store embeddings only when there are none; returns how many there are."""
        if self.embeddings().isEmpty():
            self.add_embeddings(make())
        return self.embeddings().count()

    def _versions(self) -> list[str]:
        """Finished versions of the results, oldest first."""
        folder, fs = self._path(f"{self.root}/results")
        if not fs.exists(folder):
            return []
        names = [status.getPath().getName() for status in fs.listStatus(folder)]
        return sorted(n.removesuffix(DONE) for n in names if n.endswith(DONE))

    def _results(self) -> str:
        """Folder of the current results; stores without versions have them beside the embeddings."""
        versions = self._versions()
        return f"{self.root}/results/{versions[-1]}" if versions else self.root

    def replace_clusters(self, labels: DataFrame) -> None:
        """Replace both result tables by new labels (``id, cluster_id``), in one step for readers.

        The version before stays for those who are reading it; older ones are removed.
        """
        assigned = labels.select(
            "cluster_id",
            F.col("id").alias("face_embedding_id"),
            F.col("cluster_id").isNull().alias("is_noise"),
            F.current_timestamp().alias("created_at"),
        )
        finished = self._versions()
        number = int(finished[-1].split("-")[0]) + 1 if finished else 1
        version = f"{number:012d}-{uuid.uuid4().hex}"
        folder = f"{self.root}/results/{version}"
        _cast(assigned, schemas.FACE_CLUSTERS).write.parquet(f"{folder}/face_clusters")
        stored = _labels(self._table(f"{folder}/face_clusters", schemas.FACE_CLUSTERS))
        summary = cluster_tables.cluster_summary(stored, self.embeddings())
        summary = summary.withColumn("created_at", F.current_timestamp())
        _cast(summary, schemas.CLUSTER_SUMMARY).write.parquet(f"{folder}/cluster_summary")
        marker, fs = self._path(f"{folder}{DONE}")
        fs.create(marker, False).close()
        for old in finished[:-1]:
            # The marker goes first, so that no reader finds half a version.
            for path in (f"{self.root}/results/{old}{DONE}", f"{self.root}/results/{old}"):
                target, fs = self._path(path)
                fs.delete(target, True)

    def labels(self) -> DataFrame:
        """Stored assignment as ``id, cluster_id``."""
        return _labels(self.clusters())


DONE = ".done"  # marker beside the folder of a finished version


def _labels(clusters: DataFrame) -> DataFrame:
    return clusters.select(F.col("face_embedding_id").alias("id"), "cluster_id")


def _cast(rows: DataFrame, schema: T.StructType) -> DataFrame:
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def export_rows(rows: DataFrame, target: str) -> None:
    """Write member rows (with ``cluster_id``) into one folder per cluster and ``noise``."""
    folder = cluster_tables.cluster_folder(F.col("cluster_id"))
    rows.withColumn("cluster_dir", folder).write.mode("overwrite").partitionBy(
        "cluster_dir"
    ).parquet(target)


def export_files(rows: DataFrame, target: str) -> DataFrame:
    """Copy the crops (``cropped_face_path, cluster_id``) into cluster folders of a shared mount.

    Returns ``source, destination`` of what was copied; crops that do not exist are skipped.
    A copy appears under its final name only when it is complete, so a repeated task is safe.
    """

    def copy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = []
            for source, folder in zip(batch["source"], batch["folder"]):
                if not source or not os.path.isfile(source):
                    continue
                os.makedirs(f"{target}/{folder}", exist_ok=True)
                final = f"{target}/{folder}/{os.path.basename(source)}"
                partial = f"{final}.{uuid.uuid4().hex}"
                shutil.copy2(source, partial)
                os.replace(partial, final)
                done.append((source, final))
            yield pd.DataFrame(done, columns=["source", "destination"])

    folder = cluster_tables.cluster_folder(F.col("cluster_id"))
    planned = rows.select(F.col("cropped_face_path").alias("source"), folder.alias("folder"))
    return planned.mapInPandas(copy, "source string, destination string")
