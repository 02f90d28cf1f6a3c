"""Registered queries: name -> (spark, table folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hoardlens.functions import boxes, paths, pixels, sizes
from hoardlens.functions.vectors import cosine_distance, literal_vector
from hoardlens.operators import (
    approximate,
    checks,
    cluster_tables,
    dedup,
    detections,
    predict,
    similarity,
    sketches,
)
from hoardlens.operators.dbscan import count_neighbours, dbscan, neighbour_pairs
from hoardlens.operators.silhouette import silhouette
from hoardlens.plans import cluster_report, folder_report, manifest_report, stand_ins, views
from hoardlens.sources import file_tree, images, inventory, manifests, tables
from hoardlens.streaming import manifest_counts
from hoardlens.workspace import fresh_path, materialize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register a query under its function name."""
    QUERIES[fn.__name__] = fn
    return fn


def comparable(df: DataFrame, exact: bool = False) -> DataFrame:
    """Byte totals as 64-bit integers, lists as text and doubles with six decimals.

    With ``exact`` doubles stay as they are: single arithmetic steps give the same bits in
    both engines, and rounding millions of them takes longer than computing them.
    """

    def plain(name: str, kind: str):
        if kind.startswith("decimal"):
            return F.col(name).cast("bigint").alias(name)
        if kind in ("double", "float") and not exact:
            return F.round(F.col(name).cast("double"), 6).alias(name)
        if kind.startswith("array"):
            return F.array_join(name, "|").alias(name)
        return F.col(name)

    return df.select(*[plain(name, kind) for name, kind in df.dtypes])


# --- duplicate analysis -----------------------------------------------------------------


@query
def top_duplicates_by_waste(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = views.manifest(spark, sf_dir)
    top = materialize(dedup.largest_waste(manifest), "top")
    return comparable(dedup.with_example_path(top, manifest))


@query
def top_duplicate_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = views.manifest(spark, sf_dir)
    top = materialize(dedup.top_waste(dedup.per_hash(manifest)), "top")
    return comparable(dedup.lists_for(top, manifest, "path", "sample_paths"))


@query
def dedup_basic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(manifest_report.basic_summary(views.manifest(spark, sf_dir)))


@query
def dedup_top_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(manifest_report.basic_top_groups(views.manifest(spark, sf_dir)))


@query
def dedup_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(dedup.per_hash(views.manifest(spark, sf_dir)))


@query
def dedup_hash_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(dedup.hash_paths(views.manifest(spark, sf_dir)))


@query
def dedup_hash_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(dedup.hash_manifests(views.manifest(spark, sf_dir)))


@query
def dedup_overall_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(dedup.overall_stats(views.manifest(spark, sf_dir)))


@query
def dedup_savings_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(dedup.savings_stats(dedup.per_hash(views.manifest(spark, sf_dir))))


@query
def dedup_full_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(manifest_report.overall(views.manifest(spark, sf_dir)))


@query
def path_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(dedup.path_sizes(views.manifest(spark, sf_dir)))


@query
def top_paths_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(dedup.top_paths(views.manifest(spark, sf_dir)))


@query
def cross_manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = views.manifest(spark, sf_dir)
    top = materialize(dedup.most_widespread(manifest), "top")
    return comparable(dedup.with_example_path(top, manifest))


@query
def cross_manifest_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = views.manifest(spark, sf_dir)
    top = materialize(dedup.cross_manifest(dedup.per_hash(manifest)), "top")
    return comparable(
        dedup.lists_for(top, manifest, "source_filename", "source_manifests")
    )


@query
def file_type_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(manifest_report.type_report(views.manifest(spark, sf_dir)))


@query
def format_bytes_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("size_bytes")
    manifest = views.manifest(spark, sf_dir)
    rows = manifest.groupBy("size_bytes").agg(F.count(F.lit(1)).alias("files"))
    return rows.select(
        "size_bytes",
        "files",
        sizes.format_bytes(size).alias("size_text"),
        sizes.format_bytes(size * 1048575).alias("scaled_text"),
        sizes.format_bytes(size * size * 977).alias("squared_text"),
    )


@query
def short_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    name = paths.file_name(path)
    return views.manifest(spark, sf_dir).select(
        "path",
        "hash",
        name.alias("filename_only"),
        paths.stem(path).alias("stem"),
        paths.suffix(path).alias("suffix"),
        paths.extension_label(paths.extension_class(name)).alias("type_label"),
        paths.short_hash(F.col("hash")).alias("hash_label"),
        paths.short_path(F.concat(path, F.lit("/"), F.coalesce("hash", F.lit(""))), 40).alias(
            "path_label"
        ),
    )


@query
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = views.table(spark, sf_dir, "documents").select(
        F.lit("document").alias("kind"),
        F.col("doc_id").alias("item_id"),
        F.sha2("text", 256).alias("hash"),
    )
    pages = views.table(spark, sf_dir, "pages").select(
        F.lit("page").alias("kind"),
        F.col("page_id").alias("item_id"),
        F.sha2("html", 256).alias("hash"),
    )
    return documents.unionByName(pages)


# --- vectors ----------------------------------------------------------------------------

# Radius and size at which the given vectors have clusters, border points and noise.
EPS, MIN_SAMPLES = 0.66, 4


def labels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = views.embeddings(spark, sf_dir)
    return materialize(dbscan(faces, EPS, MIN_SAMPLES), "cluster-labels")


def first_vector(faces: DataFrame) -> list[float]:
    return faces.agg(F.min_by("embedding", "id")).first()[0]


@query
def similar_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = views.embeddings(spark, sf_dir).drop("label")
    return comparable(similarity.similar(faces, first_vector(faces)))


@query
def similar_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = views.embeddings(spark, sf_dir)
    return comparable(similarity.similar_batch(faces, faces))


@query
def distance_to_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = views.embeddings(spark, sf_dir)
    distance = cosine_distance(F.col("embedding"), literal_vector(first_vector(faces)))
    return comparable(faces.select("id", distance.alias("distance")))


@query
def neighbour_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_neighbours(views.embeddings(spark, sf_dir), 0.6)


@query
def dbscan_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dbscan(views.embeddings(spark, sf_dir), EPS, MIN_SAMPLES)


@query
def dbscan_labels_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dbscan(views.embeddings(spark, sf_dir), 0.6, 2)


@query
def dbscan_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dbscan(views.embeddings(spark, sf_dir))


@query
def dbscan_many_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dbscan(views.embeddings(spark, sf_dir), 0.6, 3, cell_rows=16)


@query
def cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = views.embeddings(spark, sf_dir)
    return comparable(cluster_tables.cluster_summary(labels_of(spark, sf_dir), faces))


@query
def cluster_size_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = views.embeddings(spark, sf_dir)
    summary = cluster_tables.cluster_summary(labels_of(spark, sf_dir), faces)
    return cluster_tables.size_histogram(summary)


@query
def largest_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = views.embeddings(spark, sf_dir)
    report = cluster_report.cluster_report(labels_of(spark, sf_dir), faces)
    return comparable(report["largest_clusters"])


@query
def cluster_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_tables.totals(labels_of(spark, sf_dir))


@query
def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = views.embeddings(spark, sf_dir)
    return comparable(cluster_tables.members(labels_of(spark, sf_dir), faces))


@query
def noise_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = views.embeddings(spark, sf_dir)
    return cluster_tables.noise_members(labels_of(spark, sf_dir), faces)


@query
def cluster_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = views.embeddings(spark, sf_dir).select("id", "cropped_face_path")
    target = fresh_path(spark, "export")
    tables.export_rows(labels_of(spark, sf_dir).join(faces, "id"), target)
    return spark.read.parquet(target).select("id", "cropped_face_path", "cluster_dir")


@query
def stored_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = views.embeddings(spark, sf_dir)
    blank = {
        name: F.lit(None).cast("int")
        for name in ("frame_id", "face_id", "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2")
    }
    store = tables.ClusterStore(spark, fresh_path(spark, "store"))
    store.ensure_embeddings(
        lambda: faces.withColumns(blank).withColumn("landmark_points", F.lit(None).cast("string"))
    )
    # Stored ids are text: the numbering follows their text order.
    store.replace_clusters(dbscan(store.embeddings(), EPS, MIN_SAMPLES))
    return comparable(store.summary().drop("created_at"))


@query
def silhouette_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = views.embeddings(spark, sf_dir)
    return comparable(silhouette(faces, label_col="label"))


@query
def silhouette_by_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = views.embeddings(spark, sf_dir).drop("label")
    labelled = faces.join(labels_of(spark, sf_dir), "id")
    return comparable(silhouette(labelled))


@query
def silhouette_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = views.embeddings(spark, sf_dir)
    return comparable(silhouette(faces, label_col="label", metric="cosine"))


@query
def silhouette_no_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = views.embeddings(spark, sf_dir).drop("label")
    labelled = faces.join(labels_of(spark, sf_dir), "id")
    return comparable(silhouette(labelled, include_noise=False, metric="cosine"))


@query
def embedding_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces, labels = views.faulty_embeddings(spark, sf_dir)
    return checks.embedding_integrity(faces, labels, 64)


@query
def empty_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    nobody = views.embeddings(spark, sf_dir).where("label < 0")
    return cluster_tables.totals(dbscan(nobody))


@query
def neighbour_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, members = neighbour_pairs(views.embeddings(spark, sf_dir), 0.6)
    copies = members.where(F.col("id") != F.col("representative"))
    return pairs.select("a", "b").unionByName(copies.select(F.col("representative").alias("a"), F.col("id").alias("b")))


@query
def approximate_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, _ = approximate.fold_copies(views.embeddings(spark, sf_dir))
    pairs = materialize(approximate.approx_neighbours(points, 0.6), "approx-pairs")
    measured = approximate.measured_recall(points, pairs, 0.6)
    wrong = pairs.select(F.lit(True).alias("recall_reached"), (F.col("distance") > 0.6 + 1e-9).cast("bigint").alias("wrong"))
    reached = measured.select((F.col("recall") >= 0.9).alias("recall_reached"), F.lit(0).cast("bigint").alias("wrong"))
    return reached.unionByName(wrong).agg(
        F.min("recall_reached").alias("recall_reached"), F.sum("wrong").alias("false_pairs")
    )


# --- detections -------------------------------------------------------------------------


@query
def detection_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(detections.object_rows(views.detections(spark, sf_dir)), exact=True)


@query
def detection_class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {i: f"class_{i}" for i in range(8)}
    raw = views.detections(spark, sf_dir).drop("class_name")
    return detections.class_report(detections.object_rows(raw, names))


@query
def detection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detections.object_rows(views.detections(spark, sf_dir))
    return comparable(detections.detection_summary(rows))


def _raw_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.col("confidence").alias("det_score")
    marks = F.array(F.array("x1", "y1"), F.array("x2", "y2")).alias("landmarks")
    return views.detections(spark, sf_dir).select(
        F.col("image_path").alias("path"), "frame_id", F.col("detection_id").alias("face_id"),
        "x1", "y1", "x2", "y2", score, marks, "image_width", "image_height",
        "l_partkey", "l_suppkey",
    )


@query
def face_threshold_crop_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detections.face_rows(_raw_faces(spark, sf_dir), 0.5, "/crops")
    side = boxes.model_input_size(
        F.col("crop_x2") - F.col("crop_x1"), F.col("crop_y2") - F.col("crop_y1")
    )
    return comparable(rows.withColumns(side).drop("landmark_points"), exact=True)


@query
def face_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detections.detection_table(detections.face_rows(_raw_faces(spark, sf_dir), 0.5))
    points = F.from_json("landmark_points", "array<array<double>>")
    flat = F.flatten(points)
    return comparable(
        rows.groupBy("source_file").agg(
            F.count(F.lit(1)).alias("faces"),
            F.sum(F.aggregate(flat, F.lit(0.0), lambda total, x: total + x)).alias("mark_sum"),
            F.sum(F.size(points)).alias("marks"),
        )
    )


@query
def face_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw_faces(spark, sf_dir)
    pictures = detections.face_rows(raw, 0.5, "/crops")
    frames = detections.face_rows(detections.every_nth_frame(raw, 7), 0.5)
    return detections.face_counts(
        detections.combine(pictures, frames.drop("cropped_face_path"))
    )


@query
def largest_box_per_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw_faces(spark, sf_dir).drop("landmarks")
    order = ["face_id", "l_partkey", "l_suppkey"]
    return comparable(detections.largest_per_image(raw, "path", order), exact=True)


@query
def frame_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = detections.every_nth_frame(views.detections(spark, sf_dir), 4)
    return chosen.groupBy("frame_id").agg(F.count(F.lit(1)).alias("boxes"))


@query
def flagged_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = views.scores(spark, sf_dir).where(detections.is_flagged(F.col("results"), 0.7))
    return hits.select(
        F.sha2("text", 256).alias("hash"),
        "path",
        paths.base_name(F.col("path")).alias("filename"),
    )


# --- images and models ------------------------------------------------------------------


@query
def face_row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detections.face_rows(_raw_faces(spark, sf_dir), 0.5)
    return rows.select("source_path", "frame_id", "face_id", tables.face_key("source_path").alias("id"))


@query
def image_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc, height = F.col("doc_id"), F.col("image.height")
    box = [
        (doc % 4).cast("int"),
        F.floor(height / 4).cast("int"),
        (6 + doc % 5).cast("int"),
        height - (doc % 2).cast("int") * F.floor(height / 3).cast("int"),
    ]
    cut = views.images(spark, sf_dir).select(
        "doc_id", pixels.crop_image(F.col("image"), *box).alias("image")
    )
    return cut.select(
        "doc_id",
        F.col("image.height").alias("height"),
        F.col("image.width").alias("width"),
        F.sha2(F.col("image.data"), 256).alias("hash"),
    )


@query
def image_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    planes = views.images(spark, sf_dir).select(
        "doc_id",
        (F.col("image.height") * 10).alias("n"),
        pixels.normalized_planes(F.col("image")).alias("planes"),
    )

    def plane_sum(channel: int):
        part = F.slice("planes", F.col("n") * channel + 1, F.col("n"))
        total = F.aggregate(part, F.lit(0.0), lambda acc, v: acc + v.cast("double"))
        # Undoing the scaling gives the sum of the bytes, a whole number again.
        return F.round((total + F.col("n")) * 127.5).cast("bigint")

    return comparable(
        planes.select(
            "doc_id",
            F.size("planes").cast("bigint").alias("n_values"),
            *[plane_sum(c).alias(f"plane_{c}") for c in range(3)],
            F.array_max("planes").alias("largest"),
        )
    )


@query
def model_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    pictures = views.images(spark, sf_dir).drop("frame_id")
    rows = predict.detect_faces(pictures, stand_ins.faces, 0.5, "/crops")
    return comparable(rows.drop("landmark_points"))


@query
def model_frame_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predict.detect_faces_in_frames(views.images(spark, sf_dir), stand_ins.faces, 0.5, 3)
    return comparable(detections.detection_table(rows).drop("landmark_points"))


@query
def model_face_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    pictures = views.images(spark, sf_dir).drop("frame_id")
    crops = predict.crop_faces(pictures, stand_ins.faces, "/crops")
    return crops.select(
        "cropped_face_path",
        "source_path",
        F.col("image.height").alias("height"),
        F.col("image.width").alias("width"),
        F.sha2(F.col("image.data"), 256).alias("hash"),
    )


@query
def model_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    crops = views.images(spark, sf_dir).drop("frame_id")
    rows = predict.embed_faces(crops, stand_ins.faces, stand_ins.whole_image)
    return rows.select("path", F.col("embedding").cast("array<int>").alias("v")).select(
        "path", F.array_join("v", "|").alias("embedding")
    )


@query
def model_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    pictures = views.images(spark, sf_dir).drop("frame_id")
    return comparable(
        predict.detect_objects(pictures, stand_ins.objects, {0: "cat", 1: "dog", 2: "bird"})
    )


@query
def model_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    pictures = views.images(spark, sf_dir)
    model = stand_ins.failing(stand_ins.faces)
    _, frames = predict.detect_faces_in_frames_and_rejects(pictures, model, 0.5, 3)
    single = pictures.drop("frame_id")
    _, objects = predict.detect_objects_and_rejects(single, stand_ins.failing(stand_ins.objects), {0: "cat"})
    _, crops = predict.embed_detections_and_rejects(_crop_rows(spark, sf_dir), single, model)
    kinds = {"frame": frames, "object": objects, "crop": crops.withColumnRenamed("cropped_face_path", "path")}
    parts = [rows.select(F.lit(kind).alias("kind"), "path", "error") for kind, rows in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _crop_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image as the crop of one face; crops of some faces are gone, others have no path."""
    doc = F.col("doc_id")
    path = F.when(doc % 19 == 0, F.concat(F.lit("/gone/"), doc.cast("string"))).when(doc % 23 != 0, F.col("path"))
    blank = ["bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2"]
    return views.images(spark, sf_dir).select(
        paths.base_name(F.col("path")).alias("source_file"),
        F.lit(0).alias("frame_id"),
        doc.cast("int").alias("face_id"),
        *[F.lit(None).cast("int").alias(c) for c in blank],
        ((doc % 100).cast("double") / 100).alias("confidence"),
        F.lit(None).cast("string").alias("landmark_points"),
        path.alias("cropped_face_path"),
    )


@query
def embed_store_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    crops = views.images(spark, sf_dir).drop("frame_id")
    faces = predict.embed_detections(_crop_rows(spark, sf_dir), crops, stand_ins.faces, stand_ins.whole_image)
    store = tables.ClusterStore(spark, fresh_path(spark, "store"))
    store.ensure_embeddings(lambda: faces)
    store.replace_clusters(dbscan(store.embeddings()))
    return comparable(store.summary().drop("created_at"))


# --- folders of images ------------------------------------------------------------------


def _below(root: str, path: str = "path"):
    return F.substring(path, len(root) + 1, 1 << 20)


@query
def image_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = stand_ins.documents_as_pictures(spark, sf_dir)
    kinds = {
        "faces": file_tree.list_images(spark, root),
        "flags": file_tree.list_images(spark, root, file_tree.FLAG_IMAGES),
        "objects": file_tree.list_images_flat(spark, root),
    }
    parts = [rows.select(F.lit(k).alias("kind"), _below(root).alias("path"), "size_bytes") for k, rows in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def image_scan_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = stand_ins.documents_as_pictures(spark, sf_dir)
    found = images.scan_images(spark, root, stand_ins.ten_pixel_rows, file_tree.FLAG_IMAGES)
    return found.select(
        _below(root).alias("path"), "size_bytes", F.col("image.height").alias("height"),
        F.sha2(F.col("image.data"), 256).alias("hash"), "error",
    )


@query
def flag_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = stand_ins.documents_as_pictures(spark, sf_dir)
    report = folder_report.flags_in_folder(spark, root, stand_ins.ten_pixel_rows, stand_ins.classifier, 0.7)
    target = fresh_path(spark, "flags")
    tables.write_csv(report["rows"], target, tables.schemas.FLAGGED_IMAGES)
    rows = tables.read_csv(spark, target, tables.schemas.FLAGGED_IMAGES)
    return rows.select("hash", _below(root).alias("path"), "filename")


@query
def face_folder_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = stand_ins.documents_as_pictures(spark, sf_dir)
    model = stand_ins.failing(stand_ins.faces)
    return folder_report.faces_in_folder(spark, root, stand_ins.ten_pixel_rows, model)["summary"]


@query
def object_folder_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = stand_ins.documents_as_pictures(spark, sf_dir)
    model = stand_ins.failing(stand_ins.objects)
    return folder_report.objects_in_folder(spark, root, stand_ins.ten_pixel_rows, model, {})["summary"]


@query
def crops_on_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = stand_ins.documents_as_pictures(spark, sf_dir)
    doc = F.col("doc_id")
    faces = views.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(doc % 5 != 0, F.concat(F.lit(f"{root}/pic "), doc.cast("string"), F.lit(".png"))).alias("cropped_face_path"),
    )
    present = faces.where(F.col("cropped_face_path").isNotNull())
    found = file_tree.existing_only(present, file_tree.list_files(spark, root), "cropped_face_path")
    return found.select("doc_id", _below(root, "cropped_face_path").alias("crop"))


# --- files ------------------------------------------------------------------------------


@query
def manifest_csv_odd_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.read_manifests(spark, stand_ins.documents_as_odd_manifests(spark, sf_dir))


@query
def manifest_replace_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "manifests")
    everything = views.manifest(spark, sf_dir)
    manifests.write_manifests(everything, folder)
    device = everything.where(F.col("source_filename").isin("src1.csv", "src2.csv"))
    manifests.write_manifests(device.withColumn("size_bytes", F.col("size_bytes") + 1), folder, mode="overwrite")
    return manifests.read_manifests(spark, folder)


@query
def streaming_duplicate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, checkpoint = fresh_path(spark, "manifests"), fresh_path(spark, "stream")
    manifests.write_manifests(views.manifest(spark, sf_dir), folder)
    manifest_counts.follow(spark, folder, checkpoint, files_per_batch=8).awaitTermination()
    return comparable(manifest_counts.current_duplicates(spark, checkpoint))


@query
def approximate_distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "sketches")
    manifest = views.manifest(spark, sf_dir)
    sketches.keep_sketches(sketches.manifest_sketches(manifest), folder)
    guess = sketches.approx_overall_stats(sketches.stored_sketches(spark, folder))
    whole = sketches.approx_overall_stats(sketches.manifest_sketches(manifest.withColumn("source_filename", F.lit("x"))))
    exact = dedup.overall_stats(manifest)
    names = list(sketches.COUNTED.values())

    def tall(rows: DataFrame, value: str) -> DataFrame:
        return rows.select(F.explode(F.array(*[F.struct(F.lit(n).alias("figure"), F.col(n).alias(value)) for n in names])).alias("r")).select("r.*")

    both = tall(exact, "exact").join(tall(guess, "guess"), "figure").join(tall(whole, "whole"), "figure")
    close = F.abs(F.col("guess") - F.col("exact")) <= sketches.error_bound() * F.col("exact")
    return both.select("figure", "exact", close.alias("within_bound"), (F.col("guess") == F.col("whole")).alias("merges"))


@query
def object_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = fresh_path(spark, "objects")
    rows = detections.object_rows(views.detections(spark, sf_dir))
    tables.write_csv(rows, target, tables.schemas.OBJECT_DETECTIONS)
    return comparable(tables.read_csv(spark, target, tables.schemas.OBJECT_DETECTIONS), exact=True)


@query
def manifest_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "manifests")
    manifests.write_manifests(views.manifest(spark, sf_dir), folder)
    return manifests.read_manifests(spark, folder)


@query
def detections_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = fresh_path(spark, "detections")
    rows = detections.face_rows(_raw_faces(spark, sf_dir), 0.5, "/crops")
    tables.write_csv(rows, target, tables.schemas.FACE_DETECTIONS)
    return comparable(
        tables.read_csv(spark, target, tables.schemas.FACE_DETECTIONS).drop("landmark_points")
    )


@query
def file_tree_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = stand_ins.documents_as_files(spark, sf_dir)
    scanned = file_tree.manifest_rows(file_tree.scan_tree(spark, root))
    path = F.substring("path", len(root) + 1, 1 << 20)
    return scanned.withColumn("path", path)


@query
def inventory_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    dumps = views.inventory(spark, sf_dir)
    return inventory.scan_plan(inventory.flatten_inventory(dumps, "dump", ["c_custkey"]))
