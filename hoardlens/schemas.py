"""Fixed schemas of the tables that are read and written."""

from __future__ import annotations

from pyspark.sql import types as T


TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "array<float>": T.ArrayType(T.FloatType()),
    "array<array<double>>": T.ArrayType(T.ArrayType(T.DoubleType())),
}


def _struct(columns: str) -> T.StructType:
    """Schema from ``name type`` pairs, without needing a session."""
    pairs = (column.split() for column in columns.split(","))
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in pairs])


def with_text(schema: T.StructType, name: str) -> T.StructType:
    """A copy of ``schema`` with one more string column."""
    return T.StructType([*schema.fields, T.StructField(name, T.StringType())])


MANIFEST = _struct("path string, hash string, size_bytes bigint")

FACE_DETECTIONS = _struct(
    "source_file string, frame_id int, face_id int, bbox_x1 int, bbox_y1 int, bbox_x2 int,"
    " bbox_y2 int, confidence double, landmark_points string, cropped_face_path string"
)

OBJECT_DETECTIONS = _struct(
    "image_name string, image_path string, image_width int, image_height int,"
    " detection_id int, class_name string, class_id int, confidence double,"
    " bbox_x1 double, bbox_y1 double, bbox_x2 double, bbox_y2 double,"
    " bbox_width double, bbox_height double, bbox_area double, bbox_area_ratio double,"
    " bbox_center_x double, bbox_center_y double,"
    " has_segmentation boolean, mask_area double, mask_area_ratio double"
)

FLAGGED_IMAGES = _struct("hash string, path string, filename string")

FACE_EMBEDDINGS = _struct(
    "id string, source_file string, frame_id int, face_id int, cropped_face_path string,"
    " embedding array<float>, bbox_x1 int, bbox_y1 int, bbox_x2 int, bbox_y2 int,"
    " confidence float, landmark_points string, created_at timestamp"
)

FACE_CLUSTERS = _struct(
    "cluster_id int, face_embedding_id string, is_noise boolean, created_at timestamp"
)

CLUSTER_SUMMARY = _struct(
    "cluster_id int, cluster_size bigint, representative_face_id string,"
    " avg_confidence float, created_at timestamp"
)

DEVICES = _struct(
    "name string, size string, label string, fstype string, uuid string, serial string,"
    " mountpoint string"
)

# What a face model returns per image: boxes with scores, before any threshold.
RAW_FACES = _struct(
    "path string, frame_id int, face_id int, x1 double, y1 double, x2 double, y2 double,"
    " det_score double, landmarks array<array<double>>, image_width int, image_height int"
)

# What an object model returns per image.
RAW_OBJECTS = _struct(
    "image_path string, image_width int, image_height int, detection_id int, class_id int,"
    " confidence double, x1 double, y1 double, x2 double, y2 double, mask_area double"
)

# What a model reports for each item it finds in an image.
FACE_ITEM = _struct(
    "x1 double, y1 double, x2 double, y2 double, det_score double,"
    " landmarks array<array<double>>, embedding array<float>"
)

OBJECT_ITEM = _struct(
    "class_id int, confidence double, x1 double, y1 double, x2 double, y2 double,"
    " mask_area double"
)

SCORE_ITEM = _struct("label string, score double")

VECTOR_ITEM = _struct("embedding array<float>")
