"""DuckDB SQL that states what each registered query must return."""

from __future__ import annotations

MANIFEST = """
manifest AS (
  SELECT *, regexp_extract(path, '[^/\\\\]+$') AS filename_only FROM (
    SELECT '/' || lang || '/doc_' || CAST(doc_id % 97 AS VARCHAR)
             || CASE doc_id % 7 WHEN 0 THEN '.txt' WHEN 1 THEN '.TXT' WHEN 2 THEN '.tar.gz'
                                WHEN 3 THEN '.jpg' WHEN 4 THEN '' WHEN 5 THEN '.'
                                ELSE '.png' END AS path,
           CASE WHEN doc_id % 41 = 0 THEN NULL WHEN doc_id % 43 = 0 THEN ''
                ELSE sha256(text) END AS hash,
           CAST(strlen(text) AS BIGINT) AS size_bytes,
           source || '.csv' AS source_filename
    FROM documents)
),
hashed AS (SELECT * FROM manifest WHERE hash IS NOT NULL AND hash <> '')
"""

PER_HASH = f"""
{MANIFEST},
per_hash AS (
  SELECT hash, min(size_bytes) AS size_bytes, count(DISTINCT path) AS unique_paths,
         count(DISTINCT filename_only) AS unique_filenames, count(*) AS total_occurrences,
         count(DISTINCT source_filename) AS manifest_count, min(path) AS example_path
  FROM hashed GROUP BY hash
)
"""

TOP_WASTE = f"""
{PER_HASH},
top_waste AS (
  SELECT hash, size_bytes, total_occurrences, unique_paths, unique_filenames,
         CAST(size_bytes * (total_occurrences - 1) AS BIGINT) AS space_wasted, example_path
  FROM per_hash WHERE total_occurrences > 1
  ORDER BY space_wasted DESC, hash LIMIT 15
)
"""

CROSS = f"""
{PER_HASH},
cross_manifest AS (
  SELECT hash, size_bytes, manifest_count, unique_paths, example_path
  FROM per_hash WHERE manifest_count > 1
  ORDER BY manifest_count DESC, size_bytes DESC, hash LIMIT 10
)
"""


def lists(item: str, name: str, source: str = "hashed") -> str:
    """Sorted lists of at most about 1000 items, split by a hash of the item."""
    return f"""
    SELECT hash, part, parts, array_to_string(list({item} ORDER BY {item}), '|') AS {name}
    FROM (
      SELECT hash, {item}, parts,
             CAST('0x' || substr(md5({item}), 1, 8) AS BIGINT) % parts AS part
      FROM (
        SELECT hash, {item},
               CAST(ceil(count(*) OVER (PARTITION BY hash) / 1000.0) AS BIGINT) AS parts
        FROM (SELECT DISTINCT hash, {item} FROM {source} WHERE {item} IS NOT NULL)))
    GROUP BY hash, part, parts
    """


def bytes_text(size: str) -> str:
    """Display form of a size."""
    steps = [("KB", 1), ("MB", 2), ("GB", 3)]
    cases = " ".join(
        f"WHEN {size} < {1024 ** (p + 1)} THEN printf('%.2f {u}', {size} / {1024**p}.0::DOUBLE)"
        for u, p in steps
    )
    return (
        f"CASE WHEN {size} = 0 THEN '0 B' WHEN {size} < 1024 THEN printf('%.2f B', "
        f"CAST({size} AS DOUBLE)) {cases} "
        f"ELSE printf('%.2f TB', {size} / {1024**4}.0::DOUBLE) END"
    )


SAVINGS = """
  SELECT count(*) AS unique_file_count, CAST(sum(size_bytes) AS BIGINT) AS deduplicated_total_size,
         CAST(sum(size_bytes * (total_occurrences - 1)) AS BIGINT) AS space_that_could_be_saved,
         round(avg(unique_paths), 6) AS avg_paths_per_hash,
         round(avg(unique_filenames), 6) AS avg_filenames_per_hash
  FROM per_hash
"""

OVERALL = """
  SELECT count(*) AS total_file_entries, count(DISTINCT hash) AS unique_hashes,
         count(DISTINCT path) AS unique_paths, count(DISTINCT filename_only) AS unique_filenames,
         CAST(sum(size_bytes) AS BIGINT) AS total_size_all_files
  FROM hashed
"""

ORACLES: dict[str, str] = {
    "top_duplicates_by_waste": f"WITH {TOP_WASTE} SELECT * FROM top_waste",
    "top_duplicate_paths": f"""
WITH {TOP_WASTE},
picked AS (SELECT * FROM manifest WHERE hash IN (SELECT hash FROM top_waste))
{lists("path", "sample_paths", "picked")}""",
    "dedup_basic_summary": f"""
WITH {MANIFEST},
t AS (SELECT count(*) AS total_files, sum(size_bytes) AS total_size FROM manifest),
u AS (SELECT count(*) AS unique_files, sum(size_bytes) AS deduplicated_size
      FROM (SELECT hash, min(size_bytes) AS size_bytes FROM manifest GROUP BY hash))
SELECT total_files, unique_files, total_files - unique_files AS duplicate_files,
       CAST(total_size AS BIGINT) AS total_size,
       CAST(deduplicated_size AS BIGINT) AS deduplicated_size,
       CAST(total_size - deduplicated_size AS BIGINT) AS space_saved,
       round(CAST(total_size - deduplicated_size AS DOUBLE) / CAST(total_size AS DOUBLE) * 100, 6)
         AS savings_percentage
FROM t, u""",
    "dedup_top_groups": f"""
WITH {MANIFEST},
g AS (SELECT hash, count(*) AS duplicate_count,
             CAST(sum(size_bytes) AS BIGINT) AS total_wasted_space
      FROM manifest GROUP BY hash HAVING count(*) > 1
      ORDER BY total_wasted_space DESC, hash NULLS LAST LIMIT 10)
SELECT *, substr(hash, 1, 16) || '...' AS hash_label,
       {bytes_text("total_wasted_space")} AS wasted_label
FROM g""",
    "dedup_by_hash": f"WITH {PER_HASH} SELECT * EXCLUDE (example_path) FROM per_hash",
    "dedup_hash_paths": f"WITH {MANIFEST} {lists('path', 'sample_paths')}",
    "dedup_hash_manifests": f"WITH {MANIFEST} {lists('source_filename', 'source_manifests')}",
    "dedup_overall_stats": f"WITH {MANIFEST} {OVERALL}",
    "dedup_savings_stats": f"WITH {PER_HASH} {SAVINGS}",
    "dedup_full_summary": f"""
WITH {PER_HASH}, o AS ({OVERALL}), s AS ({SAVINGS})
SELECT *, total_file_entries - unique_hashes AS duplicate_entries,
       round(CAST(space_that_could_be_saved AS DOUBLE) / CAST(total_size_all_files AS DOUBLE)
             * 100, 6) AS savings_percentage
FROM o, s""",
    "path_sizes": f"""
WITH {MANIFEST}
SELECT path, CAST(sum(size_bytes) AS BIGINT) AS total_size_bytes, count(*) AS occurrence_count
FROM manifest GROUP BY path""",
    "top_paths_by_size": f"""
WITH {MANIFEST}
SELECT path, CAST(sum(size_bytes) AS BIGINT) AS total_size_bytes, count(*) AS occurrence_count
FROM manifest GROUP BY path ORDER BY total_size_bytes DESC, path LIMIT 10""",
    "cross_manifest_files": f"WITH {CROSS} SELECT * FROM cross_manifest",
    "cross_manifest_sources": f"""
WITH {CROSS},
picked AS (SELECT * FROM manifest WHERE hash IN (SELECT hash FROM cross_manifest))
{lists("source_filename", "source_manifests", "picked")}""",
    "file_type_distribution": f"""
WITH {MANIFEST},
raw AS (SELECT CASE WHEN filename_only LIKE '%.%'
                    THEN upper(regexp_extract(filename_only, '\\.([^.]+)$', 1))
                    ELSE 'NO_EXTENSION' END AS file_extension, hash, size_bytes FROM hashed),
marked AS (SELECT *, row_number() OVER (PARTITION BY file_extension, hash ORDER BY size_bytes) = 1 AS kept
           FROM raw),
sums AS (SELECT file_extension, count(*) AS file_count, CAST(count_if(kept) AS BIGINT) AS unique_files,
                CAST(sum(size_bytes) AS BIGINT) AS total_size,
                round(avg(size_bytes), 6) AS avg_size,
                min(size_bytes) AS min_size, max(size_bytes) AS max_size,
                CAST(sum(if(kept, size_bytes, 0)) AS BIGINT) AS deduplicated_total_size
         FROM marked GROUP BY file_extension)
SELECT *, total_size - deduplicated_total_size AS space_saved_by_type,
       CASE WHEN file_extension = '' THEN 'NO_EXT' ELSE file_extension END AS label,
       CASE WHEN total_size > 0
            THEN round(CAST(total_size - deduplicated_total_size AS DOUBLE)
                       / CAST(total_size AS DOUBLE) * 100, 6) ELSE 0.0 END AS savings_pct
FROM sums ORDER BY total_size DESC, file_extension LIMIT 20""",
    "format_bytes_column": f"""
WITH {MANIFEST},
c AS (SELECT size_bytes, count(*) AS files FROM manifest GROUP BY size_bytes)
SELECT size_bytes, files, {bytes_text("size_bytes")} AS size_text,
       {bytes_text("(size_bytes * 1048575)")} AS scaled_text,
       {bytes_text("(size_bytes * size_bytes * 977)")} AS squared_text
FROM c""",
    "short_labels": f"""
WITH {MANIFEST},
n AS (SELECT *, regexp_extract(path, '[^/]*$') AS base,
             path || '/' || coalesce(hash, '') AS long_path FROM manifest),
x AS (SELECT *, regexp_extract(base, '^(.+?)(\\.[^.]+)?$', 2) AS suffix,
             CASE WHEN filename_only LIKE '%.%'
                  THEN upper(regexp_extract(filename_only, '\\.([^.]+)$', 1))
                  ELSE 'NO_EXTENSION' END AS ext FROM n)
SELECT path, hash, filename_only, left(base, length(base) - length(suffix)) AS stem, suffix,
       CASE WHEN ext = '' THEN 'NO_EXT' ELSE ext END AS type_label,
       substr(hash, 1, 16) || '...' AS hash_label,
       CASE WHEN length(long_path) > 40 THEN '...' || right(long_path, 37)
            ELSE long_path END AS path_label
FROM x""",
    "content_hash": """
SELECT 'document' AS kind, doc_id AS item_id, sha256(text) AS hash FROM documents
UNION ALL SELECT 'page', page_id, sha256(html) FROM pages""",
}

# --- vectors ----------------------------------------------------------------------------

EMB = """
emb AS (
  SELECT vec_id AS id, 'src_' || CAST(vec_id % 7 AS VARCHAR) || '.jpg' AS source_file,
         '/crops/' || CAST(vec_id AS VARCHAR) || '.jpg' AS cropped_face_path,
         CAST(embedding AS DOUBLE[]) AS embedding, label,
         CAST(vec_id * 37 % 101 AS DOUBLE) / 100 AS confidence
  FROM embeddings
)
"""


def dbscan(eps: float, min_samples: int, key: str = "id") -> str:
    """Labels from the definition; ``key`` is what ids are ordered by."""
    return f"""
{EMB},
near AS (
  SELECT {key.replace("id", "a.id")} AS i, {key.replace("id", "b.id")} AS j FROM emb a, emb b
  WHERE a.id = b.id OR 1 - list_cosine_similarity(a.embedding, b.embedding) <= {eps}),
core AS (SELECT i FROM near GROUP BY i HAVING count(*) >= {min_samples}),
edges AS (SELECT i, j FROM near WHERE i IN (FROM core) AND j IN (FROM core)),
reach(i, r) AS (
  SELECT i, i FROM core
  UNION SELECT e.j, reach.r FROM reach JOIN edges e ON e.i = reach.i),
root AS (SELECT i, min(r) AS r FROM reach GROUP BY i),
numbered AS (SELECT i, CAST(dense_rank() OVER (ORDER BY r) - 1 AS INTEGER) AS c FROM root),
border AS (
  SELECT n.i, min(c) AS c FROM near n JOIN numbered k ON n.j = k.i
  WHERE n.i NOT IN (FROM core) GROUP BY n.i),
labels AS (
  SELECT {key} AS id, coalesce(numbered.c, border.c) AS cluster_id,
         coalesce(numbered.c, border.c) IS NULL AS is_noise
  FROM emb LEFT JOIN numbered ON numbered.i = {key.replace("id", "emb.id")}
           LEFT JOIN border ON border.i = {key.replace("id", "emb.id")})
"""


LABELS = dbscan(0.66, 4)

SUMMARY = """
  SELECT cluster_id, count(*) AS cluster_size, round(avg(confidence), 6) AS avg_confidence,
         arg_min(id, (-confidence, id)) AS representative_face_id
  FROM labels JOIN emb USING (id) WHERE cluster_id IS NOT NULL GROUP BY cluster_id
"""


EUCLIDEAN = "list_distance(a.embedding, b.embedding)"
COSINE = "1 - list_cosine_similarity(a.embedding, b.embedding)"


def silhouette(labelled: str, distance: str = EUCLIDEAN) -> str:
    """Mean silhouette of a relation ``id, embedding, label``."""
    return f"""
dist AS (
  SELECT a.id, a.label, b.label AS other,
         sum(CASE WHEN a.id = b.id THEN 0 ELSE {distance} END) AS s,
         count(*) AS n
  FROM {labelled} a, {labelled} b GROUP BY ALL),
per_point AS (
  SELECT id, max(CASE WHEN label = other THEN n END) AS n,
         max(CASE WHEN label = other AND n > 1 THEN s / (n - 1) END) AS a,
         min(CASE WHEN label <> other THEN s / n END) AS b
  FROM dist GROUP BY id)
SELECT round(avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette
FROM per_point"""


ORACLES |= {
    "similar_topk": f"""
WITH {EMB}, q AS (SELECT arg_min(embedding, id) AS v FROM emb),
s AS (SELECT id, source_file, cropped_face_path, confidence,
             round(list_cosine_similarity(embedding, v), 12) AS similarity FROM emb, q),
r AS (SELECT *, CAST(row_number() OVER (ORDER BY similarity DESC, id) AS INTEGER) AS rank FROM s)
SELECT * REPLACE (round(similarity, 6) AS similarity) FROM r WHERE rank <= 5""",
    "similar_topk_batch": f"""
WITH {EMB},
s AS (SELECT q.id AS query_id, e.id,
             round(list_cosine_similarity(e.embedding, q.embedding), 12) AS similarity
      FROM emb q, emb e),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id)
                     AS INTEGER) AS rank FROM s)
SELECT * REPLACE (round(similarity, 6) AS similarity) FROM r WHERE rank <= 5""",
    "distance_to_first": f"""
WITH {EMB}, q AS (SELECT arg_min(embedding, id) AS v FROM emb)
SELECT id, round(greatest(0, 1 - list_cosine_similarity(embedding, v)), 6) AS distance
FROM emb, q""",
    "neighbour_counts": f"""
WITH {EMB}
SELECT a.id, count(*) AS near FROM emb a, emb b
WHERE a.id = b.id OR 1 - list_cosine_similarity(a.embedding, b.embedding) <= 0.6
GROUP BY a.id""",
    "dbscan_labels": f"WITH RECURSIVE {LABELS} SELECT * FROM labels",
    "dbscan_labels_pairs": f"WITH RECURSIVE {dbscan(0.6, 2)} SELECT * FROM labels",
    "dbscan_default": f"WITH RECURSIVE {dbscan(0.5, 2)} SELECT * FROM labels",
    "dbscan_many_cells": f"WITH RECURSIVE {dbscan(0.6, 3)} SELECT * FROM labels",
    "cluster_summary": f"WITH RECURSIVE {LABELS} {SUMMARY}",
    "cluster_size_histogram": f"""
WITH RECURSIVE {LABELS}, summary AS ({SUMMARY})
SELECT cluster_size, count(*) AS count FROM summary GROUP BY cluster_size""",
    "largest_clusters": f"""
WITH RECURSIVE {LABELS}, summary AS ({SUMMARY})
SELECT cluster_id, cluster_size, avg_confidence, cropped_face_path
FROM summary JOIN emb ON representative_face_id = id
ORDER BY cluster_size DESC, cluster_id LIMIT 10""",
    "cluster_totals": f"""
WITH RECURSIVE {LABELS}
SELECT count(*) AS total_faces, count(DISTINCT cluster_id) AS total_clusters,
       count(*) FILTER (cluster_id IS NULL) AS noise_points FROM labels""",
    "cluster_members": f"""
WITH RECURSIVE {LABELS}
SELECT id, cluster_id, cropped_face_path, source_file, round(confidence, 6) AS confidence
FROM labels JOIN emb USING (id) WHERE cluster_id IS NOT NULL""",
    "noise_members": f"""
WITH RECURSIVE {LABELS}
SELECT id, cropped_face_path FROM labels JOIN emb USING (id) WHERE cluster_id IS NULL""",
    "cluster_export": f"""
WITH RECURSIVE {LABELS}
SELECT id, cropped_face_path,
       CASE WHEN cluster_id IS NULL THEN 'noise'
            ELSE printf('cluster_%03d', cluster_id) END AS cluster_dir
FROM labels JOIN emb USING (id)""",
    "stored_clusters": f"""
WITH RECURSIVE {dbscan(0.66, 4, "CAST(id AS VARCHAR)")}
SELECT cluster_id, count(*) AS cluster_size,
       round(CAST(CAST(avg(CAST(confidence AS FLOAT)) AS FLOAT) AS DOUBLE), 6) AS avg_confidence,
       arg_min(labels.id, (-confidence, labels.id)) AS representative_face_id
FROM labels JOIN emb ON labels.id = CAST(emb.id AS VARCHAR)
WHERE cluster_id IS NOT NULL GROUP BY cluster_id""",
    "silhouette_by_label": f"WITH {EMB}, {silhouette('emb')}",
    "silhouette_by_cluster": f"""
WITH RECURSIVE {LABELS},
labelled AS (SELECT id, embedding, coalesce(cluster_id, -1) AS label
             FROM labels JOIN (SELECT id, embedding FROM emb) USING (id)),
{silhouette('labelled')}""",
    "silhouette_cosine": f"WITH {EMB}, {silhouette('emb', COSINE)}",
    "silhouette_no_noise": f"""
WITH RECURSIVE {LABELS},
labelled AS (SELECT id, embedding, cluster_id AS label
             FROM labels JOIN (SELECT id, embedding FROM emb) USING (id) WHERE cluster_id IS NOT NULL),
{silhouette('labelled', COSINE)}""",
    "embedding_integrity": f"""
WITH {EMB}
SELECT 'duplicate_id' AS check_name, count(*) AS violations FROM emb WHERE id % 10 = 0
UNION ALL SELECT 'orphan_label', count(*) FROM emb WHERE id % 7 = 0
UNION ALL SELECT 'wrong_length', count(*) FROM emb
WHERE id % 13 = 0 OR id % 17 = 0""",
    "empty_clustering": "SELECT 0::BIGINT AS total_faces, 0::BIGINT AS total_clusters, 0::BIGINT AS noise_points",
    "neighbour_join": f"""
WITH {EMB}
SELECT a.id AS a, b.id AS b FROM emb a JOIN emb b
  ON a.id < b.id AND 1 - list_cosine_similarity(a.embedding, b.embedding) <= 0.6""",
    "approximate_join": "SELECT TRUE AS recall_reached, 0::BIGINT AS false_pairs",
}

# --- detections -------------------------------------------------------------------------

DETS = """
dets AS (
  SELECT '/img/' || CAST(l_orderkey AS VARCHAR) || '.jpg' AS image_path,
         CAST(l_orderkey % 30 AS INTEGER) AS frame_id,
         l_linenumber AS detection_id, l_partkey, l_suppkey,
         CAST(l_partkey % 8 AS INTEGER) AS class_id,
         'class_' || CAST(l_partkey % 8 AS VARCHAR) AS class_name,
         l_discount * 10 AS confidence,
         CAST(l_suppkey % 600 AS DOUBLE) - 20.6 AS x1,
         CAST(l_partkey % 400 AS DOUBLE) - 10.25 AS y1,
         CAST(l_suppkey % 600 AS DOUBLE) - 20.6 + l_quantity * 3 AS x2,
         CAST(l_partkey % 400 AS DOUBLE) - 10.25 + 10 + l_linenumber * 7 AS y2,
         640 AS image_width, 480 AS image_height,
         CASE WHEN l_linestatus = 'F' THEN l_quantity * 11 END AS mask_area
  FROM lineitem
)
"""

FACES = f"""
{DETS},
boxed AS (
  SELECT image_path AS source_path, frame_id, detection_id AS face_id,
         image_width, image_height, l_partkey, l_suppkey, x1, y1, x2, y2,
         regexp_extract(image_path, '[^/]*$') AS source_file, confidence,
         CAST(trunc(x1) AS INTEGER) AS bbox_x1, CAST(trunc(y1) AS INTEGER) AS bbox_y1,
         CAST(trunc(x2) AS INTEGER) AS bbox_x2, CAST(trunc(y2) AS INTEGER) AS bbox_y2
  FROM dets WHERE confidence >= 0.5),
cropped AS (
  SELECT source_file, frame_id, face_id, bbox_x1, bbox_y1, bbox_x2, bbox_y2, confidence,
         '/crops/' || regexp_replace(source_file, '\\.jpg$', '') || '_' || left(sha256(source_path), 12) || '_face_'
           || printf('%02d', face_id) || '.jpg' AS cropped_face_path,
         source_path, image_width, image_height,
         greatest(0, bbox_x1 - CAST(trunc((bbox_x2 - bbox_x1) * 0.1::DOUBLE) AS INTEGER)) AS crop_x1,
         greatest(0, bbox_y1 - CAST(trunc((bbox_y2 - bbox_y1) * 0.1::DOUBLE) AS INTEGER)) AS crop_y1,
         least(image_width, bbox_x2 + CAST(trunc((bbox_x2 - bbox_x1) * 0.1::DOUBLE) AS INTEGER))
           AS crop_x2,
         least(image_height, bbox_y2 + CAST(trunc((bbox_y2 - bbox_y1) * 0.1::DOUBLE) AS INTEGER))
           AS crop_y2
  FROM boxed)
"""

STAND_IN_FACES = """
img AS (
  SELECT doc_id, '/scans/' || lang || '/page.' || CAST(doc_id AS VARCHAR) || '.png' AS path,
         CAST(doc_id % 30 AS INTEGER) AS frame,
         CAST(ceil(strlen(text) / 30.0) AS INTEGER) AS h, 10 AS w, text
  FROM documents),
found AS (
  SELECT *, (h * 7 + i * 13) % 100 / 100.0::DOUBLE AS score,
         CAST(trunc(i - 0.5) AS INTEGER) AS x1, CAST(trunc(i * 1.5) AS INTEGER) AS y1,
         CAST(trunc(w - 3.0 * i) AS INTEGER) AS x2, CAST(trunc(h * 0.5 + i) AS INTEGER) AS y2
  FROM (SELECT *, CAST(unnest(range(h % 3)) AS INTEGER) AS i FROM img)),
kept AS (
  SELECT *, '/crops/page.' || CAST(doc_id AS VARCHAR) || '_' || left(sha256(path), 12) || '_face_' || printf('%02d', i) || '.png'
           AS crop_path,
         greatest(0, x1 - CAST(trunc((x2 - x1) * 0.1::DOUBLE) AS INTEGER)) AS cx1,
         greatest(0, y1 - CAST(trunc((y2 - y1) * 0.1::DOUBLE) AS INTEGER)) AS cy1,
         least(w, x2 + CAST(trunc((x2 - x1) * 0.1::DOUBLE) AS INTEGER)) AS cx2,
         least(h, y2 + CAST(trunc((y2 - y1) * 0.1::DOUBLE) AS INTEGER)) AS cy2
  FROM found WHERE score >= 0.5)
"""


def crop_hash(x1: str, y1: str, x2: str, y2: str) -> str:
    """SHA-256 of a box cut out of rows of ten three-byte pixels."""
    hexed = "rpad(hex(encode(text)), h * 60, '0')"
    return (
        f"sha256(unhex(array_to_string(list_transform(range({y1}, {y2}), "
        f"lambda y: substr({hexed}, CAST(y * 60 + {x1} * 6 + 1 AS BIGINT), "
        f"CAST(({x2} - {x1}) * 6 AS BIGINT))), '')))"
    )


OBJECT_ROWS = f"""
WITH {DETS}
SELECT regexp_extract(image_path, '[^/]*$') AS image_name, image_path, image_width,
       image_height, detection_id, class_name, class_id, confidence,
       x1 AS bbox_x1, y1 AS bbox_y1, x2 AS bbox_x2,
       y2 AS bbox_y2, x2 - x1 AS bbox_width,
       y2 - y1 AS bbox_height, (x2 - x1) * (y2 - y1) AS bbox_area,
       (x2 - x1) * (y2 - y1) / (640.0 * 480)::DOUBLE AS bbox_area_ratio,
       (x1 + x2) / 2 AS bbox_center_x, (y1 + y2) / 2 AS bbox_center_y,
       mask_area IS NOT NULL AS has_segmentation, mask_area,
       mask_area / (640.0 * 480)::DOUBLE AS mask_area_ratio
FROM dets"""

IMAGES_ON_DISK = """
pics AS (
  SELECT doc_id, text, CAST(strlen(text) AS BIGINT) AS size_bytes, CAST(ceil(strlen(text) / 30.0) AS INTEGER) AS h,
         ending, CASE WHEN doc_id % 2 = 0 THEN '/pic ' || doc_id || ending
                      ELSE '/.' || lang || '/' || source || '/_pic ' || doc_id || ending END AS path
  FROM (SELECT *, ['.png', '.JPG', '.jpeg', '.GIF', '.Bmp', '.tiff', '.webp', '.txt'][CAST(doc_id % 8 + 1 AS INTEGER)] AS ending
        FROM documents)),
pictured AS (SELECT *, strlen(text) % 7 = 0 AS bad FROM pics WHERE ending <> '.txt')
"""


ORACLES |= {
    "detection_metrics": OBJECT_ROWS,
    "detection_class_report": f"""
WITH {DETS} SELECT class_name, count(*) AS detections FROM dets GROUP BY class_name""",
    "detection_summary": f"""
WITH {DETS}
SELECT count(DISTINCT image_path) AS images, count(*) AS detections,
       round(avg(confidence), 6) AS avg_confidence, count(DISTINCT class_name) AS classes
FROM dets""",
    "face_threshold_crop_boxes": f"""
WITH {FACES},
sized AS (SELECT *, crop_x2 - crop_x1 AS cw, crop_y2 - crop_y1 AS ch FROM cropped)
SELECT * EXCLUDE (cw, ch),
       CASE WHEN cw < 112 OR ch < 112
            THEN CAST(trunc(cw * greatest(CAST(112 AS DOUBLE) / nullif(ch, 0),
                                          CAST(112 AS DOUBLE) / nullif(cw, 0))) AS INTEGER)
            ELSE cw END AS input_width,
       CASE WHEN cw < 112 OR ch < 112
            THEN CAST(trunc(ch * greatest(CAST(112 AS DOUBLE) / nullif(ch, 0),
                                          CAST(112 AS DOUBLE) / nullif(cw, 0))) AS INTEGER)
            ELSE ch END AS input_height
FROM sized""",
    "face_landmarks": f"""
WITH {FACES}
SELECT source_file, count(*) AS faces, round(sum(x1 + y1 + x2 + y2), 6) AS mark_sum,
       CAST(2 * count(*) AS BIGINT) AS marks
FROM boxed GROUP BY source_file""",
    "face_counts": f"""
WITH {FACES}
SELECT count(*) + count(*) FILTER (frame_id % 7 = 0) AS total_faces,
       count(*) AS cropped_faces FROM cropped""",
    "largest_box_per_image": f"""
WITH {DETS},
r AS (SELECT *, row_number() OVER (PARTITION BY image_path
        ORDER BY (x2 - x1) * (y2 - y1) DESC, detection_id, l_partkey, l_suppkey) AS place
      FROM dets)
SELECT image_path AS path, frame_id, detection_id AS face_id, x1 AS x1,
       y1 AS y1, x2 AS x2, y2 AS y2,
       confidence AS det_score, image_width, image_height, l_partkey, l_suppkey
FROM r WHERE place = 1""",
    "face_row_ids": f"""
WITH {DETS}
SELECT image_path AS source_path, frame_id, detection_id AS face_id,
       sha256(concat_ws(chr(0), image_path, frame_id, detection_id)) AS id
FROM dets WHERE confidence >= 0.5""",
    "object_csv_roundtrip": OBJECT_ROWS,
    "frame_stride": f"""
WITH {DETS}
SELECT frame_id, count(*) AS boxes FROM dets WHERE frame_id % 4 = 0 GROUP BY frame_id""",
    "flagged_items": """
WITH scores AS (
  SELECT '/' || source || '/doc_' || CAST(doc_id AS VARCHAR) || '.jpg' AS path,
         CASE doc_id % 3 WHEN 0 THEN 'nsfw' WHEN 1 THEN 'NSFW' ELSE 'Nsfw' END AS label,
         CAST(n_chars % 1000 AS DOUBLE) / 1000 AS score, sha256(text) AS hash FROM documents
  UNION ALL
  SELECT '/' || source || '/doc_' || CAST(doc_id AS VARCHAR) || '.jpg', 'normal',
         1 - CAST(n_chars % 1000 AS DOUBLE) / 1000, sha256(text) FROM documents)
SELECT hash, path, regexp_extract(path, '[^/]*$') AS filename
FROM scores WHERE lower(label) = 'nsfw' AND score >= 0.7""",
    "image_crops": f"""
WITH img AS (
  SELECT doc_id, text, CAST(ceil(strlen(text) / 30.0) AS INTEGER) AS h FROM documents),
box AS (
  SELECT *, CAST(doc_id % 4 AS INTEGER) AS x1, CAST(floor(h / 4) AS INTEGER) AS y1,
         CAST(6 + doc_id % 5 AS INTEGER) AS x2,
         CAST(h - (doc_id % 2) * floor(h / 3) AS INTEGER) AS y2 FROM img)
SELECT doc_id, y2 - y1 AS height, x2 - x1 AS width, {crop_hash("x1", "y1", "x2", "y2")} AS hash
FROM box""",
    "image_planes": """
WITH img AS (
  SELECT doc_id, CAST(ceil(strlen(text) / 30.0) AS BIGINT) * 30 AS n, hex(encode(text)) AS x
  FROM documents),
bytes AS (
  SELECT doc_id, n, list_transform(regexp_extract_all(x, '..'),
           lambda pair: CAST('0x' || pair AS BIGINT)) AS b FROM img)
SELECT doc_id, n AS n_values,
       CAST(list_sum(b[1:-:3]) AS BIGINT) AS plane_0, CAST(list_sum(b[2:-:3]) AS BIGINT) AS plane_1,
       CAST(list_sum(b[3:-:3]) AS BIGINT) AS plane_2,
       round(CAST(CAST((list_max(b) / 255.0::DOUBLE - 0.5) / 0.5 AS FLOAT) AS DOUBLE), 6) AS largest
FROM bytes""",
    "model_faces": f"""
WITH {STAND_IN_FACES}
SELECT regexp_extract(path, '[^/]*$') AS source_file, 0 AS frame_id, i AS face_id,
       x1 AS bbox_x1, y1 AS bbox_y1, x2 AS bbox_x2, y2 AS bbox_y2,
       round(score, 6) AS confidence, crop_path AS cropped_face_path, path AS source_path,
       w AS image_width, h AS image_height,
       cx1 AS crop_x1, cy1 AS crop_y1, cx2 AS crop_x2, cy2 AS crop_y2
FROM kept""",
    "model_frame_faces": f"""
WITH {STAND_IN_FACES}
SELECT regexp_extract(path, '[^/]*$') AS source_file, frame AS frame_id, i AS face_id,
       x1 AS bbox_x1, y1 AS bbox_y1, x2 AS bbox_x2, y2 AS bbox_y2,
       round(score, 6) AS confidence, CAST(NULL AS VARCHAR) AS cropped_face_path
FROM kept WHERE frame % 3 = 0""",
    "model_face_crops": f"""
WITH {STAND_IN_FACES}
SELECT crop_path AS cropped_face_path, path AS source_path, cy2 - cy1 AS height,
       cx2 - cx1 AS width, {crop_hash("cx1", "cy1", "cx2", "cy2")} AS hash
FROM kept""",
    "model_embeddings": f"""
WITH {STAND_IN_FACES},
best AS (
  SELECT path, arg_min(i, (-((w - 3.0 * i) - (i - 0.5)) * ((h * 0.5 + i) - i * 1.5), i)) AS i
  FROM found GROUP BY path)
SELECT path, CASE WHEN i IS NULL
         THEN h || '|-1|' || CAST('0x' || substr(hex(encode(text)), 1, 2) AS INTEGER)
         ELSE h || '|' || i || '|' || w END AS embedding
FROM img LEFT JOIN best USING (path)""",
    "model_objects": """
WITH img AS (
  SELECT '/scans/' || lang || '/page.' || CAST(doc_id AS VARCHAR) || '.png' AS image_path,
         CAST(ceil(strlen(text) / 30.0) AS INTEGER) AS h, 10 AS w FROM documents),
o AS (SELECT *, CAST(unnest(range(h % 4)) AS INTEGER) AS i FROM img),
b AS (SELECT *, 0.25::DOUBLE * i AS x1, 0.5::DOUBLE * i AS y1, 0.25::DOUBLE * i + 4 AS x2,
             0.5::DOUBLE * i + h AS y2,
             CASE WHEN i % 2 = 0 THEN 3.0::DOUBLE * h END AS m FROM o)
SELECT regexp_extract(image_path, '[^/]*$') AS image_name, image_path, w AS image_width,
       h AS image_height, i AS detection_id,
       CASE (h + i) % 4 WHEN 0 THEN 'cat' WHEN 1 THEN 'dog' WHEN 2 THEN 'bird' END AS class_name,
       (h + i) % 4 AS class_id, round(1.0::DOUBLE / (2 + i), 6) AS confidence,
       x1 AS bbox_x1, y1 AS bbox_y1, x2 AS bbox_x2, y2 AS bbox_y2,
       round(x2 - x1, 6) AS bbox_width, round(y2 - y1, 6) AS bbox_height,
       round((x2 - x1) * (y2 - y1), 6) AS bbox_area,
       round((x2 - x1) * (y2 - y1) / (w * h), 6) AS bbox_area_ratio,
       round((x1 + x2) / 2, 6) AS bbox_center_x, round((y1 + y2) / 2, 6) AS bbox_center_y,
       m IS NOT NULL AS has_segmentation, m AS mask_area,
       round(m / (w * h), 6) AS mask_area_ratio
FROM b""",
}

CROP_ROWS = f"""
{STAND_IN_FACES},
crop_rows AS (
  SELECT doc_id, regexp_extract(path, '[^/]*$') AS source_file,
         CASE WHEN doc_id % 19 = 0 THEN '/gone/' || doc_id WHEN doc_id % 23 <> 0 THEN path END AS crop
  FROM img)
"""

# --- files ------------------------------------------------------------------------------

ORACLES |= {
    "model_rejects": f"""
WITH {CROP_ROWS}
SELECT 'frame' AS kind, path, 'RuntimeError: height' AS error FROM img WHERE frame % 3 = 0 AND h % 11 = 0
UNION ALL SELECT 'object', path, 'RuntimeError: height' FROM img WHERE h % 11 = 0
UNION ALL
SELECT 'crop', crop, CASE WHEN img.path IS NULL THEN 'no such crop' WHEN h % 11 = 0 THEN 'RuntimeError: height'
                          ELSE 'no face found' END
FROM crop_rows LEFT JOIN img ON crop = img.path
WHERE crop IS NOT NULL AND (img.path IS NULL OR h % 11 = 0 OR h % 3 = 0)""",
    "embed_store_cluster": f"""
WITH RECURSIVE {CROP_ROWS},
best AS (
  SELECT path, arg_min(i, (-((w - 3.0 * i) - (i - 0.5)) * ((h * 0.5 + i) - i * 1.5), i)) AS i
  FROM found GROUP BY path),
faces AS (
  SELECT sha256(concat_ws(chr(0), source_file, '0', crop_rows.doc_id)) AS id,
         CAST(CAST(crop_rows.doc_id % 100 AS DOUBLE) / 100 AS FLOAT) AS confidence,
         CASE WHEN i IS NULL THEN [h, -1, CAST('0x' || substr(hex(encode(text)), 1, 2) AS INTEGER)]::DOUBLE[]
              ELSE [h, i, w]::DOUBLE[] END AS v
  FROM crop_rows JOIN img ON crop = img.path LEFT JOIN best ON best.path = img.path),
points AS (SELECT v, min(id) AS i, count(*) AS n FROM faces GROUP BY v),
near AS (SELECT a.i, b.i AS j, b.n FROM points a JOIN points b
         ON a.i = b.i OR 1 - list_cosine_similarity(a.v, b.v) <= 0.5),
core AS (SELECT i FROM near GROUP BY i HAVING sum(n) >= 2),
edges AS (SELECT i, j FROM near WHERE i IN (FROM core) AND j IN (FROM core)),
reach(i, r) AS (SELECT i, i FROM core UNION SELECT e.j, reach.r FROM reach JOIN edges e ON e.i = reach.i),
root AS (SELECT i, min(r) AS r FROM reach GROUP BY i),
numbered AS (SELECT i, CAST(dense_rank() OVER (ORDER BY r) - 1 AS INTEGER) AS c FROM root)
SELECT c AS cluster_id, count(*) AS cluster_size, arg_min(id, (-confidence, id)) AS representative_face_id,
       round(CAST(CAST(avg(CAST(confidence AS DOUBLE)) AS FLOAT) AS DOUBLE), 6) AS avg_confidence
FROM faces JOIN points USING (v) JOIN numbered USING (i) GROUP BY c""",
    "image_listings": f"""
WITH {IMAGES_ON_DISK}
SELECT 'faces' AS kind, path, size_bytes FROM pics WHERE ending NOT IN ('.GIF', '.txt')
UNION ALL SELECT 'flags', path, size_bytes FROM pics WHERE ending <> '.txt'
UNION ALL SELECT 'objects', path, size_bytes FROM pics
WHERE doc_id % 2 = 0 AND ending NOT IN ('.GIF', '.Bmp', '.txt')""",
    "image_scan_decode": f"""
WITH {IMAGES_ON_DISK}
SELECT path, size_bytes, CASE WHEN NOT bad THEN h END AS height,
       CASE WHEN NOT bad THEN sha256(unhex(rpad(hex(encode(text)), h * 60, '0'))) END AS hash,
       CASE WHEN bad THEN 'ValueError: length' END AS error
FROM pictured""",
    "flag_folder": f"""
WITH {IMAGES_ON_DISK}
SELECT sha256(text) AS hash, path, regexp_extract(path, '[^/]*$') AS filename
FROM pictured WHERE NOT bad AND h % 10 >= 7""",
    "face_folder_summary": f"""
WITH {IMAGES_ON_DISK},
p AS (SELECT *, bad OR h % 11 = 0 AS lost FROM pictured WHERE ending <> '.GIF'),
f AS (SELECT doc_id, unnest(range(h % 3)) AS i, h FROM p WHERE NOT lost),
k AS (SELECT doc_id FROM f WHERE CAST((h * 7 + i * 13) % 100 AS DOUBLE) / 100 >= 0.5)
SELECT (SELECT count(*) FROM p) AS scanned, (SELECT count(*) FROM p WHERE lost) AS failed,
       (SELECT count(DISTINCT doc_id) FROM k) AS with_hits, (SELECT count(*) FROM k) AS hits""",
    "object_folder_summary": f"""
WITH {IMAGES_ON_DISK},
p AS (SELECT *, bad OR h % 11 = 0 AS lost FROM pictured WHERE doc_id % 2 = 0 AND ending NOT IN ('.GIF', '.Bmp'))
SELECT count(*) AS scanned, count(*) FILTER (lost) AS failed,
       count(*) FILTER (NOT lost AND h % 4 > 0) AS with_hits,
       CAST(coalesce(sum(h % 4) FILTER (NOT lost), 0) AS BIGINT) AS hits
FROM p""",
    "crops_on_disk": """
SELECT doc_id, '/pic ' || doc_id || '.png' AS crop FROM documents WHERE doc_id % 8 = 0 AND doc_id % 5 <> 0""",
    "manifest_csv_odd_files": f"""
WITH {MANIFEST}
SELECT path, nullif(hash, '') AS hash, size_bytes,
       CASE size_bytes % 3 WHEN 0 THEN '_' WHEN 1 THEN '.' ELSE 'a+b %41 ' END || source_filename AS source_filename
FROM manifest""",
    "manifest_replace_device": f"""
WITH {MANIFEST}
SELECT path, nullif(hash, '') AS hash, source_filename,
       CASE WHEN source_filename IN ('src1.csv', 'src2.csv') THEN size_bytes + 1 ELSE size_bytes END AS size_bytes
FROM manifest""",
    "streaming_duplicate_counts": f"""
WITH {MANIFEST}
SELECT hash, count(*) AS total_occurrences, CAST(sum(size_bytes) AS BIGINT) AS total_size,
       min(size_bytes) AS size_bytes, CAST(min(size_bytes) * (count(*) - 1) AS BIGINT) AS space_wasted
FROM hashed GROUP BY hash HAVING count(*) > 1""",
    "approximate_distinct_counts": f"""
WITH {MANIFEST}
SELECT figure, exact, TRUE AS within_bound, TRUE AS merges
FROM (UNPIVOT (SELECT count(DISTINCT hash) AS unique_hashes, count(DISTINCT path) AS unique_paths,
                      count(DISTINCT filename_only) AS unique_filenames FROM hashed)
      ON unique_hashes, unique_paths, unique_filenames INTO NAME figure VALUE exact)""",
    "manifest_csv_roundtrip": f"""
WITH {MANIFEST}
SELECT path, nullif(hash, '') AS hash, size_bytes, source_filename FROM manifest""",
    "detections_csv_roundtrip": f"""
WITH {FACES}
SELECT source_file, frame_id, face_id, bbox_x1, bbox_y1, bbox_x2, bbox_y2,
       round(confidence, 6) AS confidence, cropped_face_path FROM cropped""",
    "file_tree_scan": """
SELECT '/.' || lang || '/' || source || '/_doc ' || CAST(doc_id AS VARCHAR)
         || CASE WHEN doc_id % 2 = 0 THEN '.txt' ELSE '' END AS path,
       sha256(text) AS hash, CAST(strlen(text) AS BIGINT) AS size_bytes
FROM documents""",
    "inventory_flatten": """
WITH m AS (
  SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS k, 'disk' || CAST(c_nationkey AS VARCHAR) AS disk,
         'part' || CAST(c_custkey % 4 AS VARCHAR) AS part, r_name, n_name, c_mktsegment
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
d AS (
  SELECT c_custkey, disk AS name, k || 'G' AS size, r_name AS label, '' AS fstype, '' AS uuid,
         '' AS serial, '' AS mountpoint FROM m
  UNION ALL
  SELECT c_custkey, disk || '/' || part, '', n_name, 'ext4',
         CASE WHEN c_custkey % 3 <> 0 THEN 'u-' || k ELSE '' END, '',
         CASE WHEN c_custkey % 2 = 0 THEN '/mnt/' || k ELSE '' END FROM m
  UNION ALL
  SELECT c_custkey, disk || '/' || part || '/vault', '', c_mktsegment, '', '', '', '/vault/' || k
  FROM m WHERE c_custkey % 5 = 0)
SELECT *, CASE WHEN mountpoint <> '' THEN mountpoint
               ELSE '/dev/' || regexp_extract(name, '[^/]*$') END AS scan_root,
       CASE WHEN uuid <> '' THEN uuid || '.csv'
            ELSE regexp_extract(name, '[^/]*$') || '_manifest.csv' END AS manifest_name
FROM d""",
}
