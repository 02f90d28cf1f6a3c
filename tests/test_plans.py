"""Plans keep the shape they were designed for."""

import contextlib
import io

import pytest

from hoardlens.operators import dedup, detections, predict
from hoardlens.plans import manifest_report, stand_ins, views
from hoardlens.sources import inventory

SF_DIR = "/root/testdata/sf0.01"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def manifest(spark):
    return views.manifest(spark, SF_DIR)


def test_top_reports_use_a_bounded_sort(manifest):
    for df in (
        dedup.top_paths(manifest),
        dedup.top_waste(dedup.per_hash(manifest)),
        dedup.cross_manifest(dedup.per_hash(manifest)),
        manifest_report.type_report(manifest),
        manifest_report.basic_top_groups(manifest),
    ):
        text = plan(df)
        assert "TakeOrderedAndProject" in text
        assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_file_types_need_two_shuffles_and_no_join(manifest):
    tree = plan(dedup.file_types(manifest)).split("\n\n")[0]
    assert tree.count("Exchange") == 2 and "Join" not in tree


def test_scans_read_only_what_is_used(spark, manifest):
    text = plan(dedup.path_sizes(manifest))
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in text
    faces = detections.confident(views.detections(spark, SF_DIR), "confidence", 0.5)
    text = plan(faces.select("image_path"))
    assert "ReadSchema: struct<l_orderkey:bigint,l_discount:double>" in text


def test_models_run_once_per_image(spark):
    images = views.images(spark, SF_DIR).drop("frame_id")
    for df in (
        predict.detect_faces(images, stand_ins.faces, 0.5, "/crops"),
        predict.detect_objects(images, stand_ins.objects, {0: "cat"}),
    ):
        assert plan(df).split("\n\n")[0].count("EvalPython") == 1
    cropped = plan(predict.crop_faces(images, stand_ins.faces, "/crops")).split("\n\n")[0]
    assert cropped.count("EvalPython") == 2  # the model, and one cut for all boxes of an image
    dumps = views.inventory(spark, SF_DIR)
    flat = plan(inventory.flatten_inventory(dumps, "dump", ["c_custkey"]))
    assert "Python" not in flat.split("\n\n")[0]


def test_duplicate_aggregations_are_hashed(manifest):
    for df in (dedup.per_hash(manifest), dedup.file_types(manifest), dedup.path_sizes(manifest)):
        text = plan(df)
        assert "HashAggregate" in text and "SortAggregate" not in text


def test_per_hash_reads_the_input_once(manifest):
    assert plan(dedup.per_hash(manifest)).split("\n\n")[0].count("Scan parquet") == 1


def test_reports_multiply_no_row_before_their_limit(manifest):
    for df in (dedup.largest_waste(manifest), dedup.most_widespread(manifest)):
        tree = plan(df).split("\n\n")[0]
        assert "NestedLoopJoin" not in tree and "CartesianProduct" not in tree


def test_largest_box_sorts_only_candidates(spark):
    raw = views.detections(spark, SF_DIR).withColumnRenamed("image_path", "path")
    tree = plan(detections.largest_per_image(raw, "path", ["detection_id"])).split("\n\n")[0]
    assert tree.count("HashAggregate") >= 2 and "SemiJoin" in tree.replace(" ", "") or "LeftSemi" in tree
