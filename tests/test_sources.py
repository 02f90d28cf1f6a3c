import hashlib
import json
import os
import struct
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from hoardlens import schemas, workspace
from hoardlens.functions import boxes
from hoardlens.operators import dedup, predict, sketches
from hoardlens.operators.dbscan import dbscan
from hoardlens.plans import folder_report
from hoardlens.sources import file_tree, images, inventory, manifests, tables
from hoardlens.streaming import manifest_counts

ROWS = [
    ("/a/x.JPG", "h1", 10), ('/a/q,"z".tar.gz', "h1", 10), ("/b/none", None, 5),
    ("/b/trail.", "h2", 7), ("/c\\w\\win.tXt", "h3", 8), (" /sp/lead.x ", "h4", 9),
    ("/b/straße.ß", "h6", 1), ("/n\nl,.txt", "h7", 1), ("/a/", "h8", 1), ('/"', "h9", 2**63 - 1),
]


def as_set(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_manifest_round_trip_keeps_odd_paths(spark, tmp_path):
    folder = str(tmp_path / "m")
    df = spark.createDataFrame(ROWS, schemas.MANIFEST)
    for name in ("a b.csv", "a+b c%41.csv"):
        manifests.write_manifest(df, folder, name)
    got = manifests.read_manifests(spark, folder)
    expected = {(*r, n) for r in ROWS for n in ("a b.csv", "a+b c%41.csv")}
    assert as_set(got, "path", "hash", "size_bytes", "source_filename") == expected
    manifests.write_manifest(df, folder, "a b.csv")
    assert manifests.read_manifests(spark, folder).count() == 3 * len(ROWS)
    manifests.write_manifest(df, folder, "a b.csv", mode="overwrite")
    assert manifests.read_manifests(spark, folder).count() == 2 * len(ROWS)


def test_many_manifests_at_once(spark, tmp_path):
    folder = str(tmp_path / "m")
    rows = [(*r, n) for r in ROWS for n in ("a b.csv", "a+b c%41.csv", "plain.csv")]
    df = spark.createDataFrame(rows, schemas.with_text(schemas.MANIFEST, "source_filename"))
    manifests.write_manifests(df, folder)
    got = manifests.read_manifests(spark, folder)
    assert as_set(got, "path", "hash", "size_bytes", "source_filename") == set(rows)


@pytest.fixture
def plain_files(tmp_path):
    (tmp_path / "one.csv").write_text('path,hash,size_bytes\n/x,,1\n/y,"",2\n"/q ""w"", z",h,"3"\n')
    (tmp_path / "two [2].csv").write_text('path,hash,size_bytes\n"/n\nl",h7,4\n')
    (tmp_path / "notes.txt").write_text("no manifest")
    return tmp_path


def test_plain_files_split_unless_a_line_break_is_quoted(spark, plain_files):
    got = manifests.read_manifests(spark, str(plain_files))
    assert as_set(got, "path", "hash", "size_bytes", "source_filename") == {
        ("/x", None, 1, "one.csv"), ("/y", None, 2, "one.csv"), ('/q "w", z', "h", 3, "one.csv"),
        ("/n\nl", "h7", 4, "two [2].csv"),
    }
    files = manifests.find_manifests(spark, str(plain_files))
    looked = {os.path.basename(f): odd for f, _, odd in manifests._looked_at(spark, files)}
    assert looked == {"one.csv": False, "two%20%5B2%5D.csv": True}


def test_bad_manifests(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        manifests.read_manifests(spark, str(tmp_path / "absent"))
    assert manifests.read_manifests(spark, str(tmp_path)).count() == 0
    (tmp_path / "bad.csv").write_text("path,hash,size_bytes\n/x,h,many\n/y,h,2\n")
    with pytest.raises(Exception):
        manifests.read_manifests(spark, str(tmp_path)).collect()
    lenient = manifests.read_manifests(spark, str(tmp_path), strict=False)
    assert as_set(lenient, "path", "size_bytes", "corrupt_record") == {
        ("/x", None, "/x,h,many"), ("/y", 2, None),
    }
    (tmp_path / "bad.csv").write_text("hash,file,size_bytes\nh,/x,1\n/path,hash,size_bytes\n")
    with pytest.raises(ValueError, match="does not begin with a header"):
        manifests.read_manifests(spark, str(tmp_path))


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for folder in ("sub/deep/er", ".hid", "empty"):
        (root / folder).mkdir(parents=True)
    for name, data in {
        "a.png": b"a", "sub/B.PNG": b"b" * 5000, ".hid/c.png": b"c", "_u.png": b"u",
        ".dot.png": b"d", "empty.jpg": b"", "C.Jpg": b"J", "G.GIF": b"g", "sub/deep/er/x": b"x",
    }.items():
        (root / name).write_bytes(data)
    (root / "link.png").symlink_to(root / "a.png")
    (root / "dirlink").symlink_to(root / "sub")
    (root / "broken.png").symlink_to(root / "nowhere")
    return root


def walk(root):
    out = {}
    for folder, _, names in os.walk(root):
        for name in names:
            path = os.path.join(folder, name)
            if os.path.isfile(path):
                data = open(path, "rb").read()
                out[path] = (hashlib.sha256(data).hexdigest(), len(data))
    return out


@pytest.mark.parametrize("budget", [20_000, 1])
def test_scan_finds_what_a_walk_finds(spark, tree, monkeypatch, budget):
    monkeypatch.setattr(file_tree, "WALK_ENTRIES", budget)
    scanned = file_tree.scan_tree(spark, str(tree)).collect()
    assert {r["path"]: (r["hash"], r["size_bytes"]) for r in scanned} == walk(tree)
    assert not [r for r in scanned if r["error"]]


def test_unreadable_content_keeps_its_row(spark, tree, monkeypatch):
    monkeypatch.setattr(
        file_tree, "file_hash",
        lambda path: (None, "denied") if path.endswith("a.png") else ("h", None),
    )
    rows = {r["path"]: r for r in file_tree.scan_tree(spark, str(tree)).collect()}
    bad = rows[str(tree / "a.png")]
    assert (bad["hash"], bad["size_bytes"], bad["error"]) == (None, 1, "denied")


def test_image_listings(spark, tree):
    def names(df):
        return {os.path.relpath(r["path"], tree) for r in df.collect()}

    images = {"a.png", "sub/B.PNG", ".hid/c.png", "_u.png", ".dot.png", "empty.jpg", "C.Jpg", "link.png"}
    assert names(file_tree.list_images(spark, str(tree))) == images
    with_gif = names(file_tree.list_images(spark, str(tree), file_tree.FLAG_IMAGES))
    assert with_gif == images | {"G.GIF"}
    flat = names(file_tree.list_images_flat(spark, str(tree)))
    assert flat == {"a.png", "_u.png", "empty.jpg", "link.png"}
    with pytest.raises(FileNotFoundError):
        file_tree.list_files(spark, str(tree / "a.png"))
    rows = spark.createDataFrame([(str(tree / "a.png"),), ("/gone",)], "p string")
    assert file_tree.existing_only(rows, file_tree.list_files(spark, str(tree)), "p").count() == 1


def png(width, height):
    def chunk(kind, data):
        body = kind + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))

    lines = b"".join(b"\0" + bytes([i, 2, 3] * width) for i in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


@pytest.fixture
def pictures(tmp_path):
    folder = tmp_path / "pictures"
    folder.mkdir()
    (folder / "a b.png").write_bytes(png(4, 3))
    (folder / "tall.png").write_bytes(png(2, 6))
    (folder / "broken.png").write_bytes(png(2, 2)[:20])
    return folder


def test_images_flags_and_failures(spark, pictures):
    images = tables.read_images(spark, str(pictures))
    assert {os.path.basename(r["path"]) for r in images.collect()} == {"a b.png", "tall.png"}

    def model():
        def predict(batch):
            if (batch["height"] == 6).any():
                raise RuntimeError("too tall")
            return [[{"label": "NSFW", "score": 0.7}] for _ in range(len(batch))]

        return predict

    hits = predict.flag_images(images, model).collect()
    data = (pictures / "a b.png").read_bytes()
    assert [tuple(r) for r in hits] == [
        (hashlib.sha256(data).hexdigest(), str(pictures / "a b.png"), "a b.png")
    ]
    ok, failed = predict.split(predict.with_result(images, model, schemas.SCORE_ITEM))
    assert ok.count() == 1
    assert failed.select("result.error").first()[0] == "RuntimeError: too tall"
    with pytest.raises(ValueError):
        predict.flag_images(images, model, 1.5)


def test_embeddings_of_crops_and_search_by_image(spark, pictures):
    crops = tables.read_images(spark, str(pictures))

    def model():
        def predict(batch):
            return [
                [
                    {"x1": 0.0, "y1": 0.0, "x2": 1.0, "y2": 1.0, "embedding": [9.0, 9.0]},
                    {"x1": 0.0, "y1": 0.0, "x2": 2.0, "y2": 2.0, "embedding": [1.0, 0.0]},
                    {"x1": 1.0, "y1": 1.0, "x2": 3.0, "y2": 3.0, "embedding": [5.0, 5.0]},
                ]
                if h == 3
                else []
                for h in batch["height"]
            ]

        return predict

    def direct():
        return lambda batch: [[{"embedding": [0.0, float(h)]}] for h in batch["height"]]

    names = ["a b.png", "tall.png", "gone.png"]
    rows = [("s.jpg", 0, i, str(pictures / n)) for i, n in enumerate(names)] + [("s.jpg", 0, 3, None)]
    faces = spark.createDataFrame(
        rows, "source_file string, frame_id int, face_id int, cropped_face_path string"
    )
    found = predict.embed_detections(faces, crops, model, direct)
    assert {(r["face_id"], tuple(r["embedding"])) for r in found.collect()} == {
        (0, (1.0, 0.0)), (1, (0.0, 6.0)),
    }
    assert predict.embed_detections(faces, crops, model).count() == 1

    stored = found.withColumn("id", tables.face_key()).withColumn("confidence", F.lit(0.5))
    by_name = crops.where(F.col("path").endswith("a b.png"))
    got = predict.similar_faces(stored, by_name, model).orderBy("rank").collect()
    assert [(r["similarity"], os.path.basename(r["face_path"])) for r in got] == [
        (1.0, "a b.png"), (0.0, "tall.png"),
    ]
    faceless = crops.where(F.col("path").endswith("tall.png"))
    assert predict.similar_faces(stored, faceless, model).count() == 0


def test_store_and_export(spark, pictures, tmp_path):
    store = tables.ClusterStore(spark, str(tmp_path / "store"))
    assert store.embeddings().count() == 0 and store.summary().count() == 0
    faces = [
        ("s.jpg", 0, i, str(pictures / "a b.png") if i < 3 else "/gone.png", [1.0, i / 1000], 0.5 + i / 10)
        for i in range(4)
    ] + [("t.jpg", 0, 0, str(pictures / "tall.png"), [0.0, 1.0], 0.9), ("u.jpg", 0, 0, None, None, 0.1)]
    df = spark.createDataFrame(
        faces, "source_file string, frame_id int, face_id int, cropped_face_path string,"
        " embedding array<float>, confidence double",
    ).withColumns({c: F.lit(1) for c in ("bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2")})
    df = df.withColumn("landmark_points", F.lit("[]"))
    assert store.ensure_embeddings(lambda: df) == 5
    assert store.ensure_embeddings(lambda: pytest.fail("already there")) == 5
    for _ in range(2):
        store.replace_clusters(dbscan(store.embeddings()))
    assert store.clusters().count() == 5
    row = store.summary().first()
    assert (row["cluster_id"], row["cluster_size"]) == (0, 4)
    members = store.embeddings().join(store.labels(), "id")
    best = members.where(F.col("id") == row["representative_face_id"]).first()
    assert best["face_id"] == 3
    copied = tables.export_files(members, str(tmp_path / "out")).collect()
    assert len(copied) == 4
    assert sorted(os.listdir(tmp_path / "out")) == ["cluster_000", "noise"]
    assert os.listdir(tmp_path / "out" / "noise") == ["tall.png"]


def test_equal_file_names_keep_their_own_keys(spark):
    rows = [("x.jpg", 0, 0, "/a/x.jpg"), ("x.jpg", 0, 0, "/b/x.jpg")]
    faces = spark.createDataFrame(rows, "source_file string, frame_id int, face_id int, source_path string")
    name = boxes.crop_name("/crops/", F.col("source_path"), F.col("face_id"))
    found = faces.select(tables.face_key("source_path").alias("id"), name.alias("name")).distinct().collect()
    assert len({r["id"] for r in found}) == len({r["name"] for r in found}) == 2
    assert all(r["name"].startswith("/crops/x_") and r["name"].endswith("_face_00.jpg") for r in found)


def test_manifests_of_any_name_and_column_order(spark, tmp_path):
    folder = tmp_path / "m"
    folder.mkdir()
    files = {
        "a.csv": "path,hash,size_bytes\n/x,h,1\n",
        "_b+ %41.csv": "\ufeffSize_Bytes,extra,\"path\",HASH,extra\n7,q,/y,h2,\n8,,/z,,\n",
        ".c.csv": "hash, size_bytes ,path\nh3,3,\"/n\nl,\"\npath,9,path\n",
        "empty.csv": "",
        "only header.csv": "hash,path,size_bytes\n",
    }
    for name, text in files.items():
        (folder / name).write_text(text)
    expected = {
        ("/x", "h", 1, "a.csv"), ("/y", "h2", 7, "_b+ %41.csv"), ("/z", None, 8, "_b+ %41.csv"),
        ("/n\nl,", "h3", 3, ".c.csv"), ("path", "path", 9, ".c.csv"),
    }
    got = manifests.read_manifests(spark, str(folder))
    assert as_set(got, "path", "hash", "size_bytes", "source_filename") == expected
    assert as_set(manifests.read_manifests(spark, folder.as_uri()), "path") == {(r[0],) for r in expected}
    # Hidden names can be written too, as one manifest and as many.
    row = spark.createDataFrame([("/new", "h", 1)], schemas.MANIFEST)
    manifests.write_manifest(row, str(folder), "_new.csv")
    manifests.write_manifests(row.withColumn("source_filename", F.lit(".x=y.csv")), str(folder))
    names = {r[0] for r in manifests.read_manifests(spark, str(folder)).select("source_filename").collect()}
    assert names == {r[3] for r in expected} | {"_new.csv", ".x=y.csv"}
    for name in ("dev1", None):
        df = row.withColumn("source_filename", F.lit(name).cast("string"))
        with pytest.raises(Exception, match="no name for a manifest"):
            manifests.write_manifests(df, str(tmp_path / "out"))


def test_hidden_folders_of_parts_are_read(spark, tmp_path):
    spark.createDataFrame([("/x", "h", 1)], schemas.MANIFEST).write.option("header", True).csv(str(tmp_path / "m" / "_parts.csv"))
    got = manifests.read_manifests(spark, str(tmp_path / "m"))
    assert as_set(got, "path", "source_filename") == {("/x", "_parts.csv")}


def test_replacing_one_device_keeps_the_others(spark, tmp_path):
    folder = str(tmp_path / "m")
    named = schemas.with_text(schemas.MANIFEST, "source_filename")
    first = [("/1", "h", 1, "a.csv"), ("/2", "h", 2, "a.csv"), ("/3", "h", 3, "b.csv"), ("/4", None, 4, "_c d.csv")]
    manifests.write_manifests(spark.createDataFrame(first, named), folder)
    (tmp_path / "m" / "plain.csv").write_text("path,hash,size_bytes\n/5,h,5\n")
    new = [("/9", "h", 9, "a.csv"), ("/8", "h", 8, "plain.csv"), ("/7", "h", 7, "_c d.csv")]
    manifests.write_manifests(spark.createDataFrame(new, named), folder, mode="overwrite")
    got = manifests.read_manifests(spark, folder)
    assert as_set(got, *named.fieldNames()) == {*new, first[2]}
    manifests.write_manifests(spark.createDataFrame(first[:2], named), folder)
    assert manifests.read_manifests(spark, folder).count() == 6
    with pytest.raises(ValueError, match="mode"):
        manifests.write_manifests(got, folder, mode="ignore")


def test_running_counts_equal_the_batch_and_survive_a_restart(spark, tmp_path):
    folder, checkpoint = str(tmp_path / "m"), str(tmp_path / "stream")
    named = schemas.with_text(schemas.MANIFEST, "source_filename")

    def rows(device, count):
        return [(f"/{device}/{i},\n", f"h{i % 3}" if i % 4 else None, i, f"{device}.csv") for i in range(count)]

    def run():
        query = manifest_counts.follow(spark, folder, checkpoint, files_per_batch=1)
        query.awaitTermination()
        return query.lastProgress["batchId"]

    def equal():
        batch = dedup.per_hash(manifests.read_manifests(spark, folder))
        found = manifest_counts.current_totals(spark, checkpoint)
        assert as_set(found, "hash", "total_occurrences", "size_bytes") == as_set(batch, "hash", "total_occurrences", "size_bytes")
        wasted = as_set(dedup.top_waste(batch), "hash", "space_wasted")
        assert as_set(manifest_counts.current_duplicates(spark, checkpoint), "hash", "space_wasted") == wasted

    manifests.write_manifests(spark.createDataFrame(rows("a", 9) + rows("b", 5), named), folder)
    assert run() >= 1
    equal()
    run()  # nothing new
    equal()
    manifests.write_manifests(spark.createDataFrame(rows("c", 30), named), folder)
    run()
    equal()


def test_sketches_of_new_manifests_join_the_stored_ones(spark, tmp_path):
    folder = str(tmp_path / "sketches")
    named = schemas.with_text(schemas.MANIFEST, "source_filename")
    rows = [(f"/{i % 700}/f{i % 50}", f"h{i % 900}", i, f"{i % 4}.csv") for i in range(3_000)]
    whole = spark.createDataFrame(rows, named)
    exact = dedup.overall_stats(whole).first()

    def guess():
        return sketches.approx_overall_stats(sketches.stored_sketches(spark, folder)).first()

    first = whole.where("source_filename <> '3.csv'")
    sketches.keep_sketches(sketches.manifest_sketches(first), folder)
    assert guess()["total_file_entries"] == 2_250
    last = whole.where("source_filename = '3.csv'")
    for part in (last.limit(1), last):  # a manifest that is read again replaces its sketch
        sketches.keep_sketches(sketches.manifest_sketches(part), folder)
    found = guess()
    one = sketches.approx_overall_stats(sketches.manifest_sketches(whole.withColumn("source_filename", F.lit("x")))).first()
    assert found == one and found["total_size_all_files"] == exact["total_size_all_files"]
    for name in sketches.COUNTED.values():
        assert abs(found[name] - exact[name]) <= max(1, sketches.error_bound() * exact[name])
    none = sketches.approx_overall_stats(sketches.manifest_sketches(whole.limit(0))).first()
    assert none["unique_hashes"] == none["total_file_entries"] == 0


def test_bad_dumps_keep_the_others(spark):
    good = '{"blockdevices": [{"name": "sda", "size": 5, "children": [{"name": "sda1"}]}]}'
    rows = [(1, good), (2, "{broken"), (3, "[]"), (4, None), (5, '{"blockdevices": [7]}')]
    dumps = spark.createDataFrame(rows, "host int, dump string")
    flat = inventory.flatten_inventory(dumps, "dump", ["host"]).collect()
    assert sorted((r["host"], r["name"], r["size"]) for r in flat) == [(1, "sda", "5"), (1, "sda/sda1", "")]
    assert {r["host"] for r in inventory.bad_dumps(dumps, "dump", ["host"]).collect()} == {2, 3, 5}
    odd = [
        (6, '{"blockdevices": {"name": "x"}}'), (7, '{"blockdevices": [{"name": "a", "children": [{"name": "b", "children": 5}]}]}'),
        (8, '{"blockdevices": null}'), (9, '{"blockdevices": [{"name": null, "label": true, "uuid": false, "size": [1, "x"], "children": {}}]}'),
        (10, ""), (11, '{"blockdevices": [{"name": "n", "children": [{"name": "m"}, null]}]}'),
    ]
    dumps = spark.createDataFrame(odd, "host int, dump string")
    flat = inventory.flatten_inventory(dumps, "dump", ["host"]).collect()
    assert [tuple(r)[:5] for r in flat] == [(9, "", '[1,"x"]', "true", "")] and flat[0]["uuid"] == ""
    bad = {r["host"]: r["error"] for r in inventory.bad_dumps(dumps, "dump", ["host"]).collect()}
    assert bad == {6: "blockdevices is not a list", 7: "children is not a list", 11: "not a device"}
    assert "python" not in inventory.flatten_inventory(dumps, "dump", ["host"])._jdf.queryExecution().toString().lower()


def test_released_tables_are_gone(spark):
    kept = workspace.materialize(spark.range(3), "kept")
    folder = kept.inputFiles()[0].removeprefix("file:").rsplit("/", 2)[0]
    assert "hoardlens" in folder and os.path.isdir(folder.replace("//", "/"))
    workspace.release(spark)
    assert not os.path.exists(folder.replace("//", "/"))


def test_empty_detection_csv_has_its_header(spark, tmp_path):
    target = str(tmp_path / "d")
    tables.write_csv(spark.createDataFrame([], schemas.OBJECT_DETECTIONS), target, schemas.OBJECT_DETECTIONS)
    text = "".join(p.read_text() for p in (tmp_path / "d").glob("*.csv"))
    assert text.strip() == ",".join(schemas.OBJECT_DETECTIONS.fieldNames())
    assert tables.read_csv(spark, target, schemas.OBJECT_DETECTIONS).count() == 0


def test_inventory_of_any_depth(spark):
    deep = {"name": "d9"}
    for i in range(8, -1, -1):
        deep = {"name": f"d{i}", "uuid": None, "children": [deep]}
    dump = json.dumps({"blockdevices": [deep, {"name": "sr0", "size": "1G", "children": None}]})
    df = spark.createDataFrame([("m1", dump), ("m2", "{}"), ("m3", None)], "machine string, dump string")
    rows = inventory.flatten_inventory(df, "dump", ["machine"]).collect()
    assert len(rows) == 11 and {r["machine"] for r in rows} == {"m1"}
    assert "/".join(f"d{i}" for i in range(10)) in {r["name"] for r in rows}
    assert {r["uuid"] for r in rows} == {""}


def test_no_image_is_lost_without_a_word(spark, pictures):
    bad = tables.bad_images(spark, str(pictures)).collect()
    assert [(r["path"], bool(r["error"])) for r in bad] == [(str(pictures / "broken.png"), True)]

    def model():
        def predict(batch):
            if (batch["height"] == 6).any():
                raise RuntimeError("too tall")
            face = {"x1": 0.0, "y1": 0.0, "x2": 2.0, "y2": 2.0, "det_score": 0.9}
            return [[face] for _ in range(len(batch))]

        return predict

    images = tables.read_images(spark, str(pictures))
    for found, rejects in (
        predict.detect_faces_and_rejects(images, model),
        predict.crop_faces_and_rejects(images, model, "/crops"),
    ):
        assert found.count() == 1
        assert [tuple(r) for r in rejects.collect()] == [(str(pictures / "tall.png"), "RuntimeError: too tall")]

    (pictures / "_SUCCESS").write_bytes(b"")
    (pictures / "day=1").mkdir()
    (pictures / "day=1" / "c.png").write_bytes(png(2, 2))
    assert tables.read_images(spark, str(pictures)).count() == 3
    for name in ("_a.png", ".b.PNG", "_old/.c=1/%41 +.png"):
        hidden = pictures.parent / f"hidden{len(name)}{name[1]}"
        (hidden / name).parent.mkdir(parents=True)
        (hidden / name).write_bytes(png(2, 3))
        (hidden / "plain.png").write_bytes(png(4, 1))
        for location in (str(hidden), hidden.as_uri(), f"{pictures.parent}/hidden*{name[1]}"):
            found = tables.read_images(spark, location).select("path", "image.origin", "image.width", "image.height")
            assert {tuple(r)[:1] + tuple(r)[2:] for r in found.collect()} == {
                (str(hidden / name), 2, 3), (str(hidden / "plain.png"), 4, 1),
            }
        (hidden / "_bad.png").write_bytes(b"no image")
        assert [r["path"] for r in tables.bad_images(spark, str(hidden)).collect()] == [str(hidden / "_bad.png")]


def decoder():
    """Images of three bytes a pixel, four pixels a row."""

    def decode(data):
        if len(data) % 12 or not data:
            raise ValueError("not whole rows")
        return {"height": len(data) // 12, "width": 4, "nChannels": 3, "mode": 16, "data": data}

    return decode


@pytest.fixture
def album(tmp_path):
    root = tmp_path / "album"
    files = {"a.png": 12, "b.JPG": 24, ".hid/_c.webp": 36, "d.png": 7, "e.txt": 12, "f.gif": 48, "G.Png": 60, "empty.bmp": 0}
    for name, size in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(bytes(range(size)))
    return root


def test_images_are_decoded_from_a_tree(spark, album):
    found = {os.path.relpath(r["path"], album): r for r in images.scan_images(spark, str(album), decoder).collect()}
    assert set(found) == {"a.png", "b.JPG", ".hid/_c.webp", "d.png", "G.Png", "empty.bmp"}
    assert {n for n, r in found.items() if r["error"]} == {"d.png", "empty.bmp"}
    assert "not whole rows" in found["d.png"]["error"] and found["d.png"]["image"] is None
    picture = found[".hid/_c.webp"]["image"]
    assert (picture["height"], picture["width"], bytes(picture["data"])) == (3, 4, bytes(range(36)))
    wrong = lambda: lambda data: {"height": 1, "width": 1, "nChannels": 3, "mode": 16, "data": data}
    assert images.scan_images(spark, str(album), wrong).where("error IS NULL").count() == 0


def heights(*bad):
    def model():
        def predict(batch):
            if batch["height"].isin(bad).any():
                raise RuntimeError("bad height")
            return [
                [{"x1": 0.0, "y1": 0.0, "x2": 2.0, "y2": 1.0, "det_score": 0.9, "class_id": 1, "confidence": 0.5,
                  "label": "NSFW", "score": h / 5}] * (h % 3)
                for h in batch["height"]
            ]

        return predict

    return model


def test_folders_account_for_every_file(spark, album):
    faces = folder_report.faces_in_folder(spark, str(album), decoder, heights(5))
    assert as_set(faces["rows"].groupBy("source_file").count(), "source_file", "count") == {("a.png", 1), ("b.JPG", 2)}
    assert {os.path.basename(r["path"]) for r in faces["rejects"].collect()} == {"d.png", "empty.bmp", "G.Png"}
    assert tuple(faces["summary"].first()) == (6, 3, 2, 3)
    objects = folder_report.objects_in_folder(spark, str(album), decoder, heights(), {1: "cat"})
    assert tuple(objects["summary"].first()) == (4, 2, 2, 3)
    assert [tuple(r) for r in objects["classes"].collect()] == [("cat", 3)]
    flags = folder_report.flags_in_folder(spark, str(album), decoder, heights(1), 0.7)
    digest = hashlib.sha256(bytes(range(48))).hexdigest()
    assert as_set(flags["rows"], "hash", "filename") == {(digest, "f.gif"), (hashlib.sha256(bytes(range(60))).hexdigest(), "G.Png")}
    assert tuple(flags["summary"].first()) == (7, 3, 2, 2)
    with pytest.raises(ValueError, match="threshold"):
        folder_report.flags_in_folder(spark, str(album), decoder, heights(), 2.0)


def test_rejects_of_frames_objects_and_embeddings(spark, pictures):
    images_df = tables.read_images(spark, str(pictures))
    frames = images_df.withColumn("frame_id", F.lit(4))
    rows, rejects = predict.detect_faces_in_frames_and_rejects(frames, heights(6), frame_skip=2)
    assert rows.count() == 0  # three rows of pixels, no face
    assert [(r["frame_id"], r["error"]) for r in rejects.collect()] == [(4, "RuntimeError: bad height")]
    found, lost = predict.detect_objects_and_rejects(images_df, heights(3), {1: "cat"})
    assert found.count() == 0 and [os.path.basename(r["path"]) for r in lost.collect()] == ["a b.png"]
    rows = [("s.jpg", 0, i, p) for i, p in enumerate([str(pictures / "a b.png"), str(pictures / "tall.png"), "/gone.png", None])]
    faces = spark.createDataFrame(rows, "source_file string, frame_id int, face_id int, cropped_face_path string")
    stored, missing = predict.embed_detections_and_rejects(faces, images_df, heights(3))
    assert stored.count() == 0
    assert as_set(missing.withColumn("name", F.regexp_extract("cropped_face_path", "[^/]*$", 0)), "name", "error") == {
        ("a b.png", "RuntimeError: bad height"), ("tall.png", "no face found"), ("gone.png", "no such crop"),
    }


def test_all_crops_of_an_image_are_cut_at_once(spark, pictures):
    def model():
        face = lambda x, score: {"x1": x, "y1": 0.0, "x2": x + 2, "y2": 2.0, "det_score": score}
        return lambda batch: [[face(0.0, 0.9), face(1.0, 0.1), face(1.0, 0.8)] for _ in range(len(batch))]

    crops = predict.crop_faces(tables.read_images(spark, str(pictures)), model, "/c").collect()
    assert sorted((os.path.basename(r["source_path"]), r["face_id"], r["image"]["width"]) for r in crops) == [
        ("a b.png", 0, 2), ("a b.png", 2, 2), ("tall.png", 0, 2), ("tall.png", 2, 1),
    ]
    assert all(len(r["image"]["data"]) == r["image"]["width"] * r["image"]["height"] * 3 for r in crops)


def test_files_are_dealt_by_bytes(spark):
    sizes = [10_000_000, 9_000_000, *[1_000_000] * 30, *[10] * 500, 0, None]
    rows = [(f"/f{i}", n) for i, n in enumerate(sizes)]
    files = spark.createDataFrame(rows, "path string, size_bytes bigint").repartition(5)
    dealt = file_tree.deal_by_bytes(files, 4_000_000)
    weight = F.sum(F.coalesce("size_bytes", F.lit(0)) + file_tree.FILE_COST)
    loads = [r["load"] for r in dealt.groupBy(F.spark_partition_id()).agg(weight.alias("load")).collect()]
    costs = [(n or 0) + file_tree.FILE_COST for n in sizes]
    assert sum(loads) == sum(costs) and dealt.count() == len(sizes)
    assert max(loads) <= sum(costs) / dealt.rdd.getNumPartitions() + max(costs)
    assert len(loads) > 20
    assert file_tree.deal_by_bytes(files.limit(0)).count() == 0


def test_results_are_replaced_together_or_not_at_all(spark, tmp_path, monkeypatch):
    store = tables.ClusterStore(spark, str(tmp_path / "store"))
    faces = spark.createDataFrame([(str(i), 0.5, [1.0, 0.0]) for i in range(4)], "id string, confidence double, embedding array<float>")
    blank = {f.name: F.lit(None).cast(f.dataType) for f in schemas.FACE_EMBEDDINGS if f.name not in faces.columns}
    store.add_embeddings(faces.withColumns(blank))
    label = lambda n: spark.createDataFrame([(str(i), i % n) for i in range(4)], "id string, cluster_id int")
    assert store.clusters().count() == store.summary().count() == 0
    store.replace_clusters(label(1))
    before = store.summary()
    with monkeypatch.context() as patch:
        patch.setattr(tables.cluster_tables, "cluster_summary", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.replace_clusters(label(4))
    assert store.summary().count() == 1 and store.clusters().select("cluster_id").distinct().count() == 1
    store.replace_clusters(label(2))
    assert store.summary().count() == 2 and store.clusters().select("cluster_id").distinct().count() == 2
    assert before.count() == 1  # a reader of the version before still has its tables
    for n in (3, 4):
        store.replace_clusters(label(n))
    assert store.summary().count() == 4 and len(store._versions()) == 2


def test_models_get_bounded_pieces(monkeypatch):
    """A model is given runs of images of bounded size, whatever the size of Spark's batches."""
    monkeypatch.setattr(predict, "MODEL_BYTES", 30)
    data = [b"x" * 10, None, b"x" * 20, b"x" * 99, b"x" * 15, b"x" * 15, b"x"]
    batch = pd.DataFrame({"data": data})
    assert [p.index.tolist() for p in predict._pieces(batch)] == [[0, 1, 2], [3], [4, 5], [6]]
    assert [len(p) for p in predict._pieces(batch.iloc[:0])] == [0]
