import random
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from hoardlens.functions import boxes, paths, sizes, vectors

PATHS = [
    "/a/x.JPG", '/a/q,"z".tar.gz', "/b/none", "/b/trail.", "/c\\w\\win.tXt", " /sp/lead.x ",
    "/b/.bashrc", "/a/", "/n\nl.txt", "/b/a..b", "/b/..png", "x",
]


def column(spark, values, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    rows = df.select("i", expr(F.col("v")).alias("out")).orderBy("i").collect()
    return [r["out"] for r in rows]


def python_size(size):
    if size == 0:
        return "0 B"
    value, unit = float(size), 0
    while value >= 1024 and unit < 4:
        value, unit = value / 1024, unit + 1
    return f"{value:.2f} {sizes.UNITS[unit]}"


def test_format_bytes_rounds_like_python(spark):
    rng = random.Random(1)
    values = [0, 1, 1023, 1024, 1152, 1408, 2**20 - 1, 2**40 + 2**37, 2**63 - 1]
    values += [rng.randrange(2 ** rng.randrange(1, 53)) for _ in range(3000)]
    assert column(spark, values, "bigint", sizes.format_bytes) == [python_size(v) for v in values]


def test_format_bytes_beyond_64_bits_and_null(spark):
    wide = lambda c: sizes.format_bytes(c.cast("decimal(38,0)") * 4)
    assert column(spark, [2**62, None], "bigint", wide) == ["16777216.00 TB", None]


def test_suffix_and_stem_follow_pathlib(spark):
    names = [p for p in PATHS if not p.endswith("/")]
    assert column(spark, names, "string", paths.suffix) == [
        "" if p.endswith(".") else PurePosixPath(p).suffix for p in names
    ]
    stems = column(spark, names, "string", paths.stem)
    assert stems[0] == "x" and stems[1] == 'q,"z".tar' and stems[6] == ".bashrc"


def test_extension_classes(spark):
    ext = lambda c: paths.extension_class(paths.file_name(c))
    got = column(spark, PATHS + [None], "string", ext)
    assert got == [
        "JPG", "GZ", "NO_EXTENSION", "", "TXT", "X ", "BASHRC", "NO_EXTENSION", "TXT", "B",
        "PNG", "NO_EXTENSION", "NO_EXTENSION",
    ]
    assert column(spark, ["", "GZ"], "string", paths.extension_label) == ["NO_EXT", "GZ"]


def test_short_texts(spark):
    assert column(spark, ["a" * 64, None], "string", paths.short_hash) == ["a" * 16 + "...", None]
    long = "x" * 20 + "y" * 47
    assert column(spark, [long, "p" * 50], "string", paths.short_path) == [
        "..." + "y" * 47,
        "p" * 50,
    ]


def test_percent_guards_zero_and_null(spark):
    df = spark.createDataFrame([(1, 4), (1, 0), (1, None)], "a bigint, b bigint")
    got = [r[0] for r in df.select(sizes.percent(F.col("a"), F.col("b"))).collect()]
    assert got == [25.0, 0.0, 0.0]


def test_box_edges(spark):
    df = spark.createDataFrame([(-1.9, 0.0, 50.7, 20.2)], "x1 double, y1 double, x2 double, y2 double")
    whole = [boxes.whole_pixels(F.col(c)) for c in df.columns]
    crop = boxes.padded_crop(*whole, F.lit(52), F.lit(30))
    row = df.select(*[c.alias(n) for n, c in crop.items()]).first()
    assert tuple(row) == (0, 0, 52, 22)
    size = boxes.model_input_size(F.lit(50), F.lit(25))
    assert tuple(df.select(*size.values()).first()) == (224, 112)
    mask = boxes.mask_area(F.array(F.lit(0), F.lit(1), F.lit(1)))
    assert df.select(mask).first()[0] == 2.0
    none = boxes.mask_metrics(F.lit(None).cast("double"), F.lit(5), F.lit(5))
    assert tuple(df.select(*none.values()).first()) == (False, None, None)


def test_cosine_of_a_vector_without_length(spark):
    x, zero = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))
    row = spark.range(1).select(
        vectors.cosine_similarity(x, zero), vectors.cosine_distance(x, zero),
        vectors.cosine_distance(x, x),
    ).first()
    assert tuple(row) == (None, 1.0, 0.0)


@pytest.mark.parametrize("uuid, expected", [("u-1", "u-1.csv"), ("", "sdb2_manifest.csv")])
def test_device_names(spark, uuid, expected):
    row = spark.range(1).select(
        paths.manifest_name(F.lit(uuid), F.lit("sdb/sdb2")),
        paths.scan_root(F.lit(""), F.lit("sdb/sdb2")),
        paths.scan_root(F.lit("/mnt/x"), F.lit("sdb/sdb2")),
    ).first()
    assert tuple(row) == (expected, "/dev/sdb2", "/mnt/x")


def test_row_key_repeats_and_separates(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), ("ab", "c"), (None, "c")], "x string, y string")
    keys = [r[0] for r in df.select(paths.row_key(F.col("x"), F.col("y"))).collect()]
    assert keys[0] == keys[2] and len(set(keys)) == 3
