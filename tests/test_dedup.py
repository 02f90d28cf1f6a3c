import random

import pytest
from pyspark.sql import functions as F

from hoardlens.operators import dedup
from hoardlens.operators.numbering import number_rows
from hoardlens.operators.skew import join_keyed, list_parts
from hoardlens.plans import manifest_report

SCHEMA = "path string, hash string, size_bytes bigint, source_filename string"
EDGE = [
    ("/a/x.JPG", "h1", 10, "a b.csv"),
    ("/a/x.JPG", "h1", 10, "second.csv"),
    ('/a/q,"z".tar.gz', "h1", 12, "a b.csv"),
    ("/b/none", None, 5, "a b.csv"),
    ("/b/none2", None, 6, "a b.csv"),
    ("/b/empty", "", 7, "a b.csv"),
    ("/b/trail.", "h2", 7, "a b.csv"),
    ("/c\\w\\win.tXt", "h3", 8, "a b.csv"),
    ("/b/.bashrc", "h5", 1, "a b.csv"),
    (None, "h9", 1, "a b.csv"),
    ("/big1", "h10", 2**63 - 1, "a b.csv"),
    ("/big2", "h10", 2**63 - 1, "a b.csv"),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


def test_basic_summary_counts_unreadable_files_as_one(edge):
    row = manifest_report.basic_summary(edge).first()
    assert (row["total_files"], row["unique_files"], row["duplicate_files"]) == (12, 8, 4)
    assert row["total_size"] == sum(r[2] for r in EDGE)
    assert row["deduplicated_size"] == 10 + 5 + 7 + 7 + 8 + 1 + 1 + 2**63 - 1


def test_basic_groups_keep_the_null_group(edge):
    rows = manifest_report.basic_top_groups(edge).collect()
    assert [(r["hash"], r["duplicate_count"], r["total_wasted_space"]) for r in rows] == [
        ("h10", 2, 2**64 - 2), ("h1", 3, 32), (None, 2, 11),
    ]
    assert rows[2]["hash_label"] is None


def test_per_hash_skips_unhashed_rows_and_takes_least_size(edge):
    rows = {r["hash"]: r for r in dedup.per_hash(edge).collect()}
    assert set(rows) == {"h1", "h2", "h3", "h5", "h9", "h10"}
    h1 = rows["h1"]
    assert (h1["size_bytes"], h1["total_occurrences"], h1["unique_paths"]) == (10, 3, 2)
    assert (h1["unique_filenames"], h1["manifest_count"]) == (2, 2)
    assert rows["h9"]["unique_paths"] == 0
    top = dedup.with_example_path(dedup.top_waste(dedup.per_hash(edge)), edge)
    assert {(r["hash"], r["example_path"]) for r in top.collect()} == {
        ("h1", "/a/q,\"z\".tar.gz"), ("h10", "/big1"),
    }


def test_waste_beyond_64_bits(spark):
    rows = [(f"/f{i}", "h", 2**63 - 1, "m.csv") for i in range(3)]
    by_hash = dedup.per_hash(spark.createDataFrame(rows, SCHEMA))
    assert dedup.top_waste(by_hash).first()["space_wasted"] == 2 * (2**63 - 1)
    assert dedup.savings_stats(by_hash).first()["space_that_could_be_saved"] == 2 * (2**63 - 1)


def test_unhashed_paths_count_in_path_sizes_only(edge):
    top = {r["path"]: r["total_size_bytes"] for r in dedup.path_sizes(edge).collect()}
    assert top["/b/none"] == 5 and top["/a/x.JPG"] == 20
    assert dedup.overall_stats(edge).first()["total_file_entries"] == 9


def test_empty_input(spark):
    empty = spark.createDataFrame([], SCHEMA)
    row = manifest_report.basic_summary(empty).first()
    assert (row["total_files"], row["unique_files"], row["savings_percentage"]) == (0, 0, 0.0)
    assert manifest_report.overall(empty).first()["savings_percentage"] == 0.0
    assert dedup.top_file_types(empty).count() == 0


def test_file_types_equal_the_join_form(spark):
    rng = random.Random(4)
    rows = [
        (f"/p{rng.randrange(40)}.{rng.choice('abc')}", f"h{rng.randrange(30)}",
         rng.choice([None, rng.randrange(100)]), f"m{rng.randrange(3)}")
        for _ in range(500)
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    raw = dedup.with_file_name(df).withColumn(
        "e", F.upper(F.regexp_extract("filename_only", r"\.([^.]+)$", 1))
    )
    stats = raw.groupBy("e").agg(
        F.count("*").alias("n"), F.count_distinct("hash").alias("u"),
        F.sum("size_bytes").alias("t"), F.avg("size_bytes").alias("a"),
        F.min("size_bytes").alias("lo"), F.max("size_bytes").alias("hi"),
    )
    least = raw.groupBy("e", "hash").agg(F.min("size_bytes").alias("s"))
    joined = stats.join(least.groupBy("e").agg(F.sum("s").alias("d")), "e")
    expected = {
        r["e"]: (r["n"], r["u"], r["t"], r["d"], round(r["a"], 9), r["lo"], r["hi"])
        for r in joined.collect()
    }
    got = {
        r[0]: (r[1], r[2], int(r[3]), int(r[4]), round(r[5], 9), r[6], r[7])
        for r in dedup.file_types(df).collect()
    }
    assert got == expected


def test_order_of_manifests_does_not_matter(spark, edge):
    shuffled = spark.createDataFrame(random.Random(2).sample(EDGE, len(EDGE)), SCHEMA)
    key = lambda df: sorted(map(str, dedup.per_hash(df).collect()))
    assert key(edge) == key(shuffled)


def test_full_report_has_every_part(edge):
    report = manifest_report.full_report(edge)
    sizes = {name: df.count() for name, df in report.items()}
    assert sizes == {
        "overall_stats": 1, "top_paths_by_size": 10, "top_duplicates": 2,
        "top_duplicate_paths": 2, "cross_manifest_files": 1, "cross_manifest_sources": 1,
        "file_type_distribution": 6,
    }


def test_long_lists_are_split_but_whole(spark):
    rows = [("hot", f"/p{i:05d}") for i in range(5000)] + [("cold", "/x"), ("cold", "/y"), ("none", None)]
    df = spark.createDataFrame(rows + rows[:100], "hash string, path string")
    parts = list_parts(df, "hash", "path", "paths", part_items=100).collect()
    hot = [p for p in parts if p["hash"] == "hot"]
    assert len(hot) == 50 and max(len(p["paths"]) for p in hot) < 200
    assert sorted(x for p in hot for x in p["paths"]) == [f"/p{i:05d}" for i in range(5000)]
    assert [p["paths"] for p in parts if p["hash"] == "cold"] == [["/x", "/y"]]
    assert not [p for p in parts if p["hash"] == "none"]


def test_join_keyed_serves_heavy_and_light_keys(spark, monkeypatch):
    monkeypatch.setattr("hoardlens.operators.skew.HEAVY_KEYS", 2)
    rows = spark.range(1000).select(
        F.when(F.col("id") < 600, 0).otherwise(F.col("id") % 7).alias("k"), "id"
    )
    keyed = rows.where("k <> 3").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m"))
    got = {(r["id"], r["k"], r["m"]) for r in join_keyed(rows, keyed, "k", "n", "id").collect()}
    expected = {(r["id"], r["k"], r["m"]) for r in rows.join(keyed, "k", "left").collect()}
    assert got == expected and len(got) == 1000


@pytest.mark.parametrize("one_task", [100_000, 10])
def test_numbers_follow_the_global_order(spark, monkeypatch, one_task):
    monkeypatch.setattr("hoardlens.operators.numbering.ONE_TASK_ROWS", one_task)
    df = spark.range(500).select(F.format_string("%03d", F.pmod(F.col("id") * 77, 500)).alias("k"))
    got = [r["n"] for r in number_rows(df, "k", "n").orderBy("k").collect()]
    assert got == list(range(500))
    assert number_rows(df.where("false"), "k", "n").count() == 0
