import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from hoardlens.operators import approximate, blocks, cluster_tables, similarity
from hoardlens.operators.cells import lay_out, principal_axes
from hoardlens.operators.components import connected_components
from hoardlens.operators.dbscan import Metric, count_neighbours, dbscan, neighbour_pairs
from hoardlens.operators.silhouette import silhouette


def frame(spark, ids, rows):
    data = [(int(i), None if r is None else [float(v) for v in r]) for i, r in zip(ids, rows)]
    return spark.createDataFrame(data, "id bigint, embedding array<double>")


def sequential(ids, rows, eps, min_samples):
    """Labels and neighbour counts by the definition, in id order."""
    order = np.argsort(ids)
    ids, rows = np.asarray(ids)[order], np.asarray(rows, float)[order]
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    units = rows / np.where(length > 0, length, 1)
    distance = 1 - units @ units.T
    np.fill_diagonal(distance, 0)
    near = distance <= eps + 1e-12
    core = near.sum(1) >= min_samples
    label = np.full(len(ids), -1)
    number = 0
    for start in range(len(ids)):
        if label[start] != -1 or not core[start]:
            continue
        label[start], open_points = number, [start]
        while open_points:
            for other in np.flatnonzero(near[open_points.pop()]):
                if label[other] == -1:
                    label[other] = number
                    if core[other]:
                        open_points.append(other)
        number += 1
    return dict(zip(ids.tolist(), label.tolist())), dict(zip(ids.tolist(), near.sum(1).tolist()))


def labels(df):
    return {r["id"]: -1 if r["is_noise"] else r["cluster_id"] for r in df.collect()}


def mixed(rng):
    """Scattered points, a crowd of near copies, exact copies and vectors without a length."""
    return np.concatenate(
        [
            rng.normal(size=(150, 3)),
            rng.normal(size=(1, 3)) + rng.normal(size=(200, 3)) * 1e-4,
            np.repeat(rng.normal(size=(1, 3)), 80, 0),
            np.zeros((4, 3)),
        ]
    )


@pytest.mark.parametrize("eps, min_samples, cell_rows", [
    (0.01, 4, 30), (0.0, 2, 30), (0.05, 1, 40), (0.003, 300, 30), (1.2, 3, 50), (0.01, 4, 8192),
])
def test_dbscan_equals_sequential_form(spark, eps, min_samples, cell_rows):
    rng = np.random.default_rng(7)
    rows = mixed(rng)
    ids = rng.permutation(len(rows))
    expected, _ = sequential(ids, rows, eps, min_samples)
    assert labels(dbscan(frame(spark, ids, rows), eps, min_samples, cell_rows=cell_rows)) == expected


@pytest.mark.parametrize("eps, min_samples", [(0.01, 4), (0.02, 10)])
def test_dbscan_blobs_across_cells_and_blocks(spark, monkeypatch, eps, min_samples):
    for module in ("blocks",):
        monkeypatch.setattr(f"hoardlens.operators.{module}.BLOCK_ROWS", 16)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 4))
    rows = np.concatenate([c + rng.normal(size=(rng.integers(1, 40), 4)) * 0.15 for c in centres])
    ids = rng.permutation(len(rows))
    expected, _ = sequential(ids, rows, eps, min_samples)
    assert labels(dbscan(frame(spark, ids, rows), eps, min_samples, cell_rows=20)) == expected


def test_dbscan_ignores_row_order_and_handles_small_inputs(spark):
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(60, 2))
    df = frame(spark, range(60), rows)
    assert labels(dbscan(df, 0.001, 3)) == labels(dbscan(df.orderBy(F.desc("id")), 0.001, 3))
    assert dbscan(df.where("false")).count() == 0
    one = frame(spark, [9], [[1, 0]])
    assert labels(dbscan(one)) == {9: -1}
    assert labels(dbscan(one, min_samples=1)) == {9: 0}
    nothing = frame(spark, [1, 2], [None, [0, 0]])
    assert labels(dbscan(nothing)) == {1: -1, 2: -1}
    assert labels(dbscan(nothing, min_samples=1)) == {1: 0, 2: 1}


def test_dbscan_border_point_takes_the_lowest_cluster(spark):
    angle = np.radians([0, 1, 2, 12, 22, 23, 24])
    rows = np.column_stack([np.cos(angle), np.sin(angle)])
    eps = 1 - np.cos(np.radians(10.5))
    ids = [10, 11, 12, 1, 2, 3, 4]
    expected, _ = sequential(ids, rows, eps, 4)
    got = labels(dbscan(frame(spark, ids, rows), eps, 4))
    assert got == expected and got[1] == 0


def test_dbscan_rejects_bad_input(spark):
    with pytest.raises(ValueError):
        dbscan(frame(spark, [1, 2], [[1, 2], [1, 2, 3]]))
    with pytest.raises(ValueError):
        dbscan(frame(spark, [1, 2], [[1, 2], [1, float("nan")]]))
    with pytest.raises(ValueError):
        dbscan(frame(spark, [1], [[1, 2]]), eps=-1)


def test_neighbour_counts(spark):
    rng = np.random.default_rng(11)
    rows = mixed(rng)
    ids = rng.permutation(len(rows))
    _, expected = sequential(ids, rows, 0.02, 1)
    got = count_neighbours(frame(spark, ids, rows), 0.02, cell_rows=50).collect()
    assert {r["id"]: r["near"] for r in got} == expected


def close_pairs(ids, rows, eps):
    """Pairs of distinct vectors under their least ids, by the definition."""
    least = {}
    for i, r in sorted(zip(ids.tolist(), map(tuple, rows))):
        if any(r):
            least.setdefault(r, i)
    found = set()
    for x, i in least.items():
        for y, j in least.items():
            gap = 1 - np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)
            if i < j and gap <= eps + 1e-12:
                found.add((i, j))
    return found, {i: least[tuple(r)] for i, r in zip(ids.tolist(), rows) if any(r)}


@pytest.mark.parametrize("eps, cell_rows, least_block", [(0.02, 30, 16), (0.5, 8192, 256)])
def test_neighbour_pairs(spark, monkeypatch, eps, cell_rows, least_block):
    monkeypatch.setattr(blocks, "LEAST_BLOCK", least_block)
    rng = np.random.default_rng(8)
    rows = np.concatenate([mixed(rng)[100:220], np.repeat(rng.normal(size=(2, 3)), 5, 0), np.zeros((2, 3))])
    ids = rng.permutation(len(rows))
    pairs, members = neighbour_pairs(frame(spark, ids, rows), eps, cell_rows=cell_rows)
    expected, copies = close_pairs(ids, rows, eps)
    found = [tuple(r) for r in pairs.collect()]
    assert len(found) == len(set(found)) and set(found) == expected
    assert {tuple(r) for r in members.collect()} == set(copies.items())
    assert neighbour_pairs(frame(spark, [1], [[0, 0, 0]]), eps)[0].count() == 0


def test_approximate_neighbours_and_their_recall(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(30, 16))
    rows = np.concatenate([c + rng.normal(size=(8, 16)) * 0.2 for c in centres] + [np.repeat(centres[:1], 4, 0), np.zeros((1, 16))])
    ids = rng.permutation(len(rows))
    points, members = approximate.fold_copies(frame(spark, ids, rows))
    assert points.count() == 241 and members.count() == 244
    expected, _ = close_pairs(ids, rows, 0.1)
    pairs = approximate.approx_neighbours(points, 0.1)
    found = {(r["a"], r["b"]) for r in pairs.collect()}
    assert found <= expected and len(found) >= 0.9 * len(expected) > 100
    recall = approximate.measured_recall(points, pairs, 0.1).first()
    assert (recall["exact_pairs"], recall["found_pairs"]) == (2 * len(expected), 2 * len(found))
    assert approximate.measured_recall(points, pairs, 0.1, sample=20).first()["recall"] >= 0.8
    none = points.limit(0)
    assert approximate.approx_neighbours(none, 0.1).count() == 0
    assert approximate.measured_recall(none, pairs, 0.1).first()["recall"] == 1.0
    with pytest.raises(ValueError, match="eps"):
        approximate.approx_neighbours(points, 1.0)


def test_leading_coordinates_settle_pairs_exactly():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 40)) * np.concatenate([np.ones(6), np.full(34, 0.05)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    axes, lead = principal_axes(x, 0.9)
    assert 1 <= lead <= 20 and np.allclose(axes.T @ axes, np.eye(40))
    for limit in (0.9, 0.999, 0.2):
        metric = Metric(40, 1.0, limit, axes, lead, 64)
        assert np.array_equal(metric.near(x @ axes, x @ axes), x @ x.T >= limit)
    assert principal_axes(rng.normal(size=(200, 8)), 0.5)[1] == 8


def test_every_pair_of_blocks_meets_once():
    rows = np.array([5, 900, 30, 40, 2_000, 1])
    touching = np.ones((6, 6), bool)
    touching[0, 5] = touching[5, 0] = False
    layout = lay_out(rows, np.arange(6), touching, 400)
    assert layout.blocks == 1 + 3 + 1 + 5 + 1 and layout.parts.tolist() == [1, 3, 1, 1, 5, 1]
    assert layout.first.tolist() == [0, 1, 4, 4, 5, 10] and layout.ranges[0] == [[0, 10]] and layout.ranges[1] == [[0, 11]]


def test_components_of_chains_stars_and_random_edges(spark):
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(999, i) for i in range(200, 300)]
    edges += [tuple(map(int, e)) for e in rng.integers(0, 90, size=(50, 2))]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = connected_components(spark.createDataFrame(edges, "a bigint, b bigint"))
    found = {r["node"]: r["root"] for r in got.collect()}
    assert {x: found.get(x, x) for x in parent} == {x: find(x) for x in parent}


def brute_silhouette(rows, label, metric="euclidean"):
    if metric == "cosine":
        length = np.linalg.norm(rows, axis=1, keepdims=True)
        units = rows / np.where(length > 0, length, 1)
        gaps = 1 - units @ units.T
        np.fill_diagonal(gaps, 0)
    else:
        squares = (rows**2).sum(1)[:, None] + (rows**2).sum(1) - 2 * rows @ rows.T
        gaps = np.sqrt(np.maximum(squares, 0))
        np.fill_diagonal(gaps, 0)
    scores = []
    for i, own in enumerate(label):
        same = label == own
        if same.sum() == 1:
            scores.append(0.0)
            continue
        a = gaps[i][same].sum() / (same.sum() - 1)
        b = min(gaps[i][label == other].mean() for other in set(label.tolist()) - {own})
        scores.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return np.mean(scores)


def labelled(spark, rows, label):
    data = [
        (i, [float(v) for v in r], None if k == 3 else int(k))
        for i, (r, k) in enumerate(zip(rows, label))
    ]
    return spark.createDataFrame(data, "id bigint, embedding array<double>, cluster_id int")


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
@pytest.mark.parametrize("n, least_block", [(300, 20), (2_500, 4_096)])
def test_silhouette_matches_brute_force(spark, monkeypatch, metric, n, least_block):
    monkeypatch.setattr(blocks, "LEAST_BLOCK", least_block)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(25, 3)) * 5
    label = rng.integers(0, 25, n)
    rows = centres[label] + rng.normal(size=(n, 3)) * 0.5
    label[0], rows[5], rows[9], rows[10] = 77, rows[6], 0, 0
    df = labelled(spark, rows, label)
    noise = np.where(label == 3, -1, label)
    whole = silhouette(df, metric=metric).first()[0]
    assert whole == pytest.approx(brute_silhouette(rows, noise, metric), abs=1e-9)
    kept = label != 3
    assert silhouette(df, include_noise=False, metric=metric).first()[0] == pytest.approx(
        brute_silhouette(rows[kept], label[kept], metric), abs=1e-9
    )


def test_silhouette_of_many_labels_and_odd_input(spark):
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(200, 4))
    label = np.arange(200) // 2  # pairs, and one hot label
    label[:80] = 500
    for metric in ("euclidean", "cosine"):
        found = silhouette(labelled(spark, rows, label), metric=metric).first()[0]
        assert found == pytest.approx(brute_silhouette(rows, label, metric), abs=1e-9)
    df = labelled(spark, rows, label)
    assert silhouette(df.where("cluster_id = 500")).first()[0] is None
    assert silhouette(df.where("false"), metric="cosine").first()[0] is None
    with pytest.raises(ValueError, match="metric"):
        silhouette(df, metric="manhattan")


def test_faulty_vectors_and_ids_are_refused(spark):
    for vec in (None, [1.0, float("nan")], [1.0]):
        df = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 1), (3, vec, 1)], "id bigint, embedding array<double>, cluster_id int")
        with pytest.raises(ValueError, match="one length"):
            silhouette(df)
    with pytest.raises(ValueError, match="unique"):
        dbscan(frame(spark, [1, 1], [[1, 0], [0, 1]]))


def test_similar_orders_ties_by_id_and_puts_undefined_last(spark):
    df = frame(spark, [5, 3, 4, 1], [[1, 0], [2, 0], [0, 0], [0, 1]])
    got = similarity.similar(df, [1.0, 0.0], 4).orderBy("rank").collect()
    assert [r["id"] for r in got] == [3, 5, 1, 4] and got[3]["similarity"] is None
    assert similarity.similar(df, None).count() == 0


@pytest.mark.parametrize("block, chunk", [(2048, 32768), (3, 7)])
def test_batch_search_with_one_and_with_many_chunks(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", block)
    monkeypatch.setattr(similarity, "CHUNK_ROWS", chunk)
    rng = np.random.default_rng(0)
    rows = np.concatenate([rng.normal(size=(50, 4)), np.zeros((1, 4))])
    rows[7] = rows[8]
    df = frame(spark, range(51), rows)
    named = df.where("id < 10").withColumn("id", F.concat(F.lit("q"), F.col("id").cast("string")))
    got = similarity.similar_batch(df, named, 3).collect()
    unit = rows[:50] / np.linalg.norm(rows[:50], axis=1, keepdims=True)
    for q in range(10):
        score = np.round(unit @ unit[q], 12)
        best = np.lexsort((np.arange(50), -score))[:3].tolist()
        mine = sorted((r["rank"], r["id"]) for r in got if r["query_id"] == f"q{q}")
        assert [i for _, i in mine] == best


def test_cluster_tables(spark):
    labels_df = spark.createDataFrame([(1, 0), (2, 0), (3, None), (4, 1)], "id bigint, cluster_id int")
    faces = spark.createDataFrame(
        [(1, 0.5, "/c/1"), (2, 0.5, "/c/2"), (3, 0.9, "/c/3"), (4, None, "/c/4")],
        "id bigint, confidence double, cropped_face_path string",
    ).withColumn("source_file", F.lit("s"))
    summary = cluster_tables.cluster_summary(labels_df, faces)
    assert {tuple(r) for r in summary.collect()} == {(0, 2, 0.5, 1), (1, 1, None, 4)}
    assert tuple(cluster_tables.totals(labels_df).first()) == (4, 2, 1)
    top = cluster_tables.largest_clusters(summary, faces, 1).collect()
    assert [tuple(r) for r in top] == [(0, 2, 0.5, "/c/1")]
    folder = labels_df.select("id", cluster_tables.cluster_folder(F.col("cluster_id")).alias("f"))
    assert {r["f"] for r in folder.collect()} == {"cluster_000", "cluster_001", "noise"}


@pytest.mark.parametrize(("eps", "buckets"), [(0.6, 2.0), (0.05, 0.4)])
def test_approximate_neighbours_are_the_pairs_that_share_a_bucket_and_are_compared_as_matrices(spark, monkeypatch, eps, buckets):
    monkeypatch.setattr(approximate, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 8))
    rows = np.concatenate([c + rng.normal(size=(4, 8)) * 0.25 for c in centres])
    points, _ = approximate.fold_copies(frame(spark, rng.permutation(len(rows)), rows))
    pairs = approximate.approx_neighbours(points, eps, tables=5, buckets=buckets)
    plan = pairs._jdf.queryExecution().toString()
    assert "FlatMapGroupsInArrow" in plan and "UDF(struct(id" not in plan

    radius = float(np.sqrt(2.0 * eps))
    units = points.withColumn("unit", array_to_vector("vec")).collect()
    units = spark.createDataFrame([(r["id"], Vectors.dense(r["unit"].toArray() / np.linalg.norm(r["unit"]))) for r in units], ["id", "unit"])
    lsh = BucketedRandomProjectionLSH(inputCol="unit", outputCol="h", bucketLength=buckets * radius, numHashTables=5, seed=7)
    joined = lsh.fit(units).approxSimilarityJoin(units, units, radius * (1 + 1e-9), "chord")
    expected = {(r[0], r[1]) for r in joined.selectExpr("datasetA.id", "datasetB.id").collect() if r[0] < r[1]}
    found = [(r["a"], r["b"]) for r in pairs.collect()]
    assert len(found) == len(set(found)) and set(found) == expected and len(found) > 20


def test_tiles_of_a_search_keep_only_what_reaches_the_floor():
    rng = np.random.default_rng(8)
    queries, rows = rng.normal(size=(30, 8)), np.repeat(rng.normal(size=(150, 8)), 2, axis=0)
    ids, types, floor = rng.permutation(300), (pa.int64(), pa.int64()), np.full(30, -np.inf)
    ask = lambda at, size, floor: similarity._close(
        np.arange(30), queries, ids[at : at + size], rows[at : at + size], 5, types, floor
    )
    tiles = [ask(at, 100, floor) for at in (0, 100, 200)]
    assert tiles[0].num_rows == 150 and sum(t.num_rows for t in tiles) < 450
    best = pa.concat_tables(tiles).to_pandas().sort_values(["query_id", "similarity", "id"], ascending=[True, False, True])
    plain = similarity._scored(np.arange(30), queries, ids, rows, 5, types).to_pandas()
    assert best.groupby("query_id").head(5).reset_index(drop=True).equals(plain)


def test_silhouette_compares_small_tiles_in_one_product(spark, monkeypatch):
    """Squared distances come from one product a tile, small enough to stay in the cache."""
    from hoardlens.operators import silhouette as module

    x, y = np.random.default_rng(3).normal(size=(2, 40, 5))
    squares = ((x[:, None] - y[None]) ** 2).sum(2)
    assert module._left(x) @ module._right(y).T == pytest.approx(squares, abs=1e-12)
    monkeypatch.setattr(module, "TILE_ROWS", 7)
    rows, label = np.concatenate([x, y, y[:3]]), np.arange(83) % 4
    whole = silhouette(labelled(spark, rows, label)).first()[0]
    assert whole == pytest.approx(brute_silhouette(rows, label), abs=1e-9)


def test_visiting_blocks_come_in_pieces(spark, monkeypatch):
    """A task holds its own block whole, and of a visiting one a bounded number of rows."""
    from hoardlens.operators import dbscan as module

    monkeypatch.setattr(module, "VISIT_ROWS", 10)
    rows = np.random.default_rng(4).normal(size=(70, 3))
    table = pa.table({
        "target": pa.array([0] * 70, pa.int32()), "visiting": [False] * 20 + [True] * 50,
        "block": pa.array([0] * 20 + [1] * 23 + [2] * 27, pa.int32()), "tile": [0] * 70,
        "id": list(range(70)), "vec": list(rows),
    })
    metric = Metric(3, 0.5, 0.9, None, 3, 8)
    found = list(module._blocks(table.to_batches(max_chunksize=9), metric))
    assert [(v, len(b.units)) for v, b in found] == [(False, 20)] + [(True, n) for n in (10, 10, 3, 10, 10, 7)]
    assert all("vec" not in b.table.column_names for _, b in found)
    assert np.concatenate([b.units for _, b in found]) == pytest.approx(module.unit(rows))

    monkeypatch.setattr(blocks, "LEAST_BLOCK", 8)
    ids, points = np.arange(120), np.random.default_rng(5).normal(size=(120, 4))
    got = {r["id"]: r["cluster_id"] for r in dbscan(frame(spark, ids, points), 0.1, 3, cell_rows=4).collect()}
    monkeypatch.setattr(module, "VISIT_ROWS", 1 << 13)
    assert got == {r["id"]: r["cluster_id"] for r in dbscan(frame(spark, ids, points), 0.1, 3, cell_rows=4).collect()}
