"""Mean silhouette (Rousseeuw 1987), exact, for Euclidean and for cosine distance.

For every point this needs the mean distance to its own label and to the closest other label.
Points lie in blocks by label; the rest of the data streams past them in the order of labels,
so a task holds one figure per point and label after label is settled. No table of points and
labels is made.

Cosine distances add up linearly: the sum over a label follows from the sum of its unit
vectors, so only one vector a label passes. Euclidean distances do not. By convexity the mean
distance to a label is at least the distance d to its centroid and at most sqrt(d**2 +
variance); only labels whose lower bound reaches the best upper bound of some point of a block
send their members there, and only to such points are they compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoardlens.operators import blocks
from hoardlens.operators.blocks import column, slices, values, vectors
from hoardlens.operators.cells import BLOCK_BYTES
from hoardlens.operators.skew import join_keyed
from hoardlens.workspace import materialize

TILE_ROWS = 128  # points compared with a piece of members at once: their products stay in the cache
SLACK = 1e-6  # rounding allowance of the bounds, on the safe side
METRICS = ("euclidean", "cosine")


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    squares = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2.0 * (x @ y.T)
    return np.sqrt(np.maximum(squares, 0.0))


def _left(rows: np.ndarray) -> np.ndarray:
    """Rows whose products with those of ``_right`` are squared distances."""
    return np.column_stack([-2.0 * rows, (rows * rows).sum(1), np.ones(len(rows))])


def _right(rows: np.ndarray) -> np.ndarray:
    return np.column_stack([rows, np.ones(len(rows)), (rows * rows).sum(1)])


def _units(rows: np.ndarray) -> np.ndarray:
    """Unit vectors; a vector without a length stays zero, at distance 1 from all others."""
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length > 0, length, 1.0)


def _label_centres(points: DataFrame, dim: int, cosine: bool) -> DataFrame:
    """``label, n, centre, spread``: mean vector (of units for cosine) and mean squared distance to it."""

    def partial(batches):
        for table in slices(batches):
            labels, codes = np.unique(values(table, "label"), return_inverse=True)
            rows = vectors(table, "vec", dim)
            rows = _units(rows) if cosine else rows
            sums = np.zeros((len(labels), dim + 1))
            np.add.at(sums, codes, np.column_stack([rows, (rows * rows).sum(1)]))
            count = np.bincount(codes, minlength=len(labels)).astype(np.int64)
            yield pa.record_batch(
                {"label": pa.array(labels), "n": pa.array(count), "sums": pa.array(list(sums))}
            )

    parts = points.select("label", "vec").mapInArrow(
        partial, "label int, n bigint, sums array<double>"
    )
    per_place = (
        parts.select("label", "n", F.posexplode("sums").alias("place", "part"))
        .groupBy("label", "place")
        .agg(F.sum("n").alias("n"), F.sum("part").alias("total"))
    )
    whole = per_place.groupBy("label").agg(
        F.first("n").alias("n"),
        F.array_sort(F.collect_list(F.struct("place", "total"))).alias("sums"),
    )
    means = F.transform("sums", lambda s: s["total"] / F.col("n"))
    centre = F.slice(means, 1, dim)
    square = F.aggregate(centre, F.lit(0.0), lambda total, c: total + c * c)
    spread = F.greatest(F.lit(0.0), F.element_at(means, dim + 1) - square)
    return whole.select("label", "n", centre.alias("centre"), spread.alias("spread"))


def _in_blocks(points: DataFrame, n: int, dim: int) -> tuple[DataFrame, int]:
    """Points with the ``block`` they lie in, sorted by label over blocks of bounded size."""
    cores = points.sparkSession.sparkContext.defaultParallelism
    count = max(-(-n * dim * 8 // BLOCK_BYTES), min(2 * cores, -(-n // blocks.LEAST_BLOCK)))
    ranged = points.repartitionByRange(count, "label", "id")
    return materialize(ranged.withColumn("block", F.spark_partition_id()), "silhouette"), count


# What reaches a block, in this order.
POINT, CENTRE, AGAIN, HEAD, MEMBER = range(5)
_COLUMNS = ["target", "phase", "label", "id", "block", "vec", "n", "centre", "spread"]


def _stream(parts: list[DataFrame], count: int, kind: str, vec_kind: str, task, schema: str) -> DataFrame:
    """Rows of all parts, block by block; within one by label from the heads of labels on."""
    missing = {"id": kind, "block": "int", "vec": vec_kind, "n": "bigint", "centre": "array<double>", "spread": "double"}

    def whole(rows: DataFrame) -> DataFrame:
        return rows.select(
            *[F.col(c) if c in rows.columns else F.lit(None).cast(missing[c]).alias(c) for c in _COLUMNS]
        )

    rows = whole(parts[0])
    for part in parts[1:]:
        rows = rows.unionByName(whole(part))
    late = F.when(F.col("phase") >= HEAD, F.col("label"))
    ordered = rows.repartitionById(count, F.col("target")).sortWithinPartitions(
        "target", F.least("phase", F.lit(HEAD)), late, "phase", "id"
    )
    return ordered.mapInArrow(task, schema)


def _runs(batches) -> Iterator[tuple[int, int, pa.Table]]:
    """``target, phase, rows``: points of a block together, others in bounded pieces of one phase and label."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        target, phase, label = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        keys = np.stack([target, phase, np.where(phase >= HEAD, label, 0)], axis=1)
        edges = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1
        for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(keys)]):
            if held and key != tuple(keys[start]):
                yield key[0], key[1], pa.Table.from_batches(held)
                held = []
            key = tuple(keys[start])
            while start < end:
                room = blocks.BLOCK_ROWS - sum(len(b) for b in held)
                stop = end if key[1] == POINT else min(end, start + room)
                held.append(batch.slice(start, stop - start))
                if key[1] != POINT and stop - start == room:
                    yield key[0], key[1], pa.Table.from_batches(held)
                    held = []
                start = stop
    if held:
        yield key[0], key[1], pa.Table.from_batches(held)


class _Points:
    """Points of a block, and what is known of each so far."""

    def __init__(self, table: pa.Table, dim: int, cosine: bool):
        self.ids, self.label = column(table, "id"), values(table, "label")
        rows = vectors(table, "vec", dim)
        self.rows = _units(rows) if cosine else rows
        n = len(self.label)
        self.size = np.zeros(n, np.int64)  # of the own label
        self.bound = np.full(n, np.inf)  # no other label is farther than this
        self.own, self.other = np.zeros(n), np.full(n, np.inf)

    def tiles(self) -> Iterator[slice]:
        for start in range(0, len(self.label), blocks.BLOCK_ROWS):
            yield slice(start, min(start + blocks.BLOCK_ROWS, len(self.label)))

    def scores(self) -> pa.RecordBatch:
        most = np.maximum(self.own, self.other)
        score = np.where((self.size > 1) & (most > 0), (self.other - self.own) / np.where(most > 0, most, 1.0), 0.0)
        return pa.RecordBatch.from_arrays([self.ids, pa.array(score)], ["id", "score"])


def _cosine_scores(dim: int):
    """Mean cosine distance to a label is 1 less the product with the mean of its unit vectors."""

    def settle(points: _Points, table: pa.Table):
        label, n = values(table, "label"), values(table, "n")
        centres = vectors(table, "centre", dim)
        for tile in points.tiles():
            rows = points.rows[tile]
            means = 1.0 - rows @ centres.T
            at, which = np.nonzero(points.label[tile][:, None] == label)
            size = n[which].astype(np.int64)
            points.size[tile.start + at] = size
            # A vector without a length is at distance 0 from itself, not at 1.
            itself = 1.0 - (rows[at] * rows[at]).sum(1)
            total = means[at, which] * size - itself
            points.own[tile.start + at] = np.maximum(total / np.maximum(size - 1, 1), 0.0)
            means[at, which] = np.inf
            points.other[tile] = np.minimum(points.other[tile], means.min(axis=1))

    def run(batches):
        points = None
        for _, phase, table in _runs(batches):
            if phase == POINT:
                if points is not None:
                    yield points.scores()
                points = _Points(table, dim, True)
            elif points is not None:
                settle(points, table)
        if points is not None:
            yield points.scores()

    return run


def _narrow(points: _Points, table: pa.Table, dim: int) -> None:
    """Lower each point's bound by the centres in ``table``."""
    label, n = values(table, "label"), values(table, "n")
    centres, spread = vectors(table, "centre", dim), values(table, "spread")
    for tile in points.tiles():
        high = np.sqrt(_distances(points.rows[tile], centres) ** 2 + spread)
        at, which = np.nonzero(points.label[tile][:, None] == label)
        points.size[tile.start + at] = n[which].astype(np.int64)
        high[at, which] = np.inf
        points.bound[tile] = np.minimum(points.bound[tile], high.min(axis=1))


def _wanted_labels(dim: int):
    """Labels of which some point of a block has to know the mean distance."""

    def run(batches):
        points = None
        for target, phase, table in _runs(batches):
            if phase == POINT:
                points = _Points(table, dim, False)
            elif points is None:
                continue
            elif phase == CENTRE:
                _narrow(points, table, dim)
            else:
                label = values(table, "label")
                centres, wanted = vectors(table, "centre", dim), np.zeros(len(label), bool)
                for tile in points.tiles():
                    low = _distances(points.rows[tile], centres)
                    wanted |= (low <= points.bound[tile][:, None] + SLACK).any(axis=0)
                wanted |= np.isin(label, points.label)
                names = pa.array(label[wanted].astype(np.int32))
                yield pa.RecordBatch.from_arrays([names, pa.array(np.full(len(names), target, np.int32))], ["label", "target"])

    return run


def _euclidean_scores(dim: int):
    def run(batches):
        points = wanted = None
        label, total, count = 0, None, 0
        room = np.empty(TILE_ROWS * blocks.BLOCK_ROWS)  # for the distances of a tile

        def settle():
            if wanted is None or not count:
                return
            own = points.label == label
            points.own[own] = total[own] / max(count - 1, 1)
            mean = total / count
            better = wanted & ~own & (mean < points.other)
            points.other[better] = mean[better]

        for target, phase, table in _runs(batches):
            if phase == POINT:
                if points is not None:
                    settle()
                    yield points.scores()
                points, wanted = _Points(table, dim, False), None
            elif points is None:
                continue
            elif phase == CENTRE:
                _narrow(points, table, dim)
            elif phase == HEAD:
                settle()
                label, centre = values(table, "label")[0], vectors(table, "centre", dim)
                wanted = points.label == label
                for tile in points.tiles():
                    wanted[tile] |= _distances(points.rows[tile], centre)[:, 0] <= points.bound[tile] + SLACK
                total, count = np.zeros(len(wanted)), int(values(table, "n")[0])
            else:
                members, picked = _right(vectors(table, "vec", dim)).T, np.flatnonzero(wanted)
                x = y = picked[:0]
                if (values(table, "block") == target).any():
                    mine = points.ids.take(pa.array(picked)).to_numpy(zero_copy_only=False)
                    _, x, y = np.intersect1d(mine, values(table, "id"), return_indices=True)
                for start in range(0, len(picked), TILE_ROWS):
                    at = picked[start : start + TILE_ROWS]
                    gaps = room[: len(at) * members.shape[1]].reshape(len(at), -1)
                    np.matmul(_left(points.rows[at]), members, out=gaps)
                    np.sqrt(np.maximum(gaps, 0.0, out=gaps), out=gaps)
                    here = (x >= start) & (x < start + TILE_ROWS)
                    gaps[x[here] - start, y[here]] = 0.0
                    total[at] += gaps.sum(axis=1)
        if points is not None:
            settle()
            yield points.scores()

    return run


def silhouette_values(
    df: DataFrame,
    id_col: str = "id",
    vec_col: str = "embedding",
    label_col: str = "cluster_id",
    include_noise: bool = True,
    metric: str = "euclidean",
) -> DataFrame | None:
    """``id, score`` of every point, None where the figure is not defined (fewer than 2 labels, or n).

    See ``silhouette``.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {', '.join(METRICS)}")
    cosine = metric == "cosine"
    rows = df.select(
        F.col(id_col).alias("id"),
        F.col(vec_col).alias("vec"),
        F.coalesce(F.col(label_col).cast("int"), F.lit(-1)).alias("label"),
        F.col(label_col).isNull().alias("noise"),
    )
    if not include_noise:
        rows = rows.where(~F.col("noise"))
    rows = materialize(rows.drop("noise"), "labelled")
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    facts = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("label").alias("k"),
        F.min(F.size("vec")).alias("least_dim"),
        F.max(F.size("vec")).alias("dim"),
        F.coalesce(F.max(F.col("vec").isNull() | bad), F.lit(False)).alias("bad"),
    ).first()
    if facts["bad"] or facts["least_dim"] != facts["dim"]:
        raise ValueError("embeddings must be given, finite and of one length")
    n, k, dim = facts["n"], facts["k"], facts["dim"]
    if not 2 <= k <= n - 1:
        return None

    placed, count = _in_blocks(rows, n, dim)
    kind, vec_kind = (placed.schema[c].dataType.simpleString() for c in ("id", "vec"))
    centres = materialize(_label_centres(placed, dim, cosine), "centres")
    points = placed.withColumn("target", F.col("block")).withColumn("phase", F.lit(POINT))
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    passing = centres.withColumn("target", everywhere).withColumn("phase", F.lit(CENTRE))
    scored = f"id {kind}, score double"
    if cosine:
        return _stream([points, passing], count, kind, vec_kind, _cosine_scores(dim), scored)

    again = passing.withColumn("phase", F.lit(AGAIN))
    wanted = _stream(
        [points, passing, again], count, kind, vec_kind, _wanted_labels(dim), "label int, target int"
    )
    wanted = materialize(wanted, "wanted")
    heads = wanted.join(centres, "label").withColumn("phase", F.lit(HEAD))
    guests = wanted.groupBy("label").agg(F.collect_list("target").alias("targets"))
    guests = guests.join(centres.select("label", "n"), "label")
    members = (
        join_keyed(placed, guests, "label", "n", "id")
        .withColumn("target", F.explode("targets"))
        .withColumn("phase", F.lit(MEMBER))
        .drop("targets")
    )
    return _stream(
        [points, passing, heads, members], count, kind, vec_kind, _euclidean_scores(dim), scored
    )


def silhouette(
    df: DataFrame,
    id_col: str = "id",
    vec_col: str = "embedding",
    label_col: str = "cluster_id",
    include_noise: bool = True,
    metric: str = "euclidean",
) -> DataFrame:
    """One row ``silhouette``: the mean over all points, NULL when it is not defined.

    Vectors must be given, finite and of one length. It is defined for 2 to n - 1 labels. A NULL
    label is noise: one label of its own, or left out with ``include_noise=False``. With the
    metric ``cosine`` a vector without a length is at distance 1 from all others.
    """
    found = silhouette_values(df, id_col, vec_col, label_col, include_noise, metric)
    if found is None:
        return df.sparkSession.range(1).select(F.lit(None).cast("double").alias("silhouette"))
    return found.agg(F.avg("score").alias("silhouette"))
