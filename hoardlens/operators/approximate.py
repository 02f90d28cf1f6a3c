"""Opt-in approximate neighbour join, with its recall measured against exact neighbours.

Random projections of unit vectors put near vectors into equal buckets of some table with high
probability; every pair that meets in a bucket is checked exactly. Pairs can be missed, never
wrongly found, and ``measured_recall`` tells the share that was found. The exact join
(``dbscan.neighbour_pairs``) stays the default.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoardlens.operators.blocks import BLOCK_ROWS, chunk_of, column, every_chunk, slices, spread_blocks, unit, values, vectors
from hoardlens.operators.dbscan import ROUNDING, has_direction
from hoardlens.operators.skew import join_keyed
from hoardlens.workspace import materialize

TABLES = 12
BUCKETS = 2.0  # width of a bucket in radii
TILE_BYTES = 16 << 20  # vectors per side of a tile, which a task holds
NEAR = 1e-9  # products this near to the limit are settled by the distance itself
SAMPLE = 1000  # vectors whose neighbours are found exactly to measure the recall; bounds a broadcast


def fold_copies(df: DataFrame, id_col: str = "id", vec_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """``id, vec`` of each distinct vector under its least id, and ``id, representative`` of all rows.

    Vectors without a length have no neighbours and are left out.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).where(has_direction("vec"))
    points = materialize(rows.groupBy("vec").agg(F.min("id").alias("id")).select("id", "vec"), "points")
    members = rows.join(points.withColumnRenamed("id", "representative"), "vec").select("id", "representative")
    return points, members


def approx_neighbours(
    points: DataFrame, eps: float, tables: int = TABLES, buckets: float = BUCKETS, seed: int = 7
) -> DataFrame:
    """``a, b, distance`` with a < b: pairs of distinct vectors (``id, vec``) within cosine distance ``eps``.

    On unit vectors a cosine distance of ``eps`` is a straight distance of ``sqrt(2 eps)``. More
    tables find more pairs; wider buckets find more and compare more. Vectors must be finite and
    of one length.
    """
    if not 0.0 < eps < 1.0:
        raise ValueError("eps must lie between 0 and 1")
    radius = float(np.sqrt(2.0 * eps))
    numbers = F.col("vec").cast("array<double>")
    length = F.sqrt(F.aggregate(numbers, F.lit(0.0), lambda total, x: total + x * x))
    rows = points.select("id", array_to_vector(F.transform(numbers, lambda x: x / length)).alias("unit"))
    rows = materialize(rows, "units")
    if rows.isEmpty():
        kind = points.schema["id"].dataType.simpleString()
        return points.sparkSession.createDataFrame([], f"a {kind}, b {kind}, distance double")
    lsh = BucketedRandomProjectionLSH(
        inputCol="unit", outputCol="buckets", bucketLength=buckets * radius, numHashTables=tables, seed=seed
    )
    model = lsh.fit(rows)
    numbers = [vector_to_array(F.col("buckets")[t])[0].cast("bigint") for t in range(tables)]
    hashed = model.transform(rows).select("id", vector_to_array("unit").alias("unit"), F.array(*numbers).alias("buckets"))
    return _meeting(materialize(hashed, "hashed"), eps, tables)


def _meeting(hashed: DataFrame, eps: float, tables: int) -> DataFrame:
    """``a, b, distance`` of the pairs that share a bucket of some table, each once.

    Members of a bucket meet tile by tile in matrix products, so no row stands for a pair that is
    not near. A pair counts in the first table in which it shares a bucket. Where the buckets are
    so wide that they hold more pairs than the whole table, all vectors meet once instead, and
    the buckets are compared last.
    """
    per_table = F.posexplode("buckets").alias("table", "bucket")
    n, kind = hashed.count(), hashed.schema["id"].dataType.simpleString()
    # Small buckets of a table share groups, so that a task is not called for a few rows.
    large, slots = F.col("n") > BLOCK_ROWS, -(-n // BLOCK_ROWS)
    slot = F.when(large, F.col("bucket")).otherwise(F.pmod(F.xxhash64("bucket"), F.lit(slots)))
    sizes = hashed.select(per_table).groupBy("table", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = materialize(sizes.withColumn("large", large).withColumn("slot", slot), "buckets")
    group = ["table", "large", "slot"]
    sums = sizes.groupBy(*group).agg(F.sum("n").alias("members"))
    held, most = sums.agg(F.sum(F.col("members").cast("double") ** 2), F.max("members")).first()
    if held is None:
        return hashed.sparkSession.createDataFrame([], f"a {kind}, b {kind}, distance double")
    together = held > float(n) ** 2
    dim, cores = len(hashed.first()["unit"]), hashed.sparkSession.sparkContext.defaultParallelism
    # As few tiles as keep the cores busy, since each vector is sent to all tiles of its row.
    widest = n if together else most
    fits = max(TILE_BYTES // (8 * (dim + tables)), BLOCK_ROWS)
    rows = int(min(max(widest / (2 * cores) ** 0.5, BLOCK_ROWS), fits))
    if together:
        alike = [F.lit(-1).alias("table"), F.lit(True).alias("large"), F.lit(0).cast("bigint").alias("slot")]
        members = hashed.select(*alike, "*", F.lit(n).alias("members"))
    else:
        key = F.xxhash64("table", "bucket").alias("key")
        known = sizes.join(sums, group).select(key, "large", "slot", "members", "n")
        members = hashed.select(per_table, "*").withColumn("key", key).withColumn("salt", F.xxhash64("id"))
        members = join_keyed(members, known, "key", "n", "salt").where("members IS NOT NULL")
    blocks = F.ceil(F.col("members") / rows).cast("int")
    block = chunk_of(F.col("id"), blocks, 3)
    sent = members.withColumn("block", block).select(*group, "id", "unit", "buckets", "block", every_chunk(blocks).alias("other"))
    sent = sent.select(
        *group, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "unit", "buckets",
        (F.col("block") <= F.col("other")).alias("left"), (F.col("block") >= F.col("other")).alias("right"),
    )
    per_side, times = -(-widest // rows), 1 if together else tables
    volume = n * times * per_side * 8 * (dim + tables)
    spread = spread_blocks(sent, [*group, "i", "j"], int(times * max(per_side**2, slots)), int(volume))
    found = spread.groupBy(*group, "i", "j").applyInArrow(_near_pairs(eps, dim, tables), f"a {kind}, b {kind}, distance double")
    return found.where("a < b")


def _near_pairs(eps: float, dim: int, tables: int):
    """Near pairs of the left and the right rows of a tile."""

    def run(table: pa.Table) -> pa.Table:
        ids, units = column(table, "id"), vectors(table, "unit", dim)
        buckets = column(table, "buckets").flatten().to_numpy(zero_copy_only=False).reshape(-1, tables)
        left, right = (np.flatnonzero(values(table, side).astype(bool)) for side in ("left", "right"))
        same_block = values(table, "i")[0] == values(table, "j")[0]
        at_table = int(values(table, "table")[0])
        out = []
        for start in range(0, len(left), BLOCK_ROWS):
            x = left[start : start + BLOCK_ROWS]
            for begin in range(0, len(right), BLOCK_ROWS):
                if same_block and begin < start:
                    continue
                y = right[begin : begin + BLOCK_ROWS]
                near = units[x] @ units[y].T >= 1.0 - eps - NEAR
                if same_block and begin == start:
                    near = np.triu(near, 1)
                a, b = np.nonzero(near)
                a, b = x[a], y[b]
                equal = buckets[a] == buckets[b]
                met = equal.any(axis=1) if at_table < 0 else equal[:, at_table] & ~equal[:, :at_table].any(axis=1)
                a, b = a[met], b[met]
                distance = ((units[a] - units[b]) ** 2).sum(axis=1) / 2
                within = distance <= eps + ROUNDING
                out.append((a[within], b[within], distance[within]))
        a, b, distance = (np.concatenate(c) for c in zip(*out))
        one, two = ids.take(pa.array(a)), ids.take(pa.array(b))
        swap = pc.greater(one, two)
        return pa.table(
            {"a": pc.if_else(swap, two, one), "b": pc.if_else(swap, one, two), "distance": pa.array(distance, pa.float64())}
        )

    return run


def exact_for_sample(points: DataFrame, eps: float, sample: int = SAMPLE) -> DataFrame:
    """``a, b`` with a <> b: all neighbours b of a repeatable sample of vectors a, in one pass."""
    chosen = points.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    spark, kind = points.sparkSession, points.schema["id"].dataType.simpleString()
    if not chosen:
        return spark.createDataFrame([], f"a {kind}, b {kind}")
    asked = spark.sparkContext.broadcast(([r["id"] for r in chosen], unit(np.array([r["vec"] for r in chosen], float))))
    dim = len(chosen[0]["vec"])

    def compare(batches):
        ids, queries = asked.value
        for table in slices(batches):
            near = unit(vectors(table, "vec", dim)) @ queries.T >= 1.0 - eps - ROUNDING
            at, which = np.nonzero(near)
            b = column(table, "id").take(pa.array(at))
            a = pa.array([ids[w] for w in which.tolist()], b.type)
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"])

    found = points.select("id", "vec").mapInArrow(compare, f"a {kind}, b {kind}")
    return found.where(F.col("a") != F.col("b"))


def measured_recall(points: DataFrame, pairs: DataFrame, eps: float, sample: int = SAMPLE) -> DataFrame:
    """``exact_pairs, found_pairs, recall``: share of a sample's neighbours that ``pairs`` holds.

    The sample is bounded, so this costs one pass over the vectors. Without neighbours the
    recall is 1.
    """
    exact = exact_for_sample(points, eps, sample)
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    marked = exact.join(both.distinct().withColumn("found", F.lit(1)), ["a", "b"], "left")
    return marked.agg(
        F.count(F.lit(1)).alias("exact_pairs"),
        F.count("found").alias("found_pairs"),
        F.coalesce(F.try_divide(F.count("found"), F.count(F.lit(1))), F.lit(1.0)).alias("recall"),
    )
