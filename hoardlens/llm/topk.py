"""Exact top-k inner products by block-at-a-time pruning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hoardlens.workspace import materialize

BLOCK = 512  # vectors of one document-range block
CHUNK = 16  # blocks that one task scores for a batch of queries
QUERIES = 256  # queries of one batch
SCALE = 256

_CHUNKS = "dim int, base bigint, ids binary, data binary"


def _valid(vector: str):
    """Vectors without null and non-finite components."""
    v = F.col(vector).cast("array<double>")
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & fine


def quantise(vector: str, scale: int = SCALE):
    """Integer vectors: the floor of ``scale`` times each component in double precision."""
    return F.transform(F.col(vector).cast("array<double>"), lambda x: F.floor(x * F.lit(scale)).cast("bigint"))


def _pack(batches):
    """Rows sorted by dimension and id, as chunks; a row's number is its chunk's base and its place."""
    from pyspark import TaskContext

    base = TaskContext.get().partitionId() << 36
    dim, ids, rows = None, [], []

    def chunk():
        nonlocal base
        made = (dim, base, np.array(ids, "<i8").tobytes(), np.array(rows, "<i8").tobytes())
        base += len(ids)
        ids.clear()
        rows.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([made[0]], pa.int32()), pa.array([made[1]], pa.int64()),
             pa.array([made[2]], pa.binary()), pa.array([made[3]], pa.binary())],
            ["dim", "base", "ids", "data"],
        )

    for batch in batches:
        vectors = batch.column(1).to_pylist()
        for vec_id, vector in zip(batch.column(0).to_pylist(), vectors):
            if ids and (len(vector) != dim or len(ids) >= BLOCK * CHUNK):
                yield chunk()
            dim = len(vector)
            ids.append(vec_id)
            rows.append(vector)
    if ids:
        yield chunk()


def _select_queries(every: int):
    """Query rows of each chunk, in batches."""

    def run(batches):
        for batch in batches:
            for dim, base, ids, data in zip(*[c.to_pylist() for c in batch.columns]):
                ids = np.frombuffer(ids, "<i8")
                data = np.frombuffer(data, "<i8").reshape(len(ids), dim)
                places = np.flatnonzero(ids % every == 0)
                for at in range(0, len(places), QUERIES):
                    part = places[at : at + QUERIES]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([dim], pa.int32()), pa.array([(base + part).astype("<i8").tobytes()], pa.binary()),
                         pa.array([ids[part].tobytes()], pa.binary()), pa.array([data[part].tobytes()], pa.binary())],
                        ["dim", "rows", "query_ids", "queries"],
                    )

    return run


def _merge(best, scores, ids, k):
    """The k best of two lists by score, then smaller id."""
    s = np.concatenate([best[0], scores])
    i = np.concatenate([best[1], ids])
    order = np.lexsort((i, -s))[:k]
    return s[order], i[order]


def search_chunk(queries, query_rows, data, ids, base, k):
    """Best k per query in one chunk: blocks in order of their bound, until it falls below the kth score."""
    big = max(np.abs(queries).max(initial=0), np.abs(data).max(initial=0))
    exact = float(big) ** 2 * max(data.shape[1], 1) < 2**53
    kind = np.float64 if exact else np.int64
    q, d = queries.astype(kind), data.astype(kind)
    starts = range(0, len(d), BLOCK)
    top = np.array([d[s : s + BLOCK].max(axis=0) for s in starts])
    low = np.array([d[s : s + BLOCK].min(axis=0) for s in starts])
    # Summed maxima of the terms: each component can add at most its sign's extreme.
    bounds = np.maximum(q, 0) @ top.T + np.minimum(q, 0) @ low.T
    for n, vector in enumerate(q):
        best = (np.array([], kind), np.array([], np.int64))
        for b in np.argsort(-bounds[n], kind="stable"):
            if len(best[0]) == k and bounds[n, b] < best[0][-1]:
                break
            at = b * BLOCK
            scores = d[at : at + BLOCK] @ vector
            names = ids[at : at + BLOCK]
            keep = np.arange(base + at, base + at + len(names)) != query_rows[n]
            if len(best[0]) == k:
                keep &= scores >= best[0][-1]
            if keep.any():
                best = _merge(best, scores[keep], names[keep], k)
        yield n, best[0].astype(np.int64), best[1]


def _score(k: int):
    names = ["row", "query_id", "vec_id", "score"]

    def run(batches):
        for batch in batches:
            for dim, base, ids, data, rows, query_ids, queries in zip(*[c.to_pylist() for c in batch.columns]):
                ids, rows, query_ids = (np.frombuffer(x, "<i8") for x in (ids, rows, query_ids))
                data = np.frombuffer(data, "<i8").reshape(len(ids), dim)
                queries = np.frombuffer(queries, "<i8").reshape(len(rows), dim)
                out = [[], [], [], []]
                for n, scores, found in search_chunk(queries, rows, data, ids, base, k):
                    for column, values in zip(
                        out, (np.full(len(found), rows[n]), np.full(len(found), query_ids[n]), found, scores)
                    ):
                        column.append(values)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out], names)

    return run


def top_k(
    vectors: DataFrame,
    k: int = 5,
    every: int = 50,
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best rows for each row whose id is divisible by ``every``.

    Exact. Vectors lie in blocks of consecutive ids with the extremes of each component; a task
    takes a batch of queries and a chunk of blocks, visits blocks in order of their bound and
    stops below the kth score. Each task returns k rows a query, which one window merges.

    Rows with a null id, a null vector, or null or non-finite components take no part; vectors
    are compared within their length only. Rows that share an id are rows of their own: a query
    leaves out only itself. Ties go to the smaller id. Empty tables give no rows. Vectors whose
    scores need not fit in 64 bits raise a ValueError.
    """
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("id"), F.col(vector).alias("v"))
    rows = rows.where(F.col("id").isNotNull() & _valid("v")).select(
        "id", quantise("v").alias("v"), F.size("v").alias("dim")
    )
    largest = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    bound = rows.agg(F.max(F.col("dim") * largest * largest)).first()[0]
    if bound is not None and bound >= 2.0**63:
        raise ValueError("scores of these vectors do not fit in 64 bits")
    ranged = rows.repartitionByRange("dim", "id").sortWithinPartitions("dim", "id", "v").select("id", "v")
    chunks = materialize(ranged.mapInArrow(_pack, _CHUNKS), "chunks")
    queries = chunks.mapInArrow(
        _select_queries(every), "dim int, rows binary, query_ids binary, queries binary"
    )
    numbered = materialize(queries.withColumn("batch", F.monotonically_increasing_id()), "queries")
    # Each batch meets each chunk of its dimension once; the pairs are spread over all tasks.
    bases = chunks.groupBy("dim").agg(F.collect_list("base").alias("bases"))
    pairs = numbered.join(bases, "dim").select(
        "dim", "rows", "query_ids", "queries", F.explode("bases").alias("base")
    )
    met = pairs.join(chunks.drop("dim"), "base").select(
        "dim", "base", "ids", "data", "rows", "query_ids", "queries"
    )
    found = met.mapInArrow(_score(k), "row bigint, query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


ORACLE = """
WITH ints AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
    FROM ints q JOIN ints c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
"""
