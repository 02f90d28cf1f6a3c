"""Vectors most similar to given ones."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hoardlens.functions.vectors import cosine_similarity, literal_vector
from hoardlens.operators.blocks import (
    BLOCK_ROWS,
    chunk_of,
    column,
    every_chunk,
    spread_blocks,
    values,
    vectors,
)

CHUNK_ROWS = 32_768  # rows shuffled to a chunk of queries at once, compared in tiles of BLOCK_ROWS
NEAR = 1e-11  # products this near to the kth best may round to it
DIGITS = 12  # similarities that agree to this many digits are ties, ordered by id


def similar(
    df: DataFrame,
    query: Sequence[float] | None,
    top_k: int = 5,
    id_col: str = "id",
    vec_col: str = "embedding",
) -> DataFrame:
    """The ``top_k`` rows most similar to one vector, best first.

    A query without a vector finds nothing. Rows whose vector has no length come last.
    """
    similarity = F.lit(None).cast("double")
    if query is not None:
        similarity = cosine_similarity(F.col(vec_col), literal_vector(query))
    found = df.withColumn("similarity", F.round(similarity, DIGITS)).drop(vec_col)
    order = [F.col("similarity").desc_nulls_last(), F.col(id_col).asc()]
    if query is None:
        found = found.where(F.lit(False))
    top = found.orderBy(*order).limit(top_k)
    # Only the top_k rows reach this window.
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def _best(ids: np.ndarray, scores: np.ndarray, top_k: int) -> np.ndarray:
    """Positions of the best scores, ties by id."""
    at = np.arange(len(scores))
    if len(scores) > top_k:
        at = np.flatnonzero(scores >= np.partition(scores, -top_k)[-top_k])
    return at[np.lexsort((ids[at], -scores[at]))][:top_k]


def _scored(query_ids, queries, ids, rows, top_k, id_types) -> pa.Table:
    """Best rows of one block for each query."""
    lengths = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(rows, axis=1)[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        scores = np.where(lengths > 0, queries @ rows.T / lengths, -np.inf).round(DIGITS)
    picks = [_best(ids, row, top_k) for row in scores]
    at = np.concatenate(picks) if picks else np.zeros(0, dtype=np.int64)
    which = np.repeat(np.arange(len(picks)), [len(p) for p in picks])
    score = scores[which, at]
    return pa.table(
        {
            "query_id": pa.array(query_ids[which], id_types[0]),
            "id": pa.array(ids[at], id_types[1]),
            "similarity": pa.array(score, mask=~np.isfinite(score)),
        }
    )


def _close(query_ids, queries, ids, rows, top_k, id_types, floor) -> pa.Table:
    """``_scored`` without the rows below ``floor``, the kth best of earlier tiles per query, which it raises.

    Only what comes near the floor is rounded and ordered. A tile with vectors without a length
    goes the plain way.
    """
    own, other = np.linalg.norm(queries, axis=1), np.linalg.norm(rows, axis=1)
    if not (np.isfinite(own).all() and np.isfinite(other).all() and (own > 0).all() and (other > 0).all()):
        return _scored(query_ids, queries, ids, rows, top_k, id_types)
    scores = (queries / own[:, None]) @ (rows / other[:, None]).T
    if len(ids) > top_k and np.isinf(floor).any():
        np.maximum(floor, np.partition(scores, -top_k, axis=1)[:, -top_k], out=floor)
    which, at = np.nonzero(scores >= (floor - NEAR)[:, None])
    score = scores[which, at].round(DIGITS)
    order = np.lexsort((ids[at], -score, which))
    which, at, score = which[order], at[order], score[order]
    begins = np.searchsorted(which, np.arange(len(queries)))
    place = np.arange(len(which)) - begins[which]
    full = which[place == top_k - 1]
    np.maximum.at(floor, full, score[place == top_k - 1])
    kept = place < top_k
    return pa.table(
        {
            "query_id": pa.array(query_ids[which[kept]], id_types[0]),
            "id": pa.array(ids[at[kept]], id_types[1]),
            "similarity": pa.array(score[kept]),
        }
    )


def similar_batch(
    df: DataFrame,
    queries: DataFrame,
    top_k: int = 5,
    id_col: str = "id",
    vec_col: str = "embedding",
) -> DataFrame:
    """``query_id, id, similarity, rank``: the same search for a table of queries.

    Chunks of queries meet chunks of rows, whatever their numbers; each side keeps its own type
    of id. A task returns the best rows of a chunk per query.
    """
    asked = queries.select(F.col(id_col).alias("query_id"), F.col(vec_col).alias("vec"))
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    asked, rows = asked.where(F.col("vec").isNotNull()), rows.where(F.col("vec").isNotNull())
    kinds = [asked.schema["query_id"].dataType, rows.schema["id"].dataType]
    schema = f"query_id {kinds[0].simpleString()}, id {kinds[1].simpleString()}, similarity double"
    first, n, q = rows.first(), rows.count(), asked.count()
    if first is None or q == 0:
        found = rows.sparkSession.createDataFrame([], schema)
    else:
        found = _blockwise(rows, asked, kinds, top_k, len(first["vec"]), n, q, schema)
    order = [F.col("similarity").desc_nulls_last(), F.col("id").asc()]
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return found.withColumn("rank", place).where(F.col("rank") <= top_k)


def _blockwise(
    rows: DataFrame, asked: DataFrame, kinds: list, top_k: int, dim: int, n: int, q: int, schema: str
) -> DataFrame:
    row_chunks = F.lit(max(1, -(-n // CHUNK_ROWS)))
    query_chunks = F.lit(max(1, -(-q // BLOCK_ROWS)))
    left = asked.select(
        chunk_of(F.col("query_id"), query_chunks, 1).alias("qc"),
        every_chunk(row_chunks).alias("rc"),
        "query_id", F.lit(None).cast(kinds[1]).alias("id"), "vec", F.lit(True).alias("asked"),
    )
    right = rows.select(
        every_chunk(query_chunks).alias("qc"),
        chunk_of(F.col("id"), row_chunks, 2).alias("rc"),
        F.lit(None).cast(kinds[0]).alias("query_id"), "id", "vec", F.lit(False).alias("asked"),
    )

    def score(table: pa.Table) -> pa.Table:
        is_query = values(table, "asked").astype(bool)
        both = vectors(table, "vec", dim)
        types = (column(table, "query_id").type, column(table, "id").type)
        query_ids, ids = values(table, "query_id")[is_query], values(table, "id")[~is_query]
        data = both[~is_query]
        # Tiles bound the matrix of products; the best of all tiles leave the task.
        floor = np.full(int(is_query.sum()), -np.inf)
        tiles = [
            _close(query_ids, both[is_query], ids[at : at + BLOCK_ROWS], data[at : at + BLOCK_ROWS], top_k, types, floor)
            for at in range(0, len(ids), BLOCK_ROWS)
        ]
        if not tiles:
            return _scored(query_ids, both[is_query], ids, data, top_k, types)
        whole = pa.concat_tables(tiles)
        if len(tiles) == 1:
            return whole
        ordered = whole.to_pandas().sort_values(
            ["query_id", "similarity", "id"], ascending=[True, False, True], na_position="last"
        )
        return pa.Table.from_pandas(ordered.groupby("query_id", sort=False).head(top_k), whole.schema, preserve_index=False)

    volume = (n * -(-q // BLOCK_ROWS) + q * -(-n // CHUNK_ROWS)) * dim * 8
    blocks = -(-n // CHUNK_ROWS) * -(-q // BLOCK_ROWS)
    spread = spread_blocks(left.unionByName(right), ["qc", "rc"], blocks, volume)
    return spread.groupBy("qc", "rc").applyInArrow(score, schema)
