"""Arrow and NumPy helpers for tasks that compare one block of vectors with another."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 2048  # vectors per side of a block, 32 MB for the products of two blocks
TASK_BYTES = 128 * 1024 * 1024
LEAST_BLOCK = 2048  # rows of a block of a small table; fewer are not worth a task


def column(table: pa.Table, name: str) -> pa.Array:
    data = table.column(name).combine_chunks()
    if isinstance(data, pa.ChunkedArray):
        data = pa.concat_arrays(data.chunks) if data.num_chunks else pa.array([], data.type)
    return data


def values(table: pa.Table, name: str) -> np.ndarray:
    return column(table, name).to_numpy(zero_copy_only=False)


def vectors(table: pa.Table, name: str, dim: int) -> np.ndarray:
    flat = column(table, name).flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(-1, dim)


def slices(batches):
    """Arrow batches as tables of at most BLOCK_ROWS rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK_ROWS):
            yield pa.Table.from_batches([batch.slice(start, BLOCK_ROWS)])


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def chords(cosines: np.ndarray) -> np.ndarray:
    """Straight-line distance between unit vectors from the cosine of their angle."""
    return np.sqrt(np.maximum(2.0 - 2.0 * cosines, 0.0))


def chunk_of(key: Column, chunks: Column, seed: int) -> Column:
    """Even, repeatable spread of rows over ``chunks`` chunks."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), chunks).cast("int")


def chunk_count(rows: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(rows / BLOCK_ROWS)).cast("int")


def every_chunk(chunks: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), chunks - 1))


def spread_blocks(df: DataFrame, keys: list[str], blocks: int, data_bytes: int) -> DataFrame:
    """Shuffle block pairs so that small inputs still use all cores and large ones fit."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = max(min(blocks, 4 * cores), -(-data_bytes // TASK_BYTES), 1)
    return df.repartition(int(tasks), *keys)
