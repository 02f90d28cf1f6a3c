"""Arrow passes over rows, bounded row filters and small value helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIEVE_BITS = 1 << 26  # 8 MB, whatever the data
_BUCKET_BITS = 32_768  # bits of one bitmap of bitmap_construct_agg


def append_columns(
    df: DataFrame, inputs: list[str], make: Callable, fields: str, lead: list[Column] | None = None
) -> DataFrame:
    """Append columns computed batch by batch in Python.

    ``make`` is called once per task and returns a function from a list of Arrow arrays (the
    ``inputs``, in order) to the list of new arrays. Rows travel under positional names, so
    columns of any name pass through untouched. ``lead`` replaces the columns handed on.
    """
    new = T._parse_datatype_string(fields)
    names = df.columns
    places = [names.index(name) for name in inputs]
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    schema = T.StructType(
        [T.StructField(f"c{i}", f.dataType, True) for i, f in enumerate(df.schema)]
        + [T.StructField(f"n{i}", f.dataType, True) for i, f in enumerate(new)]
    )
    labels = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            step = step or make()
            columns = batch.columns
            yield pa.RecordBatch.from_arrays(columns + step([columns[i] for i in places]), labels)

    return plain.mapInArrow(run, schema).toDF(*names, *[f.name for f in new])


def blobs(array: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a text column."""
    if pa.types.is_large_string(array.type):
        return array.cast(pa.large_binary()).to_pylist()
    if pa.types.is_string(array.type):
        return array.cast(pa.binary()).to_pylist()
    return array.to_pylist()


def text_slices(data: list[bytes | None], most: int) -> Iterator[list[str]]:
    """Texts in runs of about ``most`` bytes; one of that size or more is a run of its own."""
    run, size = [], 0
    for blob in data:
        own = len(blob or b"")
        if run and size + own > most:
            yield run
            run, size = [], 0
        run.append((blob or b"").decode("utf-8", "replace"))
        size += own
    if run:
        yield run


def hash_slot(key: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots).cast("bigint"))


class Sieve:
    """A set of hashes (64 bits) as a bitmap of fixed size: may let others pass, never drops one.

    The bitmap is built by Spark in buckets of 4 KB; the driver only joins its 2,048 buckets,
    so neither its size nor the broadcast grows with the data. A full sieve lets all rows
    pass, which costs time and changes no result.
    """

    def __init__(self, keys: DataFrame, column: str, bits: int = SIEVE_BITS):
        slot = F.pmod(F.col(column), F.lit(bits).cast("bigint"))
        rows = (
            keys.select((slot + 1).alias("slot"))
            .groupBy(F.bitmap_bucket_number("slot").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bitmap"))
            .collect()
        )
        table = np.zeros(bits // 8, dtype=np.uint8)
        for bucket, bitmap in rows:
            at = (bucket - 1) * (_BUCKET_BITS // 8)
            table[at : at + len(bitmap)] = np.frombuffer(bytes(bitmap), dtype=np.uint8)
        self.bits = bits
        self.table = keys.sparkSession.sparkContext.broadcast(table)

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        slots = hashes.astype(np.int64) & (self.bits - 1)
        return (self.table.value[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1
