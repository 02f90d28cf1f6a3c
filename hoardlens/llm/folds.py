"""Held-out rows and bounded, repeatable samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the ids that no model may learn from; a null id is learned from by none."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(True))


def sample_per_class(rows: DataFrame, label: str, key: Column, most: int) -> DataFrame:
    """About ``most`` rows of each value of ``label``, chosen by a hash of ``key``.

    Values with fewer rows keep all. Only the counts per value reach the driver.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for value, count in counts.items():
        share = F.when(F.col(label) == F.lit(value), min(1.0, most / count)).otherwise(share)
    place = F.pmod(F.xxhash64(key, F.lit(7)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    return rows.where(place < share)
