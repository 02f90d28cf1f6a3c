"""Joins and lists that stay spread out when one key owns a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAVY_KEYS = 1000  # a key outside the 1000 largest owns less than 1/1000 of the rows
SALTS = 1000


def join_keyed(
    rows: DataFrame, keyed: DataFrame, key: str, weight: str, spread: str
) -> DataFrame:
    """Left join many ``rows`` per key to one ``keyed`` row per key.

    ``weight`` tells how many rows a key owns. The 1000 heaviest keys are broadcast, which
    bounds both the broadcast and the share of every other key. Rows served that way take part
    in the following shuffle under a salt (from the column ``spread``) that matches nothing.
    """
    values = [c for c in keyed.columns if c not in (key, weight)]
    heavy = (
        keyed.orderBy(F.col(weight).desc(), F.col(key))
        .limit(HEAVY_KEYS)
        .select(key, F.struct(*values).alias("_heavy"))
    )
    light = keyed.select(key, F.lit(0).alias("_salt"), F.struct(*values).alias("_light"))
    salt = 1 + F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")
    joined = (
        rows.join(F.broadcast(heavy), key, "left")
        .withColumn("_salt", F.when(F.col("_heavy").isNull(), 0).otherwise(salt))
        .join(light, [key, "_salt"], "left")
        .withColumn("_found", F.coalesce("_heavy", "_light"))
    )
    return joined.select(*rows.columns, *[F.col("_found")[v].alias(v) for v in values])


def list_parts(
    df: DataFrame, key: str, item: str, name: str, part_items: int = 1000
) -> DataFrame:
    """Distinct items of every key as sorted arrays of bounded size.

    A key with up to ``part_items`` items gets one array. A larger one is split by a hash of
    the item into ``parts`` arrays of about that size, so that no task and no row ever holds
    the whole list.
    """
    distinct = df.select(key, item).where(F.col(item).isNotNull()).distinct()
    large = (
        distinct.groupBy(key)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > part_items)
        .withColumn("parts", F.ceil(F.col("_n") / part_items).cast("bigint"))
    )
    parts = F.coalesce("parts", F.lit(1).cast("bigint"))
    return (
        join_keyed(distinct, large, key, "_n", item)
        .withColumn("parts", parts)
        .withColumn("part", F.pmod(_slot(F.col(item)), F.col("parts")))
        .groupBy(key, "part", "parts")
        .agg(F.array_sort(F.collect_list(item)).alias(name))
    )


def _slot(item: Column) -> Column:
    return F.conv(F.substring(F.md5(item.cast("string")), 1, 8), 16, 10).cast("bigint")
