"""Key checks that the storage does not enforce."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Key values that occur more than once."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose key has no parent."""
    keys = parent.select(F.col(parent_key).alias(child_key))
    return child.join(keys, child_key, "left_anti")


def wrong_lengths(df: DataFrame, vec: str, dim: int) -> DataFrame:
    """Rows whose vector is missing, has another length or holds a NULL."""
    fits = (F.size(vec) == dim) & ~F.exists(vec, lambda x: x.isNull())
    return df.where(~F.coalesce(fits, F.lit(False)))


def embedding_integrity(embeddings: DataFrame, labels: DataFrame, dim: int) -> DataFrame:
    """Violations per check, one row each."""

    def count(name: str, rows: DataFrame) -> DataFrame:
        return rows.agg(F.count(F.lit(1)).alias("violations")).select(
            F.lit(name).alias("check_name"), "violations"
        )

    return (
        count("duplicate_id", duplicate_keys(embeddings, "id"))
        .unionByName(count("orphan_label", orphans(labels, embeddings, "id", "id")))
        .unionByName(count("wrong_length", wrong_lengths(embeddings, "embedding", dim)))
    )
