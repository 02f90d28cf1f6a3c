"""Consecutive numbers over a globally sorted column without a one-task window."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hoardlens.workspace import materialize


ONE_TASK_ROWS = 100_000  # tables up to this size are ranked by a single task


def number_rows(df: DataFrame, order: str, number: str) -> DataFrame:
    """Number the rows 0, 1, ... by a unique column.

    Beyond ONE_TASK_ROWS the rows are range-partitioned and written once together with their
    range, so the ranges cannot move when a task is repeated; only one count per range reaches
    the driver. ``df`` should be cheap to read twice.
    """
    if df.limit(ONE_TASK_ROWS + 1).count() <= ONE_TASK_ROWS:
        place = F.row_number().over(Window.orderBy(order))
        return df.withColumn(number, (place - 1).cast("bigint"))
    ranged = materialize(
        df.repartitionByRange(F.col(order).asc()).withColumn("_range", F.spark_partition_id()),
        "ranges",
    )
    counts = sorted(tuple(row) for row in ranged.groupBy("_range").count().collect())
    starts = accumulate((count for _, count in counts), initial=0)
    offsets = [(index, start) for (index, _), start in zip(counts, starts)]
    first = df.sparkSession.createDataFrame(offsets, "_range int, _first bigint")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    numbered = ranged.join(F.broadcast(first), "_range").withColumn(
        number, F.col("_first") + place - 1
    )
    return numbered.drop("_range", "_first")
