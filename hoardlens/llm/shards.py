"""K-d tree sharding: splits at distributed weighted medians along the widest metadata dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hoardlens.workspace import materialize

SHARDS = 24
OVERHEAD = 8  # bytes a document takes besides its text
DIGIT = 13  # bits of the key settled by one pass over the metadata
KEY_BITS = 62  # 31 bits of the dimension, 31 of the row's hash
CLOSE_ENOUGH = 0.0005  # of a shard's bytes: a median is settled when one step decides less


def _scaled(dims: dict[str, Column], rows: DataFrame) -> DataFrame:
    """The dimensions as whole numbers of 31 bits over their whole range; null counts as least."""
    bounds = rows.agg(
        *[f(c).cast("double").alias(f"{f.__name__}_{n}") for n, c in dims.items() for f in (F.min, F.max)]
    ).first()
    for name, column in dims.items():
        low, high = bounds[f"min_{name}"], bounds[f"max_{name}"]
        wide = float(high - low) if low is not None and high > low else 1.0
        share = (column.cast("double") - F.lit(low if low is not None else 0.0)) / wide
        rows = rows.withColumn(
            f"d_{name}", F.coalesce((share * (2**31 - 1)).cast("bigint"), F.lit(0).cast("bigint"))
        )
    return rows


def _by_node(values: dict[int, Column]) -> Column:
    out = F.lit(None)
    for node, value in values.items():
        out = F.when(F.col("node") == node, value).otherwise(out)
    return out


def _medians(rows: DataFrame, keys: dict[int, Column], targets: dict[int, int], close: float):
    """Per node the least key whose bytes, with those of all lower keys, reach the target.

    Settles DIGIT bits a pass: bytes are summed by node and digit, a running sum within a node
    finds the digit that crosses the target. A task sends at most one row a node and digit.
    """
    prefix = {node: 0 for node in keys}
    before = {node: 0 for node in keys}
    shift, open_nodes = KEY_BITS, set(keys)
    while shift > 0 and open_nodes:
        width = min(DIGIT, shift)
        shift -= width
        held = rows.where(F.col("node").isin([*open_nodes])).withColumn("key", _by_node({n: keys[n] for n in open_nodes}))
        digit = F.shiftright("key", shift)
        inside = F.shiftright(digit, width) == _by_node({n: F.lit(prefix[n]).cast("bigint") for n in open_nodes})
        sums = held.where(inside).groupBy("node", digit.alias("digit")).agg(F.sum("size").alias("bytes"))
        total = F.sum("bytes").over(Window.partitionBy("node").orderBy("digit"))
        wanted = _by_node({n: F.lit(targets[n] - before[n]).cast("bigint") for n in open_nodes})
        crossing = (
            sums.withColumn("upto", total)
            .where((F.col("upto") >= wanted) & (F.col("upto") - F.col("bytes") < wanted))
            .collect()
        )
        for row in crossing:
            node = row["node"]
            start = before[node] + row["upto"] - row["bytes"]
            prefix[node] = row["digit"]
            if row["bytes"] <= close or shift == 0:
                # The nearer edge of the digit is the border.
                after = start + row["bytes"] - targets[node] < targets[node] - start
                prefix[node] = (row["digit"] + (1 if after else 0)) << shift
                open_nodes.discard(node)
            else:
                before[node] = start
        for node in open_nodes - {row["node"] for row in crossing}:
            prefix[node] <<= shift
            open_nodes.discard(node)
    return prefix


def kd_shards(meta: DataFrame, dims: dict[str, Column], shards: int, tiebreak: Column) -> DataFrame:
    """``meta`` (with a column ``size``) and its ``shard``, by recursive splits near equal in bytes.

    A node for n shards is cut along its widest dimension where n // 2 of n shares of its bytes
    lie below, rows of equal value being ordered by a hash. So a hot value is cut like any other.
    """
    known = meta.columns
    rows = _scaled(dims, meta).withColumn("tie", F.xxhash64(tiebreak).bitwiseAND((1 << 31) - 1))
    rows = materialize(rows, "metadata").withColumn("node", F.lit(0))
    nodes = {0: (0, shards)}  # node: first shard, number of shards
    fresh = 1
    while any(n > 1 for _, n in nodes.values()):
        active = {node: span for node, span in nodes.items() if span[1] > 1}
        facts = (
            rows.where(F.col("node").isin([*active]))
            .groupBy("node")
            .agg(
                F.sum("size").alias("bytes"),
                *[(F.max(f"d_{d}") - F.min(f"d_{d}")).alias(d) for d in dims],
            )
            .collect()
        )
        facts = {row["node"]: row for row in facts}
        keys, targets = {}, {}
        leaf = 1
        for node, (_, n) in active.items():
            if node not in facts:
                continue
            widest = max(dims, key=lambda d: facts[node][d])
            keys[node] = F.shiftleft(F.col(f"d_{widest}"), 31) + F.col("tie")
            targets[node] = facts[node]["bytes"] * (n // 2) // n
            leaf = max(leaf, facts[node]["bytes"] // n)
        borders = _medians(rows, keys, targets, CLOSE_ENOUGH * leaf)
        moved = {}
        for node, (first, n) in active.items():
            left, right = fresh, fresh + 1
            fresh += 2
            del nodes[node]
            nodes[left], nodes[right] = (first, n // 2), (first + n // 2, n - n // 2)
            if node in borders:
                moved[node] = F.when(keys[node] < F.lit(borders[node]).cast("bigint"), left).otherwise(right)
        if moved:
            # Written level by level: nested conditions of all levels would not compile.
            deeper = rows.withColumn("node", F.coalesce(_by_node(moved), F.col("node")))
            rows = materialize(deeper, "level")
    numbers = {node: F.lit(first) for node, (first, _) in nodes.items()}
    return rows.withColumn("shard", _by_node(numbers).cast("int")).select(*known, "shard")


def number_within(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Number the rows of each group from 0 without bringing a group into one task.

    Rows are spread by range and written; counts per range and group give each range its start.
    """
    ranged = materialize(
        rows.repartitionByRange(group, *order).withColumn("_range", F.spark_partition_id()), "slots"
    )
    counts = ranged.groupBy("_range", group).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", group, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    place = F.row_number().over(Window.partitionBy("_range", group).orderBy(*order))
    numbered = ranged.withColumn("_place", place).join(starts, ["_range", group])
    return numbered.withColumn(name, F.col("_first") + F.col("_place") - 1).drop("_range", "_place", "_first")


def shard_documents(
    docs: DataFrame,
    shards: int = SHARDS,
    text: str = "text",
    doc_id: str = "doc_id",
    dims: dict[str, Column] | None = None,
    target_bytes: int | None = None,
) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row, near equal in bytes.

    With ``target_bytes`` the number of shards is the least that keeps the mean below it. ``dims``
    are numeric columns of ``docs``; the default are hashes of source and language, the size and
    the id. The text is read once, for its size and checksum; all splits work on the metadata.

    A null text has size 8 and checksum 0; null dimensions count as the least value. Copies and
    rows of one source may lie in several shards. Repeated rows have equal keys and differ in
    their slot only. An empty table gives no rows; fewer rows than shards leave shards empty.
    """
    if dims is None:
        dims = {
            "source": F.crc32(F.coalesce(F.col("source"), F.lit(""))),
            "lang": F.crc32(F.coalesce(F.col("lang"), F.lit(""))),
            "size": F.coalesce(F.octet_length(text), F.lit(0)),
            "id": F.col(doc_id),
        }
    meta = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("text_crc32"),
        *[c.cast("double").alias(f"v_{n}") for n, c in dims.items()],
    )
    meta = materialize(meta, "sizes")
    if target_bytes:
        total = meta.agg(F.sum("size")).first()[0] or 0
        shards = max(1, -(-total // target_bytes))
    placed = kd_shards(
        meta,
        {n: F.col(f"v_{n}") for n in dims},
        shards,
        F.struct("doc_id", "text_crc32", "size"),
    ).select("doc_id", "size", "text_crc32", "shard")
    numbered = number_within(placed, "shard", ["doc_id", "text_crc32", "size"], "slot")
    return numbered.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
