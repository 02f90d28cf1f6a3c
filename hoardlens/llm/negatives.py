"""Hard negatives by an STR-packed R-tree: boxes bound inner products, a best-first queue prunes."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hoardlens.llm.topk import quantise
from hoardlens.workspace import materialize

LEAF = 128  # vectors of one leaf box
FAN = 16  # boxes of one box of the next level
AXES = 3  # widest coordinates, by which the rows of a tree are tiled
TREE = 16_384  # most vectors that are tiled together
GROUP_BYTES = 64 << 20  # of the vectors that one task holds while queries stream past them
SEED_ROWS = 64  # anchors whose first threshold is found at once
MOST = 1 << 56  # bound of scores, so that a hundredfold fits in 64 bits
LONG = np.iinfo(np.int64)


def _usable(vec_id: str, label: str, vector: str) -> Column:
    v = F.col(vector).cast("array<double>")
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & fine


def str_order(labels: np.ndarray, values: np.ndarray, leaf: int) -> np.ndarray:
    """Sort-tile-recursive order: slabs along the first column of ``values``, each cut along the next.

    Every ``leaf`` rows in a row make a leaf. Rows of one label stay together within a slab.
    """

    def tile(rows: np.ndarray, axis: int) -> np.ndarray:
        rows = rows[np.lexsort((values[rows, axis], labels[rows]))]
        left = values.shape[1] - axis
        if left == 1:
            return rows
        leaves = -(-len(rows) // leaf)
        slabs = int(np.ceil(leaves ** (1 / left)))
        size = leaf * -(-leaves // slabs)
        return np.concatenate([tile(rows[at : at + size], axis + 1) for at in range(0, len(rows), size)])

    everything = np.arange(len(labels))
    return tile(everything, 0) if values.shape[1] and len(labels) else everything


class Forest:
    """R-trees over one group of vectors; level 0 holds the leaves."""

    def __init__(self, leaves: np.ndarray, numbers, ids, labels, data: np.ndarray):
        self.numbers, self.ids, self.labels, self.data = numbers, ids, labels, data
        starts = np.concatenate([[0], np.flatnonzero(np.diff(leaves)) + 1])
        self.rows = np.append(starts, len(ids))
        low, high = np.minimum.reduceat(data, starts), np.maximum.reduceat(data, starts)
        first, last = np.minimum.reduceat(labels, starts), np.maximum.reduceat(labels, starts)
        self.levels = [(low, high, first, last)]
        while len(low) > FAN:
            at = np.arange(0, len(low), FAN)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            first, last = np.minimum.reduceat(first, at), np.maximum.reduceat(last, at)
            self.levels.append((low, high, first, last))

    def search(self, vector, label, number, same: bool, lows, highs, k: int):
        """Best ``k`` rows of each window ``lows <= score <= highs``: window, id and score.

        ``same`` asks for rows of the label, else for rows of others; the row ``number`` itself
        is left out. Boxes come in order of their upper bound. One is dropped when its interval
        misses every window, or lies strictly below what each window still needs.
        """
        plus, minus = np.maximum(vector, 0), np.minimum(vector, 0)
        need = lows.copy()
        best = [(vector[:0], np.zeros(0, np.int64)) for _ in need]
        heap: list[tuple] = []

        def push(level: int, start: int, end: int):
            low, high, first, last = (x[start:end] for x in self.levels[level])
            upper = high @ plus + low @ minus
            lower = low @ plus + high @ minus
            if same:
                fits = (first <= label) & (label <= last)
            else:
                fits = (first != label) | (last != label)
            fits &= ((upper[:, None] >= need) & (lower[:, None] <= highs)).any(axis=1)
            for box in np.flatnonzero(fits).tolist():
                heapq.heappush(heap, (-upper[box], level, start + box))

        top = len(self.levels) - 1
        push(top, 0, len(self.levels[top][0]))
        while heap:
            bound, level, box = heapq.heappop(heap)
            if -bound < need.min():
                break
            if level:
                push(level - 1, box * FAN, (box + 1) * FAN)
                continue
            rows = slice(self.rows[box], self.rows[box + 1])
            scores = self.data[rows] @ vector
            open_ = ((self.labels[rows] == label) == same) & (self.numbers[rows] != number)
            open_ &= (scores >= need.min()) & (scores <= highs.max())
            if not open_.any():
                continue
            scores, ids = scores[open_], self.ids[rows][open_]
            for w in range(len(need)):
                inside = (scores >= need[w]) & (scores <= highs[w])
                if not inside.any():
                    continue
                s = np.concatenate([best[w][0], scores[inside]])
                i = np.concatenate([best[w][1], ids[inside]])
                order = np.lexsort((i, -s))[:k]
                best[w] = s[order], i[order]
                if len(order) == k:
                    need[w] = max(need[w], best[w][0][-1])
        window = np.repeat(np.arange(len(best)), [len(s) for s, _ in best])
        return window, np.concatenate([i for _, i in best]), np.concatenate([s for s, _ in best])


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return _numbers(column.flatten()).astype(np.int64).reshape(len(column), dim)


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of equal rows of ``values``."""
    edges = np.flatnonzero((np.diff(values, axis=0) != 0).any(axis=1)) + 1
    return zip([0, *edges.tolist()], [*edges.tolist(), len(values)])


def _arithmetic(dim: int, big: int):
    """Doubles are exact up to 2**53 and multiply much faster than integers."""
    return np.float64 if dim * big**2 < 1 << 53 else np.int64


class Layout:
    """What is known of the vectors of each length: rows, largest value, axes, groups, tree size."""

    def __init__(self, rows: DataFrame):
        spread = (
            rows.select("dim", F.posexplode_outer(F.col("v").cast("array<double>")).alias("at", "x"))
            .groupBy("dim", "at")
            .agg(F.count(F.lit(1)).alias("n"), F.var_pop("x").alias("spread"), F.max(F.abs("x")).alias("big"))
        )
        by_spread = F.array_sort(F.collect_list(F.struct(-F.col("spread"), "at")))
        figures = spread.groupBy("dim").agg(
            F.max("n").alias("n"), F.max("big").alias("big"), F.slice(by_spread, 1, AXES)["at"].alias("axes")
        )
        cores = rows.sparkSession.sparkContext.defaultParallelism
        self.big, self.axes, self.groups, self.trees, self.first = {}, {}, {}, {}, {}
        slots = 0
        for dim, n, big, axes in sorted(figures.collect()):
            if dim * (big or 0) ** 2 >= MOST:
                raise ValueError("scores of these vectors do not fit in 64 bits")
            self.big[dim], self.axes[dim] = int(big or 0), [a for a in axes if a is not None]
            wanted = max(-(-n * dim * 8 // GROUP_BYTES), min(4 * cores, -(-n // LEAF)))
            self.groups[dim], self.trees[dim] = wanted, min(TREE, max(LEAF, -(-n // wanted)))
            self.first[dim] = slots
            slots += wanted
        self.slots = slots
        self.kind = "int" if max(self.big.values(), default=0) < 1 << 31 else "bigint"

    def by_dim(self, values: dict[int, int]) -> Column:
        return F.create_map(*[F.lit(x) for item in values.items() for x in item])[F.col("dim")]


def _pack(layout: Layout, every: int, k: int):
    """Rows sorted by length, label and widest coordinate, as trees in STR order.

    An anchor gets the kth best score of its own label within its tree, which the whole search
    can only exceed.
    """
    names = ["slot", "leaf", "number", "id", "label", "dim", "floor", "v"]

    def tree(dim: int, slot: int, number: int, leaf: int, ids, labels, data):
        order = str_order(labels, data[:, layout.axes[dim]], LEAF)
        ids, labels, data = ids[order], labels[order], data[order].astype(_arithmetic(dim, layout.big[dim]))
        floors = np.full(len(ids), LONG.min)
        anchors = np.flatnonzero(ids % every == 0)
        for at in range(0, len(anchors), SEED_ROWS):
            some = anchors[at : at + SEED_ROWS]
            scores = data[some] @ data.T
            for row, anchor in enumerate(some.tolist()):
                own = labels == labels[anchor]
                own[anchor] = False
                found = scores[row][own]
                if len(found) >= k:
                    floors[anchor] = int(np.partition(found, len(found) - k)[len(found) - k])
        place = np.arange(len(ids))
        lists = pa.ListArray.from_arrays(
            pa.array(np.arange(len(ids) + 1) * dim, pa.int32()),
            pa.array(data.astype(np.int64).ravel(), pa.int32() if layout.kind == "int" else pa.int64()),
        )
        columns = [np.full(len(ids), slot), leaf + place // LEAF, number + place, ids, labels, np.full(len(ids), dim), floors]
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns], lists], names)

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held, dim, size, made, number, leaf = [], None, 0, 0, part << 36, part << 36

        def flush():
            nonlocal held, size, made, number, leaf
            ids, labels, data = (np.concatenate(x) for x in zip(*held))
            slot = layout.first[dim] + (part + made) % layout.groups[dim]
            found = tree(dim, slot, number, leaf, ids, labels, data)
            made, number, leaf = made + 1, number + size, leaf + -(-size // LEAF)
            held, size = [], 0
            return found

        for batch in batches:
            if not batch.num_rows:
                continue
            dims = _numbers(batch.column(3))
            for start, end in _runs(dims[:, None]):
                if size and dim != dims[start]:
                    yield flush()
                dim = int(dims[start])
                while start < end:
                    stop = min(end, start + layout.trees[dim] - size)
                    piece = batch.slice(start, stop - start)
                    held.append((_numbers(piece.column(0)), _numbers(piece.column(1)), _vectors(piece.column(2), dim)))
                    size, start = size + stop - start, stop
                    if size == layout.trees[dim]:
                        yield flush()
        if size:
            yield flush()

    return run


def _search(layout: Layout, same: bool, k: int):
    """Rows of a slot (leaf by leaf), then the queries that are to meet them."""
    names = ["anchor", "at", "vec_id", "score"]

    def run(batches):
        slot, held, forest = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            slots, queries = _numbers(batch.column(0)), _numbers(batch.column(1))
            out = [[], [], [], []]
            for start, end in _runs(np.stack([slots, queries], axis=1)):
                piece = batch.slice(start, end - start)
                leaves, numbers, ids, labels, dims = (_numbers(piece.column(i)) for i in range(2, 7))
                dim = int(dims[0])
                data = _vectors(piece.column(7), dim)
                if slot != slots[start]:
                    slot, held, forest = slots[start], [], None
                if not queries[start]:
                    held.append((leaves, numbers, ids, labels, data))
                    continue
                kind = _arithmetic(dim, layout.big[dim])
                if forest is None and held:
                    *columns, rows = (np.concatenate(x) for x in zip(*held))
                    held, forest = [], Forest(*columns, rows.astype(kind))
                if forest is None:
                    continue
                windows = zip(piece.column(8).to_pylist(), piece.column(9).to_pylist())
                for n, (lows, highs) in enumerate(windows):
                    bounds = (np.array(x, np.int64).astype(kind) for x in (lows, highs))
                    at, found, scores = forest.search(data[n].astype(kind), labels[n], numbers[n], same, *bounds, k)
                    for column, values in zip(out, (np.full(len(at), numbers[n]), at, found, scores)):
                        column.append(values.astype(np.int64))
            if any(len(x) for x in out[0]):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out], names)

    return run


def best_in_windows(packed: DataFrame, layout: Layout, queries: DataFrame, same: bool, k: int) -> DataFrame:
    """``anchor, at, vec_id, score, rank``: best ``k`` rows of each query's windows over all groups.

    Vectors stay in their group; every query visits each group of its length once and brings
    back at most ``k`` rows a window.
    """
    copies = F.explode(F.sequence(F.lit(0), layout.by_dim(layout.groups) - 1))
    none = F.lit(None).cast("array<bigint>")
    columns = ["slot", "query", "leaf", "number", "id", "label", "dim", "v", "lows", "highs"]
    rows = packed.withColumn("query", F.lit(0)).withColumn("lows", none).withColumn("highs", none)
    sent = queries.withColumn("query", F.lit(1)).withColumn("copy", copies)
    sent = sent.withColumn("slot", (layout.by_dim(layout.first) + F.col("copy")).cast("bigint"))
    met = (
        rows.select(*columns)
        .unionByName(sent.select(*columns))
        .repartitionById(layout.slots, F.col("slot").cast("int"))
        .sortWithinPartitions("slot", "query", "leaf", "number")
    )
    found = met.mapInArrow(_search(layout, same, k), "anchor bigint, at bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("anchor", "at").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame,
    positives: int = 5,
    negatives: int = 3,
    every: int = 50,
    low: int = 50,
    high: int = 95,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``, exact.

    Anchors are the rows whose id is divisible by ``every``; their positives the best
    ``positives`` other rows of their label by integer inner product. For each positive, the
    best ``negatives`` rows of other labels whose score lies between ``low`` and ``high`` per
    cent of the positive's. Ties go to the smaller id.

    Vectors are packed into R-trees of bounded size, sort-tile-recursive along the widest
    coordinates after a range partition by label and the widest one; the label is one more side
    of each box. Groups of trees stay in their tasks and queries stream past them, so hot labels
    and repeated vectors only mean more groups. Only one row a vector length goes to the driver.

    Rows with a null id, label or vector, or null or non-finite components take no part; vectors
    are compared within their length. Rows that share an id are rows of their own, also as
    anchors. A positive score below zero leaves no window, hence no rows. Empty tables give no
    rows. Vectors whose scores, times 100, need not fit in 64 bits raise a ValueError.
    """
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    rows = vectors.select(
        F.col(vec_id).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), F.col(vector).alias("v")
    )
    rows = rows.where(_usable("id", "label", "v")).select("id", "label", quantise("v").alias("v"), F.size("v").alias("dim"))
    layout = Layout(rows)
    if not layout.slots:
        return vectors.sparkSession.createDataFrame([], schema)
    widest = layout.by_dim({d: axes[0] if axes else 0 for d, axes in layout.axes.items()})
    ranged = (
        rows.withColumn("x", F.get("v", widest))
        .repartitionByRange(layout.slots, "dim", "label", "x", "id", F.hash("v"))
        .sortWithinPartitions("dim", "label", "x", "id")
        .select("id", "label", "v", F.col("dim").cast("bigint").alias("dim"))
    )
    columns = ", ".join(f"{n} bigint" for n in ("slot", "leaf", "number", "id", "label", "dim", "floor"))
    packed = ranged.mapInArrow(_pack(layout, every, positives), f"{columns}, v array<{layout.kind}>")
    packed = materialize(packed.withColumn("dim", F.col("dim").cast("int")), "packed")

    anchors = packed.where(F.col("id") % every == 0)
    queries = anchors.withColumn("lows", F.array("floor")).withColumn("highs", F.array(F.lit(LONG.max)))
    near = best_in_windows(packed, layout, queries, True, positives)
    near = near.select(F.col("anchor").alias("number"), "vec_id", "score", "rank").where("score >= 0")
    near = materialize(near, "positives")
    window = F.struct(
        "rank",
        F.expr(f"(score * {low} + 99) div 100").alias("low"),
        F.expr(f"(score * {high}) div 100").alias("high"),
    )
    windows = near.groupBy("number").agg(F.array_sort(F.collect_list(window)).alias("windows"))
    queries = anchors.join(windows, "number").select(
        "*", F.col("windows.low").alias("lows"), F.col("windows.high").alias("highs")
    )
    found = best_in_windows(packed, layout, queries, False, negatives)
    # Ranks of an anchor's positives count from 1 without a gap, so window n is that of rank n + 1.
    return (
        found.select(
            F.col("anchor").alias("number"), (F.col("at") + 1).cast("int").alias("place"),
            F.col("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"),
        )
        .join(near.withColumnRenamed("rank", "place").withColumnRenamed("vec_id", "positive_id"), ["number", "place"])
        .join(anchors.select("number", F.col("id").alias("anchor_id")), "number")
        .select("anchor_id", "positive_id", "rank", "negative_id", F.col("score").alias("positive_score"), "negative_score")
    )


def shifted_labels(vectors: DataFrame) -> DataFrame:
    """Labels as the registered query takes them: one further where the id is divisible by 7."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return vectors.select("vec_id", "embedding", moved.alias("label"))


ORACLE = """
WITH ints AS (
    SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT a.row AS anchor, a.vec_id AS anchor_id, c.row, c.vec_id, a.label = c.label AS same,
           CAST(coalesce(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
    FROM ints a JOIN ints c ON a.vec_id % 50 = 0 AND a.row <> c.row AND len(a.v) = len(c.v)),
positives AS (
    SELECT * FROM (
        SELECT anchor, anchor_id, row AS positive, vec_id AS positive_id, score AS positive_score,
               row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS place
        FROM scored WHERE same)
    WHERE place <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM (
    SELECT p.anchor_id, positive_id, positive_score, n.vec_id AS negative_id, n.score AS negative_score,
           row_number() OVER (PARTITION BY p.anchor, positive ORDER BY n.score DESC, n.vec_id) AS rank
    FROM positives p JOIN scored n
      ON p.anchor = n.anchor AND NOT n.same
     AND 50 * positive_score <= 100 * n.score AND 100 * n.score <= 95 * positive_score)
WHERE rank <= 3
"""
