"""Exact DBSCAN on cosine distance.

A point is core when at least ``min_samples`` points, itself included, lie within ``eps``.
Clusters are the connected components of core points, numbered by their least core id. A
border point takes the least number among its core neighbours; the rest is noise.

Exact copies are folded into one weighted point and dense balls into one graph node. The blocks
of ``cells.py`` meet once a pair: one stays in its task, the others pass. There, tiles whose balls
lie apart are skipped, then rows out of reach of a tile, then pairs whose leading principal
coordinates settle the matter, then rows already known to be connected. A block returns counts
or the links that merge nodes, so nothing that leaves a task grows with the number of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoardlens.operators import blocks
from hoardlens.operators import cells as cell_index
from hoardlens.operators.blocks import column, unit, values, vectors
from hoardlens.operators.components import connected_components
from hoardlens.operators.numbering import number_rows
from hoardlens.operators.skew import join_keyed
from hoardlens.workspace import materialize

CELL_ROWS = 1024
OPEN_SHARE = 32  # a full product is cheaper when more than one pair in so many is left open
OPEN_ROWS = 1 << 14  # open pairs that are multiplied at once
VISIT_ROWS = 1 << 13  # rows of a visiting block that are held at once
ROUNDING = 1e-12  # distances that differ from eps by less than this count as within


def has_direction(vec: str) -> F.Column:
    """True for vectors with a length; NULL and all-zero vectors have no neighbours."""
    return F.coalesce(F.exists(vec, lambda x: x != 0), F.lit(False))


@dataclass
class Search:
    """Settings of one run and what it learned about its input."""

    points: DataFrame  # id, vec, w: distinct vectors with a direction
    eps: float
    min_samples: int
    cell_rows: int
    dim: int
    rows: int

    @property
    def radius(self) -> float:
        return float(np.sqrt(2.0 * min(self.eps, 2.0)))

    @cached_property
    def cells(self) -> cell_index.Cells:
        return cell_index.place(
            self.points, self.dim, self.rows, self.radius, 1.0 - self.eps, self.min_samples, self.cell_rows
        )

    @property
    def metric(self) -> Metric:
        index = self.cells
        axes = index.axes if index.lead < self.dim else None
        return Metric(self.dim, self.radius, 1.0 - self.eps - ROUNDING, axes, index.lead, blocks.BLOCK_ROWS)

    def meet(self, rows: DataFrame, extra: list[str], tile: str, task, schema: str) -> DataFrame:
        """Run ``task`` over the rows of each block followed by those of the blocks that visit it.

        ``tile`` tells apart rows that must not share a tile.
        """
        layout = self.cells.layout
        sent = cell_index.visits(rows.withColumn("tile", F.expr(tile)), layout)
        names = ["target", "visiting", "block", "tile", "along", "id", "vec", *extra]
        met = sent.select(*names).repartitionById(layout.blocks, F.col("target"))
        ordered = met.sortWithinPartitions("target", "visiting", "block", "tile", "along", "id")
        return ordered.mapInArrow(task, schema)


@dataclass
class Metric:
    """What a task needs to compare unit vectors."""

    dim: int
    radius: float
    limit: float  # least cosine of neighbours
    axes: np.ndarray | None  # rotation to the principal axes, None where it saves nothing
    lead: int
    tile_rows: int

    def near(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which rows of two sets are neighbours.

        Leading coordinates come first; the others of a pair are multiplied only if their
        lengths leave it open, unless so many are open that a full product is cheaper.
        """
        lead = self.lead
        if lead == x.shape[1]:
            return x @ y.T >= self.limit
        low = x[:, :lead] @ y[:, :lead].T
        rest_x, rest_y = np.linalg.norm(x[:, lead:], axis=1), np.linalg.norm(y[:, lead:], axis=1)
        open_ = np.flatnonzero(low + np.multiply.outer(rest_x, rest_y) >= self.limit - cell_index.SLACK)
        if len(open_) > low.size // OPEN_SHARE:
            return low + x[:, lead:] @ y[:, lead:].T >= self.limit
        found = np.zeros(low.shape, dtype=bool)
        for start in range(0, len(open_), OPEN_ROWS):
            rows, columns = np.divmod(open_[start : start + OPEN_ROWS], low.shape[1])
            rest = np.einsum("ij,ij->i", x[rows, lead:], y[columns, lead:])
            found[rows, columns] = low[rows, columns] + rest >= self.limit
        return found

    def reachable(self, x: np.ndarray, centre: np.ndarray, reach: float) -> np.ndarray:
        """Rows that may have a neighbour in a ball."""
        squares = 1.0 + centre @ centre - 2.0 * (x @ centre)
        return squares <= (reach + self.radius + cell_index.SLACK) ** 2


class Block:
    """Rows of one block as unit vectors, cut into tiles of one kind and of bounded size."""

    def __init__(self, table: pa.Table, metric: Metric):
        self.table = table.drop_columns(["vec"])
        # Piece by piece, so that no second copy of the vectors is made.
        self.units = np.empty((table.num_rows, metric.dim))
        for start in range(0, table.num_rows, blocks.BLOCK_ROWS):
            rows = unit(vectors(table.slice(start, blocks.BLOCK_ROWS), "vec", metric.dim))
            self.units[start : start + len(rows)] = rows if metric.axes is None else rows @ metric.axes
        kind = values(table, "tile")
        edges = np.flatnonzero(np.diff(kind)) + 1
        starts = [
            start
            for low, high in zip([0, *edges.tolist()], [*edges.tolist(), len(kind)])
            for start in range(low, high, metric.tile_rows)
        ]
        self.starts, self.ends = starts, [*starts[1:], len(kind)]
        sizes = np.diff([*starts, len(kind)])
        self.kind = kind[starts]
        self.centre = np.add.reduceat(self.units, starts) / sizes[:, None]
        tiles = (self.units[self.rows(t)] - self.centre[t] for t in range(len(starts)))
        self.reach = np.array([np.linalg.norm(t, axis=1).max() for t in tiles])

    def rows(self, tile: int) -> slice:
        return slice(self.starts[tile], self.ends[tile])


def _tile_pairs(own: Block, other: Block, metric: Metric) -> Iterator[tuple[int, int]]:
    """Tiles whose balls come within the radius of each other, each unordered pair once."""
    squares = (own.centre**2).sum(1)[:, None] + (other.centre**2).sum(1) - 2.0 * own.centre @ other.centre.T
    gaps = np.sqrt(np.maximum(squares, 0.0)) - own.reach[:, None] - other.reach
    for i, j in np.argwhere(gaps <= metric.radius + cell_index.SLACK).tolist():
        if own is not other or i <= j:
            yield i, j


def _blocks(batches, metric: Metric) -> Iterator[tuple[bool, Block]]:
    """Blocks of a sorted stream, each with whether it visits; visitors come in pieces of bounded size."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        target, visiting, block = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        keys = np.stack([target, visiting.astype(np.int32), block], axis=1)
        edges = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1
        for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(keys)]):
            if held and key != tuple(keys[start]):
                yield bool(key[1]), Block(pa.Table.from_batches(held), metric)
                held = []
            key = tuple(keys[start])
            while start < end:
                room = VISIT_ROWS - sum(len(b) for b in held)
                stop = min(end, start + room) if key[1] else end
                held.append(batch.slice(start, stop - start))
                if key[1] and stop - start == room:
                    yield True, Block(pa.Table.from_batches(held), metric)
                    held = []
                start = stop
    if held:
        yield bool(key[1]), Block(pa.Table.from_batches(held), metric)


def _add_counts(own: Block, other: Block, own_near, other_near, metric: Metric) -> None:
    weights = [values(b.table, "w").astype(np.float64) for b in (own, other)]
    for i, j in _tile_pairs(own, other, metric):
        if own.kind[i] % 2 and other.kind[j] % 2:
            continue  # members of dense balls are core whatever their neighbours
        rows, columns = own.rows(i), other.rows(j)
        x, y = own.units[rows], other.units[columns]
        at_x = np.flatnonzero(metric.reachable(x, other.centre[j], other.reach[j]))
        at_y = np.flatnonzero(metric.reachable(y, own.centre[i], own.reach[i]))
        # Doubles count exactly up to 2**53 and are summed by the matrix library.
        near = metric.near(x[at_x], y[at_y]).astype(np.float64)
        own_near[rows.start + at_x] += (near @ weights[1][columns][at_y]).astype(np.int64)
        if own is not other or i != j:
            other_near[columns.start + at_y] += (near.T @ weights[0][rows][at_x]).astype(np.int64)


def neighbour_counts(search: Search) -> DataFrame:
    """``id, near``: weight within eps of every point outside the dense balls, self included."""
    metric = search.metric

    def count(batches):
        def found(block: Block, near: np.ndarray):
            some = (near > 0) & (values(block.table, "tile") % 2 == 0)
            ids = column(block.table, "id").filter(pa.array(some))
            return pa.RecordBatch.from_arrays([ids, pa.array(near[some])], ["id", "near"])

        own = own_near = None
        for visiting, block in _blocks(batches, metric):
            near = np.zeros(len(block.units), np.int64)
            if visiting:
                if own is not None:
                    _add_counts(own, block, own_near, near, metric)
                    yield found(block, near)
                continue
            if own is not None:
                yield found(own, own_near)
            own, own_near = block, near
            _add_counts(own, own, own_near, own_near, metric)
        if own is not None:
            yield found(own, own_near)

    placed = search.cells.placed
    kind = placed.schema["id"].dataType.simpleString()
    tile = "home * 2 + int(dense)"
    partial = search.meet(placed, ["w"], tile, count, f"id {kind}, near bigint")
    return partial.groupBy("id").agg(F.sum("near").alias("near"))


def _near_rows(own: Block, other: Block, metric: Metric):
    """Rows of both blocks that are neighbours, tile by tile, each unordered pair once."""
    for i, j in _tile_pairs(own, other, metric):
        rows, columns = own.rows(i), other.rows(j)
        x, y = own.units[rows], other.units[columns]
        at_x = np.flatnonzero(metric.reachable(x, other.centre[j], other.reach[j]))
        at_y = np.flatnonzero(metric.reachable(y, own.centre[i], own.reach[i]))
        x_at, y_at = np.nonzero(metric.near(x[at_x], y[at_y]))
        x_at, y_at = rows.start + at_x[x_at], columns.start + at_y[y_at]
        if own is other and i == j:
            x_at, y_at = x_at[x_at < y_at], y_at[x_at < y_at]
        yield x_at, y_at


def neighbour_pairs(
    df: DataFrame, eps: float, id_col: str = "id", vec_col: str = "embedding", cell_rows: int = CELL_ROWS
) -> tuple[DataFrame, DataFrame]:
    """The neighbourhood join itself: pairs of distinct vectors within ``eps``, and all their copies.

    Returns ``a, b`` with a < b, each distinct vector under the least id that carries it, and
    ``id, representative`` of every row with a direction. Copies are neighbours of each other
    and of all neighbours of their representative, so they need not be paired. The number of
    pairs may be quadratic where the data is dense; they leave the tasks tile by tile.
    """
    if eps >= 1:
        raise ValueError("neighbour pairs need eps below 1")
    rows, search, total = _open(df, id_col, vec_col, eps, 2**62, cell_rows)
    kind = search.points.schema["id"].dataType.simpleString()
    members = rows.where(has_direction("vec")).join(
        search.points.select("vec", F.col("id").alias("representative")), "vec"
    )
    members = members.select("id", "representative")
    if not total:
        return df.sparkSession.createDataFrame([], f"a {kind}, b {kind}"), members
    metric = search.metric

    def pair(batches):
        own = None
        for visiting, block in _blocks(batches, metric):
            own = own if visiting else block
            if own is None:
                continue
            ids = column(own.table, "id"), column(block.table, "id")
            for x, y in _near_rows(own, block, metric):
                found = [i.take(pa.array(at)) for i, at in zip(ids, (x, y))]
                yield pa.RecordBatch.from_arrays(found, ["a", "b"])

    pairs = search.meet(search.cells.placed, [], "home * 2", pair, f"a {kind}, b {kind}")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), members


def _block_groups(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group number of every row and column of a block that are linked in it, else -1.

    Grows one group at a time by whole rows and columns, which reads each of them once.
    """
    of_row, of_column = np.full(near.shape[0], -1), np.full(near.shape[1], -1)
    group = 0
    for start in np.flatnonzero(near.any(axis=1)).tolist():
        if of_row[start] >= 0:
            continue
        of_row[start], rows = group, np.array([start])
        while len(rows):
            columns = np.flatnonzero(near[rows].any(axis=0) & (of_column < 0))
            of_column[columns] = group
            rows = np.flatnonzero(near[:, columns].any(axis=1) & (of_row < 0))
            of_row[rows] = group
        group += 1
    return of_row, of_column


def local_forest(near: np.ndarray, q_nodes: np.ndarray, m_nodes: np.ndarray):
    """Spanning forest of one block: every node with the least node it reaches in the block."""
    of_row, of_column = _block_groups(near)
    group = np.concatenate([of_row, of_column])
    linked = group >= 0
    nodes, code = np.unique(np.concatenate([q_nodes, m_nodes])[linked], return_inverse=True)
    group = group[linked]
    # Several points can share a node, so groups that meet in a node are one.
    label = np.arange(len(nodes))
    while True:
        least = np.full(len(linked) + 1, len(nodes))
        np.minimum.at(least, group, label[code])
        after = label.copy()
        np.minimum.at(after, code, least[group])
        if np.array_equal(after, label):
            break
        label = after
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


class Links:
    """Connections between the nodes of one block and, one after the other, its visitors.

    Rows that are known to be connected are not compared again, so a cluster that fills many
    blocks costs far less than all its pairs, and no more links leave a task than it merges nodes.
    """

    def __init__(self, own: Block, metric: Metric):
        self.own, self.metric = own, metric
        self.nodes, self.code = np.unique(values(own.table, "node"), return_inverse=True)
        self.label = np.arange(len(self.nodes))  # least node of the block known to be connected

    def join(self, other: Block) -> pa.RecordBatch:
        nodes, own_code, other_code, label = self.nodes, self.code, self.code, self.label.copy()
        if other is not self.own:
            own_count = len(nodes)
            nodes, both = np.unique(
                np.concatenate([nodes, np.unique(values(other.table, "node"))]), return_inverse=True
            )
            renamed = both[:own_count]
            label = np.arange(len(nodes))
            label[renamed] = renamed[self.label]
            own_code = renamed[self.code]
            other_code = np.searchsorted(nodes, values(other.table, "node"))
        links, borders = [], []
        for i, j in _tile_pairs(self.own, other, self.metric):
            core_x, core_y = self.own.kind[i] % 2, other.kind[j] % 2
            if not (core_x or core_y):
                continue
            rows, columns = self.own.rows(i), other.rows(j)
            code_x, code_y = own_code[rows], other_code[columns]
            at_x, at_y = np.arange(len(code_x)), np.arange(len(code_y))
            sets = [(at_x, at_y)]
            if core_x and core_y:
                label_x, label_y = label[code_x], label[code_y]
                main = np.bincount(np.concatenate([label_x, label_y])).argmax()
                sets = [(at_x[label_x != main], at_y), (at_x[label_x == main], at_y[label_y != main])]
            x, y = self.own.units[rows], other.units[columns]
            for at_x, at_y in sets:
                if not len(at_x) or not len(at_y):
                    continue
                at_x = at_x[self.metric.reachable(x[at_x], other.centre[j], other.reach[j])]
                at_y = at_y[self.metric.reachable(y[at_y], self.own.centre[i], self.own.reach[i])]
                near = self.metric.near(x[at_x], y[at_y])
                if core_x and core_y:
                    child, parent = local_forest(near, label[code_x[at_x]], label[code_y[at_y]])
                    if len(child):
                        links.append((child, parent))
                        renumber = np.arange(len(nodes))
                        renumber[child] = parent
                        label = renumber[label]
                    continue
                x_at, y_at = np.nonzero(near)
                x_at, y_at = code_x[at_x[x_at]], code_y[at_y[y_at]]
                borders.append((y_at, x_at) if core_x else (x_at, y_at))
        if other is not self.own:
            _, first, group = np.unique(label[own_code], return_index=True, return_inverse=True)
            least = self.code[first][group]
            self.label = np.empty(len(self.nodes), np.int64)
            self.label[self.code] = least
        else:
            self.label = label
        ends = [np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*links, *borders)] if links or borders else None
        a, b = (nodes[e] for e in ends) if ends else (nodes[:0], nodes[:0])
        border = np.arange(len(a)) >= sum(len(c) for c, _ in links)
        kind = column(self.own.table, "node").type
        return pa.RecordBatch.from_arrays(
            [pa.array(a, kind), pa.array(b, kind), pa.array(border)], ["a", "b", "border"]
        )


def core_links(search: Search, flagged: DataFrame) -> DataFrame:
    """``a, b, border``: links that connect the core nodes, and core nodes next to others.

    A point that is not core has fewer than ``min_samples`` neighbours, which bounds the
    second kind.
    """
    metric = search.metric
    kind = flagged.schema["id"].dataType.simpleString()

    def link(batches):
        known = None
        for visiting, block in _blocks(batches, metric):
            if not visiting:
                known = Links(block, metric)
                yield known.join(block)
            elif known is not None:
                yield known.join(block)

    tile = "(home * 2 + int(dense)) * 2 + int(core)"
    return search.meet(flagged, ["node"], tile, link, f"a {kind}, b {kind}, border boolean").distinct()


def ball_groups(index: cell_index.Cells, radius: float) -> list:
    """Node of every dense ball; balls whose central members are neighbours share one.

    Works on one figure per cell, so its size is bounded by the number of pivots.
    """
    dense = [c for c, anchor in enumerate(index.anchor) if anchor is not None]
    touching = cell_index.chords(index.medoids[dense] @ index.medoids[dense].T)
    touching = touching <= radius - cell_index.SLACK
    node: list = list(index.anchor)
    open_cells = set(range(len(dense)))
    while open_cells:
        group, frontier = set(), {open_cells.pop()}
        while frontier:
            group |= frontier
            open_cells -= frontier
            reached = touching[list(frontier)].any(axis=0)
            frontier = {i for i in open_cells if reached[i]}
        least = min(index.anchor[dense[i]] for i in group)
        for i in group:
            node[dense[i]] = least
    return node


def _label_distinct(search: Search, lone_cores: DataFrame | None) -> DataFrame:
    """``id, cluster_id`` of all distinct vectors that belong to a cluster."""
    index = search.cells
    spark = search.points.sparkSession
    id_field = search.points.schema["id"]
    kind = id_field.dataType.simpleString()
    loose_rows = int((index.home_rows - index.dense_rows).sum())
    has_balls = any(a is not None for a in index.anchor)

    nodes = ball_groups(index, search.radius) if has_balls else []
    ball_nodes = spark.createDataFrame(
        [(c, n) for c, n in enumerate(nodes) if n is not None], f"home int, node {kind}"
    )
    # With up to two samples a point next to any other is core: the links tell, and no counts are
    # needed.
    by_links = search.min_samples <= 2
    flagged = index.placed
    if by_links:
        flagged = flagged.withColumn("core", F.lit(True))
    else:
        if loose_rows:
            flagged = flagged.join(neighbour_counts(search), "id", "left")
        else:
            flagged = flagged.withColumn("near", F.lit(None).cast("bigint"))
        many = F.coalesce("near", F.lit(0)) >= search.min_samples
        flagged = flagged.withColumn("core", F.col("dense") | many).drop("near")
    flagged = (
        flagged.join(F.broadcast(ball_nodes.withColumnRenamed("node", "ball")), "home", "left")
        .withColumn("node", F.when(F.col("dense"), F.col("ball")).otherwise(F.col("id")))
        .drop("ball")
    )
    flagged = materialize(flagged, "flagged")

    edges = spark.createDataFrame([], f"a {kind}, b {kind}")
    links = None
    if loose_rows or len({n for n in nodes if n is not None}) > 1:
        links = materialize(core_links(search, flagged), "links")
        edges = links.where(~F.col("border")).select("a", "b")
    component = connected_components(edges)

    loose = flagged.where(F.col("core") & ~F.col("dense"))
    if by_links:
        linked = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        heavy = loose.where(F.col("w") >= search.min_samples).select("node")
        core_nodes = linked.unionByName(heavy).unionByName(ball_nodes.select("node")).distinct()
    else:
        core_nodes = loose.select("node").unionByName(ball_nodes.select("node").distinct())
    if lone_cores is not None:
        core_nodes = core_nodes.unionByName(lone_cores.select(F.col("id").alias("node")))
    rooted = materialize(
        core_nodes.join(component, "node", "left").select(
            "node", F.coalesce("root", "node").alias("root")
        ),
        "roots",
    )
    numbered = number_rows(
        rooted.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "root", "cluster_id"
    )
    numbered = numbered.withColumn("cluster_id", F.col("cluster_id").cast("int"))
    node_cluster = materialize(
        join_keyed(rooted, numbered, "root", "n", "node").select("node", "cluster_id"), "nodes"
    )

    # Loose cores are their own nodes; dense points look theirs up in the bounded cell table.
    parts = node_cluster.select(F.col("node").alias("id"), "cluster_id").join(
        ball_nodes.select(F.col("node").alias("id")).distinct(), "id", "left_anti"
    )
    if has_balls:
        ball_cluster = ball_nodes.join(node_cluster, "node").select("home", "cluster_id")
        parts = parts.unionByName(
            flagged.where("dense")
            .select("id", "home")
            .join(F.broadcast(ball_cluster), "home")
            .select("id", "cluster_id")
        )
    if links is not None:
        touched = links.where("border").select("a", "b")
        counts = touched.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
        known = counts.join(node_cluster.withColumnRenamed("node", "b"), "b")
        borders = join_keyed(touched, known, "b", "n", "a")
        parts = parts.unionByName(
            borders.groupBy("a").agg(F.min("cluster_id").alias("cluster_id")).select(
                F.col("a").alias("id"), "cluster_id"
            )
        )
    return parts


def _open(df: DataFrame, id_col: str, vec_col: str, eps: float, min_samples: int, cell_rows: int):
    """Fold copies and check the input; returns the search, the figures and the table."""
    if eps < 0 or min_samples < 1 or cell_rows < 1:
        raise ValueError("eps must not be negative; min_samples and cell_rows must be positive")
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    if not rows.groupBy("id").count().where("count > 1").isEmpty():
        raise ValueError("ids must be unique")
    points = materialize(
        rows.where(has_direction("vec"))
        .groupBy("vec")
        .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("w"))
        .select("id", "vec", "w"),
        "points",
    )
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    facts = points.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum("w"), F.lit(0)).alias("total"),
        F.min(F.size("vec")).alias("dim"),
        F.max(F.size("vec")).alias("max_dim"),
        F.coalesce(F.max(bad), F.lit(False)).alias("bad"),
    ).first()
    if facts["bad"] or facts["dim"] != facts["max_dim"]:
        raise ValueError("embeddings must be finite and of one length")
    search = Search(points, eps, min_samples, cell_rows, facts["dim"] or 0, facts["rows"])
    return rows, search, facts["total"]


def count_neighbours(
    df: DataFrame, eps: float, id_col: str = "id", vec_col: str = "embedding",
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """``id, near`` for every vector: how many vectors, itself included, lie within ``eps``.

    Vectors without a length have only themselves (for ``eps`` below 1).
    """
    if eps >= 1:
        raise ValueError("neighbour counts need eps below 1")
    # No ball may be skipped here, so none is heavy enough.
    rows, search, total = _open(df, id_col, vec_col, eps, 2**62, cell_rows)
    lone = rows.where(~has_direction("vec")).select("id", F.lit(1).cast("bigint").alias("near"))
    if not total:
        return lone
    near = neighbour_counts(search)
    if total == search.rows:
        return near.unionByName(lone)
    keyed = search.points.join(near, "id").select("vec", "w", "near")
    spread = join_keyed(rows.where(has_direction("vec")), keyed, "vec", "w", "id")
    return spread.select("id", "near").unionByName(lone)


def dbscan(
    df: DataFrame,
    eps: float = 0.5,
    min_samples: int = 2,
    id_col: str = "id",
    vec_col: str = "embedding",
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """``id, cluster_id, is_noise`` for every row of ``df``; noise has a NULL cluster.

    Ids must be unique and sortable: they decide the numbering. Vectors that are NULL or all
    zero are at distance 1 from everything.
    """
    rows, search, total = _open(df, id_col, vec_col, eps, min_samples, cell_rows)
    lone = rows.where(~has_direction("vec")).select("id")
    if eps >= 1 and not lone.isEmpty():
        # A vector without a length is within eps of all others and ties them together.
        everyone = rows.count() >= min_samples
        number = F.lit(0 if everyone else None).cast("int")
        return rows.select("id", number.alias("cluster_id"), F.lit(not everyone).alias("is_noise"))
    if not total and min_samples > 1:
        return rows.select(
            "id", F.lit(None).cast("int").alias("cluster_id"), F.lit(True).alias("is_noise")
        )
    if not total:
        numbered = number_rows(lone, "id", "cluster_id")
        return numbered.select(
            "id", F.col("cluster_id").cast("int"), F.lit(False).alias("is_noise")
        )

    labels = _label_distinct(search, lone if min_samples == 1 else None)
    if total == search.rows:
        labelled = rows.select("id").join(labels, "id", "left")
    else:
        labels = materialize(labels, "labels")
        keyed = search.points.join(labels, "id").select("vec", "w", "cluster_id")
        copies = rows.where(has_direction("vec"))
        labelled = join_keyed(copies, keyed, "vec", "w", "id").select("id", "cluster_id")
        lone_labels = lone.join(labels, "id", "left")
        labelled = labelled.unionByName(lone_labels)
    return labelled.select("id", "cluster_id", F.col("cluster_id").isNull().alias("is_noise"))
