"""Partition of unit vectors into cells around pivots, and of cells into blocks of bounded size.

Every vector belongs to the cell of its nearest pivot. Small neighbouring cells share a block,
a large cell is split over several. Two blocks meet when the balls around two of their cells
come within the search radius of each other; a pair of blocks meets once, in the task of one
of them, where the vectors of that block stay while the others pass.

Distances here are chords between unit vectors: chord**2 = 2 * cosine distance.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoardlens.operators import blocks
from hoardlens.operators.blocks import chords, chunk_of, slices, unit, vectors
from hoardlens.workspace import materialize

MAX_PIVOTS = 2048  # bounds the pivot matrix and the per-cell figures known to the driver
SLACK = 1e-6  # rounding allowance of chord comparisons, always on the safe side
BLOCK_BYTES = 64 << 20  # of the vectors of one block in double precision
RESIDUE = 0.5  # share of the threshold that the coordinates left out of a first product may hold


@dataclass
class Layout:
    """Blocks of the cells (at most MAX_PIVOTS cells), and which blocks meet."""

    first: np.ndarray  # first block of each cell
    parts: np.ndarray  # blocks over which the cell is spread
    ranges: list  # of each cell, the runs of blocks its own blocks meet
    blocks: int
    moved_rows: int


@dataclass
class Cells:
    """Placed vectors and one figure per cell (at most MAX_PIVOTS cells)."""

    placed: DataFrame  # id, w, vec, home, along, dense, block, ranges
    dim: int
    home_rows: np.ndarray
    dense_rows: np.ndarray
    anchor: list  # least id of a cell's dense ball, None without one
    medoids: np.ndarray
    axes: np.ndarray  # rotation that brings the widest directions first
    lead: int  # coordinates of the first product
    layout: Layout


def choose_pivots(candidates: np.ndarray, radius: float) -> np.ndarray:
    """Unit vectors of a sample of which no two are closer than half the search radius.

    The sample follows the data, the thinning keeps a crowded spot from taking all pivots.
    """
    kept: list[int] = []
    for i in range(len(candidates)):
        if not kept or chords(candidates[kept] @ candidates[i]).min() > max(radius / 2, SLACK):
            kept.append(i)
    return candidates[kept]


def principal_axes(sample: np.ndarray, threshold: float) -> tuple[np.ndarray, int]:
    """Rotation to the axes of a sample, and how many of them a first product needs.

    x.y is at most the product over the leading coordinates plus |x'||y'| over the others, so
    pairs that stay below the threshold need no more work. Any rotation and any number give
    right results; the sample only decides how many pairs are settled early.
    """
    dim = sample.shape[1]
    strength, axes = np.linalg.eigh(sample.T @ sample / len(sample))
    axes, strength = axes[:, ::-1], np.maximum(strength[::-1], 0.0)
    residue = strength.sum() - np.cumsum(strength)
    fits = np.flatnonzero(residue <= RESIDUE * max(threshold, 0.0))
    lead = int(fits[0]) + 1 if len(fits) else dim
    # A first product over most of the coordinates would save nothing.
    return axes, lead if lead <= dim // 2 else dim


def lay_out(home_rows: np.ndarray, order: np.ndarray, touching: np.ndarray, block_rows: int) -> Layout:
    """Blocks of at most about ``block_rows`` rows; cells are packed in the given order."""
    cells = len(home_rows)
    bin_of, bin_parts = np.zeros(cells, np.int64), []
    filled = block_rows + 1
    for cell in order.tolist():
        rows = int(home_rows[cell])
        if rows > block_rows or filled + rows > block_rows:
            bin_parts.append(max(1, -(-rows // block_rows)))
            filled = 0
        filled = block_rows if rows > block_rows else filled + rows
        bin_of[cell] = len(bin_parts) - 1
    parts = np.array(bin_parts, np.int64)
    first = np.cumsum(parts) - parts
    member = np.zeros((len(parts), cells), np.float32)
    member[bin_of, np.arange(cells)] = 1.0
    meet = member @ touching.astype(np.float32) @ member.T > 0
    ranges, moved = [], 0
    for own, row in enumerate(meet):
        runs: list[list[int]] = []
        for other in np.flatnonzero(row).tolist():
            start, end = int(first[other]), int(first[other] + parts[other])
            if runs and runs[-1][1] == start:
                runs[-1][1] = end
            else:
                runs.append([start, end])
        ranges.append(runs)
        met = sum(end - start for start, end in runs)
        # A block stays at home and visits about half of those it meets.
        moved += int(home_rows[bin_of == own].sum()) * (1 + (met - 1) // 2)
    return Layout(first[bin_of], parts[bin_of], [ranges[b] for b in bin_of], int(parts.sum()), moved)


def place(
    points: DataFrame,
    dim: int,
    rows: int,
    radius: float,
    threshold: float,
    min_weight: int,
    cell_rows: int,
) -> Cells:
    """Assign ``points`` (id, w, vec) to cells and blocks and find the dense ball of each cell.

    Two vectors within half the radius of one pivot are neighbours of each other. When such a
    ball weighs at least ``min_weight``, all its members are core points of one cluster and
    never need to be compared with each other, however many they are.
    """
    chosen = points.orderBy(F.xxhash64("id"), "id").limit(MAX_PIVOTS).select("vec").collect()
    sample = unit(np.array([row["vec"] for row in chosen], dtype=np.float64))
    axes, lead = principal_axes(sample, threshold)
    if len(sample) < 2 * dim:
        lead = dim  # too few vectors to tell their axes
    pivots = choose_pivots(sample[: max(1, min(rows // cell_rows, MAX_PIVOTS))], radius)
    k = len(pivots)
    ball = radius / 2 - SLACK

    def assign(batches):
        for table in slices(batches):
            units = unit(vectors(table, "vec", dim))
            gaps = chords(units @ pivots.T)
            home = gaps.argmin(axis=1)
            table = table.append_column("home", pa.array(home.astype(np.int32)))
            table = table.append_column("rho", pa.array(gaps[np.arange(len(home)), home]))
            yield from table.append_column("along", pa.array(units @ axes[:, 0])).to_batches()

    kind = points.schema["id"].dataType.simpleString()
    vec_kind = points.schema["vec"].dataType.simpleString()
    columns = f"id {kind}, w bigint, vec {vec_kind}"
    assigned = materialize(
        points.select("id", "w", "vec").mapInArrow(assign, f"{columns}, home int, rho double, along double"),
        "cells",
    )
    inside = F.col("rho") <= ball
    figures = (
        assigned.groupBy("home")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max("rho").alias("reach"),
            F.count_if(inside).alias("ball_n"),
            F.coalesce(F.sum(F.when(inside, F.col("w"))), F.lit(0)).alias("ball_w"),
            F.min(F.when(inside, F.col("id"))).alias("anchor"),
            F.min_by("vec", F.struct("rho", "id")).alias("medoid"),
        )
        .collect()
    )
    home_rows, dense_rows = np.zeros(k, np.int64), np.zeros(k, np.int64)
    reach, medoids = np.full(k, -np.inf), np.zeros((k, dim))
    anchor: list = [None] * k
    for row in figures:
        cell = row["home"]
        home_rows[cell], reach[cell] = row["n"], row["reach"]
        medoids[cell] = unit(np.array([row["medoid"]], dtype=np.float64))[0]
        if row["ball_n"] and row["ball_w"] >= min_weight:
            dense_rows[cell], anchor[cell] = row["ball_n"], row["anchor"]

    between = chords(pivots @ pivots.T)
    touching = between <= reach[:, None] + reach[None, :] + radius + SLACK
    cores = points.sparkSession.sparkContext.defaultParallelism
    most = max(1, BLOCK_BYTES // (8 * dim))
    block_rows = min(most, max(blocks.LEAST_BLOCK, -(-rows // (2 * cores))))
    layout = lay_out(home_rows, np.argsort(pivots @ axes[:, 0], kind="stable"), touching, block_rows)

    marks = [
        (c, int(layout.first[c]), int(layout.parts[c]), bool(dense_rows[c]), layout.ranges[c])
        for c in range(k)
    ]
    table = points.sparkSession.createDataFrame(
        marks, "home int, first int, parts int, has_ball boolean, ranges array<array<int>>"
    )
    placed = (
        assigned.join(F.broadcast(table), "home")
        .withColumn("dense", inside & F.col("has_ball"))
        .withColumn("block", F.col("first") + chunk_of(F.col("id"), F.col("parts"), 1))
        .drop("rho", "first", "parts", "has_ball", "ranges")
    )
    return Cells(
        materialize(placed, "placed"), dim, home_rows, dense_rows, anchor, medoids, axes, lead, layout
    )


def visits(rows: DataFrame, layout: Layout) -> DataFrame:
    """Rows (with ``home`` and ``block``) once in their own block and in each block they visit.

    Of two blocks that meet, the one with the lower number is visited when both numbers are
    even or both odd, else the other one: every pair meets once and the work is even.
    """
    spark = rows.sparkSession
    by_cell = list(enumerate(layout.ranges))
    table = spark.createDataFrame(by_cell, "home int, ranges array<array<int>>")
    met = F.flatten(F.transform("ranges", lambda r: F.sequence(r[0], r[1] - 1)))
    block = F.col("block")

    def visited(other):
        low, high = F.least(block, other), F.greatest(block, other)
        return other == F.when((block + other) % 2 == 0, low).otherwise(high)

    targets = F.filter(met, lambda other: (other == block) | visited(other))
    return (
        rows.join(F.broadcast(table), "home")
        .withColumn("target", F.explode(targets))
        .drop("ranges")
        .withColumn("visiting", F.col("target") != block)
    )
