"""Neighbours among the points of bounded shells of grid cells, by leaves of a tree of cells.

The leaves come from a bounded sample of the points' cells, so they follow the density. A leaf holds whole
cells; its task gets the points of its cells and of the cells at most REACH away, counts the candidates of each of
its cells and searches them there. So no pair of points and no row per cell looked at is shuffled: a point goes
to its own leaf and to those that it is near to. A leaf of dense cells alone, whose queries look at
their own cell only, gets no others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.geometry import cells, threshold
from plumbline.functions.runtime import ship
from plumbline.operators.kdjoin import LEAVES, SAMPLE, Tree, first_k, search
from plumbline.schema import ApproxConfig

#: Cells away that are looked at, and points that a leaf should hold, in large and in small clouds.
REACH, LEAF, SMALL_LEAF = 2, 16_384, 1024
#: Distances held at once.
PAIRS = 1 << 19
_STEPS = np.stack(np.meshgrid(*[np.arange(-REACH, REACH + 1)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
_RING = np.abs(_STEPS).max(1)
_NEAR = "array<struct<idx:bigint,d2:bigint,intensity:int>>"
FOUND = f"qi long, qx long, qy long, qz long, qintensity int, radius int, found long, fallback boolean, near {_NEAR}"


def cell_of(points: np.ndarray, size: float) -> np.ndarray:
    """As geometry.cell."""
    return np.floor(points.astype(np.float64) * (1.0 / size)).astype(np.int64)


class Grid:
    """Points by cell: `points` are places in the order of their cells, cell c has those from start[c] to start[c + 1]."""

    def __init__(self, cell: np.ndarray):
        self.axes = [np.unique(cell[:, a], return_inverse=True) for a in range(3)]
        names = [a[0] for a in self.axes]
        key = self._key([a[1].astype(np.int64) for a in self.axes])
        self.points = np.argsort(key, kind="stable")
        self.keys, first = np.unique(key[self.points], return_index=True)
        self.start = np.append(first, len(key))
        self.cells = cell[self.points[first]]
        self.names = names

    def _key(self, place: list[np.ndarray]) -> np.ndarray:
        return (place[0] * len(self.axes[1][0]) + place[1]) * len(self.axes[2][0]) + place[2]

    def find(self, cell: np.ndarray) -> np.ndarray:
        """The number of each cell, -1 where it holds no point."""
        place, there = [], np.ones(len(cell), bool)
        for a in range(3):
            at = np.minimum(np.searchsorted(self.names[a], cell[:, a]), len(self.names[a]) - 1)
            there &= self.names[a][at] == cell[:, a]
            place.append(at)
        key = self._key(place)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(there & (self.keys[at] == key), at, -1)

    def of(self, cells: np.ndarray) -> np.ndarray:
        """The places of the points of the cells."""
        n = self.start[cells + 1] - self.start[cells]
        return self.points[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[cells], n)]


def _block(q: np.ndarray, qi: np.ndarray, qc: np.ndarray, p: np.ndarray, pi: np.ndarray, pc: np.ndarray, k: int, rings: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, d2) of points in cells of the rings that are among the k nearest or tie with the k-th."""
    far, out = np.iinfo(np.int64).max, []
    step = max(1, PAIRS // max(1, len(p)))
    for lo in range(0, len(q), step):
        d2 = np.zeros((min(step, len(q) - lo), len(p)), np.int64)
        ring = np.zeros(d2.shape, np.int64)
        for a in range(3):
            d = q[lo : lo + step, a, None] - p[None, :, a]
            d2 += d * d
            np.maximum(ring, np.abs(qc[lo : lo + step, a, None] - pc[None, :, a]), out=ring)
        d2[~rings[np.minimum(ring, REACH + 1)] | (qi[lo : lo + step, None] == pi[None, :])] = far
        most = np.full(len(d2), far - 1)
        if len(p) > k:
            most = np.minimum(most, np.partition(d2, k - 1, axis=1)[:, k - 1])
        row, col = np.nonzero(d2 <= most[:, None])
        out.append((row + lo, col, d2[row, col]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def look(q: np.ndarray, qi: np.ndarray, p: np.ndarray, pi: np.ndarray, size: float, k: int, config: ApproxConfig) -> tuple[np.ndarray, ...]:
    """(radius, found, fallback of each query; query, point, d2 of the neighbours of those that do not fall back, in order).

    The queries are among the points.
    """
    cell, own_cell = cell_of(p, size), cell_of(q, size)
    grid = Grid(cell)
    own = grid.find(own_cell)
    asked, query_cell = np.unique(own, return_inverse=True)
    by = np.argsort(query_cell, kind="stable")
    edge = np.searchsorted(query_cell[by], np.arange(len(asked) + 1))
    beside = np.stack([grid.find(grid.cells[asked] + s) for s in _STEPS], axis=1)
    counts = np.where(beside >= 0, np.diff(grid.start)[beside], 0)
    r0, r1, r2 = (counts[:, _RING == r].sum(1) for r in range(3))
    c0 = r0 - 1
    go1 = c0 < threshold(k, config.second_ratio) if config.second else np.zeros(len(asked), bool)
    c1 = c0 + np.where(go1, r1, 0)
    go2 = c1 < threshold(k, config.third_ratio) if config.third else np.zeros(len(asked), bool)
    found = c1 + np.where(go2, r2, 0)
    radius, fallback = np.where(go2, 2, np.where(go1, 1, 0)), found < k
    out = [(np.zeros(0, np.int64),) * 3]
    dense = ~go1 & ~go2 & ~fallback
    for c in np.flatnonzero(dense).tolist():
        mine, here = by[edge[c] : edge[c + 1]], grid.of(asked[c : c + 1])
        row, col, d2 = search(q[mine], qi[mine], p[here], pi[here], k, np.full(len(mine), -1))
        out.append((mine[row], here[col], d2))
    # cells of one block of two along each axis are searched together
    open_ = np.flatnonzero(~dense & ~fallback)
    block = np.column_stack([grid.cells[asked[open_]] // 2, go1[open_], go2[open_]])
    order = np.lexsort(block.T[::-1])
    open_, block = open_[order], block[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(block)), bool), (block[1:] != block[:-1]).any(1)]))
    for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(open_)][: len(first)], strict=True):
        some = open_[lo:hi]
        rings = np.array([True, go1[some[0]], go2[some[0]], False])
        there = np.unique(beside[some][:, rings[_RING]])
        here = grid.of(there[there >= 0])
        mine = np.concatenate([by[edge[c] : edge[c + 1]] for c in some.tolist()])
        row, col, d2 = _block(q[mine], qi[mine], own_cell[mine], p[here], pi[here], cell[here], k, rings)
        out.append((mine[row], here[col], d2))
    near = first_k(*(np.concatenate(x) for x in zip(*out, strict=True)), p, pi, k)
    return radius[query_cell], found[query_cell], fallback[query_cell], *near


def shells(points: DataFrame, k: int, size: float, config: ApproxConfig) -> DataFrame:
    """FOUND: a row per point. near has the k nearest candidates in order, or nothing where there are fewer than k."""
    spark = points.sparkSession
    ship(spark)
    points = points.select("idx", *[F.col(c).cast("long").alias(c) for c in "xyz"], F.col("intensity").cast("int").alias("intensity"))
    n = points.count()
    step = max(1, -(-n // SAMPLE))
    grid = points.withColumns(cells(size))
    chosen = grid.filter(F.pmod(F.xxhash64("idx"), F.lit(step)) == 0).select("cx", "cy", "cz").toArrow()  # about SAMPLE rows at most
    sample = np.stack([chosen.column(c).to_numpy() for c in ("cx", "cy", "cz")], axis=1) if chosen.num_rows else np.zeros((0, 3), np.int64)
    leaf = min(LEAF, max(SMALL_LEAF, -(-n // 64)))
    tree = spark.sparkContext.broadcast(Tree(sample, max(1.0, len(sample) / min(LEAVES, max(1, -(-n // leaf))))))

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = tree.value.locate(np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), batch.column(3)], names=["leaf", "n"])

    # leaves without a query that looks beyond its own cell: at most LEAVES rows
    most = max(threshold(k, config.second_ratio) if config.second else 0, threshold(k, config.third_ratio) if config.third else 0)
    counted = grid.groupBy("cx", "cy", "cz").agg(F.count("*").alias("n")).mapInArrow(located, "leaf int, n long")
    closed = counted.groupBy("leaf").agg(F.min("n").alias("m")).filter(F.col("m") > most).select("leaf").toArrow().column("leaf").to_numpy()
    closed = spark.sparkContext.broadcast(closed)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                batch = whole.slice(lo, 2000)
                cell = cell_of(np.stack([batch.column(i).to_numpy() for i in range(1, 4)], axis=1), size)
                home = tree.value.locate(cell)
                row, leaf = tree.value.around(cell, REACH)
                own = leaf == home[row]
                kept = own | ~np.isin(leaf, closed.value)
                row, leaf, own = row[kept], leaf[kept], own[kept]
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in batch.columns), pa.array(leaf.astype(np.int32)), pa.array(own)], names=[*batch.schema.names, "leaf", "own"])

    def answer(table: pa.Table) -> pa.Table:
        own = table.column("own").to_numpy(zero_copy_only=False).astype(bool)
        pi, level = table.column("idx").to_numpy(), table.column("intensity").to_numpy()
        p = np.stack([table.column(c).to_numpy() for c in "xyz"], axis=1)
        q, qi = p[own], pi[own]
        if len(q):
            radius, found, fallback, row, col, d2 = look(q, qi, p, pi, size, k, config)
        else:
            radius, found, fallback, row, col, d2 = (np.zeros(0, t) for t in (np.int32, np.int64, bool, np.int64, np.int64, np.int64))
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(q)))])
        near = pa.StructArray.from_arrays([pa.array(pi[col]), pa.array(d2), pa.array(level[col])], names=["idx", "d2", "intensity"])
        cols = [pa.array(qi), *(pa.array(q[:, a]) for a in range(3)), pa.array(level[own]), pa.array(radius.astype(np.int32)), pa.array(found.astype(np.int64)), pa.array(fallback)]
        return pa.table([*cols, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), near)], names=["qi", "qx", "qy", "qz", "qintensity", "radius", "found", "fallback", "near"])

    return points.mapInArrow(deal, "idx long, x long, y long, z long, intensity int, leaf int, own boolean").groupBy("leaf").applyInArrow(answer, FOUND)
