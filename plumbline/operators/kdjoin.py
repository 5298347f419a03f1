"""Exact nearest neighbours over a k-d partition of the cloud, in two rounds.

The leaves come from a bounded sample, so they follow the density of the points: a dense clump is cut
finely and an outlier costs one wide leaf. Round one finds each query's neighbours in its own leaf. The
k-th distance bounds the ball that can hold a nearer point; round two sends a query to the other
leaves that its ball meets, if any, and only points within the ball come back. Each leaf sends k rows
per query at most. A leaf is searched by the same scheme over a tree of its own points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.runtime import cut, ship, stored

#: Points of the sample, points that a leaf should hold (in large and in small clouds: of larger leaves fewer queries look
#: beyond their own), and leaves at most (a tree of some MB on the driver and each worker).
SAMPLE, LEAF, SMALL_LEAF, LEAVES = 65_536, 32_768, 4096, 16_384
#: Points of the leaves within a task's tree, and queries whose distances are held at once.
INNER, ROWS = 512, 256
#: Coordinates may span so much: squared distances are 64-bit integers.
SPAN = 1_750_000_000
_FAR = np.int64(1) << 40
_NEAR = "array<struct<d2:bigint,x:bigint,y:bigint,z:bigint,idx:bigint,intensity:int>>"
_FOUND = f"qi long, qx long, qy long, qz long, qintensity int, r2 long, near {_NEAR}, leaves array<int>"


class Tree:
    """Splits of integer points by the median of the widest axis: left below the value, right from it on."""

    def __init__(self, points: np.ndarray, size: float):
        self.axis, self.value, self.child, self.lo, self.hi, self.leaf = [], [], [], [], [], []
        self.leaves: list[int] = []
        self._grow(points, size, np.full(3, -_FAR), np.full(3, _FAR))
        self.axis, self.value, self.child, self.lo, self.hi, self.leaf = (np.array(x) for x in (self.axis, self.value, self.child, self.lo, self.hi, self.leaf))

    def _grow(self, points: np.ndarray, size: float, lo: np.ndarray, hi: np.ndarray) -> int:
        todo = [(points, lo, hi, -1, 0)]
        while todo:
            points, lo, hi, parent, side = todo.pop()
            me = len(self.axis)
            if parent >= 0:
                self.child[parent][side] = me
            axis, value = 0, 0
            split = len(points) > size
            if split:
                spans = points.max(0) - points.min(0)
                axis = int(spans.argmax())
                along = points[:, axis]
                value = int(np.partition(along, len(along) // 2)[len(along) // 2])
                if value == along.min():  # half of the points share the least coordinate: those go left alone
                    value += 1
                split = spans[axis] > 0
            self.axis.append(axis)
            self.value.append(value)
            self.child.append([-1, -1])
            self.lo.append(lo)
            self.hi.append(hi)
            self.leaf.append(-1 if split else len(self.leaves))
            if not split:
                self.leaves.append(me)
                continue
            below = along < value
            for side, mine in ((0, below), (1, ~below)):
                low, high = lo.copy(), hi.copy()
                if side:
                    low[axis] = value
                else:
                    high[axis] = value - 1
                todo.append((points[mine], low, high, me, side))
        return 0

    def locate(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        node = np.zeros(len(points), np.int64)
        rows = np.arange(len(points))
        while len(rows):
            at = node[rows]
            rows, at = rows[self.leaf[at] < 0], at[self.leaf[at] < 0]
            node[rows] = self.child[at, (points[rows, self.axis[at]] >= self.value[at]).astype(np.int64)]
        return self.leaf[node]

    def touching(self, points: np.ndarray, r2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, leaf) for all leaves that the balls around the points meet; a negative r2 is no bound."""
        row, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        found = []
        while len(row):
            near = (r2[row] < 0) | (self.gap(points[row], node) <= r2[row])
            row, node = row[near], node[near]
            done = self.leaf[node] >= 0
            found.append((row[done], self.leaf[node[done]]))
            row, node = row[~done], node[~done]
            row, node = np.concatenate([row, row]), np.concatenate([self.child[node, 0], self.child[node, 1]])
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (row, node)

    def around(self, cells: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """(cell, leaf) for all leaves with a cell at most reach away along each axis, in a tree of cells."""
        row, node = np.arange(len(cells)), np.zeros(len(cells), np.int64)
        found = []
        while len(row):
            done = self.leaf[node] >= 0
            found.append((row[done], self.leaf[node[done]]))
            row, node = row[~done], node[~done]
            along, value = cells[row, self.axis[node]], self.value[node]
            left, right = along - reach < value, along + reach >= value
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([self.child[node[left], 0], self.child[node[right], 1]])
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (row, node)

    def gap(self, points: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Squared distance from points to the nodes' boxes."""
        out = np.maximum(np.maximum(self.lo[node] - points, points - self.hi[node]), 0)
        return (out * out).sum(-1)


def nearest(q: np.ndarray, qi: np.ndarray, p: np.ndarray, pi: np.ndarray, k: int, r2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, d2): each query's points within r2 (negative: any) that are among its k nearest or tie with the k-th."""
    out = []
    for lo in range(0, len(q), ROWS):
        d2 = np.zeros((min(ROWS, len(q) - lo), len(p)), np.int64)
        for a in range(3):
            d = q[lo : lo + ROWS, a, None] - p[None, :, a]
            d2 += d * d
        d2[qi[lo : lo + ROWS, None] == pi[None, :]] = np.iinfo(np.int64).max
        most = np.where(r2[lo : lo + ROWS] < 0, np.iinfo(np.int64).max - 1, r2[lo : lo + ROWS])
        if len(p) > k:
            most = np.minimum(most, np.partition(d2, k - 1, axis=1)[:, k - 1])
        row, col = np.nonzero(d2 <= np.minimum(most, np.iinfo(np.int64).max - 1)[:, None])
        out.append((row + lo, col, d2[row, col]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def first_k(row: np.ndarray, col: np.ndarray, d2: np.ndarray, p: np.ndarray, pi: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k first of each query, in the neighbours' order."""
    order = np.lexsort((pi[col], p[col, 2], p[col, 1], p[col, 0], d2, row))
    row, col, d2 = row[order], col[order], d2[order]
    first = np.searchsorted(row, row)
    kept = np.arange(len(row)) - first < k
    return row[kept], col[kept], d2[kept]


def search(q: np.ndarray, qi: np.ndarray, p: np.ndarray, pi: np.ndarray, k: int, r2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, d2) of the k nearest within r2, in order, for queries and points of any number."""
    if not len(q) or not len(p):
        return (np.zeros(0, np.int64),) * 3
    if len(p) <= 2 * INNER:
        return first_k(*nearest(q, qi, p, pi, k, r2), p, pi, k)
    # at one place only the k + 1 points of the smallest numbers can be anyone's neighbours
    order = np.lexsort((pi, p[:, 2], p[:, 1], p[:, 0]))
    new = np.ones(len(p), bool)
    new[1:] = (p[order][1:] != p[order][:-1]).any(1)
    start = np.maximum.accumulate(np.where(new, np.arange(len(p)), 0))
    used = order[np.arange(len(p)) - start <= k]
    tree = Tree(p[used], INNER)
    place = tree.locate(p[used])
    by = np.argsort(place, kind="stable")
    edge = np.searchsorted(place[by], np.arange(len(tree.leaves) + 1))
    own = tree.locate(q)
    asked = np.argsort(own, kind="stable")
    out = []
    for leaf in np.unique(own).tolist():
        mine = asked[slice(*np.searchsorted(own[asked], [leaf, leaf + 1]))]
        here = used[by[edge[leaf] : edge[leaf + 1]]]
        row, col, d2 = nearest(q[mine], qi[mine], p[here], pi[here], k, r2[mine])
        row, col, d2 = first_k(row, here[col], d2, p, pi, k)
        found = np.bincount(row, minlength=len(mine))
        bound = r2[mine].copy()
        full = np.flatnonzero(found >= k)
        last = d2[np.searchsorted(row, full, "right") - 1]
        bound[full] = np.where(bound[full] < 0, last, np.minimum(bound[full], last))
        rows, cols, far = [row], [col], [d2]
        query, other = tree.touching(q[mine], bound)
        query, other = query[other != leaf], other[other != leaf]
        by_leaf = np.argsort(other, kind="stable")
        for x in np.unique(other).tolist():
            some = query[by_leaf[slice(*np.searchsorted(other[by_leaf], [x, x + 1]))]]
            there = used[by[edge[x] : edge[x + 1]]]
            i, j, d = nearest(q[mine[some]], qi[mine[some]], p[there], pi[there], k, bound[some])
            rows.append(some[i])
            cols.append(there[j])
            far.append(d)
        row, col, d2 = first_k(np.concatenate(rows), np.concatenate(cols), np.concatenate(far), p, pi, k)
        out.append((mine[row], col, d2))
    row, col, d2 = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(row, kind="stable")
    return row[order], col[order], d2[order]


def _columns(table: pa.Table, names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy() for n in names.split()]


def knn_kd(points: DataFrame, k: int, queries: DataFrame) -> DataFrame:
    """qi, qintensity, rank, idx, d2, intensity: the k nearest points of each query (qi, qx, qy, qz, qintensity)."""
    return listed(knn_lists(points, k, queries))


def listed(lists: DataFrame) -> DataFrame:
    """A row per neighbour of rows of qi, qintensity, near."""
    near = lists.select("qi", "qintensity", F.posexplode("near").alias("rank", "n"))
    return near.select("qi", "qintensity", (F.col("rank") + 1).alias("rank"), "n.idx", "n.d2", "n.intensity")


def knn_lists(points: DataFrame, k: int, queries: DataFrame) -> DataFrame:
    """qi, qintensity, near: a row per query with its k nearest points (idx, d2, intensity) in order."""
    spark = points.sparkSession
    ship(spark)
    points = points.select("idx", *[F.col(c).cast("long").alias(c) for c in "xyz"], F.col("intensity").cast("int").alias("intensity"))
    queries = queries.select("qi", *[F.col(f"q{c}").cast("long").alias(f"q{c}") for c in "xyz"], F.col("qintensity").cast("int").alias("qintensity"))
    row = points.agg(F.count("*"), *[f(c) for c in "xyz" for f in (F.min, F.max)]).first()
    n = row[0]
    if n and max(row[2 + 2 * i] - row[1 + 2 * i] for i in range(3)) > SPAN:
        raise ValueError(f"coordinates span more than {SPAN}")
    step = max(1, -(-n // SAMPLE))
    chosen = points.filter(F.pmod(F.xxhash64("idx"), F.lit(step)) == 0).select("x", "y", "z").toArrow()  # about SAMPLE rows at most
    sample = np.stack(_columns(chosen, "x y z"), axis=1) if chosen.num_rows else np.zeros((0, 3), np.int64)
    tree = spark.sparkContext.broadcast(Tree(sample, max(1.0, len(sample) / min(LEAVES, max(1, -(-n // min(LEAF, max(SMALL_LEAF, n // 128))))))))
    leaves = len(tree.value.leaves)

    def located(df: DataFrame, names: str) -> DataFrame:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = tree.value.locate(np.stack([batch.column(c).to_numpy() for c in names.split()], axis=1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], names=[*batch.schema.names, "leaf"])

        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
        return df.mapInArrow(add, f"{fields}, leaf int")

    placed = cut(located(points, "x y z"))

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        qi, *q = _columns(left, "qi qx qy qz")
        pi, *p, level = _columns(right, "idx x y z intensity")
        q, p = np.stack(q, axis=1), np.stack(p, axis=1)
        r2 = left.column("r2").to_numpy()
        row, col, d2 = search(q, qi, p, pi, k, r2)
        found = np.bincount(row, minlength=len(q))
        own = left.column("leaf").to_numpy()
        offsets = np.concatenate([[0], np.cumsum(found)])
        bound = np.where(found >= k, d2[np.maximum(offsets[1:] - 1, 0)] if len(d2) else -1, -1) if len(q) else r2
        first = left.column("first").to_numpy(zero_copy_only=False).astype(bool)
        query, leaf = tree.value.touching(q[first], bound[first])
        query = np.flatnonzero(first)[query]
        other = leaf != own[query]
        query, leaf = query[other], leaf[other]
        by = np.argsort(query, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(query, minlength=len(q)))])
        away = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(leaf[by].astype(np.int32)))
        alone = first & (np.diff(ends) == 0)  # the order of these is settled: no coordinates
        near = pa.StructArray.from_arrays([pa.array(d2), *(pa.array(p[col, a], mask=alone[row]) for a in range(3)), pa.array(pi[col]), pa.array(level[col])], names=["d2", "x", "y", "z", "idx", "intensity"])
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), near)
        cols = [left.column(c) for c in ("qi", "qx", "qy", "qz", "qintensity")]
        return pa.table([*cols, pa.array(bound), lists, away], names=["qi", "qx", "qy", "qz", "qintensity", "r2", "near", "leaves"])

    def joined(asked: DataFrame) -> DataFrame:
        return asked.groupBy("leaf").cogroup(placed.groupBy("leaf")).applyInArrow(look, _FOUND)

    asked = located(queries, "qx qy qz").select("*", F.lit(-1).cast("long").alias("r2"), F.lit(True).alias("first"))
    first = stored(joined(asked))
    plain = lambda near: F.transform(near, lambda n: F.struct(n["idx"].alias("idx"), n["d2"].alias("d2"), n["intensity"].alias("intensity")))
    settled = first.filter(F.size("leaves") == 0).select("qi", "qintensity", plain(F.col("near")).alias("near"))
    if leaves == 1:
        return settled
    open_ = first.filter(F.size("leaves") > 0)
    again = joined(open_.select("qi", "qx", "qy", "qz", "qintensity", F.explode("leaves").alias("leaf"), "r2", F.lit(False).alias("first")))
    both = open_.select("qi", "qintensity", "near").unionByName(again.filter(F.size("near") > 0).select("qi", "qintensity", "near"))
    # the structs' fields are in the order of NEIGHBOUR_ORDER
    merged = both.groupBy("qi", "qintensity").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    return settled.unionByName(merged.select("qi", "qintensity", plain(F.col("near")).alias("near")))
