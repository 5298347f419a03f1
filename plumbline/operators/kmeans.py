"""Integer K-means: seeds are the first k points, means truncate toward zero, ties go to the smallest coordinates.

A step is one scan with a partial and final aggregate; at most 128 centroids reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.remap import div
from plumbline.functions.runtime import cut
from plumbline.schema import Params


@dataclass(frozen=True)
class Centroid:
    c: int
    x: int
    y: int
    z: int


def seeds(points: DataFrame, k: int) -> list[Centroid]:
    rows = points.filter(F.col("idx") < k).select("idx", "x", "y", "z").collect()
    return sorted((Centroid(*r) for r in rows), key=lambda s: s.c)


def _cluster(centroids: list[Centroid]) -> Column:
    """The least of (distance, coordinates, number) over the centroids, in plain arithmetic."""
    order = sorted(centroids, key=lambda s: (s.x, s.y, s.z, s.c))
    far = [sum(((F.col(a) - F.lit(v).cast("long")) * (F.col(a) - F.lit(v).cast("long")) for a, v in zip("xyz", (s.x, s.y, s.z), strict=True)), F.lit(0).cast("long")) for s in order]
    best = F.least(*[F.struct(d.alias("d2"), F.lit(i).alias("i"), F.lit(s.c).cast("long").alias("c")) for i, (d, s) in enumerate(zip(far, order, strict=True))]) if len(order) > 1 else None
    return F.lit(order[0].c).cast("long") if best is None else best["c"]


def assign(points: DataFrame, centroids: list[Centroid]) -> DataFrame:
    """points with `cluster`, without a join."""
    return points.withColumn("cluster", _cluster(centroids))


def update(assigned: DataFrame, old: list[Centroid]) -> list[Centroid]:
    """Means of the clusters; an empty cluster keeps its centroid."""
    rows = assigned.groupBy("cluster").agg(*[div(F.sum(a), F.count("*")).alias(a) for a in "xyz"]).collect()
    new = {r["cluster"]: Centroid(r["cluster"], r["x"], r["y"], r["z"]) for r in rows}
    return [new.get(s.c, s) for s in old]


def changed_counts(points: DataFrame, history: list[list[Centroid]]) -> list[int]:
    """How many points each assignment step moved to another cluster (the first moves all): one aggregation over the steps' centroids."""
    moved = [F.count_if(_cluster(a) != _cluster(b)) for a, b in zip(history[:-1], history[1:], strict=True)]
    return list(points.agg(F.count("*"), *moved).first())


@dataclass(frozen=True)
class Clustering:
    """The points with `cluster` of the last assignment, the centroids after the last update, the assignment steps, and the
    centroids that each step assigned by."""

    assigned: DataFrame
    centroids: list[Centroid]
    steps: int
    history: list[list[Centroid]]


def kmeans(points: DataFrame, k: int, t: int) -> Clustering:
    """At most t assignment steps; one that changes no point is the last.

    Steps go on until the means repeat, as the next assignment then repeats as well; whether the last one
    already changed nothing is counted once.
    """
    coordinates = cut(points.select("x", "y", "z"))  # read in each step
    Params(k, t).check(coordinates.count(), clusters=True)
    history = [seeds(points, k)]
    while True:
        new = update(assign(coordinates, history[-1]), history[-1])
        if new == history[-1] and len(history) < t and (len(history) == 1 or changed_counts(coordinates, history[-2:])[1]):
            history.append(new)  # the step that changes nothing
        if new == history[-1] or len(history) == t:
            return Clustering(assign(points, history[-1]), new, len(history), history)
        history.append(new)
