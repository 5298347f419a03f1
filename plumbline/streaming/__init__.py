"""Structured Streaming entry points for point clouds.

A stream of points can be equalized against level tables that a batch run has made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.kmeans import Centroid, assign


def equalize_stream(stream: DataFrame, centroids: list[Centroid], table: DataFrame) -> DataFrame:
    """A stream of points with cluster and new_intensity, from fixed centroids and their level table (256 rows each at most)."""
    known = table.select("cluster", "intensity", "new_intensity")
    return assign(stream, centroids).join(known, ["cluster", "intensity"], "left").withColumn("new_intensity", F.coalesce("new_intensity", "intensity"))
