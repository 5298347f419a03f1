"""The point schema and the parameters of a run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

POINT_SCHEMA = T.StructType(
    [
        T.StructField("idx", T.LongType(), False),
        T.StructField("x", T.LongType(), False),
        T.StructField("y", T.LongType(), False),
        T.StructField("z", T.LongType(), False),
        T.StructField("intensity", T.IntegerType(), False),
    ]
)
LEVELS = 256
MAX_POINTS, MAX_K, MAX_T = 100_000, 128, 50


@dataclass(frozen=True)
class Params:
    """k neighbours or clusters and T assignment steps; n is checked where a file states it."""

    k: int
    t: int = 1

    def check(self, n: int, clusters: bool = False, limit: int | None = None) -> None:
        """Raises ValueError outside the allowed ranges: k < n for neighbours, k <= n for clusters."""
        if n < 1 or (limit is not None and n > limit):
            raise ValueError(f"n = {n} is out of range")
        if not 1 <= self.k <= MAX_K:
            raise ValueError(f"k = {self.k} is out of range")
        if not 1 <= self.t <= MAX_T:
            raise ValueError(f"T = {self.t} is out of range")
        if self.k > n or (self.k == n and not clusters):
            raise ValueError(f"k = {self.k} needs more than {n} points")


@dataclass(frozen=True)
class ApproxConfig:
    """Shell search: radii tried in turn while there are fewer than ceil(ratio * k) candidates."""

    second: bool = True
    third: bool = True
    second_ratio: tuple[int, int] = (5, 4)
    third_ratio: tuple[int, int] = (5, 4)
