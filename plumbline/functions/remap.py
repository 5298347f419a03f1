"""Histogram equalization of an 8-bit level, in exact integers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def remap(level: Column, m: Column, at_least: Column, up_to: Column) -> Column:
    """New level from the neighbourhood's size m, its count at the lowest level and its count up to the centre's level."""
    scaled = F.call_function("div", (up_to - at_least) * 255, m - at_least)
    return F.when(m == at_least, level).otherwise(F.greatest(F.lit(0), F.least(F.lit(255), scaled))).cast("int")


def div(a: Column, b: Column) -> Column:
    """Integer division that truncates toward zero."""
    return F.call_function("div", a, b)


def remap_from_array(level: Column, levels: Column, m: Column | None = None) -> Column:
    """New level from the array of the neighbours' levels; the centre's own level is added."""
    every = F.concat(levels, F.array(level))
    low = F.array_min(every)
    count = lambda test: F.size(F.filter(every, test)).cast("long")
    size = F.size(every).cast("long") if m is None else m
    return remap(level, size, count(lambda v: v == low), count(lambda v: v <= level))


def level_table(points: DataFrame, group: str) -> DataFrame:
    """group, intensity, cnt, cdf, cdf_min, m, new_intensity: each group's histogram with its remapping."""
    hist = points.groupBy(group, "intensity").agg(F.count("*").alias("cnt"))
    upward = Window.partitionBy(group).orderBy("intensity").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(group)
    table = hist.select(
        group, "intensity", "cnt", F.sum("cnt").over(upward).alias("cdf"), F.first("cnt").over(upward).alias("cdf_min"), F.sum("cnt").over(whole).alias("m")
    )
    return table.withColumn("new_intensity", remap(F.col("intensity"), F.col("m"), F.col("cdf_min"), F.col("cdf")))
