"""Differences of two results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

APPROX_MAE = 3.0


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: mae, max_abs_error, mismatch_count of new_intensity, joined by ordinal with equal coordinates.

    Rows that one side lacks, or whose coordinates differ, fail the query.
    """
    other = b.select("idx", *[F.col(c).alias(f"_{c}") for c in "xyz"], F.col("new_intensity").alias("_new"))
    both = a.join(other, "idx", "full")
    same = F.col("_new").isNotNull() & F.col("new_intensity").isNotNull() & (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y")) & (F.col("z") == F.col("_z"))
    e = F.when(F.coalesce(same, F.lit(False)), F.abs(F.col("new_intensity") - F.col("_new"))).otherwise(F.raise_error("the results are of different points").cast("int"))
    both = both.select(e.alias("e"))
    return both.agg(F.coalesce(F.avg("e"), F.lit(0.0)).alias("mae"), F.coalesce(F.max("e"), F.lit(0)).alias("max_abs_error"), F.count_if(F.col("e") != 0).alias("mismatch_count"))
