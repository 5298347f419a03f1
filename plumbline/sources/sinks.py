"""Where results go: text in input order, Parquet, JSON metrics."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUTPUT_NAMES = {"knn": "knn.txt", "approx_knn": "approx_knn.txt", "kmeans": "kmeans.txt"}


def lines(result: DataFrame) -> DataFrame:
    """idx and value, the line `x y z level` with coordinates as they were read."""
    texts = [F.col(f"{c}_text") if f"{c}_text" in result.columns else F.col(c).cast("string") for c in "xyz"]
    return result.select("idx", F.concat_ws(" ", *texts, F.col("new_intensity").cast("string")).alias("value"))


def write_text(result: DataFrame, path: str, one_file: bool = False) -> None:
    """A sorted folder of text files whose names are in input order; one file only where asked."""
    out = lines(result).orderBy("idx")
    (out.coalesce(1).sortWithinPartitions("idx") if one_file else out).select("value").write.mode("overwrite").text(path)


def write_parquet(result: DataFrame, path: str) -> None:
    result.write.mode("overwrite").parquet(path)


def metrics_json(metrics: dict) -> str:
    """One line of JSON, numbers with fractions to six places."""
    return json.dumps({k: round(v, 6) if isinstance(v, float) else v for k, v in metrics.items()})
