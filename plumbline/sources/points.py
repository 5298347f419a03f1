"""Where points come from: text files, the events table, a seeded generator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.runtime import global_rank
from plumbline.schema import MAX_POINTS, Params

#: Distinct coordinates of the generator run from -EXTENT to EXTENT.
EXTENT = 10_000
EVENTS_SQL = """
SELECT event_id AS idx, user_id * 7919 % 20011 - 10005 AS x, CAST(floor(value * 100) AS BIGINT) % 10007 AS y,
       event_id * 104729 % 19997 - 9998 AS z, CAST(event_id * 1299709 % 256 AS INT) AS intensity
FROM {events}
"""


def points_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point per event, in integers only; reads three columns."""
    return spark.sql(EVENTS_SQL.format(events="{e}"), e=spark.read.parquet(f"{sf_dir}/events.parquet"))


def integer_coordinate(token: str) -> F.Column:
    """A long from text such as 12, 12.0 or 1.2e1; raises for text that is no integer of 32 bits (tolerance 1e-9)."""
    v = F.expr(f"try_cast({token} AS double)")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) > 2147483648.0) | (F.abs(v - F.round(v)) > 1e-9) | (F.round(v) > 2147483647.0)
    return F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.concat(F.lit("not an integer coordinate: "), F.coalesce(F.expr(token), F.lit("missing")))).cast("long")).otherwise(F.round(v).cast("long"))


#: Lines come by file, then by split, then by their place in it.
LINE_ORDER = ("file", "block", "at")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """value and LINE_ORDER of the lines of a text file, or of a folder of files in the order of their names, that are not blank."""
    place = [F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")]
    return spark.read.text(path).select("value", *place).filter(F.trim("value") != "")


def read_points_text(spark: SparkSession, path: str, clusters: bool = False) -> tuple[DataFrame, Params, int]:
    """(points with the coordinates' text, parameters, n) from a file of `n k T` and one record per line.

    Lines are put in order by their place in the file (or folder); records after the n-th are ignored.
    Checks run on the whole file and raise ValueError (header) or fail the query (records).
    """
    lines = text_lines(spark, path)
    tokens = F.split(F.trim("value"), r"\s+")
    head = lines.orderBy(*LINE_ORDER).limit(1).select(tokens.alias("t")).collect()
    try:
        n, k, t = (int(x) for x in head[0]["t"])
    except (IndexError, ValueError) as e:
        raise ValueError(f"{path}: the first line is not n k T") from e
    params = Params(k, t)
    params.check(n, clusters, MAX_POINTS)
    body = global_rank(lines.select(*LINE_ORDER, tokens.alias("t")), *LINE_ORDER, name="place")
    body = body.select((F.col("place") - 1).alias("idx"), "t").filter(F.col("idx").between(0, n - 1))
    if body.count() < n:
        raise ValueError(f"{path}: fewer than {n} records")
    level = F.expr("try_cast(get(t, 3) AS int)")
    checked = F.when(F.coalesce((F.size("t") == 4) & level.between(0, 255), F.lit(False)), level).otherwise(F.raise_error("not a record of x y z and a level from 0 to 255").cast("int"))
    inside = F.col("idx").between(0, n - 1)  # checks may run before the other lines are left out
    checked = F.when(inside, checked)
    cols = [F.when(inside, integer_coordinate(f"get(t, {i})")).alias(c) for i, c in enumerate("xyz")]
    texts = [F.expr(f"get(t, {i})").alias(f"{c}_text") for i, c in enumerate("xyz")]
    return body.select("idx", *cols, checked.alias("intensity"), *texts), params, n


def generate_points(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """n points of distinct coordinates with uniform levels; the same for the same seed, however partitioned."""
    if not 1 <= n <= (2 * EXTENT + 1) ** 3 // 2:
        raise ValueError(f"n = {n} is out of range")
    wide = 2 * EXTENT + 1
    draw = lambda tag, of: F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(tag)), F.lit(of))
    drawn = spark.range(n + n // 10 + 64).select("id", *[(draw(c, wide) - EXTENT).alias(c) for c in "xyz"], draw("i", 256).cast("int").alias("intensity"))
    distinct = drawn.groupBy("x", "y", "z").agg(F.min("id").alias("id"), F.min_by("intensity", "id").alias("intensity"))
    return global_rank(distinct, "id", name="idx").filter(F.col("idx") < n).select("idx", "x", "y", "z", "intensity")
