"""Checkpoints in the folder that the cluster shares, ranks over many tasks, and this package's sources for executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: list[str] = []
_shipped: set[str] = set()


def _folder(spark: SparkSession) -> str:
    """The folder of checkpoints: in spark.checkpoint.dir, or one of ours where that is unset.

    Ours is on this machine, so it is made for a local master only; a cluster has to name its shared folder.
    """
    if not spark.sparkContext.getCheckpointDir():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
            if not _own:
                _own.append(tempfile.mkdtemp(prefix="plumbline-"))
                atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
            at = "file://" + _own[0]
        spark.sparkContext.setCheckpointDir(at)
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written once as a checkpoint."""
    _folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written once as Parquet beside the checkpoints: lists take a third of a checkpoint's room, and what
    reads them takes the columns that it needs. The folder goes when the application ends."""
    spark = df.sparkSession
    at = f"{_folder(spark)}/stored-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def ship(spark: SparkSession) -> None:
    """Sends this package's sources to the executors once per application, for operators that run Python there."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    made = Path(tempfile.mkdtemp(prefix="plumbline-core-"))
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    with zipfile.ZipFile(made / "plumbline-core.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(made / "plumbline-core.zip"))
    _shipped.add(app)


def global_rank(df: DataFrame, *order: str, name: str = "pos") -> DataFrame:
    """Zero-based position in a total order: a distributed sort, and the tasks' row counts before each task."""
    ordered = cut(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    parts = ordered.groupBy(part.alias("_p")).agg(F.count("*").alias("_c"))
    before = parts.select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_b"))  # a row per task
    ranked = ordered.withColumn("_p", part).join(F.broadcast(before), "_p")
    return ranked.withColumn(name, F.col("_b") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m", "_p", "_b")
