"""A training corpus from documents: stages that each read what their predecessor wrote.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame. All but the last return the columns of docs. `run` writes each stage as Parquet
in the shared folder and reads it again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import bpe, exact_dedup, jaccard_join, mixing, quality
from plumbline.llm.common import delete_dir, new_dir, release


#: Documents that go to Python at a time, so that a worker's memory does not depend on Spark's default of ten thousand.
ARROW_ROWS = 1000


def _bounded(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    _bounded(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays."""
    return exact_dedup.dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one stays."""
    _bounded(spark)
    return jaccard_join.one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that a document is taken."""
    return mixing.mix(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and digests."""
    _bounded(spark)
    return bpe.encode_decode(docs, bpe.tokenizer_path(), ids=True)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("bpe", tokens_stage),
]

#: Near duplicates and BPE cannot be expressed in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from the documents of sf_dir."""
    docs, old = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        at = new_dir(spark, f"stage-{name}")
        out.write.parquet(at)
        docs = spark.read.schema(out.schema).parquet(at)
        if old:
            delete_dir(spark, old)
        old = at
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
