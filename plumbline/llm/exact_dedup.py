"""1. Exact dedup: stateful streaming deduplication, in DataFrame functions only.

Texts are equal when identical after each run of ASCII white space becomes one space.

1. One scan writes a log: digest (SHA-256 of the normalised text), stable identifier and
   content locator (file and row) of every row.
2. The log is streamed through a keyed aggregation whose state, in RocksDB on disk, has
   one entry per digest without expiry: the smallest identifier with its locator, and the
   number of rows. Keys combine on the map side, so a third of all rows under one digest
   reach its state as one row per task.
3. The state is read back through Spark's state data source. For digests with several rows
   (hits) the full normalised bytes are grouped again, again combined on the map side; a
   digest whose bytes differ is split by its texts.

With a state folder the rows, the log and the keyed state stay there, and a later batch meets them:
its rows are decided against all batches so far, and texts of earlier rows are fetched by their
locators. Without one the state lasts for one call.

Defined results: null text is empty text; empty texts are copies of one another; very long texts
are compared whole; a null doc_id sorts after all others; of rows that repeat a
doc_id and a text one stays, by what it holds (see `common.ties_of`) and last by its place; an empty table gives an empty result; extra columns, whatever their names, are
ignored by `decide` and kept by `dedup`. A row kept by an earlier batch is not taken back
when a later one brings a smaller doc_id; the later row is then kept as well.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import Identified, cut, delete_dir, hot_join, identified, new_dir

SPACE = r"[\x20\x09-\x0D]+"
#: The state is on disk, its memory is bounded, and many small stores do not reserve disk ahead.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "48",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # an executor closes the stores of a stream that has ended at its next maintenance; a minute later is too late for what follows
    "spark.sql.streaming.stateStore.maintenanceInterval": "5s",
}


def normalised(text) -> F.Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def digest(text) -> F.Column:
    """SHA-256; where texts should share one all the same, `_split` tells them apart."""
    return F.unhex(F.sha2(text, 256))


def _run_state(spark: SparkSession, log_dir: str, schema, state_dir: str) -> None:
    """Streams the log through the keyed state; what is new since the last run is what it reads."""
    stream = spark.readStream.schema(schema).parquet(f"{log_dir}/*").groupBy("_digest").agg(least().alias("keep"), F.count("*").alias("n"))
    old = {k: spark.conf.get(k, None) for k in STORE}
    try:
        for k, v in STORE.items():
            spark.conf.set(k, v)
        q = stream.writeStream.outputMode("update").format("noop").option("checkpointLocation", state_dir).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_state(spark: SparkSession, state_dir: str) -> DataFrame:
    """The keyed state as rows: _digest, keep (late, _id, _ta, _tb, _rf, _rr), n."""
    state = spark.read.format("statestore").load(state_dir)
    value = state.schema["value"].dataType.names
    return state.select(F.col("key")[state.schema["key"].dataType.names[0]].alias("_digest"), F.col("value")[value[0]].alias("keep"), F.col("value")[value[1]].alias("n"))




def least() -> F.Column:
    """The smallest identifier, nulls last, with its locator; of rows with one identifier the least by what they hold."""
    return F.min(F.struct((F.col("_id").isNull()).alias("late"), "_id", "_ta", "_tb", "_rf", "_rr"))


#: What a state folder knows of a file: the hash in locators, the path, and the column of texts.
FILES = "_rf long, path string, text string"


def _texts(rows: Identified, id_col: str, text_col: str) -> DataFrame:
    text = rows.df.select("_rf", "_rr", *rows.ties(), rows.col(id_col).cast("long").alias("_id"), normalised(rows.col(text_col).cast("string")).alias("_text"))
    return text.withColumn("_digest", digest(F.col("_text")))


def _earlier_texts(spark: SparkSession, state_dir: str, places: DataFrame) -> DataFrame:
    """_digest, _id, _rf, _rr, _text of rows of earlier batches (places: _digest, _id, _ta, _tb, _rf, _rr), read again by their locators."""
    places = cut(places)
    files = spark.read.schema(FILES).parquet(f"{state_dir}/files").dropDuplicates(["_rf"])
    needed = files.join(places.select("_rf").distinct(), "_rf", "left_semi").collect()  # a row per file that holds such a row
    out = spark.createDataFrame([], "_rf long, _rr long, _text string")
    for name in sorted({f["text"] for f in needed}):
        read = spark.read.parquet(*sorted(f["path"] for f in needed if f["text"] == name))
        out = out.unionByName(read.select(F.xxhash64(F.col("_metadata.file_path")).alias("_rf"), F.col("_metadata.row_index").alias("_rr"), normalised(F.col(name).cast("string")).alias("_text")))
    return places.join(out, ["_rf", "_rr"]).select("_rf", "_rr", "_ta", "_tb", "_id", "_text", "_digest")


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", state_dir: str | None = None) -> tuple[Identified, DataFrame]:
    """(rows with their identity, decisions): decisions has _rf, _rr, _id, _digest, keep, n, kept per row."""
    spark = docs.sparkSession
    base, batch = state_dir or new_dir(spark, "digests"), uuid.uuid4().hex
    rows = identified(docs, f"{base}/rows/{batch}" if state_dir else None)
    if state_dir:
        stored = F.lit(rows.place(text_col))
        rows.df.select("_rf", "_file", stored).distinct().toDF("_rf", "path", "text").write.mode("append").parquet(f"{base}/files")
    texts = _texts(rows, id_col, text_col)
    log = texts.select("_rf", "_rr", "_ta", "_tb", "_id", "_digest")
    log.write.parquet(f"{base}/log/{batch}")
    log = spark.read.schema(log.schema).parquet(f"{base}/log/{batch}")
    if log.isEmpty():
        empty = log.select("*", F.struct(F.lit(False).alias("late"), "_id", "_ta", "_tb", "_rf", "_rr").alias("keep"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("kept"))
        return rows, empty
    _run_state(spark, f"{base}/log", log.schema, f"{base}/state")
    state = cut(read_state(spark, f"{base}/state"))
    if not state_dir:
        delete_dir(spark, f"{base}/state")
    total = state.agg(F.sum("n")).first()[0]

    hits = state.filter("n > 1").select("_digest", "n")
    hit_rows = hot_join(texts, hits, ["_digest"], "n", total, ["_rf", "_rr"]).select("_digest", "_text")
    decided = hot_join(log, state, ["_digest"], "n", total, ["_rf", "_rr"])
    if state_dir:
        places = decided.filter("n > 1").groupBy("_digest").agg(F.first("keep").alias("k")).select("_digest", "k._id", "k._ta", "k._tb", "k._rf", "k._rr")
        places = places.join(log, ["_rf", "_rr"], "left_anti")
        hit_rows = hit_rows.unionByName(_earlier_texts(spark, state_dir, places).select("_digest", "_text"))
    # grouping by the text compares full bytes; one row per text and task is shuffled
    classes = hit_rows.groupBy("_digest", "_text").agg(F.count("*").alias("m"))
    split = classes.groupBy("_digest").agg(F.count("*").alias("c")).filter("c > 1").select("_digest")
    if not split.isEmpty():
        decided = _split(texts, decided, cut(split), base if state_dir else None)
    return rows, decided.withColumn("kept", F.expr("keep._rf = _rf and keep._rr = _rr"))


def _split(texts: DataFrame, decided: DataFrame, split: DataFrame, state_dir: str | None) -> DataFrame:
    """Decisions where one digest stands for several texts: those rows are grouped by the text itself."""
    own = cut(texts.join(split, "_digest", "left_semi"))
    every = own
    if state_dir:
        spark = texts.sparkSession
        log = spark.read.schema(own.select("_rf", "_rr", "_ta", "_tb", "_id", "_digest").schema).parquet(f"{state_dir}/log/*").join(split, "_digest", "left_semi")
        earlier = _earlier_texts(spark, state_dir, log.join(own, ["_rf", "_rr"], "left_anti"))
        every = every.unionByName(earlier)
    by_text = every.groupBy("_digest", "_text").agg(least().alias("keep"), F.count("*").alias("n"))
    redone = own.join(by_text, ["_digest", "_text"]).select("_digest", "_rf", "_rr", "_id", "keep", "n")
    return decided.join(split, "_digest", "left_anti").select(*redone.columns).unionByName(redone)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", state_dir: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    _, decisions = decide(docs, id_col, text_col, state_dir)
    return decisions.select(
        F.col("_id").alias("doc_id"), F.col("keep._id").alias("keep_id"), F.col("n").alias("group_size"), "kept", F.lower(F.hex("_digest")).alias("text_sha256")
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", state_dir: str | None = None) -> DataFrame:
    """docs without the rows whose text a kept row has, all columns as they were."""
    rows, decisions = decide(docs, id_col, text_col, state_dir)
    gone = decisions.filter("not kept").select("_rf", "_rr")
    return rows.restore(rows.df.join(gone, ["_rf", "_rr"], "left_anti"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP1_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS s FROM documents
), g AS (SELECT s, min(doc_id) AS keep_id, CAST(count(*) AS BIGINT) AS group_size FROM t GROUP BY s)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.s) AS text_sha256
FROM t JOIN g ON t.s = g.s
"""
