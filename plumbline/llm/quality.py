"""9. Quality classifier: hierarchical empirical Bayes over documents, paths and hosts.

1. Document evidence. A ridge logistic regression learned from labels: shares of hashed character
   trigrams (letters, digits and blanks as classes, other characters as they are), how often a word
   repeats the one before, the share of different words, and the length. It is fitted by Newton steps
   on the driver, on at most `sample_rows` labelled rows (a documented bound: those with the
   smallest hashes of their ids), and goes to the executors as some thousand numbers.
2. Sites. Each host (here `source`) and path below it (here `lang` of a source) gets a
   posterior mean of quality from grouped sums of the evidence over all documents. A
   path shrinks toward its host and a host toward the global mean, with prior strengths
   estimated from the spread between sites by the method of moments, so that sparse
   sites say little.
3. A document's posterior log-odds are its evidence plus the path's posterior log-odds,
   relative to the global prior. Documents below `cut` are rejected.

`score` reads the texts once and writes the evidence without them; `keep_good` computes it a second
time, which is cheaper than carrying whole rows through a shuffle. The sums combine on the map side (a
host with a third of all rows sends a row per task); site tables reach the documents by a broadcast of
checked size, or a shuffle join whose hot keys are salted.

Defined results: null text is empty text; very long texts are read whole, one at a time; null hosts
and paths are sites of their own; a label without a document or with a null is ignored, repeated
labels count with their mean, of documents that repeat a labelled doc_id the one with the least
hash of its text is learned; with no labels of both kinds every document is kept at the prior 0.5; an
empty table gives an empty result; extra columns, whatever their names, are ignored by `score` and
kept by `keep_good`.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import cut as checkpointed
from plumbline.llm.common import hot_join, identified, new_dir, ship
from plumbline.llm.shingles import give_back, in_chunks, let_go, word_hashes

#: Buckets of hashed character trigrams, and the other features.
TRIGRAMS, SHAPES = 1024, 3
#: Labelled rows that the classifier is fitted on at most.
SAMPLE_ROWS = 8_000
#: Posterior probability below which a document is rejected.
CUT = 0.5
#: Sites count at most this many pseudo-documents of their parent as prior.
MAX_STRENGTH = 1e6
_CLASS = np.arange(256, dtype=np.uint32)
_CLASS[128:] = ord("a")
for first, last, as_ in (("a", "z", "a"), ("A", "Z", "A"), ("0", "9", "0"), ("\t", "\r", "\n")):
    _CLASS[ord(first) : ord(last) + 1] = ord(as_)


def features(texts: list[bytes]) -> np.ndarray:
    """A row per text: square roots of the trigrams' shares, then SHAPES numbers."""
    out = np.zeros((len(texts), TRIGRAMS + SHAPES))
    words, _, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    for i, (text, lo, hi) in enumerate(zip(texts, (ends - counts).tolist(), ends.tolist(), strict=True)):
        if len(text) >= 3:
            c = _CLASS[np.frombuffer(text, np.uint8)]
            code = (c[:-2] << np.uint32(16)) | (c[1:-1] << np.uint32(8)) | c[2:]
            code = (code * np.uint32(2654435761)) >> np.uint32(22)
            out[i, :TRIGRAMS] = np.sqrt(np.bincount(code, minlength=TRIGRAMS) / len(code))
        n = hi - lo
        if n:
            w = words[lo:hi]
            out[i, TRIGRAMS:] = (w[1:] == w[:-1]).sum() / n, len(np.unique(w)) / n, math.log1p(n) / 10
    return out


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, steps: int = 25) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; the last is the intercept, which is not penalised."""
    w = np.zeros(x.shape[1] + 1)
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        slope, curve = penalty * w, np.diag(penalty)
        for lo in range(0, len(x), 512):  # x may be small floats: few rows are widened at a time
            rows = np.hstack([x[lo : lo + 512].astype(float), np.ones((len(x[lo : lo + 512]), 1))])
            p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
            slope += rows.T @ (p - y[lo : lo + 512])
            curve += (rows * (p * (1 - p) + 1e-9)[:, None]).T @ rows
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def sample(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(features, labels 0 or 1) of at most sample_rows labelled documents, in the order of their ids."""
    own = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("_y"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(own), "doc_id")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in in_chunks(batches, 2, 1 << 18):
            x = features(texts).astype(np.float16)
            yield pa.RecordBatch.from_arrays([*part.columns[:2], part.column(3), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "y", "h", "x"])

    seen = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "_y", "text", F.xxhash64("text").alias("h")).mapInArrow(scan, "doc_id long, y double, h long, x binary")
    got = seen.groupBy("doc_id").agg(F.min(F.struct("h", "x", "y")).alias("m")).orderBy("doc_id").select("m.x", "m.y").collect()  # sample_rows at most
    x = np.frombuffer(b"".join(r.x for r in got), np.float16).reshape(-1, TRIGRAMS + SHAPES)
    return x, np.array([float(r.y >= 0.5) for r in got])


def fit_on(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray | None, float]:
    """The fitted weights, or None without labels of both kinds; and the share of good labels."""
    x, y = sample(docs, labels, sample_rows)
    prior = float(y.mean()) if len(y) else 0.5
    w = None if prior in (0.0, 1.0) or not len(y) else fit(x, y)
    del x
    give_back()
    return w, prior


def log_odds(texts: list[bytes], w: np.ndarray | None) -> np.ndarray:
    """The evidence of texts."""
    return np.zeros(len(texts)) if w is None else np.clip(features(texts) @ w[:-1] + w[-1], -30, 30)


def evidence(w: np.ndarray | None) -> Callable:
    """The evidence as a function of a text column; other columns stay in the JVM."""

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        let_go()
        parts = (texts.slice(i, 64).to_pylist() for i in range(0, len(texts), 64))
        out = pa.array(np.concatenate([np.zeros(0), *(log_odds([(t or "").encode("utf-8", "replace") for t in part], w) for part in parts)]))
        give_back()
        return out

    return of


def _logit(p: F.Column) -> F.Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, n: str, total: str, parent: F.Column) -> float:
    """Prior strength (pseudo-documents) of a beta prior around the parent's mean, by moments over the groups."""
    p, q = F.col(total) / F.col(n), parent
    row = groups.agg(
        F.sum(F.col(n) * (p - q) * (p - q)).alias("between"), F.sum(q * (1 - q)).alias("within"), F.sum(F.col(n) * q * (1 - q)).alias("scale"), F.count("*").alias("k")
    ).first()
    if not row["k"] or not row["scale"]:
        return MAX_STRENGTH
    # E[n (p - q)^2] = q (1 - q) + (n - 1) q (1 - q) / (strength + 1) for beta-binomial groups
    rho = max(0.0, row["between"] - row["within"]) / max(1e-12, row["scale"] - row["within"]) if row["scale"] > row["within"] else 0.0
    return MAX_STRENGTH if rho <= 1 / MAX_STRENGTH else min(MAX_STRENGTH, max(1.0, 1 / rho - 1))


def _sites(narrow: DataFrame, prior: float) -> tuple[DataFrame, float, int]:
    """(_host, _path, n, host_quality, path_quality; the global mean; number of rows) from rows of _host, _path, _e."""
    p = 1 / (1 + F.exp(-F.col("_e")))
    sites = checkpointed(narrow.select("_host", "_path", p.alias("_p")).groupBy("_host", "_path").agg(F.count("*").alias("n"), F.sum(F.round("_p", 12).cast("decimal(30,12)")).cast("double").alias("t")))
    hosts = sites.groupBy("_host").agg(F.sum("n").alias("hn"), F.sum("t").alias("ht"))
    row = hosts.agg(F.sum("hn"), F.sum("ht")).first()
    total, mean = row[0] or 0, (row[1] / row[0] if row[0] else prior)
    a = _strength(hosts, "hn", "ht", F.lit(mean))
    hosts = hosts.withColumn("host_quality", (F.col("ht") + F.lit(a * mean)) / (F.col("hn") + F.lit(a)))
    paths = checkpointed(sites.join(hosts.select("_host", "host_quality"), "_host"))
    b = _strength(paths, "n", "t", F.col("host_quality"))
    return checkpointed(paths.select("_host", "_path", "n", "host_quality", ((F.col("t") + F.lit(b) * F.col("host_quality")) / (F.col("n") + F.lit(b))).alias("path_quality"))), mean, total


def _quality(mean: float) -> F.Column:
    """Posterior probability from _e and path_quality."""
    # coalesce: else a filter on it asks before the join whether _e is null, and the function of the texts runs twice
    odds = F.coalesce("_e", F.lit(0.0)) + _logit(F.col("path_quality")) - F.lit(math.log(max(mean, 1e-6) / max(1 - mean, 1e-6)))
    return 1 / (1 + F.exp(-odds))


def _keys(host: F.Column, path: F.Column) -> list[F.Column]:
    return [F.coalesce(host.cast("string"), F.lit("\0")).alias("_host"), F.coalesce(path.cast("string"), F.lit("\0")).alias("_path")]


def _narrow(docs: DataFrame, host: str, path: str, w: np.ndarray | None) -> DataFrame:
    """_id, _host, _path, _e of every document, written once."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").alias("_id"), *_keys(F.col(f"`{host}`"), F.col(f"`{path}`")), evidence(w)(F.col("text").cast("string")).alias("_e"))
    at = new_dir(spark, "evidence")
    rows.write.parquet(at)
    return spark.read.schema(rows.schema).parquet(at)


def score(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", sample_rows: int = SAMPLE_ROWS, cut: float = CUT) -> DataFrame:
    """One row per document: doc_id, evidence, host_quality, path_quality, quality, keep."""
    w, prior = fit_on(docs, labels, sample_rows)
    rows = _narrow(docs, host, path, w)
    sites, mean, total = _sites(rows, prior)
    known = hot_join(rows, sites, ["_host", "_path"], "n", total, ["_id", "_e"])
    quality = _quality(mean)
    return known.select(F.col("_id").alias("doc_id"), F.col("_e").alias("evidence"), "host_quality", "path_quality", quality.alias("quality"), (quality >= F.lit(cut)).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", sample_rows: int = SAMPLE_ROWS, cut: float = CUT) -> DataFrame:
    """docs without the rejected ones, all columns as they were."""
    w, prior = fit_on(docs, labels, sample_rows)
    sites, mean, total = _sites(_narrow(docs, host, path, w), prior)
    rows = identified(docs)
    known = rows.df.select("*", *_keys(rows.col(host), rows.col(path)), evidence(w)(rows.col("text").cast("string")).alias("_e"))
    known = hot_join(known, sites, ["_host", "_path"], "n", total, ["_rf", "_rr"])
    return rows.restore(known.filter(_quality(mean) >= F.lit(cut)))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
