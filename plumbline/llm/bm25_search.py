"""5. Exact top-k search: inverted index with block-max WAND pruning for BM25, by shards.

1. One scan writes every document's term counts to the shared folder. Corpus statistics
   (documents, mean length, document frequencies) are counted over all of them with partial sums.
2. Queries get their terms' global weights by a join, so every shard scores alike, and go out
   in batches of some BATCH_TERMS terms (16 MB): a batch is broadcast, answered and written
   before the next one, so memory does not depend on the number of queries.
3. Each task takes its rows as shards of at most SHARD_ROWS documents and SHARD_POSTINGS
   postings, wherever they lie: nothing is shuffled. A shard is an inverted index: documents in
   the order of their length, blocks of BLOCK_ROWS neighbours, postings by term and document
   with their BM25 impact, for each term the largest impact in each block, and each document's own postings.
4. As in block-max WAND, the sum of a query's terms' block maxima bounds every score in a
   block, and only blocks are read whose bound reaches the threshold, the k-th best
   score so far (also that of the task's earlier shards). Bounds of a batch come from one matrix
   product for the frequent terms and from the postings of the others. Blocks with the largest
   bounds are scored first, from their documents' own postings, in rounds that raise the threshold; the
   documents of the rest are never read. Ties at the threshold are scored, so the k are exact.
5. The shards' k best are merged by a window with limits before and after the shuffle.

Terms are lower-case (A-Z) runs of anything but ASCII white space, known by 64-bit hashes.
A score is the sum over a document's matching terms in ascending order of their hashes, as
floats of 64 bits, so copies score alike in every shard.

Defined results: null text is empty; documents and queries without terms match nothing and
give no rows; rows that repeat an id are separate documents and separate queries, null ids
included; equal scores come in the order of doc_id, nulls first; an empty table gives an empty
result; very long texts are counted whole, one at a time; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import arrow_rows, cut, delete_dir, identified, new_dir, ship
from plumbline.llm.shingles import in_chunks, word_hashes

K1, B = 1.2, 0.75
TOP = 10
SHARD_ROWS, SHARD_POSTINGS = 8192, 4_000_000
BLOCK_ROWS = 1
#: Rows that go to Python at a time.
ARROW_ROWS = 1000
#: Terms of one batch of queries; the largest query can be above it alone.
BATCH_TERMS = 1_000_000
#: Blocks scored before the threshold prunes the rest, and how many times as many each later round scores.
FIRST_BLOCKS, MORE_BLOCKS = 10, 2
#: Queries whose bounds come from one matrix product.
PRODUCT = 512
#: Terms in at least this share of a shard's documents have their block maxima in a matrix.
DENSE = 1 / 32
#: Sums of 32-bit floats may be this much too small.
SLACK = 1 + 1e-4
_U = np.uint64
_LEAST = -(1 << 63)
VECTORS = "doc_id long, n long, terms binary, counts binary"


def term_counts(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(terms ascending, their counts) of each text."""
    words, _, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    return [np.unique(words[lo:hi], return_counts=True) for lo, hi in zip((ends - counts).tolist(), ends.tolist(), strict=True)]


def vectors_of(docs: DataFrame, *extra: str) -> DataFrame:
    """VECTORS, one row per document, after the columns named in extra."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = len(extra)
        for part, texts in in_chunks(batches, at + 1, 1 << 20):
            got = term_counts(texts)
            cols = [pa.array([int(c.sum()) for _, c in got], pa.int64()), pa.array([t.tobytes() for t, _ in got], pa.binary()), pa.array([c.astype("<u4").tobytes() for _, c in got], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(at + 1)), *cols], names=[*extra, "doc_id", "n", "terms", "counts"])

    schema = ", ".join([*(f"{c} long" for c in extra), VECTORS])
    return docs.selectExpr(*extra, "cast(doc_id as long) as doc_id", "text").mapInArrow(scan, schema)


def ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(every position of the ranges, the range of each)."""
    n = hi - lo
    own = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[own], own


class Queries:
    """A batch: terms of all queries, ascending, and each query's terms as places in them with their weights."""

    def __init__(self, terms: list[np.ndarray], weights: list[np.ndarray]):
        sizes = [len(t) for t in terms]
        self.size = len(terms)
        self.end = np.cumsum(sizes) if sizes else np.zeros(0, np.int64)
        self.terms, place = np.unique(np.concatenate(terms) if sizes else np.zeros(0, _U), return_inverse=True)
        query = np.repeat(np.arange(self.size), sizes)
        order = np.lexsort((place, query))
        self.term, self.weight = place[order], (np.concatenate(weights) if sizes else np.zeros(0))[order]

    def of(self, q: int) -> tuple[np.ndarray, np.ndarray]:
        lo = self.end[q - 1] if q else 0
        return self.term[lo : self.end[q]], self.weight[lo : self.end[q]]


class Index:
    """One shard for a batch of queries. `held` and `read` count the postings of the queries' terms and those read to score."""

    def __init__(self, lengths: np.ndarray, sizes: np.ndarray, term: np.ndarray, count: np.ndarray, mean: float, queries: Queries):
        """lengths (ascending) and sizes: words and postings of each document; term, count: the postings of all, document by document."""
        self.queries, self.size, self.mean, self.lengths = queries, len(lengths), mean, lengths
        self.blocks = -(-self.size // BLOCK_ROWS)
        self.forward = (np.concatenate([[0], np.cumsum(sizes)]), term, count)
        order = np.argsort(term, kind="stable")
        self.doc = np.repeat(np.arange(self.size, dtype=np.int32), sizes)[order]
        tf = count[order].astype(np.float32)
        del order
        self.impact = tf * np.float32(K1 + 1) / (tf + self._norm(lengths).astype(np.float32)[self.doc])
        del tf
        df = np.bincount(term, minlength=len(queries.terms))
        self.start = np.concatenate([[0], np.cumsum(df)])
        frequent = np.flatnonzero(df >= max(BLOCK_ROWS, self.size * DENSE))
        self.dense = np.full(len(df), -1, np.int32)
        self.dense[frequent] = np.arange(len(frequent))
        self.top = np.zeros((len(frequent), self.blocks), np.float32)
        for i, t in enumerate(frequent.tolist()):
            lo, hi = self.start[t], self.start[t + 1]
            block = self.doc[lo:hi] // BLOCK_ROWS
            new = np.flatnonzero(np.diff(block, prepend=-1))
            self.top[i, block[new]] = np.maximum.reduceat(self.impact[lo:hi], new) * SLACK
        self.weights = np.zeros(len(queries.terms))
        self.held = self.read = 0

    def _norm(self, lengths: np.ndarray) -> np.ndarray:
        return K1 * (1 - B + B * lengths / self.mean)

    def bounds(self, first: int, last: int) -> np.ndarray:
        """For queries from first to last a bound on the scores in each block."""
        lo = self.queries.end[first - 1] if first else 0
        term, weight = self.queries.term[lo : self.queries.end[last - 1]], self.queries.weight[lo : self.queries.end[last - 1]]
        query = np.searchsorted(self.queries.end, np.arange(lo, self.queries.end[last - 1]), "right") - first
        dense = self.dense[term]
        some = dense >= 0
        w = np.zeros((last - first, len(self.top)), np.float32)
        w[query[some], dense[some]] = weight[some]
        out = w @ self.top
        out *= np.float32(SLACK)
        rare = np.flatnonzero(~some)
        for q in range(0, last - first, 64):
            mine = rare[slice(*np.searchsorted(query[rare], [q, q + 64]))]
            rows, own = ranges(self.start[term[mine]], self.start[term[mine] + 1])
            gain = np.bincount((query[mine] - q)[own] * self.blocks + self.doc[rows] // BLOCK_ROWS, self.impact[rows] * weight[mine][own] * SLACK, 64 * self.blocks)
            out[q : q + 64] += gain.reshape(64, self.blocks)[: last - first - q]
        return out

    def search(self, q: int, bound: np.ndarray, k: int, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores): the shard's documents that score `least` or more and may be among its k best, ties included.

        Bounds are floats of 32 bits, so the threshold is lowered by SLACK; the scores are exact.
        """
        least /= SLACK
        term, weight = self.queries.of(q)
        self.held += int((self.start[term + 1] - self.start[term]).sum())
        left = np.flatnonzero((bound > 0) & (bound >= least))
        if len(left) > FIRST_BLOCKS:
            left = left[np.argpartition(-bound[left], FIRST_BLOCKS)]
        n, docs, scores = FIRST_BLOCKS, np.zeros(0, np.int64), np.zeros(0)
        self.weights[term] = weight
        while len(left):
            now = (left[:n, None] * BLOCK_ROWS + np.arange(BLOCK_ROWS)).reshape(-1)
            now = now[now < self.size]
            score = self._exact(now)
            good = np.flatnonzero((score > 0) & (score >= least))
            docs, scores = np.concatenate([docs, now[good]]), np.concatenate([scores, score[good]])
            if len(scores) >= k:
                least = max(least, float(np.partition(scores, -k)[-k]) / SLACK)
            left, n = left[n:], n * MORE_BLOCKS
            left = left[bound[left] >= least]
        self.weights[term] = 0
        kept = scores >= least
        return docs[kept], scores[kept]

    def _exact(self, docs: np.ndarray) -> np.ndarray:
        """The documents' scores by self.weights, each added up in the order of terms."""
        first, terms, counts = self.forward
        rows, own = ranges(first[docs], first[docs + 1])
        self.read += len(rows)
        tf = counts[rows].astype(float)
        gain = tf * (K1 + 1) / (tf + self._norm(self.lengths[docs])[own]) * self.weights[terms[rows]]
        ends = np.cumsum(first[docs + 1] - first[docs]).tolist()
        return np.array([np.add.reduce(gain[lo:hi]) for lo, hi in zip([0, *ends], ends, strict=False)])


Shard = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def answer(shards: Iterator[Shard], queries: Queries, mean: float, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, document's id, score) from shards (see shards_of): k rows per query and shard at most."""
    least = np.zeros((queries.size, k))  # the k best scores so far
    for ids, *postings in shards:
        index = Index(*postings, mean, queries)
        del postings
        out = []
        for first in range(0, queries.size, PRODUCT):
            last = min(first + PRODUCT, queries.size)
            bound = index.bounds(first, last)
            for q in range(first, last):
                docs, score = index.search(q, bound[q - first], k, float(least[q, 0]))
                if len(docs):
                    best = np.lexsort((ids[docs], -score))[:k]
                    docs, score = docs[best], score[best]
                    least[q] = np.sort(np.concatenate([least[q], score]))[-k:]
                    out.append((np.full(len(docs), q), ids[docs], score))
        del index
        if out:
            yield tuple(np.concatenate(c) for c in zip(*out, strict=True))


def shards_of(batches: Iterator[pa.RecordBatch], queries: Queries) -> Iterator[Shard]:
    """(ids, lengths, sizes, term, count) of shards from rows of VECTORS, shortest documents first, with the postings of the queries' terms only.

    A null id becomes the least number; term is the place among the queries' terms.
    """
    parts: list[Shard] = []
    rows = held = 0
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            part = part.filter(pa.compute.greater(part.column(1), 0))
            if part.num_rows:
                parts.append(_postings(part, queries))
                rows, held = rows + part.num_rows, held + len(parts[-1][3])
            if rows >= SHARD_ROWS or held >= SHARD_POSTINGS:
                yield _by_length(parts)
                rows = held = 0
    if parts:
        yield _by_length(parts)


def _postings(part: pa.RecordBatch, queries: Queries) -> Shard:
    terms = [np.frombuffer(x.as_buffer(), _U) for x in part.column(2)]
    every = np.concatenate(terms)
    at = np.minimum(np.searchsorted(queries.terms, every), max(0, len(queries.terms) - 1)).astype(np.int32)
    asked = queries.terms[at] == every if len(queries.terms) else np.zeros(len(every), bool)
    sizes = np.add.reduceat(asked, np.cumsum([0, *map(len, terms[:-1])]), dtype=np.int64)
    count = np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in part.column(3)])[asked]
    return part.column(0).fill_null(_LEAST).to_numpy().copy(), part.column(1).to_numpy().copy(), sizes, at[asked], count


def _by_length(parts: list[Shard]) -> Shard:
    """The parts as one shard; empties the list."""
    ids, lengths, sizes, term, count = (np.concatenate(c) for c in zip(*parts, strict=True))
    parts.clear()
    order = np.argsort(lengths, kind="stable")
    begin = (np.cumsum(sizes) - sizes)[order]
    rows = ranges(begin, begin + sizes[order])[0].astype(np.int32)
    return ids[order], lengths[order], sizes[order], term[rows], count[rows]


def weighed_queries(vectors: DataFrame, queries: DataFrame, total: int) -> DataFrame:
    """query_id, terms, weights of each row of queries that has a term of the corpus."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [np.frombuffer(x, _U) for x in batch.column(0).to_pylist()]
            terms, n = np.unique(np.concatenate(got), return_counts=True) if got else (np.zeros(0, _U), np.zeros(0, int))
            yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n.astype(np.int64))], names=["term", "n"])

    frequency = vectors.select("terms").mapInArrow(each, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                t = np.frombuffer(x["terms"], np.int64)
                if len(t):
                    head = [pa.array([x[c]] * len(t), pa.int64()) for c in ("_rf", "_rr", "doc_id")]
                    yield pa.RecordBatch.from_arrays([*head, pa.array(t), pa.array(np.frombuffer(x["counts"], "<u4").astype(np.int64))], names=["f", "r", "query_id", "term", "c"])

    rows = identified(queries.select("doc_id", "text")).select("doc_id", "text")
    wanted = vectors_of(rows, "_rf", "_rr").mapInArrow(spread, "f long, r long, query_id long, term long, c long")
    idf = F.log1p((F.lit(float(total)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    joined = wanted.join(frequency, "term").groupBy("f", "r", "query_id").agg(F.sort_array(F.collect_list(F.struct("term", (F.col("c") * idf).alias("w")))).alias("t"))
    return joined.select("f", "r", "query_id", F.col("t.term").alias("terms"), F.col("t.w").alias("weights"))


def search(docs: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """query_id, rank, doc_id, score: the k best documents of each query (columns doc_id, text)."""
    with arrow_rows(docs.sparkSession, ARROW_ROWS):  # rows of some KB each
        return _search(docs, queries, k)


def _search(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    at, out = new_dir(spark, "vectors"), new_dir(spark, "best")
    vectors_of(docs).write.parquet(at)
    vectors = spark.read.schema(VECTORS).parquet(at)
    total, mean = vectors.agg(F.count("*"), F.avg("n")).first()
    mean = mean or 1.0
    asked = cut(weighed_queries(vectors, queries, total))
    terms = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    batches = max(1, -(-terms // BATCH_TERMS))
    schema = "q long, doc_id long, score double"
    result = "query_id long, rank long, doc_id long, score double"
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    spark.createDataFrame([], result).write.parquet(out)
    for b in range(batches):
        rows = asked.filter(F.pmod(F.xxhash64("f", "r"), F.lit(batches)) == b).select("query_id", "terms", "weights").toArrow()
        if not rows.num_rows:
            continue
        listed = [(t.values.to_numpy().view(_U), w.values.to_numpy()) for t, w in zip(rows.column("terms"), rows.column("weights"), strict=True)]
        batch = spark.sparkContext.broadcast(Queries([t for t, _ in listed], [w for _, w in listed]))

        def shard(parts: Iterator[pa.RecordBatch], batch=batch) -> Iterator[pa.RecordBatch]:
            for q, ids, score in answer(shards_of(parts, batch.value), batch.value, mean, k):
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids, mask=ids == _LEAST), pa.array(score)], names=["q", "doc_id", "score"])

        # small splits go to one task, without a shuffle, so that shards are full
        best = vectors.coalesce(max(1, -(-total // SHARD_ROWS))).mapInArrow(shard, schema).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        names = spark.createDataFrame([*enumerate(rows.column("query_id").to_pylist())], "q long, query_id long")
        best = best.join(F.broadcast(names), "q")  # a row per query of the batch
        best.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", F.round("score", 6).alias("score")).write.mode("append").parquet(out)
        batch.destroy()
    delete_dir(spark, at)
    return spark.read.schema(result).parquet(out)


def op5_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose doc_id is divisible by 100 as a query, against all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return search(docs, docs.filter("doc_id % 100 = 0"))
